"""Compare registered queries with their DuckDB statements: python tests/oracle_check.py [prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else (0.0 if v == 0 else v)
        return v

    out = [tuple(cell(row[k]) for k in order) for row in rows]
    return [columns[k] for k in order], sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t))


def compare(df, con, sql: str, allow_empty: bool = False) -> list[str]:
    """Problems found; empty when names, types, counts and values agree."""
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    start = time.time()
    rel = con.execute(sql)
    types = {d[0]: str(d[1]) for d in rel.description}
    theirs_cols, theirs = rows_of([d[0] for d in rel.description], rel.fetchall())
    sql_time = time.time() - start
    if sql_time > 5:
        print(f"     slow SQL: {sql_time:.1f}s", flush=True)
    mine_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    mine_cols, mine = rows_of(df.columns, [tuple(x) for x in df.collect()])
    problems = []
    if mine_cols != theirs_cols:
        return [f"columns {mine_cols} != {theirs_cols}"]
    for c in mine_cols:
        if kinds.get(mine_types[c]) != types[c]:
            problems.append(f"type of {c}: {mine_types[c]} vs {types[c]}")
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} != {len(theirs)}")
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ {mine_cols}; first {bad[0][0]} vs {bad[0][1]}; {bad[-1][0]} vs {bad[-1][1]}")
    if not mine and not allow_empty:
        problems.append("empty result")
    return problems


def main(prefixes):
    import __spark_entry__ as entry
    from beadloom.session import local_session

    spark = local_session()
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problems = compare(df, con, oracles[name])
                n = ""
            else:
                n = df.count()
                problems = [] if n else ["empty result"]
        except Exception as exc:  # report and go on with the next query
            problems, n = [f"{type(exc).__name__}: {str(exc)[:1500]}"], ""
        status = "ok  " if not problems else "FAIL"
        kind = "sql" if name in oracles else f"rows={n}"
        print(f"{status} {name} [{kind}] {time.time() - start:.1f}s", *problems, sep="\n     " if problems else " ", flush=True)
        if problems:
            failed.append(name)
    print("failed:", failed or "none")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
