"""Registry of queries and their DuckDB counterparts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixtures import SQL_FIXTURES, Inputs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType)


def _plain_types(df: DataFrame) -> DataFrame:
    """bigint/double/string/boolean columns only, so both engines agree on types."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, _INTEGRAL):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        out.append(c.alias(field.name))
    return df.select(*out)


def with_fixtures(sql: str) -> str:
    """Prepend the derived tables (``fx_*``) a statement mentions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(set(re.findall(r"\bfx_\w+", text))):
            if name in SQL_FIXTURES and name not in needed:
                visit(SQL_FIXTURES[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({SQL_FIXTURES[n].strip()})" for n in needed)
    body = sql.strip()
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if match:
        return f"WITH {match.group(1) or ''}{ctes},\n{body[match.end():]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark, sf_dir):
            return _plain_types(fn(Inputs(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return fn

    return register


def r(c, digits: int = 6):
    """Rounded double; the SQL side writes round(x, digits)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)
