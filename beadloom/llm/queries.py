"""Registered queries of this package and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, minhash, mixing, periodic, pieces, pii, quality, spelling, substring, token_codec, topk, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(
    "op2_minhash_near_dedup",
    rf"""
    WITH RECURSIVE w AS (SELECT doc_id, {SQL_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
            ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS ss FROM w),
    e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM s),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c
               FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
    link AS (SELECT a, b FROM shared WHERE 100 * c >= 75 * (na + nb - c)),
    both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
    reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
    label AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
    SELECT s.doc_id, len(ss)::BIGINT AS n_shingles, label.c AS component_id, s.doc_id = label.c AS kept
    FROM s JOIN label ON s.doc_id = label.a
    """,
)
def op2(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_sentencepiece")
def op5(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"))


@query(
    "op6_substring_dedup",
    rf"""
    WITH w AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents),
    win AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 48, 1))) AS p, ws FROM w),
    keyed AS (SELECT doc_id, p, hash(array_to_string(ws[p:p + 49], ' ')) AS h, md5(array_to_string(ws[p:p + 49], ' ')) AS m FROM win),
    seen AS (SELECT h, m, min(doc_id) AS least FROM keyed GROUP BY h, m),
    bad AS (SELECT doc_id, p FROM keyed JOIN seen USING (h, m) WHERE doc_id > least),
    lost AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM bad),
    word AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w),
    kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY i) FILTER (WHERE lost.i IS NULL) AS t, count(lost.i) AS n_removed
             FROM word LEFT JOIN lost USING (doc_id, i) GROUP BY word.doc_id)
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
    """,
)
def op6(spark, sf_dir):
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


@query("op7_quality_rules")
def op7(spark, sf_dir):
    return quality.measures(table(spark, sf_dir, "documents"))


@query(
    "op1_exact_topk",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id,
                 coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
          FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id != c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
)
def op1(spark, sf_dir):
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, F.col("id") % 100 == 0, 10)


@query("op4_pii")
def op4(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query(
    "op8_warc",
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS sha FROM pages),
    f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha),
    d AS (SELECT p.*, f.first, list_transform(range(0, 8), lambda k: ('0x' || substr(p.sha, 1 + 5 * k, 5))::INTEGER) AS five FROM p JOIN f USING (sha))
    SELECT page_id, n AS payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((five[1 + j // 4] >> (15 - 5 * (j % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
           CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id > first THEN first END AS refers_to
    FROM d
    """,
)
def op8(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages")).drop("url")


@query("op3_source_mixing")
def op3(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query(
    "op9_line_dedup",
    r"""
    WITH p AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM documents),
    l AS (SELECT * FROM p WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    d AS (SELECT line, min((doc_id, k)) AS first, length(line) AS n FROM l GROUP BY line),
    c AS (SELECT *, n + longer AS c, (n + longer - 1) // 2 AS half FROM d, (SELECT unnest([0, 1]) AS longer) WHERE n >= 19),
    h AS (SELECT line, first, n, c, half, left(line, half) AS part, 0 AS side FROM c UNION ALL SELECT line, first, n, c, half, right(line, half), 1 FROM c),
    pair AS (SELECT DISTINCT x.line AS a, y.line AS b, x.n AS na, y.n AS nb
             FROM h x JOIN h y ON x.c = y.c AND x.side = y.side AND x.part = y.part AND x.first > y.first AND (x.n = x.c OR y.n = y.c)),
    near AS (SELECT DISTINCT a FROM pair WHERE greatest(na, nb) >= 20 AND len(list_filter(range(0, greatest(na, nb)),
               lambda i: left(a, i) = left(b, i) AND substr(a, i + 1 + (na >= nb)::INTEGER) = substr(b, i + 1 + (nb >= na)::INTEGER))) > 0),
    m AS (SELECT l.doc_id, l.k, l.line, near.a IS NOT NULL AS is_near, near.a IS NOT NULL OR (l.doc_id, l.k) > d.first AS is_gone
          FROM l JOIN d USING (line) LEFT JOIN near ON near.a = l.line),
    r AS (SELECT p.doc_id, count(m.k) AS n_lines, count_if(is_gone AND NOT is_near) AS n_equal, count_if(is_near) AS n_near,
                 string_agg(p.line, chr(10) ORDER BY p.k) FILTER (WHERE NOT coalesce(is_gone, FALSE)) AS kept
          FROM p LEFT JOIN m USING (doc_id, k) GROUP BY p.doc_id)
    SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_equal, 0)::BIGINT AS n_equal, coalesce(n_near, 0)::BIGINT AS n_near,
           CASE WHEN d.text IS NOT NULL THEN coalesce(kept, '') END AS kept_text
    FROM documents d LEFT JOIN r USING (doc_id)
    """,
)
def op9(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@query("op10_token_files")
def op10(spark, sf_dir):
    return token_codec.round_trip(table(spark, sf_dir, "documents"))


@query(
    "op11_decontamination",
    r"""
    WITH t AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS word),
    iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), up, low), word) AS ws FROM benchmark, t WHERE item_id IS NOT NULL),
    k AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM iw WHERE len(ws) > 0),
    win AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda p: array_to_string(ws[p:p + k - 1], ' '))) AS s FROM k),
    dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), word) AS ws FROM documents, t),
    sizes AS (SELECT DISTINCT k FROM win),
    place AS (SELECT doc_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda p: {'p': p, 's': array_to_string(ws[p:p + k - 1], ' ')})) AS w
           FROM dw, sizes WHERE len(ws) >= k),
    hit AS (SELECT doc_id, w.p AS p, place.k, item_id FROM place JOIN win ON win.k = place.k AND win.s = place.w.s),
    covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS i FROM hit) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
    SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def op11(spark, sf_dir):
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _planted(batches):
    """Texts in which the contract of op12 lets a stretch of words repeat to the end."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            h = zlib.crc32(str(doc_id).encode())
            own = (texts[k] or "").encode().split() if h % 10 == 0 and doc_id is not None else []
            if own:
                g, n = h // 10, len(own)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                texts[k] = b" ".join(own[:a] + [own[a + (i - a) % p] for i in range(a, n)]).decode()
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = periodic.periodic_runs(docs.mapInArrow(_planted, "doc_id long, text string"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    "op13_spelling_variants",
    r"""
    WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS tab),
    run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run FROM documents),
    per AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS hex FROM run GROUP BY doc_id, run),
    summed AS (SELECT run, n, xor(list_reduce(list_transform(range(0, length(hex) // 2), lambda k: ('0x' || substr(hex, 2 * k + 1, 2))::BIGINT),
                 lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) AS h FROM per, tab),
    result AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
    word AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM result WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    place AS (SELECT word, n, unnest(range(length(word))) AS i FROM word),
    skip AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS s FROM place),
    near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM skip a JOIN skip b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
             UNION SELECT a.word, b.word, b.n FROM skip a JOIN word b ON a.s = b.word
             UNION SELECT b.word, a.word, a.n FROM skip a JOIN word b ON a.s = b.word),
    best AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY word),
    first AS (SELECT near.word, min(near) AS form FROM near JOIN best ON near.word = best.word AND near_n = most GROUP BY near.word),
    formed AS MATERIALIZED (SELECT word.word, CASE WHEN most >= 10 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN most END AS form_n
               FROM word LEFT JOIN best USING (word) LEFT JOIN first USING (word)),
    path(word, tip, form) AS (SELECT word, word, form FROM formed UNION ALL SELECT p.word, f.word, f.form FROM path p JOIN formed f ON p.form = f.word)
    SELECT formed.word, formed.form, path.tip AS root, n, n_near, form_n FROM formed JOIN path ON path.word = formed.word AND path.form IS NULL
    """,
)
def op13(spark, sf_dir):
    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents"), misspell=spelling.drop_letter))
