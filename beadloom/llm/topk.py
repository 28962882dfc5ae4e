"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integers: (term, weight) for every non-zero component. Queries and candidates are
dealt into groups by a hash, and every query group meets every candidate group in one cell of a grid. A
cell turns its candidates into postings (per term: which candidates, which weights) and, a block of queries
at a time, scatters query weight times posting weight into a dense array of scores, term after term. The k
best of each row are picked by partition selection, and the cells' lists are merged by rank.

The grid is the stated query set against all rows in blocks: the work is queries times candidates by
definition, each cell is bounded by ``QUERY_GROUP`` and ``CANDIDATE_GROUP`` rows, and nothing is dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_GROUP, CANDIDATE_GROUP, QUERY_BLOCK = 4096, 32_768, 64
SCORES = 4 << 20


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(id, v): component x becomes floor(scale * x); vectors null or with null or non-finite components are left out."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.where(fine).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))


def _postings(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms in ascending order with the rows and weights of their non-zero components."""
    size = np.array([len(v) for v in vectors])
    row = np.repeat(np.arange(len(vectors)), size)
    term = np.concatenate([np.arange(n) for n in size]) if len(size) else np.zeros(0, np.int64)
    weight = np.concatenate(vectors).astype(np.int64) if len(size) else np.zeros(0, np.int64)
    keep = np.flatnonzero(weight)
    order = keep[np.argsort(term[keep], kind="stable")]
    return term[order], row[order], weight[order]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest values, ties to the front, best first."""
    n = len(scores)
    if n > k:
        limit = np.partition(scores, n - k)[n - k]
        above = np.flatnonzero(scores > limit)
        at = np.sort(np.concatenate([above, np.flatnonzero(scores == limit)[: k - len(above)]]))
    else:
        at = np.arange(n)
    return at[np.argsort(-scores[at], kind="stable")]


def _cell(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "query_key": [], "vec_id": [], "score": []}
        candidates = candidates.sort_values("id", kind="stable")
        ids = candidates["id"].to_numpy(np.int64)
        n = len(ids)
        terms, rows, weights = _postings(candidates["v"].tolist())
        dims = int(terms[-1]) + 1 if len(terms) else 0
        begin = np.searchsorted(terms, np.arange(dims + 1))
        block = max(1, min(QUERY_BLOCK, SCORES // max(n, 1)))
        for lo in range(0, len(queries) if n else 0, block):
            part = queries.iloc[lo : lo + block]
            q_terms, q_rows, q_weights = _postings(part["v"].tolist())
            q_begin = np.searchsorted(q_terms, np.arange(dims + 1))
            scores = np.zeros((len(part), n), np.int64)
            for t in range(dims):
                mine, theirs = slice(q_begin[t], q_begin[t + 1]), slice(begin[t], begin[t + 1])
                if mine.stop > mine.start and theirs.stop > theirs.start:
                    add = q_weights[mine, None] * weights[None, theirs]
                    if theirs.stop - theirs.start == n:
                        scores[q_rows[mine]] += add
                    else:
                        scores[np.ix_(q_rows[mine], rows[theirs])] += add
            for r, (query, key) in enumerate(zip(part["id"], part["key"], strict=True)):
                others = np.flatnonzero(ids != query)
                at = others[_best(scores[r, others], k)]
                out["query_id"] += [query] * len(at)
                out["query_key"] += [key] * len(at)
                out["vec_id"] += ids[at].tolist()
                out["score"] += scores[r, at].tolist()
        return pd.DataFrame(out).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (id long, v array<long>) where ``is_query`` holds, its k best others.

    Score: inner product over the components both have; fewer candidates than k give fewer rows, ties go to
    the smaller id. Candidates are all rows but those with the query's own id; a candidate that is repeated
    is listed as often. A query row that is repeated counts once; different vectors of one query id are
    ranked apart. Rows with a null id or vector take no part, an empty vector scores 0, an empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    vectors = vectors.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v")
    queries = vectors.where(is_query).distinct().withColumn("key", F.xxhash64("v"))
    n_candidates, n_queries = vectors.count(), queries.count()
    spread = min(spark.sparkContext.defaultParallelism, -(-n_candidates // 2048))
    groups = max(1, spread, -(-n_candidates // CANDIDATE_GROUP))
    query_groups = max(1, -(-n_queries // QUERY_GROUP))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("q", F.pmod(F.xxhash64("id", "v"), F.lit(query_groups)).cast("int")).withColumn("c", every(groups))
    right = vectors.withColumn("c", F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int")).withColumn("q", every(query_groups))
    best = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(_cell(k), "query_id long, query_key long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
