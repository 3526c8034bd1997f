"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks, queries into chunks; every (block, chunk) cell is one group. A
cell sorts each dimension once. A query reads all its lists in step, best entries first, scores
what it meets by random access, and stops when the sum of the list heads cannot beat its kth score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.scratch import materialize

BLOCK_ROWS, CHUNK_ROWS = 8_192, 4_096


def whole_numbers(vectors: DataFrame, id_column: str, column: str, scale: int = 1024) -> DataFrame:
    """``id`` and ``v``, each component x as floor(scale * x); vectors that are null, empty or hold null, NaN or infinity go."""
    x = F.col(column)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True))).select(
        F.col(id_column).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v")
    )


def search(ids: np.ndarray, x: np.ndarray, order: np.ndarray, query: np.ndarray, own: int, k: int):
    """Places of the best ``k`` rows of ``x`` for one query, best first, ties by smaller id; row ``own`` never."""
    n = len(ids)
    dims = np.flatnonzero(query)
    lists = [order[::-1, j] if query[j] > 0 else order[:, j] for j in dims]
    seen = ids == own
    best, score = np.zeros(0, np.int64), np.zeros(0, x.dtype)
    at, step = 0, max(4, k)
    while True:
        if len(dims):
            rows = np.unique(np.concatenate([one[at : at + step] for one in lists]))
        else:  # every score is 0
            rows = np.arange(at, min(n, at + step))
        rows = rows[~seen[rows]]
        seen[rows] = True
        best, score = np.concatenate((best, rows)), np.concatenate((score, x[rows] @ query))
        keep = np.lexsort((ids[best], -score))[:k]
        best, score = best[keep], score[keep]
        at += step
        if at >= n:
            return best, score
        bound = sum(query[j] * x[one[at - 1], j] for j, one in zip(dims, lists))
        if len(dims) and len(best) == k and score[-1] > bound:
            return best, score
        step *= 2


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """``queries`` and ``vectors`` (id, v: arrays of whole numbers) to query_id, rank (from 1), vec_id, score.

    Candidates are all vectors of the same length but those with the query's id; equal scores rank
    by smaller vec_id. Fewer than ``k`` candidates are all returned. Queries with a null id are
    left out; candidates with a null id rank last among equals. Repeated candidates rank one by
    one; a repeated query is answered once, and several vectors under one id are several queries.
    Scores are exact while they fit a signed 64-bit number.
    """
    vectors = materialize(vectors.select("id", "v", F.size("v").alias("dim")), "vectors")
    queries = queries.where("id is not null").select("id", "v", F.size("v").alias("dim")).distinct()
    queries = materialize(queries, "queries")
    blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    chunks = max(1, -(-queries.count() // CHUNK_ROWS))
    left = vectors.select(
        "dim", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "id", "v",
    )
    right = queries.select(
        "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("id", "v"), F.lit(chunks)).alias("chunk"), "id", "v", F.xxhash64("v").alias("which"),
    )

    def cell(_, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "which": [], "vec_id": [], "score": []})
        x, q = (np.array(t["v"].tolist(), np.int64) for t in (rows, asked))
        largest = int(max(abs(x).max(), 1)) * int(max(abs(q).max(), 1)) * x.shape[1]
        if largest < 2**53:  # exact in doubles, and much faster
            x, q = x.astype(float), q.astype(float)
        elif largest >= 2**63:  # single products may pass 64 bits where the sum does not
            x, q = x.astype(object), q.astype(object)
        ids = rows["id"].astype("Int64").fillna(2**63 - 1).to_numpy(np.int64)
        null = rows["id"].isna().to_numpy()
        order = np.argsort(x, axis=0, kind="stable")
        out = []
        for own, which, one in zip(asked["id"].tolist(), asked["which"].tolist(), q):
            best, score = search(ids, x, order, one, int(own), k)
            out += [(own, which, None if null[b] else int(ids[b]), int(s)) for b, s in zip(best, score)]
        return pd.DataFrame(out, columns=["query_id", "which", "vec_id", "score"]).astype({"vec_id": "Int64"})

    keys = ("dim", "block", "chunk")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        cell, "query_id long, which long, vec_id long, score long"
    )
    rank = F.row_number().over(Window.partitionBy("query_id", "which").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
