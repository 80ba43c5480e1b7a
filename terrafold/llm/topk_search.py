"""Exact top-k inner products by columnar branch and bound.

Vectors become integer components and are dealt into blocks by a hash of their id,
by dimension. A block of candidates meets a block of queries in one task, where
the candidates lie dimension by dimension (vertical layout). Scores accumulate over
blocks of dimensions; after each, the mass that is left in query and candidates
bounds every score from both sides, and candidates below the k-th lower bound
are compacted away. Each meeting returns its k best per query; a window over those
gives the final ranks.

Blocks bound the memory of a task. All candidates are read for every block of
queries, which a search over all pairs of a stated query set needs; nothing is
broadcast and no rows are paired in the plan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

SCALE = 256
CANDIDATES = 8192
QUERIES = 2048
DIMENSIONS = 8


def integer_vectors(df: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, dims, v``: components as floor(scale * x).

    Rows with a null id, a null vector or a null or non-finite component take no
    part. Rows that share an id are one row, the least of their vectors.
    Components beyond 64 bits are cut to the nearest long.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).filter(~odd)
    rows = rows.groupBy("vec_id").agg(F.min(F.transform("x", lambda c: F.floor(c * F.lit(float(scale))))).alias("v"))
    return rows.select("vec_id", F.size("v").alias("dims"), "v")


def best_of_block(query: np.ndarray, columns: np.ndarray, rests: list[np.ndarray], own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the candidates that may be among the ``k`` best, best bounds first settled.

    ``columns[d, c]`` is component ``d`` of candidate ``c``; ``rests[i][c]`` the norm of its
    components from dimension ``i * DIMENSIONS`` on. ``own`` is the place of the query itself (-1: absent).
    """
    dims, n = columns.shape
    alive = np.arange(n) if own < 0 else np.delete(np.arange(n), own)
    sums = np.zeros(len(alive), dtype=columns.dtype)
    for i, at in enumerate(range(0, dims, DIMENSIONS)):
        part = columns[at : at + DIMENSIONS]
        sums += query[at : at + DIMENSIONS] @ (part if len(alive) == n else part[:, alive])
        if len(alive) <= k:
            continue
        rest = np.sqrt(np.dot(query[at + DIMENSIONS :], query[at + DIMENSIONS :].astype(float))) * rests[i + 1][alive]
        rest = rest * (1 + 1e-9) + 1e-6
        least = sums - rest
        bar = np.partition(least, len(least) - k)[len(least) - k]
        stay = sums + rest >= bar
        if stay.mean() < 0.8:
            alive, sums = alive[stay], sums[stay]
    return alive, sums


def search_block(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The ``k`` best candidates of each query within one meeting: ``query_id, vec_id, score``."""
    ids, asked = candidates["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(ids) and len(asked):
        order = np.argsort(ids)
        ids = ids[order]
        flat = lambda t, n: t["v"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        mine, theirs = flat(queries, len(asked)), flat(candidates, len(ids))[order]
        largest = float(np.abs(mine).max(initial=0)) * float(np.abs(theirs).max(initial=0)) * max(1, mine.shape[1])
        exact = largest < 2.0**52  # then floating point adds integers exactly
        if exact:
            mine, theirs = mine.astype(np.float64), theirs.astype(np.float64)
        columns = np.ascontiguousarray(theirs.T)
        mass = np.cumsum((columns.astype(np.float64) ** 2)[::-1], axis=0)[::-1]
        edges = range(0, columns.shape[0], DIMENSIONS)
        rests = [np.sqrt(mass[at]) for at in edges] + [np.zeros(len(ids))]
        at = np.searchsorted(ids, asked)
        for q, (query_id, place) in enumerate(zip(asked, at)):
            own = int(place) if place < len(ids) and ids[place] == query_id else -1
            if exact:
                alive, score = best_of_block(mine[q], columns, rests, own, k)
            else:  # 64-bit integers, whose overflow wraps as in the JVM
                alive = np.delete(np.arange(len(ids)), own) if own >= 0 else np.arange(len(ids))
                score = mine[q] @ columns[:, alive]
            top = np.lexsort((ids[alive], -score))[:k]
            found.append((np.full(len(top), query_id), ids[alive[top]], score[top].astype(np.int64)))
    empty = np.empty(0, dtype=np.int64)
    parts = [np.concatenate([empty, *(f[i] for f in found)]) for i in range(3)]
    return pa.table(parts, names=["query_id", "vec_id", "score"])


def top_k(df: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest scores of every query row, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``. Candidates are all other rows with as many
    components; a query with fewer candidates than ``k`` gets all, one without any gets none.
    """
    rows = integer_vectors(df, vec_id, vector, scale)
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    n_blocks, q_blocks = -(-n // CANDIDATES) or 1, -(-n_queries // QUERIES) or 1
    deal = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    candidates = rows.withColumns({"c": deal(n_blocks)}).withColumn("q", every(q_blocks))
    queries = rows.filter(is_query).withColumns({"q": deal(q_blocks)}).withColumn("c", every(n_blocks))
    met = candidates.groupBy("dims", "c", "q").cogroup(queries.groupBy("dims", "c", "q"))
    found = met.applyInArrow(lambda left, right: search_block(left, right, k), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
