"""Exact top-k by inner product through a pivot table.

Every vector has its distances to a few pivots computed once. For a query q and a candidate x the triangle inequality bounds
their distance from below by the largest |d(q, p) - d(x, p)| over the pivots, and so the inner product from above by
(|q|^2 + |x|^2 - bound^2) / 2. Candidates are evaluated in order of that bound until the k-th best score so far is above all
bounds left: the answer is exact.

Rows are sorted by their nearest pivot and the distance to it and cut into blocks, each with the least and greatest distance of
its rows to every pivot. A query is first answered in its own block; its k-th score there decides, by the same bound taken over
a whole block, which other blocks it must visit. A task holds one block and some of the queries that visit it; bounds are
matrices over queries and candidates, and a window over at most k rows a block and query merges the answers. Pivots come from a
bounded sample (``sample_rows``) by farthest-first choice; they decide how much is skipped, never the answer. Vectors without
clusters have weak bounds: then most queries visit most blocks, and the work grows with queries times rows.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of unequal length are
filled with zeros (an empty one scores 0 with all); rows with a null id take no part, since they cannot be told from a
query's own row; repeated rows are candidates each on its own, except for queries of their own id, and a query
that occurs several times is answered once, for its smallest vector; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelwatt.llm.common import cut
from parcelwatt.llm.vectors import hash_sample, matrix, spread, usable, widened


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(vectors.shape[1], pivots.shape[1])
    vectors, pivots = widened(vectors, width), widened(pivots, width)
    square = (vectors ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def upper_bounds(distances: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Greatest inner product each query (rows) can have with rows whose pivot distances lie in low..high and whose squared length is at most norms."""
    gap = np.zeros((len(distances), len(low)))
    for p in range(distances.shape[1]):
        to = distances[:, p, None]
        np.maximum(gap, low[None, :, p] - to, out=gap)
        np.maximum(gap, to - high[None, :, p], out=gap)
    total = sizes[:, None] + norms[None, :]
    # rounding of the square roots must never put a bound below a true score
    return (total - gap ** 2) / 2 + 1e-6 * (1.0 + total)


def best_of(query: np.ndarray, upper: np.ndarray, vectors: np.ndarray, ids: np.ndarray, own: int, floor: float, k: int, step: int = 128):
    """Rows and scores of the k best candidates of one query, by score and then id, none below ``floor``, and how many were evaluated."""
    alive = np.flatnonzero((upper >= floor) & (ids != own))
    order = alive[np.argsort(-upper[alive], kind="stable")]
    rows, scores, done = np.zeros(0, np.int64), np.zeros(0), 0
    while done < len(order):
        if len(rows) >= k and scores[-1] > upper[order[done]]:
            break
        new = order[done:done + step]
        done += len(new)
        step *= 2
        found = vectors[new] @ query
        kept = found >= (max(floor, scores[-1]) if len(rows) >= k else floor)
        rows, scores = np.append(rows, new[kept]), np.append(scores, found[kept])
        best = np.lexsort((ids[rows], -scores))[:k]
        rows, scores = rows[best], scores[best]
    return rows, scores, done


FOUND = "query_id long, vec_id long, score double, seen long, among long"


def _searched(k: int, batch: int = 256):
    """Task over one block and queries that visit it: their best rows, and a row without vec_id for each query with its counts."""
    def task(cell: pd.DataFrame) -> pd.DataFrame:
        asks = cell["asks"].to_numpy(bool)
        every, distances, names = matrix(cell["v"]), matrix(cell["d"]), cell["id"].to_numpy(np.int64)
        x, t, ids = every[~asks], distances[~asks], names[~asks]
        norms, where = (x ** 2).sum(axis=1), np.flatnonzero(asks)
        floors = np.nan_to_num(cell["floor"].to_numpy(np.float64), nan=-np.inf)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        seen = np.zeros(len(where), np.int64)
        for start in range(0, len(where), batch):
            now = where[start:start + batch]
            upper = upper_bounds(distances[now], (every[now] ** 2).sum(axis=1), t, t, norms)
            for i, row in enumerate(now):
                rows, scores, seen[start + i] = best_of(every[row], upper[i], x, ids, names[row], floors[row], k)
                parts.append((np.full(len(rows), names[row]), ids[rows], scores))
        query, vec, score = map(np.concatenate, zip(*parts))
        found = pd.DataFrame({"query_id": query, "vec_id": pd.array(vec, "Int64"), "score": score, "seen": 0, "among": 0})
        counts = pd.DataFrame({"query_id": names[where], "vec_id": pd.array([None] * len(where), "Int64"), "score": np.nan, "seen": seen, "among": len(x)})
        return pd.concat([found, counts])

    return task


def _visits(cell: pd.DataFrame) -> pd.DataFrame:
    """The queries of a cell, once for each block of the cell (rows without floor) whose bound reaches their floor, but for their own."""
    block = cell["low"].notna().to_numpy()
    asks, blocks = cell[~block], cell[block]
    columns = ["id", "v", "d", "floor", "block"]
    if not len(asks) or not len(blocks):
        return asks[columns].iloc[:0]
    vectors = matrix(asks["v"])
    upper = upper_bounds(matrix(asks["d"]), (vectors ** 2).sum(axis=1), matrix(blocks["low"]), matrix(blocks["high"]), blocks["norm"].to_numpy(np.float64))
    floors = np.nan_to_num(asks["floor"].to_numpy(np.float64), nan=-np.inf)
    names = blocks["block"].to_numpy(np.int64)
    query, at = np.nonzero((upper >= floors[:, None]) & (names[None, :] != asks["block"].to_numpy(np.int64)[:, None]))
    return asks.iloc[query].assign(block=names[at])[columns]


def top_k(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", pivots: int = 32, sample_rows: int = 2000, block_rows: int = 4096, query_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score, evaluated, candidates: the k best of all rows for each row where ``queries`` holds.

    evaluated counts the exact products computed for the query, candidates the rows of the blocks it visited.
    """
    whole = vectors.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("asks"))
    whole = cut(whole)
    total, asked = whole.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    chosen = spread(hash_sample(whole, "id", "v", sample_rows), pivots)

    def tabled(batches):
        for batch in batches:
            found = pivot_distances(matrix(batch["v"]), chosen) if len(batch) else np.zeros((0, max(1, len(chosen))))
            batch["d"], batch["near"], batch["dist"] = list(found), found.argmin(axis=1), found.min(axis=1)
            batch["norm"] = [float(np.dot(v, v)) for v in batch["v"]]
            yield batch

    blocks, parts = max(1, -(-total // block_rows)), max(1, -(-asked // query_rows))
    table = whole.mapInPandas(tabled, "id long, v array<double>, asks boolean, d array<double>, near int, dist double, norm double")
    table = table.repartitionByRange(blocks, "near", "dist", F.xxhash64("id", F.hash("v")))
    table = cut(table.select("id", "v", "asks", "d", "norm", F.spark_partition_id().cast("long").alias("block")))
    ends = [f(*(g(F.element_at("d", p + 1)) for p in range(len(chosen)))).alias(name) for f, g, name in ((F.array, F.min, "low"), (F.array, F.max, "high"))]
    shapes = table.groupBy("block").agg(*ends, F.max("norm").alias("norm"))
    asking = table.where("asks").groupBy("id").agg(F.min(F.struct("v", "d", "block")).alias("m")).select("id", "m.*")
    rows = table.select("id", "v", "d", "block", F.lit(False).alias("asks"), F.lit(None).cast("double").alias("floor"))

    own = rows.unionByName(asking.select("*", F.lit(True).alias("asks"), F.lit(None).cast("double").alias("floor")))
    own = cut(own.groupBy("block").applyInPandas(_searched(k), FOUND))
    floors = own.where("vec_id IS NOT NULL").groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))

    # shapes of 4096 blocks meet one part of the queries at a time
    group, part = 4096, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
    shaped = shapes.select("block", "low", "high", "norm", F.floor(F.col("block") / group).cast("long").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    put = asking.join(floors, "id", "left").select("*", part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit((blocks - 1) // group).cast("long"))).alias("group"))
    visits = put.unionByName(shaped, allowMissingColumns=True).groupBy("group", "part").applyInPandas(_visits, "id long, v array<double>, d array<double>, floor double, block long")
    visits = cut(visits.select("*", part, F.lit(True).alias("asks")))
    visited = rows.join(visits.select("block", "part").distinct(), "block").unionByName(visits)
    others = visited.groupBy("block", "part").applyInPandas(_searched(k), FOUND)

    each = Window.partitionBy("query_id")
    ranked = own.unionByName(others).select(
        "*", F.row_number().over(each.orderBy(F.col("vec_id").isNull(), F.desc("score"), "vec_id")).alias("rank"),
        F.sum("seen").over(each).alias("evaluated"), F.sum("among").over(each).alias("candidates"))
    return ranked.where((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "evaluated", "candidates")
