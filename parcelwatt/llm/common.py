"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelwatt.session import cut

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def counted_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it was counted to hold at most ``rows`` rows, else left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_chunks(texts: pd.Series, chars: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """Whole texts in runs of about ``chars`` characters (one text at least), each with the index of its first text; null is empty."""
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        text = text if isinstance(text, str) else ""
        if run and size + len(text) > chars:
            yield start, run
            start, size, run = i, 0, []
        run.append(text)
        size += len(text)
    if run:
        yield start, run


LOCAL_PAIRS = 250_000  # edges one task takes when so few are left


def joined(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, smallest vertex reachable from each) of the edges left - right."""
    names, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[:len(left)], at[len(left):]
    label = np.arange(len(names))
    while len(a):
        low = np.minimum(label[a], label[b])
        # the roots of both ends take the lower label, then every vertex that of its root
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return names, names[label]


def components(edges: DataFrame, a: str = "a", b: str = "b", local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """(v, root) for every vertex of the edges, which are whole numbers: root is the smallest vertex reachable.

    Rounds of contraction: a vertex moves to its neighbour (or itself) of smallest random priority; edges are rewritten and
    made distinct, so their number falls by a constant factor whatever the shape of the graph. The minima are partial aggregates, and
    the vertex table of each round has one row per vertex, so a hub only meets other rows in joins that adaptive
    execution can split. Once at most ``local_pairs`` edges are left, one task joins them; a few links take that step alone. Each round is
    a reliable checkpoint.
    """
    pairs = cut(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    maps: list[DataFrame] = []
    while pairs.count() > local_pairs:
        priority = F.struct(F.xxhash64("u", F.lit(len(maps))).alias("h"), F.col("u"))
        ends = F.explode(F.array(*(F.struct(F.col(v).alias("v"), F.col(u).alias("u")) for v in "ab" for u in "ab"))).alias("e")
        moved = cut(pairs.select(ends).select("e.*").groupBy("v").agg(F.min(priority)["u"].alias("p")))
        maps.append(moved)
        pairs = cut(
            pairs.join(moved.selectExpr("v AS a", "p AS pa"), "a").join(moved.selectExpr("v AS b", "p AS pb"), "b")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a < b").distinct())

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype="int64"), *batches])
        v, root = joined(held["a"].to_numpy(), held["b"].to_numpy())
        yield pd.DataFrame({"v": v, "p": root})

    label = cut(pairs.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInPandas(rest, "v long, p long"))
    if not maps:
        return label.select("v", F.col("p").alias("root"))
    # cut at every step: the optimizer's time and memory grow steeply with a chain of outer joins
    for earlier in reversed(maps):
        label = cut(earlier.alias("x").join(label.alias("y"), F.col("x.p") == F.col("y.v"), "left").select(
            "x.v", F.coalesce("y.p", "x.p").alias("p")))
    lowest = label.groupBy("p").agg(F.min("v").alias("root"))
    return label.join(lowest, "p").select("v", "root")
