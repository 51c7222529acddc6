"""SimHash near-duplicates through BK-trees.

A fingerprint has 64 bits; bit i is 1 if it is set in over half of the XXH64 (seed 42) hashes of the text's word
shingles. Equal fingerprints are collapsed first, so a group of copies is one fingerprint whatever its size. Two
fingerprints within ``radius`` agree on at least one of ``radius + 1`` bit blocks, so each fingerprint belongs to that many
blocks and every linked pair shares one. Blocks are gathered into shards of bounded size; a task builds the BK-trees of its
shard (one tree per block: a child hangs at its Hamming distance from the parent) and follows only edges within the radius
of the query. A block too large for a shard is divided into slices: one task per pair of slices searches the trees of the
one with the queries of the other, so no pair is lost and no task grows with the block.

Shard trees meet their queries by shuffle: broadcasting all of them would take every fingerprint through the driver.

Defined results: a null or wordless text has fingerprint zero and links like any other; repeated rows are kept, one
result row per input row; rows with a null id take part, and a component's id is its smallest non-null id (null if it has
none); an empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from parcelwatt.llm.common import WORD, components, counted_broadcast, cut, free_name, text_chunks

_WORDS = re.compile(WORD)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of one text."""
    words = _WORDS.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    if len(words) > shingle:
        parts = map(" ".join, zip(*(words[i:] for i in range(shingle))))
    else:
        parts = [" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), 42) for p in parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: str, shingle: int = 3) -> Column:
    """The fingerprint as a signed long."""
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        found = [fingerprint(t, shingle) for _, run in text_chunks(texts) for t in run]
        return pd.Series(np.array(found, np.uint64).view(np.int64))

    return prints(F.col(text))


class Forest:
    """BK-trees over ``values`` (uint64), one per distinct ``block``; the first value of a block is its root."""

    def __init__(self, values: np.ndarray, blocks: np.ndarray):
        self.values = values
        self.blocks, first, block = np.unique(blocks, return_index=True, return_inverse=True)
        self.roots = first
        self.child = np.full((len(values), 65), -1, np.int32)
        at = first[block]
        waiting = np.flatnonzero(at != np.arange(len(values)))
        at = at[waiting]
        while len(waiting):
            edge = at * 65 + np.bitwise_count(values[waiting] ^ values[at]).astype(np.int64)
            taken, newest = np.unique(edge, return_index=True)
            free = self.child.ravel()[taken] < 0
            self.child.ravel()[taken[free]] = waiting[newest[free]]
            at = self.child.ravel()[edge]
            moved = at != waiting
            waiting, at = waiting[moved], at[moved]

    def search(self, values: np.ndarray, blocks: np.ndarray, radius: int, many: int = 128):
        """Yields (query index, node index) arrays of the pairs within ``radius`` in the query's block."""
        root = np.searchsorted(self.blocks, blocks)
        root[root == len(self.blocks)] = 0
        known = np.flatnonzero(self.blocks[root] == blocks) if len(self.blocks) else np.zeros(0, np.int64)
        for start in range(0, len(known), many):
            query = known[start:start + many]
            node = self.roots[root[query]]
            while len(query):
                far = np.bitwise_count(values[query] ^ self.values[node]).astype(np.int64)
                near = far <= radius
                if near.any():
                    yield query[near], node[near]
                edges = far[:, None] + np.arange(-radius, radius + 1)
                below = np.where((edges >= 0) & (edges <= 64), self.child[node[:, None], edges.clip(0, 64)], -1)
                row, col = np.nonzero(below >= 0)
                query, node = query[row], below[row, col].astype(np.int64)


def _forest_edges(size: int, left, right) -> np.ndarray:
    """A spanning forest of the links among ``size`` items: (item, smallest item of its group) where they differ."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    rest = np.flatnonzero(label != np.arange(size))
    return np.stack([rest, label[rest]], axis=1)


def shard_links(shard: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links of one shard as a spanning forest; part 0 rows are in the trees, part 1 rows only search (part 0 alone searches itself)."""
    values, blocks, part = shard["f"].to_numpy(np.int64).view(np.uint64), shard["block"].to_numpy(np.int64), shard["part"].to_numpy()
    inside, queries = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
    own = shard["cell_a"].iat[0] == shard["cell_b"].iat[0]
    queries = inside if own else queries
    trees = Forest(values[inside], blocks[inside])
    left, right, held = [], [], 0
    edges: list[np.ndarray] = []
    for q, n in trees.search(values[queries], blocks[queries], radius):
        a, b = queries[q], inside[n]
        keep = a != b
        left.append(a[keep])
        right.append(b[keep])
        held += int(keep.sum())
        if held > 2_000_000:
            edges = [_forest_edges(len(values), *map(np.concatenate, ([*left, *(e[:, 0] for e in edges)], [*right, *(e[:, 1] for e in edges)])))]
            left, right, held = [], [], 0
    if left or edges:
        found = _forest_edges(len(values), *map(np.concatenate, ([*left, *(e[:, 0] for e in edges)], [*right, *(e[:, 1] for e in edges)])))
    else:
        found = np.zeros((0, 2), np.int64)
    signed = values.view(np.int64)
    return pd.DataFrame({"a": signed[found[:, 0]], "b": signed[found[:, 1]]})


def links(prints: DataFrame, radius: int = 2, shard_rows: int = 8192) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints ``f`` within ``radius``; every linked pair is connected by them."""
    count = radius + 1
    bounds = [64 * i // count for i in range(count + 1)]
    blocks = [
        F.xxhash64(F.lit(i), F.shiftrightunsigned("f", bounds[i]).bitwiseAND(F.lit((1 << (bounds[i + 1] - bounds[i])) - 1)))
        for i in range(count)
    ]
    keyed = prints.select("f", F.explode(F.array(*blocks)).alias("block"))
    sizes = cut(keyed.groupBy("block").count().where("count > 1"))
    shards = max(1, -(-count * prints.count() // shard_rows))
    hot = counted_broadcast(sizes.where(F.col("count") > shard_rows).select("block", F.ceil(F.col("count") / shard_rows).alias("slices")))
    shared = keyed.join(sizes.select("block"), "block", "left_semi").join(hot, "block", "left")
    normal = shared.where("slices IS NULL").select(
        F.pmod("block", F.lit(shards)).alias("shard"), F.lit(0).alias("cell_a"), F.lit(0).alias("cell_b"), F.lit(0).alias("part"), "block", "f")
    sliced = shared.where("slices IS NOT NULL").withColumn("slice", F.pmod(F.xxhash64("f"), F.col("slices")).cast("int"))
    # a slice sits in the trees of every later slice's task, and searches the trees of every earlier one
    trees = sliced.withColumn("other", F.explode(F.expr("sequence(slice, CAST(slices AS INT) - 1)"))).select(
        F.col("block").alias("shard"), F.col("slice").alias("cell_a"), F.col("other").alias("cell_b"), F.lit(0).alias("part"), "block", "f")
    search = sliced.where("slice > 0").withColumn("other", F.explode(F.expr("sequence(0, slice - 1)"))).select(
        F.col("block").alias("shard"), F.col("other").alias("cell_a"), F.col("slice").alias("cell_b"), F.lit(1).alias("part"), "block", "f")
    cells = normal.unionByName(trees).unionByName(search)

    def task(shard: pd.DataFrame) -> pd.DataFrame:
        return shard_links(shard, radius)

    return cells.groupBy("shard", "cell_a", "cell_b").applyInPandas(task, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, shard_rows: int = 8192) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text)."""
    marked = cut(docs.select("doc_id", fingerprint_column("text", shingle).alias("f")))
    distinct = cut(marked.groupBy("f").agg(F.min("doc_id").alias("first")))
    grouped = components(links(distinct.select("f"), radius, shard_rows)).withColumnRenamed("v", "f")
    rooted = distinct.join(grouped, "f", "left").withColumn("root", F.coalesce("root", "f"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(lowest, "root").select("f", "component_id")
    return marked.join(known, "f").select(
        "doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = 3, radius: int = 2, shard_rows: int = 8192) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of smallest id (nulls last, then smallest source,
    language and text), all columns kept."""
    f, root = free_name(docs, "_f"), free_name(docs, "_root")
    keys = [c for c in ("doc_id", "source", "lang") if c in docs.columns]
    # a row is known by its keys and the hash of its text; equal rows are equal, so any one of them will do
    key = F.struct(*(c for k in keys for c in (F.col(k).isNull(), F.col(k))), F.xxhash64("text"))
    slim = cut(docs.select(fingerprint_column("text", shingle).alias("f"), key.alias("k")))
    distinct = cut(slim.groupBy("f").agg(F.min("k").alias("k")))
    grouped = components(links(distinct.select("f"), radius, shard_rows)).withColumnRenamed("v", "f")
    first = distinct.join(grouped, "f", "left").groupBy(F.coalesce("root", "f").alias("root")).agg(F.min("k").alias("k"))
    kept = first.select(F.col("k").alias(root), F.xxhash64("k").alias(f))
    marked = docs.withColumn(root + "k", key).withColumn(f + "k", F.xxhash64(F.col(root + "k")))
    chosen = marked.join(kept, (F.col(f + "k") == F.col(f)) & (F.col(root + "k") == F.col(root)), "left_semi")
    # rows equal in all of the key come through together; one of them stays
    return chosen.dropDuplicates([f + "k", root + "k"]).select(*docs.columns)
