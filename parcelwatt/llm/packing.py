"""Variable-capacity best-fit packing of texts into sequences.

Texts are cut into pieces of at most the largest permitted length, and pieces are packed longest first: into the open bin
they fill best, else into a new bin of the size that costs least for each word it can still be filled with, counting the
words left to pack. At the end each bin shrinks to the least permitted length that holds its contents. Permitted lengths
are thus chosen together, and no word is lost: pieces of a text cover it whole.

Rows are dealt at random (by a hash of id and row position) to shards of about ``shard_words`` words, each packed by one task
in bounded memory; only the last bins of a shard can be worse than with all rows together.

Defined results: null and wordless texts have no words and get no row (nothing is lost); repeated rows are packed each on its
own; rows with a null id are packed under that null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from parcelwatt.llm.common import WORD, cut

CAPACITIES = (256, 512, 1024, 2048, 4096)
_WORD = re.compile(WORD)


def bin_cost(capacity: int) -> float:
    """Cost of a sequence: its length, a fixed part for each sequence, and a part that grows with the square (attention)."""
    return capacity + 64.0 + capacity * capacity / 16384.0


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = bin_cost):
    """(bin of each piece, offset in its bin, capacity of each bin) for lengths from 1 to the largest capacity."""
    sizes = sorted(set(capacities))
    prices = {c: cost(c) for c in sizes}
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: dict[int, list[int]] = {}  # free words -> open bins
    free_bits, filled = 0, []  # bit i: an open bin has i free words
    opened: list[int] = []
    rest = int(lengths.sum())
    for i in order.tolist():
        length = int(lengths[i])
        fits = free_bits >> length
        if fits:
            free = length + ((fits & -fits).bit_length() - 1)
            at = room[free].pop()
            if not room[free]:
                free_bits &= ~(1 << free)
        else:
            free = min((c for c in sizes if c >= length), key=lambda c: (prices[c] / min(c, rest), c))
            at = len(filled)
            filled.append(0)
            opened.append(free)
        bins[i], offsets[i] = at, filled[at]
        filled[at] += length
        rest -= length
        left = free - length
        if left:
            room.setdefault(left, []).append(at)
            free_bits |= 1 << left
    final = np.array([next(c for c in sizes if c >= f) for f in filled], np.int64)
    return bins, offsets, final


def _shards(docs: DataFrame, words: int, shard_words: int, *columns) -> DataFrame:
    shards = max(1, -(-words // shard_words))
    return docs.select(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards)).alias("shard"), "doc_id", *columns)


def _pieces(words: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, piece number, first word and length of the pieces of texts with these many words."""
    counts = -(-words // largest)
    row = np.repeat(np.arange(len(words)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, nth, nth * largest, np.minimum(words[row] - nth * largest, largest)


def assign(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, shard_words: int = 2_000_000, cost: Callable[[int], float] = bin_cost) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, n_words, bin_id (shard:bin), bin_capacity, bin_offset. Only word counts are moved."""
    largest = max(capacities)
    counted = cut(docs.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")).where("words > 0"))
    total = counted.agg(F.sum("words")).first()[0] or 0

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "words"], kind="stable")
        row, nth, first, length = _pieces(shard["words"].to_numpy(np.int64), largest)
        bins, offsets, final = best_fit(length, capacities, cost)
        prefix = f"{shard['shard'].iat[0]}:"
        return pd.DataFrame({"doc_id": shard["doc_id"].astype("Int64").to_numpy()[row], "piece": nth, "first_word": first, "n_words": length, "bin_id": [prefix + str(b) for b in bins], "bin_capacity": final[bins], "bin_offset": offsets})

    return _shards(counted, total, shard_words, "words").groupBy("shard").applyInPandas(
        pack, "doc_id long, piece long, first_word long, n_words long, bin_id string, bin_capacity long, bin_offset long")


def sequences(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, shard_words: int = 500_000, cost: Callable[[int], float] = bin_cost) -> DataFrame:
    """One row per packed sequence: bin_id, bin_capacity, n_words, doc_ids and texts of its pieces in order (a piece keeps the white space inside it)."""
    largest = max(capacities)
    counted = docs.select("doc_id", "text", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")).where("words > 0")
    total = counted.agg(F.sum("words")).first()[0] or 0

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "words"], kind="stable")
        ids, texts = shard["doc_id"].astype("Int64").to_numpy(), shard["text"].to_numpy()
        row, nth, first, length = _pieces(shard["words"].to_numpy(np.int64), largest)
        bins, _, final = best_fit(length, capacities, cost)
        spans: dict[int, list[tuple[int, int]]] = {}
        for r in np.unique(row[nth > 0]).tolist():
            spans[r] = [m.span() for m in _WORD.finditer(texts[r])]
        out = {b: ([], [], 0) for b in range(len(final))}
        for p, b in enumerate(bins.tolist()):
            text, r = texts[row[p]], int(row[p])
            if r in spans:
                text = text[spans[r][first[p]][0]:spans[r][first[p] + length[p] - 1][1]]
            held, parts, n = out[b]
            held.append(ids[r])
            parts.append(text)
            out[b] = (held, parts, n + int(length[p]))
        prefix = f"{shard['shard'].iat[0]}:"
        return pd.DataFrame({"bin_id": [prefix + str(b) for b in out], "bin_capacity": final, "n_words": [v[2] for v in out.values()], "doc_ids": [[None if pd.isna(x) else int(x) for x in v[0]] for v in out.values()], "texts": [v[1] for v in out.values()]})

    return _shards(counted, total, shard_words, "text", "words").groupBy("shard").applyInPandas(
        pack, "bin_id string, bin_capacity long, n_words long, doc_ids array<long>, texts array<string>")
