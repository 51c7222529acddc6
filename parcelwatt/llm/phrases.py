"""Phrase collocation mining: Misra-Gries summaries find every frequent n-gram, a second pass counts them exactly.

Texts are lower-cased (A-Z only) and split into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. All n-grams of 1 to
``longest`` words within a piece are counted per language, overlaps included.

First pass. An n-gram is hashed to a partition and a 32-bit key in it. A task counts a run of texts and sends each
partition its keys and counts. A partition keeps a Misra-Gries summary: as many counters as its mass divided by the threshold,
and one more; when there are more keys, the greatest count beyond the capacity is taken from all of them and those at or below
zero go. What was taken in all is below the threshold, so every n-gram that reaches the threshold keeps a counter; survivors are those
whose counter and the amount taken still reach it. Summaries merge the same way in any order, so a lost task is only repeated.
Survivors mark a bit each in a filter of fixed size, so its broadcast is bounded whatever the input; a full filter only lets more
n-grams into the second pass.

Second pass. Tasks count the n-grams that pass the filter by their words, not by hash, and Spark adds the counts by language and
phrase. Those below the threshold go: nothing of the first pass enters a count. As parts of a phrase are at least as
frequent as the phrase, all counts that scores need are there.

A word that is everywhere costs a run of texts one entry, so hot words, phrases and languages are one row a run and
partition. Runs hold about ``RUN_WORDS`` words, and one text at least.

Defined results: a null text is empty; a null language is ``und``, together with rows of that language; empty texts and pieces
have no n-gram; texts of any length are counted whole; repeated rows count again; ties are broken as stated in ``collocations``; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelwatt.llm.common import cut

SPLIT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")
RUN_WORDS = 400_000
PARTITION_CHARS = 8_000_000  # characters of text a hash partition stands for
FILTER_BITS = 27
CHUNK = "part long, mass long, keys binary, counts binary"
GOLD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text, with ``.`` at the ends of pieces."""
    return (text or b"").lower().translate(SPLIT).replace(b".", b" . ").split()


def runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(languages, language of each token, word number of each token, distinct words) of texts taken together up to ``RUN_WORDS``.

    The first distinct word is the end of a piece; texts and languages end pieces too.
    """
    words, langs, sizes = [], [], []
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            found = tokens(text)
            if found:
                words.append(b".")
                words += found
                langs.append(lang)
                sizes.append(len(found) + 1)
            if len(words) >= RUN_WORDS:
                yield numbered(words, langs, sizes)
                words, langs, sizes = [], [], []
    if words:
        yield numbered(words, langs, sizes)


def numbered(words: list[bytes], langs: list[str], sizes: list[int]):
    column = np.empty(len(words), object)
    column[:] = words
    ids, distinct = pd.factorize(column)  # in order of appearance: the piece end comes first
    lang_ids, names = pd.factorize(np.array(langs, object))
    return list(names), np.repeat(lang_ids, sizes), ids.astype(np.int64), distinct


def grams(ids: np.ndarray, length: int) -> np.ndarray:
    """Positions where ``length`` words of one piece begin."""
    inside = ids != 0
    good = inside[: len(ids) - length + 1].copy() if len(ids) >= length else np.zeros(0, bool)
    for k in range(1, length):
        good &= inside[k: len(ids) - length + 1 + k]
    return np.flatnonzero(good)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * GOLD
    return h ^ (h >> np.uint64(29))


def hashed(names: list[str], langs: np.ndarray, ids: np.ndarray, distinct: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, 64-bit hashes) of the n-grams of each length."""
    word = np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)[ids]
    start = np.array([xxhash.xxh64_intdigest(n.encode()) for n in names], np.uint64)[langs]
    for length in range(1, longest + 1):
        at = grams(ids, length)
        h = mixed(start[at] + np.uint64(length))
        for k in range(length):
            h = mixed(h + word[at + k])
        yield at, h


def placed(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition and 32-bit key of each hash."""
    high, low = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)
    return ((high * np.uint64(parts)) >> np.uint64(32)).astype(np.int64), low.astype(np.uint32)


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and their summed counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(keys) else counts
    return keys[first], sums.astype(np.int64)


def misra_gries(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A summary cut down to ``capacity`` counters, and what was taken from each."""
    if len(keys) <= capacity:
        return keys, counts, 0
    taken = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    kept = counts > taken
    return keys[kept], counts[kept] - taken, taken


def summarised(chunks: pd.DataFrame, threshold: int) -> tuple[np.ndarray, int]:
    """Keys that may reach the threshold in a partition, from its chunks merged as Misra-Gries summaries; and what was taken."""
    capacity = int(chunks["mass"].sum()) // threshold + 1
    keys, counts, taken = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
    waiting_keys, waiting_counts, waiting = [], [], 0
    for i, (k, c) in enumerate(zip(chunks["keys"], chunks["counts"])):
        waiting_keys.append(np.frombuffer(k, np.uint32))
        waiting_counts.append(unpacked(c, len(waiting_keys[-1])))
        waiting += len(waiting_keys[-1])
        if waiting > 2 * capacity or i == len(chunks) - 1:
            keys, counts = counted(np.concatenate([keys, *waiting_keys]), np.concatenate([counts, *waiting_counts]))
            keys, counts, cut_off = misra_gries(keys, counts, capacity)
            taken += cut_off
            waiting_keys, waiting_counts, waiting = [], [], 0
    return keys[counts + taken >= threshold], taken


def packed(counts: np.ndarray) -> bytes:
    """One byte a count; those above 254 follow in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, np.int64, offset=n)
    return counts


def alike(columns: list[np.ndarray], at: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray]:
    """One of the positions ``at`` for each combination of the columns there, and how many have it. Columns hold numbers below ``values``."""
    if values ** len(columns) < 2 ** 63:
        key = np.zeros(len(at), np.int64)
        for column in columns:
            key = key * values + column[at]
        at = at[np.argsort(key, kind="stable")]
    else:
        at = at[np.lexsort([column[at] for column in columns])]
    new = np.zeros(len(at), bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[at[1:]] != column[at[:-1]]
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at)))


def texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))


def survivors(rows: DataFrame, longest: int, threshold: int, filter_bits: int = FILTER_BITS, partition_chars: int = PARTITION_CHARS) -> tuple[np.ndarray, int]:
    """(filter, bits a partition): a row of bytes for each hash partition, a bit set for each key that may reach the threshold."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // partition_chars))
    bits = max(3, filter_bits - max(0, (parts - 1).bit_length()))

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names, langs, ids, distinct in runs(batches):
            h = np.concatenate([h for _, h in hashed(names, langs, ids, distinct, longest)])
            part, key = placed(h, parts)
            both, counts = counted((part.astype(np.uint64) << np.uint64(32)) | key)
            part, key = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            ends = np.searchsorted(part, np.arange(parts + 1))
            # exact counts of a run are a summary from which nothing was taken
            spans = [(p, slice(ends[p], ends[p + 1])) for p in range(parts) if ends[p] < ends[p + 1]]
            yield pd.DataFrame({"part": [p for p, _ in spans], "mass": [int(counts[s].sum()) for _, s in spans],
                                "keys": [key[s].tobytes() for _, s in spans], "counts": [packed(counts[s]) for _, s in spans]})

    def marked(group: pd.DataFrame) -> pd.DataFrame:
        keys, _ = summarised(group, threshold)
        flags = np.zeros(1 << bits, bool)
        flags[keys >> np.uint32(32 - bits)] = True
        return pd.DataFrame({"part": group["part"].iloc[:1], "bits": [np.packbits(flags).tobytes()]})

    slices = rows.mapInPandas(chunks, CHUNK).groupBy("part").applyInPandas(marked, "part long, bits binary")
    table = np.zeros((parts, (1 << bits) // 8), np.uint8)
    for row in cut(slices).toLocalIterator():
        table[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return table, bits


def phrase_counts(docs: DataFrame, longest: int = 3, threshold: int = 10, text: str = "text", lang: str = "lang", filter_bits: int = FILTER_BITS, partition_chars: int = PARTITION_CHARS) -> DataFrame:
    """lang, length, phrase, f of every n-gram that occurs at least ``threshold`` times in its language, and lang, 0, '', number of words."""
    rows = texts(docs, text, lang)
    table, bits = survivors(rows, longest, threshold, filter_bits, partition_chars)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat, parts, width = shared.value.ravel(), len(shared.value), shared.value.shape[1]
        for names, langs, ids, distinct in runs(batches):
            words = np.bincount(langs, ids != 0, len(names)).astype(np.int64)
            out = [pd.DataFrame({"lang": names, "length": 0, "phrase": b"", "f": words})]
            for length, (at, h) in enumerate(hashed(names, langs, ids, distinct, longest), 1):
                part, key = placed(h, parts)
                spot = key >> np.uint32(32 - bits)
                at = at[(flat[part * width + (spot >> 3)] >> (7 - (spot & 7)).astype(np.uint8)) & 1 > 0]
                # columns of a phrase: its language and word numbers, exact
                at, f = alike([langs, *(ids[k:] for k in range(length))], at, max(len(names), len(distinct)))
                phrases = [b" ".join(p) for p in zip(*(distinct[ids[at + k]] for k in range(length)))]
                out.append(pd.DataFrame({"lang": [names[i] for i in langs[at]], "length": length, "phrase": phrases, "f": f}))
            yield pd.concat(out)

    counts = rows.mapInPandas(exact, "lang string, length int, phrase binary, f long")
    whole = counts.groupBy("lang", "length", "phrase").agg(F.sum("f").alias("f"))
    return whole.where((F.col("f") >= threshold) | (F.col("length") == 0)).select("lang", "length", F.col("phrase").cast("string").alias("phrase"), "f")


def part(words: Column, start: int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(counts: DataFrame, longest: int = 3, contained: int = 50, best: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of phrases of two words or more, from ``phrase_counts``.

    A cut after k words gives floor(10^6 a^2 / (l r)) in exact decimals; the lowest cut counts, equal ones by the smallest k. Phrases that
    lie within a longer one with at least ``contained`` percent of their count go. Rank is by score, a (both falling), then
    phrase in byte order; ``best`` (None: all) rows a language are kept.
    """
    counts = cut(counts)
    words = F.split("phrase", " ")
    phrases = counts.where("length >= 2").select("lang", "length", "phrase", F.col("f").alias("a"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")).select(
        "*", part(words, 1, F.col("k")).alias("head"), F.array_join(F.slice(words, F.col("k") + 1, F.col("length")), " ").alias("tail"))
    known = counts.where("length >= 1")
    heads, tails = (known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count)) for name, count in (("head", "l"), ("tail", "r")))
    long = lambda c: F.col(c).cast("decimal(19,0)")
    parts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("square", long("a") * long("a")).withColumn("under", long("l") * long("r"))
    scored = parts.withColumn("score", F.expr("(1000000BD * square) div under"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m")).select("lang", "phrase", "m.*")
    inner = phrases.where("length >= 3").select("lang", "a", "length", words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("size"))
    inside = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)).alias("start")).select(
        "lang", "a", F.array_join(F.slice("w", F.col("start"), F.col("size")), " ").alias("phrase"))
    holder = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = lowest.join(holder, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * 100 < long("a") * contained)).drop("longer")
    sizes = counts.where("length = 0").select("lang", F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(order))
    ranked = ranked if best is None else ranked.where(F.col("rank") <= best)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
