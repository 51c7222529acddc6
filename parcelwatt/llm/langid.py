"""Language of whole texts by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (1 to 4 characters of words, word ends marked) in rank order. A text's language is
the one whose profile has the smallest out-of-place distance: the sum, over the text's most frequent n-grams, of the
difference of ranks, and the full profile length for an n-gram the language lacks. Ties go to the smaller language name.

Profiles come from a bounded sample of labelled documents (``sample_rows`` a language in hash order of the id); prediction
reads every text whole, in the tasks.

Defined results: a null text and one without letters is ``und`` with score 0; with no labelled documents every text is
``und``; null languages are not learned. Rows are judged one by one, so repeated rows and null ids change nothing, an empty
table gives no rows and other columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from parcelwatt.llm.common import counted_broadcast, crc_mod, text_chunks

UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
ORDERS = (1, 2, 3, 4)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a text; a code packs four characters, 16 bits each, shorter n-grams with zeros in front."""
    plain = f" {_OTHER.sub(' ', text.lower()).strip()} "
    if not any(map(str.isalpha, plain)):  # signs such as superscripts and Roman numerals are word characters, but no letters
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    points = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = (points % 65521).astype(np.uint64)
    code, parts = np.zeros(len(letters), np.uint64), []
    space = letters == 32
    for n in ORDERS:
        if len(letters) < n:
            break
        code = (code[:len(letters) - n + 1] << np.uint64(16)) | letters[n - 1:]
        # a space only begins or ends an n-gram, and never stands alone
        inner = np.zeros(len(code), bool)
        for i in range(1, n - 1):
            inner |= space[i:len(code) + i]
        parts.append(code[~(inner | space) if n == 1 else ~inner])
    return np.unique(np.concatenate(parts), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` most frequent codes, ties in order of the code."""
    if len(codes) > 4 * length:  # counts below that of the last rank cannot enter; ties with it stay in
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:length]]


class Profiles:
    """Languages with their ranked n-grams."""

    def __init__(self, ranks: dict[str, list[int]], length: int):
        self.languages, self.length = sorted(ranks), length
        codes = np.array(sorted({c for r in ranks.values() for c in r}), np.uint64)
        self.codes = codes
        self.rank = np.full((len(codes) + 1, len(self.languages)), -1, np.int64)
        for j, language in enumerate(self.languages):
            self.rank[np.searchsorted(codes, np.array(ranks[language], np.uint64)), j] = np.arange(len(ranks[language]))

    def predict(self, text: str) -> tuple[str, float]:
        codes, counts = gram_counts(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.length)
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        place = self.rank[at]
        distance = np.where(place < 0, self.length, np.abs(place - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], float(max(0.0, 1.0 - distance[best] / (self.length * len(own))))


def fit(docs: DataFrame, sample_rows: int = 1000, length: int = 400) -> Profiles:
    """Profiles of the languages in ``docs`` (doc_id, text, lang): one bounded sample and one bounded list a language."""
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = (docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
           .withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_rows).select("doc_id", "lang").distinct())
    sample = docs.select("doc_id", "lang", "text").join(counted_broadcast(ids), ["doc_id", "lang"], "left_semi")

    def count(batches):
        for batch in batches:
            out = []
            for language, texts in batch.groupby("lang")["text"]:
                for _, run in text_chunks(texts):
                    parts = [gram_counts(t) for t in run]
                    codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    total = np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(codes))
                    out.append(pd.DataFrame({"lang": language, "gram": codes.view(np.int64), "n": total.astype(np.int64)}))
            if out:
                yield pd.concat(out)

    top = Window.partitionBy("lang").orderBy(F.desc("n"), "unsigned")
    rows = (sample.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
            .withColumn("unsigned", F.shiftrightunsigned("gram", 1)).withColumn("r", F.row_number().over(top)).where(F.col("r") <= length)
            .select("lang", "gram", "r").orderBy("lang", "r").collect())
    ranks: dict[str, list[int]] = {}
    for row in rows:
        ranks.setdefault(row["lang"], []).append(row["gram"] & 0xFFFFFFFFFFFFFFFF)
    return Profiles(ranks, length)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with lang_pred and score of ``text``; columns of these names are replaced."""
    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        found = [profiles.predict(t) for _, run in text_chunks(texts) for t in run]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    judged = docs.withColumn("lang_pred", judge(F.col("text")))
    return judged.select(*kept, F.col("lang_pred.lang_pred").alias("lang_pred"), F.col("lang_pred.score").alias("score"))


def held_out():
    """True where a document is never learned from."""
    return crc_mod("doc_id", 5) == 0
