"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Words enter by a hashed word vector and the mean of hashed character n-gram vectors. Overlapping windows cover the whole
text; a text's score is its highest window score. Training knows only labels of texts, so each step takes the window the
network finds most toxic of every text in the batch (and some random windows of clean texts, all of which are clean).

The network is fitted on the driver on a bounded sample of labelled rows (``sample_rows`` a class and ``sample_chars``
characters a class, in hash order of the id); scoring runs in the tasks over every text, windows in blocks of bounded size.

Defined results: null, empty and wordless texts score 0; a text shorter than a window is one padded window; labels that
are null are ignored and a document labelled twice counts as toxic if one label says so; without labels of both classes
every text with words scores the share of toxic labels (0 without labels). Rows are scored one by one, so repeated rows and
null ids change nothing, an empty table gives no rows and other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from parcelwatt.llm.common import crc_mod, free_name, text_chunks

WORD_BUCKETS, GRAM_BUCKETS, WORD_SIZE, GRAM_SIZE, HIDDEN, ATTENTION = 16384, 8192, 12, 12, 12, 8
WINDOW, STRIDE = 48, 24
_EDGE = ".,;:!?\"'()[]{}<>*#%$&-_/\\|~`^+=«»„“”’‘…"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, character n-gram buckets of all words in a row, and where each word's n-grams begin."""
    plain = [w.strip(_EDGE) or w for w in words]
    coded = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in plain]
    buckets = np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in coded), np.int64, len(coded))
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    raw = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(coded)), sizes)
    grams, owners = [], []
    for n in (3, 4):
        if len(raw) < n:
            continue
        code = np.full(len(raw) - n + 1, n, np.uint32)
        for i in range(n):
            code = code * np.uint32(16777619) ^ raw[i:len(raw) - n + 1 + i]
        inside = owner[:len(code)] == owner[n - 1:]
        code ^= code >> np.uint32(15)
        grams.append((code[inside] * np.uint32(2654435761) >> np.uint32(16)) % GRAM_BUCKETS)
        owners.append(owner[:len(code)][inside])
    grams, owners = np.concatenate(grams).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets, grams[order], np.searchsorted(owners[order], np.arange(len(coded)))


class Network:
    """Parameters by name, forward and backward passes over (windows, words) arrays of word numbers."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        inputs, h = WORD_SIZE + GRAM_SIZE, HIDDEN
        self.p = {
            "word": normal(WORD_BUCKETS, WORD_SIZE, by=0.1), "gram": normal(GRAM_BUCKETS, GRAM_SIZE, by=0.3),
            "wx": normal(inputs, 6 * h, by=inputs ** -0.5), "bx": np.zeros(6 * h, np.float32),
            "uf": normal(h, 3 * h, by=h ** -0.5), "ub": normal(h, 3 * h, by=h ** -0.5),
            "wa": normal(2 * h, ATTENTION, by=(2 * h) ** -0.5), "ba": np.zeros(ATTENTION, np.float32), "va": normal(ATTENTION, by=0.3),
            "wo": normal(2 * h, by=0.3), "bo": np.zeros(1, np.float32),
        }

    def embed(self, feats) -> np.ndarray:
        words, grams, starts = feats
        counts = np.diff(np.append(starts, len(grams)))
        chars = np.add.reduceat(self.p["gram"][grams], starts, axis=0) / counts[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][words], chars], axis=1)

    def gates(self, words: list[str]) -> np.ndarray:
        """The input side of all gates for each word; it does not depend on the neighbours."""
        parts = [self.embed(features(words[i:i + 8192])) @ self.p["wx"] + self.p["bx"] for i in range(0, len(words), 8192)]
        return np.concatenate(parts) if parts else np.zeros((0, 6 * HIDDEN), np.float32)

    def _direction(self, x: np.ndarray, u: np.ndarray, mask, keep: bool):
        """Hidden states (words, windows, HIDDEN); x is (words, windows, 3 HIDDEN). With ``keep``, also what the backward pass needs."""
        steps, h = x.shape[:2], HIDDEN
        state = np.zeros((steps[1], h), np.float32)
        out, saved = np.empty((*steps, h), np.float32), []
        for t in range(steps[0]):
            a = state @ u
            zr = _sigmoid(x[t, :, :2 * h] + a[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[t, :, 2 * h:] + r * a[:, 2 * h:])
            new = n + z * (state - n)
            if mask is not None:
                new = np.where(mask[t][:, None], new, state)
            if keep:
                saved.append((state, z, r, n, a[:, 2 * h:]))
            out[t] = state = new
        return out, saved

    def forward(self, gates: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of windows; ids (windows, words), -1 for padding."""
        mask = None if (ids >= 0).all() else (ids >= 0).T
        x = gates[ids.T]
        fw, kept_f = self._direction(x[:, :, :3 * HIDDEN], self.p["uf"], mask, keep)
        bw, kept_b = self._direction(x[::-1, :, 3 * HIDDEN:], self.p["ub"], None if mask is None else mask[::-1], keep)
        states = np.concatenate([fw, bw[::-1]], axis=2)
        u = np.tanh(states @ self.p["wa"] + self.p["ba"])
        score = u @ self.p["va"]
        if mask is not None:
            score = np.where(mask, score, np.float32(-1e9))
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logit, (mask, kept_f, kept_b, states, u, weight, pooled)) if keep else logit

    def _back(self, grad: np.ndarray, u: np.ndarray, saved, mask):
        h, steps = HIDDEN, len(saved)
        dx, du, carry = np.empty((*grad.shape[:2], 3 * h), np.float32), np.zeros_like(u), np.zeros(grad.shape[1:], np.float32)
        for t in range(steps - 1, -1, -1):
            state, z, r, n, an = saved[t]
            d = grad[t] + carry
            held = 0.0
            if mask is not None:
                m = mask[t][:, None]
                held, d = np.where(m, 0, d), np.where(m, d, 0)
            dan = d * (1 - z) * (1 - n * n)
            daz, dar = d * (state - n) * z * (1 - z), dan * an * r * (1 - r)
            da = np.concatenate([daz, dar, dan * r], axis=1)
            du += state.T @ da
            carry = d * z + da @ u.T + held
            dx[t] = np.concatenate([daz, dar, dan], axis=1)
        return dx, du

    def gradients(self, feats, ids: np.ndarray, target: np.ndarray, weight: np.ndarray, seen: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss; ``feats`` are those of the words numbered in ``ids``, ``seen`` is 0 where a word vector is left out."""
        e = self.embed(feats)
        e[:, :WORD_SIZE] *= seen[:, None]
        logit, (mask, kept_f, kept_b, states, u, alpha, pooled) = self.forward(e @ self.p["wx"] + self.p["bx"], ids, True)
        dl = ((_sigmoid(logit) - target) * weight / len(target)).astype(np.float32)
        g = {"wo": pooled.T @ dl, "bo": dl.sum(keepdims=True)}
        dp = dl[:, None] * self.p["wo"]
        dalpha = np.einsum("bh,tbh->tb", dp, states)
        dscore = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        du = dscore[:, :, None] * self.p["va"] * (1 - u * u)
        g["va"], g["wa"], g["ba"] = np.einsum("tba,tb->a", u, dscore), np.einsum("tbh,tba->ha", states, du), du.sum(axis=(0, 1))
        ds = alpha[:, :, None] * dp + du @ self.p["wa"].T
        dxf, g["uf"] = self._back(ds[:, :, :HIDDEN], self.p["uf"], kept_f, mask)
        dxb, g["ub"] = self._back(ds[::-1, :, HIDDEN:], self.p["ub"], kept_b, None if mask is None else mask[::-1])
        dx = np.concatenate([dxf, dxb[::-1]], axis=2).reshape(-1, 6 * HIDDEN)
        flat = ids.T.ravel()
        dg = np.zeros((len(e), 6 * HIDDEN), np.float32)
        np.add.at(dg, flat[flat >= 0], dx[flat >= 0])
        g["wx"], g["bx"] = e.T @ dg, dg.sum(axis=0)
        de = dg @ self.p["wx"].T
        words, grams, starts = feats
        g["word"], g["gram"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["gram"])
        np.add.at(g["word"], words, de[:, :WORD_SIZE] * seen[:, None])
        counts = np.diff(np.append(starts, len(grams)))
        np.add.at(g["gram"], grams, np.repeat(de[:, WORD_SIZE:] / counts[:, None], counts, axis=0))
        return g


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of overlapping windows that cover texts of these many words; the last window ends with the text."""
    whole = np.maximum(sizes - WINDOW, 0)
    counts = np.where(sizes > 0, 1 + -(-whole // STRIDE), 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, np.minimum(nth * STRIDE, whole[text])


def _window_ids(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    at = np.arange(WINDOW)[None, :]
    inside = start[:, None] + at < sizes[text][:, None]
    return np.where(inside, flat[np.minimum(first[text][:, None] + start[:, None] + at, len(flat) - 1)], -1)


class Scorer:
    """Scores texts; the gates of words met before are kept, up to ``held`` words."""

    def __init__(self, network: Network, held: int = 150_000):
        self.network, self.held, self.number, self.table = network, held, {}, np.zeros((0, 6 * HIDDEN), np.float32)

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = [t.lower().split() for t in texts]
        if len(self.number) > self.held:
            self.number, self.table = {}, self.table[:0]
        number, new = self.number, []
        for words in split:
            for w in words:
                if w not in number:
                    number[w] = len(number)
                    new.append(w)
        if new:
            self.table = np.concatenate([self.table, self.network.gates(new)])
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter((number[w] for words in split for w in words), np.int64, int(sizes.sum()))
        text, start = windows(sizes)
        best = np.full(len(texts), -np.inf)
        first = np.cumsum(sizes) - sizes
        short = sizes[text] < WINDOW
        for part in (np.flatnonzero(~short), np.flatnonzero(short)):
            for i in range(0, len(part), 1024):
                block = part[i:i + 1024]
                ids = _window_ids(flat, first, sizes, text[block], start[block])
                np.maximum.at(best, text[block], self.network.forward(self.table, ids))
        return np.where(sizes > 0, _sigmoid(best), 0.0)


def train(texts: list[str], toxic: list[int], steps: int = 300, batch: int = 48, seed: int = 7) -> Network:
    """Fit on whole texts with 0/1 labels; both classes must occur.

    A third of each batch is toxic. Some labels are wrong, so in the second half a toxic text counts less the surer the
    network is that none of its windows is toxic; word vectors are left out at random, so that single rare words aren't learned by heart.
    """
    rng, network = np.random.default_rng(seed), Network(seed)
    number: dict[str, int] = {}
    coded = [np.array([number.setdefault(w, len(number)) for w in t.lower().split()], np.int32) for t in texts]
    groups = [np.array([i for i, y in enumerate(toxic) if y == k and len(coded[i])]) for k in (0, 1)]
    words = list(number)
    number.clear()
    parts = [features(words[i:i + 16384]) for i in range(0, len(words), 16384)]  # in parts: the driver holds all words of the sample
    buckets, grams = np.concatenate([p[0] for p in parts]), np.concatenate([p[1].astype(np.int32) for p in parts])
    starts = np.concatenate([p[2] + before for p, before in zip(parts, np.cumsum([0, *(len(p[1]) for p in parts)]))])
    ends = np.append(starts[1:], len(grams))

    def some(ids: np.ndarray):
        """Features of the words in ``ids``, and ``ids`` renumbered for them."""
        used, back = np.unique(ids[ids >= 0], return_inverse=True)
        out = np.full(ids.shape, -1, np.int64)
        out[ids >= 0] = back
        counts = ends[used] - starts[used]
        first = np.cumsum(counts) - counts
        picked = grams[np.repeat(starts[used] - first, counts) + np.arange(counts.sum())]
        return (buckets[used], picked, first), out

    decay = 0.2
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(g, n) for g, n in zip(groups, (batch - batch // 3, batch // 3))])
        target = np.repeat([0.0, 1.0], (batch - batch // 3, batch // 3))
        sizes = np.array([len(coded[i]) for i in chosen])
        text, start = windows(sizes)
        if len(text) > 8 * batch:  # this step looks at a random part of the windows of its texts, one of each at least
            kept = np.unique(np.append(rng.permutation(len(text))[:8 * batch], np.unique(text, return_index=True)[1]))
            text, start = text[kept], start[kept]
        flat, first = np.concatenate([coded[i] for i in chosen]), np.cumsum(sizes) - sizes
        ids = _window_ids(flat, first, sizes, text, start)
        feats, local = some(ids)
        if step <= steps // 5:
            score = rng.random(len(text))
        else:
            score = network.forward(network.embed(feats) @ network.p["wx"] + network.p["bx"], local)
        order = np.lexsort((-score, text))
        top = order[np.append(True, text[order][1:] != text[order][:-1])]
        clean = np.flatnonzero(target[text] == 0)
        picked = np.append(top, rng.choice(clean, min(len(clean), batch)))
        feats, local = some(ids[picked])
        weight = np.where(np.arange(len(picked)) < len(top), 1.0, 0.5)
        if step > steps // 2:
            weight *= np.where(target[text[picked]] > 0, np.clip(2 * _sigmoid(score[picked]), 0.1, 1.0), 1.0)
        rate = 0.02 * (1 - step / (steps + 1)) + 0.001
        for k, g in network.gradients(feats, local, target[text[picked]], weight, rng.random(len(feats[0])) < 0.5).items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            network.p[k] -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
            if k in ("word", "gram"):
                network.p[k] *= np.float32(1 - decay * rate)
    return network


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 2500, sample_chars: int = 9_000_000, steps: int = 300) -> Network | float:
    """Network from labelled documents (doc_id, text; doc_id, toxic), or the share of toxic labels if a class is missing."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("int(toxic > 0)")).alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    texts, marks = [], []
    for y in (0, 1):
        ids = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id")
        chars = 0
        rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(sample_rows)
        for row in rows.toLocalIterator():
            # a text that does not fit is passed over, those after it are still taken
            if row["text"].strip() and chars + len(row["text"]) <= sample_chars:
                chars += len(row["text"])
                texts.append(row["text"])
                marks.append(y)
    if len(set(marks)) < 2:
        return float(share or 0.0)
    return train(texts, marks, steps)


def score(docs: DataFrame, model: Network | float, name: str = "score") -> DataFrame:
    """``docs`` with the toxicity of ``text`` from 0 to 1 in column ``name``."""
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model) if isinstance(model, Network) else lambda run: [model if t.split() else 0.0 for t in run]
        for texts in batches:
            yield pd.Series(np.concatenate([np.zeros(0), *(scorer(run) for _, run in text_chunks(texts))]))

    return docs.withColumn(name, scores(F.col("text")))


def without_toxic(docs: DataFrame, model: Network | float, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept."""
    name = free_name(docs, "_toxicity")
    return score(docs, model, name).where(F.col(name) < threshold).drop(name)


def held_out():
    """True where a document's label is never learned from."""
    return crc_mod("doc_id", 3) == 1


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out())
