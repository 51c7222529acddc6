"""Edge cases and brute-force comparisons of the document operators."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from conftest import SF, rows, spark  # noqa: E402,F401
from parcelwatt.llm import htmltext, langid, mixing, packing, pii, pseudolm, simhash, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _row string"
LONG = "lorem ipsum dolor sit amet " * 4000
EDGE_ROWS = [
    (1, None, None, None, None, None, None), (2, "", "en", "a", 0, 1.0, "x"), (3, " \t\n ", "en", "a", 3, None, "x"), (4, LONG, "en", "b", len(LONG), 0.5, "y"),
    (4, LONG, "en", "b", len(LONG), 0.5, "y"), (None, "one two three four", "de", None, 18, None, None), (6, "one two three four", "de", "b", 18, None, None),
    (7, "ÉTÉ 123 ?!", "fr", "c", 10, None, None),
]


@pytest.fixture()
def edges(spark):  # noqa: F811
    return spark.createDataFrame(EDGE_ROWS, SCHEMA)


@pytest.fixture()
def none(spark):  # noqa: F811
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def docs(spark):  # noqa: F811
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_components(prints, radius=2):
    unique = sorted(set(prints))
    parent = {u: u for u in unique}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(unique):
        for b in unique[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {u: find(u) for u in unique}


@pytest.mark.parametrize("shard_rows", [8192, 20])
def test_simhash_links_match_all_pairs(spark, shard_rows):  # noqa: F811
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in values[:20]:
        for _ in range(6):
            v ^= 1 << rng.randrange(64)
            values.append(v)
    values += [values[0] & ~((1 << 22) - 1) | i for i in range(80)]  # one crowded block
    values = sorted(set(values))
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "f long")
    found = {(a, b) for a, b in simhash.links(frame, 2, shard_rows).collect()}
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        a, b = a & (2**64 - 1), b & (2**64 - 1)
        parent[find(a)] = find(b)
    want = brute_components(values)
    groups = lambda label: {frozenset(v for v in values if label(v) == r) for r in map(label, values)}
    assert groups(find) == groups(want.get)


def test_simhash_documents_match_brute_force(docs):
    from xxhash import xxh64_intdigest

    def slow(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    got = simhash.near_duplicates(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {i: slow(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    label = brute_components(prints.values())
    lowest = {}
    for i, p in prints.items():
        lowest[label[p]] = min(i, lowest.get(label[p], i))
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: lowest[label[p]] for i, p in prints.items()}
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(lowest.values()))


def test_simhash_edges(edges, none):
    got = [tuple(r) for r in simhash.near_duplicates(edges).collect()]
    assert len(got) == 8
    assert {(i, c) for i, p, c in got if p == "0" * 16} == {(1, 1), (2, 1), (3, 1)}
    assert {c for i, _, c in got if i in (None, 6)} == {6}
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicated(none).count() == 0
    kept = sorted((r["doc_id"] for r in simhash.deduplicated(edges).collect()))
    assert kept == [1, 4, 6, 7]


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and total % 10 == 0 or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_spans_match_plain_patterns(spark, docs):  # noqa: F811
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab0123456789..@@ -+() é😀\n_%") for _ in range(rng.randrange(100))) for _ in range(1500)]
    texts += ["".join(rng.choice("0123456789.. -") for _ in range(60)) for _ in range(700)] + [None, "", "x" * 50000 + " a@b.co", "4111 1111 1111 1111", "a@b.com_x@c.de"]
    texts += [r["text"] for r in docs.collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.spans(frame).collect():
        assert [tuple(s) for s in r["base"]] == brute_spans(texts[r["doc_id"]])
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))


def test_pii_contexts_discover_and_masks(spark):  # noqa: F811
    seeds = [(i, f"note {i * 'x'} please call my number +1 (212) 555-{1000 + i} after nine o'clock") for i in range(1, 9)]
    more = [(20, "please call my number 212.555.77 after nine o'clock"), (21, "chapter number 12 of the book"), (22, None), (23, ""), (23, "")]
    frame = spark.createDataFrame(seeds + more, "doc_id long, text string").selectExpr("*", "'k' AS _digest", "1 AS spans")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.spans(frame.drop("spans")).collect()}
    assert got[20] == [(22, 3, 32)] and got[21] == [] and got[22] == [] and len(got[3]) == 1
    masked = pii.redacted(frame)
    assert masked.columns == frame.columns and masked.count() == frame.count()
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts[20] == "please call my number <PHONE> after nine o'clock" and texts[22] is None and texts[23] == ""
    assert texts[2] == "note xx please call my number <PHONE> after nine o'clock"
    assert pii.spans(frame.drop("spans").limit(0)).count() == 0 and pii.redacted(frame.limit(0)).count() == 0


def test_pii_finds_numbers_of_several_tokens(spark):  # noqa: F811
    seeds = [(i, f"note {i * 'x'} please call my number +1 (212) 555-{1000 + i} after nine o'clock") for i in range(1, 9)]
    more = [(20, "please call my number 020 7946 0958 after nine o'clock"), (21, "10.0.0.1 call my number, 12 34 of the book")]
    frame = spark.createDataFrame(seeds + more, "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in pii.redacted(frame).collect()}
    assert texts[20] == "please call my number <PHONE> after nine o'clock" and texts[21] == "<IP> call my number, 12 34 of the book"


def test_pii_found_instances_support_patterns(spark):  # noqa: F811
    rows = [(i, f"please call my number +1 (212) 555-{1000 + i} after nine o'clock") for i in range(60)]
    rows += [(100 + i, f"please call my number 7946 09{i:02} after nine o'clock") for i in range(10)]
    rows += [(200 + i, f"the desk line 7946 09{i:02} is open late") for i in range(10)] + [(300, "the desk line 555 123 is open late")]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[205] == [(14, 3, 23)] and got[300] == [(14, 3, 21)]


def test_pii_mask_overlapping_spans(spark):  # noqa: F811
    kind = "array<struct<start:int,kind:int,stop:int>>"
    frame = spark.sql(f"SELECT 'a 12345 b 678' AS t, from_json('[{{\"start\":2,\"kind\":2,\"stop\":5}},{{\"start\":4,\"kind\":3,\"stop\":7}},{{\"start\":10,\"kind\":1,\"stop\":13}}]', '{kind}') AS s")
    assert frame.select(pii.mask(F.col("t"), F.col("s"))).first()[0] == "a <CARD> b <IP>"


def reshared(sizes, weights, share, most):
    """Targets by repeated resharing of what is above the limits."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        out = {s: most * sizes[s] if s in capped else rest * weight[s] / total for s in names}
        over = {s for s in names if out[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return out
        capped |= over


def test_mixing_meets_targets(docs):
    got = mixing.mix(docs).collect()
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(3)).collect()}
    assert {(r["doc_id"], r["taken"]) for r in got} == again
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes, taken, largest, target = {}, {}, {}, {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        s = r["source"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), r["size"])
        target[s] = r["target"]
    for s, want in reshared(sizes, (3, 1, 2), 1.5, 2.0).items():
        assert target[s] == pytest.approx(want, rel=1e-9)
        assert abs(taken[s] - want) <= largest[s]


def test_mixing_edges(edges, none):
    got = mixing.mix(edges).collect()
    assert len(got) == 8 and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert {r["source_size"] for r in got if r["source"] is None} == {4} and {r["target"] for r in got if r["source"] == "a"} == {0.0}
    copies = mixing.mixed(edges)
    assert copies.columns == edges.columns and copies.count() == sum(r["copies"] for r in got)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_packing_keeps_every_word(docs, edges, none):
    pieces = packing.assign(docs, shard_words=20_000).toPandas()
    texts = {r["doc_id"]: re.findall(packing.WORD, r["text"] or "") for r in docs.collect()}
    for i, part in pieces.sort_values("first_word").groupby("doc_id"):
        assert part["first_word"].tolist() == [0, *part["n_words"].cumsum()[:-1]] and part["n_words"].sum() == len(texts[i])
    assert set(pieces["doc_id"]) == {i for i, w in texts.items() if w}
    for _, held in pieces.sort_values("bin_offset").groupby("bin_id"):
        assert held["bin_offset"].tolist() == [0, *held["n_words"].cumsum()[:-1]]
        assert held["bin_capacity"].iat[0] == min(c for c in packing.CAPACITIES if c >= held["n_words"].sum())
    packed = packing.sequences(docs, shard_words=20_000).collect()
    words = sorted(w for r in packed for t in r["texts"] for w in re.findall(packing.WORD, t))
    assert words == sorted(w for ws in texts.values() for w in ws)
    assert all(r["n_words"] <= r["bin_capacity"] and len(r["doc_ids"]) == len(r["texts"]) for r in packed)
    many = packing.assign(edges).toPandas()
    assert many["n_words"].sum() == 2 * 20000 + 4 + 4 + 3 and many["doc_id"].isna().sum() == 1
    assert packing.sequences(edges).count() > 0 and packing.assign(none).count() == 0 and packing.sequences(none).count() == 0


def test_best_fit_fills_better_than_one_length():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 4097, 3000)
    bins, offsets, capacity = packing.best_fit(lengths)
    assert (np.bincount(bins, weights=lengths) <= capacity).all() and (offsets >= 0).all()
    assert lengths.sum() / capacity.sum() > 0.97
    _, _, single = packing.best_fit(lengths, [4096])
    assert sum(map(packing.bin_cost, capacity)) <= sum(map(packing.bin_cost, single))


def test_language_profiles_on_held_out_documents(spark, edges, none):  # noqa: F811
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = langid.fit(docs.where(~langid.held_out()))
    got = langid.predict(docs, profiles).where(langid.held_out()).select("doc_id", "lang", "lang_pred", "score").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    judged = langid.predict(edges, profiles)
    assert judged.columns == ["doc_id", "text", "lang", "source", "n_chars", "_row", "lang_pred", "score"]
    assert {r["doc_id"] for r in judged.collect() if r["lang_pred"] == "und"} == {1, 2, 3}
    assert langid.predict(none, profiles).count() == 0
    assert {r["lang_pred"] for r in langid.predict(edges, langid.fit(none)).collect()} == {"und"}


def test_language_distance_by_hand():
    profiles = langid.Profiles({"x": [3, 1], "y": [1, 2]}, 2)
    assert profiles.languages == ["x", "y"]
    codes, counts = langid.gram_counts("ab ab c")
    grams = {bytes(int(c).to_bytes(8, "big")).replace(b"\0", b"").decode(): int(n) for c, n in zip(codes, counts)}
    assert grams == {"a": 2, "b": 2, "c": 1, "ab": 2, " a": 2, "b ": 2, " c": 1, "c ": 1, " ab": 2, "ab ": 2, " c ": 1, " ab ": 2}


def test_toxicity_learns_and_scores_all_windows(spark, edges, none):  # noqa: F811
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    clean = [" ".join(rng.choices(vocabulary, k=rng.randrange(5, 200))) for _ in range(150)]
    foul = [" ".join([*rng.choices(vocabulary, k=rng.randrange(0, 150)), "zwurgle", *rng.choices(vocabulary, k=rng.randrange(0, 50))]) for _ in range(150)]
    network = toxicity.train(clean[:100] + foul[:100], [0] * 100 + [1] * 100, steps=150)
    scorer = toxicity.Scorer(network)
    assert (scorer(clean[100:]) < 0.7).mean() > 0.95 and (scorer(foul[100:]) >= 0.7).mean() > 0.95
    deep = " ".join([*rng.choices(vocabulary, k=5000), "zwurgle", *rng.choices(vocabulary, k=5000)])
    assert scorer([deep])[0] >= 0.7 and scorer(["", " "]).tolist() == [0.0, 0.0]
    assert np.allclose(scorer(clean[:9]), [scorer([t])[0] for t in clean[:9]], atol=1e-5)
    got = toxicity.score(edges, network, "tox")
    assert got.columns == [*edges.columns, "tox"] and {r["tox"] for r in got.collect() if r["doc_id"] in (1, 2, 3)} == {0.0}
    assert toxicity.without_toxic(edges, 0.2).columns == edges.columns and toxicity.score(none, network).count() == 0
    labels = spark.createDataFrame([(6, None), (7, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(edges, labels) == 0.0 and toxicity.fit(none, labels.limit(0)) == 0.0


def test_toxicity_gradients_by_differences():
    network = toxicity.Network(1)
    feats = toxicity.features(["aa", "bbb", "c", "dddd"])
    ids, target, weight, seen = np.array([[0, 1, 2, 3, 1], [3, 2, -1, -1, -1]]), np.array([1.0, 0.0]), np.ones(2), np.ones(4)
    grads = network.gradients(feats, ids, target, weight, seen)

    def loss():
        z = network.forward(network.embed(feats) @ network.p["wx"] + network.p["bx"], ids).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(z)) - target * z))

    for name in ("uf", "ub", "wa", "va", "wo", "wx", "bx"):
        flat, g = network.p[name].reshape(-1), grads[name].reshape(-1)
        at = int(np.abs(g).argmax())
        old = flat[at]
        flat[at] = old + 1e-2
        up = loss()
        flat[at] = old - 1e-2
        down = loss()
        flat[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-2, rel=0.1, abs=2e-4), name


def test_windows_cover_every_word():
    sizes = np.array([0, 1, 47, 48, 49, 80, 81, 1000])
    text, start = toxicity.windows(sizes)
    for i, n in enumerate(sizes):
        covered = {w for s in start[text == i] for w in range(s, min(s + toxicity.WINDOW, n))}
        assert covered == set(range(n))


def test_pseudo_likelihood(docs, edges, none):
    vocabulary, p = model = pseudolm.fit(docs, rounds=1, stride=2, batch=256)
    context = np.array([[1, 2, 3, pseudolm.EDGE]])
    every = np.arange(pseudolm.VOCABULARY)
    assert np.exp(pseudolm.log_probabilities(p, every, np.repeat(context, len(every), 0))).sum() == pytest.approx(1, abs=1e-3)
    got = {r["doc_id"]: r for r in pseudolm.score(docs, model).collect()}
    counts = {r["word"]: r["n"] for r in pseudolm.word_counts(docs).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert sum(counts.values()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts.values())
    one = next(i for i, t in texts.items() if 5 < len(t.split()) < 60)
    ids = vocabulary.ids(texts[one].lower().split())
    slow = sum(float(pseudolm.log_probabilities(p, ids[i:i + 1], pseudolm.windows(ids, np.array([i])))[0]) for i in range(len(ids)))
    assert got[one]["log_prob"] == pytest.approx(slow, rel=1e-4)
    total = sum(r["log_prob"] for r in got.values()) / sum(r["n_words"] for r in got.values())
    assert total > np.log(1 / pseudolm.VOCABULARY) + 0.8
    judged = pseudolm.score(edges, model)
    assert judged.columns == [*edges.columns, "n_words", "log_prob", "mean_log_prob"]
    assert {(r["n_words"], r["log_prob"], r["mean_log_prob"]) for r in judged.collect() if r["doc_id"] in (1, 2, 3)} == {(0, 0.0, None)}
    assert pseudolm.score(none, pseudolm.fit(none)).count() == 0


def test_pseudo_likelihood_trains_on_every_word(spark, monkeypatch):  # noqa: F811
    import inspect

    rounds = inspect.signature(pseudolm.fit).parameters["rounds"].default
    for text, n in (("a", 1), ("one two three", 3), ("w " * 1000, 1000)):
        assert sorted(i for r in range(rounds) for i in pseudolm.targets(text, n, r, rounds)) == list(range(n))
    sizes = [1, 3, 23, 100, 0, 5000]
    frame = spark.createDataFrame([(" ".join(f"t{i}w{j % 7}" for j in range(n)),) for i, n in enumerate(sizes)] + [(None,)], "text string").coalesce(1)
    seen, runs, step = [], [], pseudolm.fit_step

    def counted(p, squares, target, context, rate):
        seen.append(len(target))
        step(p, squares, target, context, rate)

    monkeypatch.setattr(pseudolm, "fit_step", counted)
    monkeypatch.setattr(type(frame), "mapInPandas", lambda self, f, schema: runs.append(f) or spark.createDataFrame([], schema))
    pseudolm.fit(frame)
    for run in runs:
        list(run([frame.toPandas()]))
    assert sum(seen) == sum(sizes)


def test_pseudo_likelihood_shares_of_buckets(spark, docs, edges):  # noqa: F811
    counts = {r["word"]: r["n"] for r in pseudolm.word_counts(docs).collect()}
    vocabulary = pseudolm.Vocabulary([w for w, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0]))])
    model, bucket = (vocabulary, pseudolm.initial()), lambda w: zlib.crc32(w.encode()) % pseudolm.BUCKETS
    held: dict = {}
    for w, n in counts.items():
        if w not in vocabulary.number:
            held.setdefault(bucket(w), []).append(n)
    share = lambda w: (counts.get(w, 0) + 0.5) / (sum(held.get(bucket(w), [])) + 0.5 * (len(held.get(bucket(w), [])) + 1))
    assert held
    seen = next(w for w in counts if w not in vocabulary.number)
    junk = next(w for i in range(10**6) if bucket(w := f"junk{i}") == bucket(seen))
    own = [(i, t) for i, t in enumerate([seen, junk, None, "", f"{junk}\u00a0x {seen}", *(r["text"] for r in docs.limit(60).collect())])] + [(1, junk), (None, junk)]
    frame = spark.createDataFrame(own, "doc_id long, text string")
    frame_counts = spark.createDataFrame(list(counts.items()), "word string, n long")
    plain = {r["text"]: r for r in pseudolm.score(frame, model).collect()}
    got = pseudolm.score(frame, model, frame_counts)
    assert got.columns == ["doc_id", "text", "n_words", "log_prob", "mean_log_prob"] and got.count() == len(own)
    for r in got.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").lower())
        want = plain[r["text"]]["log_prob"] + sum(np.log(share(w)) for w in words if w not in vocabulary.number)
        assert r["n_words"] == len(words) and r["log_prob"] == pytest.approx(want, rel=1e-5)
    of = {r["text"]: r["log_prob"] for r in got.collect()}
    assert plain[seen]["log_prob"] == plain[junk]["log_prob"] and of[seen] > of[junk]
    assert pseudolm.score(edges, model, frame_counts).count() == len(EDGE_ROWS)


def test_html_blocks_and_tree(spark):  # noqa: F811
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    import html as h

    for r in htmltext.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        parts = (" ".join(h.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body))
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])
    page = (
        "<body><div class='cookie-banner'>We use cookies to make this site work better for you</div><header class='site-header'><a href=/>Home</a></header>"
        "<main><h1>T &amp; x</h1><p>Hello<br>wor<b>ld</b> &nbsp; a<p>one<aside>Side story with quite a few words in it</aside><form>Name <input></form>"
        "<section id='comments'><p>I liked this article a lot, thanks for writing it</p></section></main><footer>Legal words</footer><script>var a='</p>'</script>")
    frame = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, None), (3, "u", "", "t"), (3, "u", "plain <", "t"), (None, "u", "<p>" * 3000 + "deep " * 60, "t")], "page_id long, url string, html string, text string")
    got = [tuple(r) for r in htmltext.extract(frame).collect()]
    assert got[0] == (1, "u", "T & x\n\nHello world a\n\none", 25) and got[1] == (2, None, "", 0) and got[2] == (3, "u", "", 0)
    assert len(got) == 5 and got[4][2] == " ".join(["deep"] * 60)
    assert htmltext.extract(frame.limit(0)).count() == 0
    x, y = htmltext.labelled_table()
    assert ((htmltext.Tree(x, y).predict(x) >= 0.5) == y).mean() > 0.95


def test_html_article_inside_wrappers():
    tree = htmltext.Tree(*htmltext.labelled_table())
    long = [" ".join(f"{w}{i}" for i in range(80)) for w in "abcd"]
    article = f"<h1>A title</h1><p>{long[0]}<p>Short one.<p>{long[1]}"
    want = f"A title\n\n{long[0]}\n\nShort one.\n\n{long[1]}"
    for wrapped in ("<div class='layout has-sidebar'><article>{}</article></div>", "<div id='search-page'><main>{}</main></div>", "<form><div role=main>{}</div></form>",
                    "<form><main><article>{}</article></main></form>"):
        assert htmltext.main_text(f"<body>{wrapped.format(article)}<footer>Legal words</footer></body>", tree) == want, wrapped
    assert htmltext.main_text("<body><form>" + "".join(f"<p>{t}</p>" for t in long) + "</form></body>", tree) == "\n\n".join(long)
    beside = "<aside><article><p>A teaser of some other story of the day</p></article></aside>"
    assert htmltext.main_text(f"<body><article>{article}</article>{beside}</body>", tree) == want
    assert htmltext.main_text(f"<body><main>{article}<div class=related><article><p>A teaser of some other story</p></article></div></main></body>", tree) == want


def test_toxicity_sample_goes_on_after_an_oversize_text(spark, monkeypatch):  # noqa: F811
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, marks, steps: taken.extend(zip(texts, marks)))
    frame = spark.createDataFrame([(i, "x" * (90 if i in (0, 1, 2, 3) else 5)) for i in range(12)], "doc_id long, text string")
    toxicity.fit(frame, frame.selectExpr("doc_id", "int(doc_id % 2) AS toxic"), sample_chars=50)
    assert sorted(taken) == [("xxxxx", 0)] * 4 + [("xxxxx", 1)] * 4
    assert toxicity.STRIDE <= toxicity.WINDOW // 2


def test_malformed_sections_are_comments():
    tree = htmltext.Tree(*htmltext.labelled_table())
    text = "The council met on Monday and agreed on the new bridge, which will be built over the river next year after a long debate among all members."
    for bad in ("<![foo[ x ]]>", "<![ ]>", "<![>", "<![CDATA[ y ]]>", "<![if !IE]>", "<!>", "<!doctype x>"):
        assert htmltext.main_text(f"<body><article><p>{text}</p>{bad}<p>{text}</p></article></body>", tree) == f"{text}\n\n{text}", bad
    assert text in htmltext.main_text(f"<body><article><p>{text}</p><![foo", tree)


@pytest.mark.parametrize("text", ["²", "½ ³", "Ⅷ", "12 345", "!?", "", None])
def test_texts_without_letters_have_no_language(spark, text):  # noqa: F811
    docs = spark.createDataFrame([(1, "the cat sat on the mat and the dog", "en"), (2, "der hund und die katze sind im haus", "de")], "doc_id long, text string, lang string")
    got = langid.predict(spark.createDataFrame([(9, text), (8, "x² the cat")], "doc_id long, text string"), langid.fit(docs)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 9] == [("und", 0.0)] and all(r["lang_pred"] == "en" for r in got if r["doc_id"] == 8)


def test_pii_very_long_texts(spark):  # noqa: F811
    """One text of very many tokens and one of very many addresses: each span is found, and the mask takes all of them."""
    digits = " ".join(f"word {i}" for i in range(50_000))
    mails = [f"u{i}@h{i % 9}.org" for i in range(5_000)]
    frame = spark.createDataFrame([(1, digits), (2, " ".join(f"mail {m} now" for m in mails))], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.spans(frame).collect()}
    at, expected = 0, []
    for m in mails:
        expected.append((at + 5, 0, at + 5 + len(m)))
        at += len(m) + 10
    assert got[1] == [] and got[2] == expected
    texts = {r["doc_id"]: r["text"] for r in pii.redacted(frame).collect()}
    assert texts[1] == digits and texts[2] == " ".join(["mail <EMAIL> now"] * len(mails))


def test_pii_running_and_blocks(spark):  # noqa: F811
    rows = [([],), ([3],), ([2, 9, 1],), (list(range(200, 0, -7)),)]
    frame = spark.createDataFrame(rows, "v array<int>").select(
        "v", pii._running(F.col("v"), pii._sum).alias("sums"), pii._running(F.col("v"), pii._greater).alias("tops"), pii._blocks(F.col("v")).alias("blocks"))
    for r in frame.collect():
        assert r["sums"] == [sum(r["v"][:i]) for i in range(len(r["v"]))]
        assert r["tops"] == [max([0, *r["v"][:i]]) for i in range(len(r["v"]))]
        assert [x for b in r["blocks"] for x in b] == r["v"]


def test_a_training_step_follows_the_gradient_and_words_are_hashed_once(monkeypatch):
    rng, p = np.random.default_rng(5), pseudolm.initial()
    y, x = rng.integers(0, pseudolm.VOCABULARY, 300) // 8, rng.integers(0, 40, (300, 4))
    x[:, 0] = pseudolm.EDGE
    squares = {k: np.full(s, 1e-6, np.float32) for k, s in pseudolm.SHAPES.items()}
    loss = lambda q: -pseudolm.log_probabilities({k: v.astype(np.float64) if k != "word_w" else v for k, v in q.items()}, y, x).mean()
    before = {k: v.copy() for k, v in p.items()}
    pseudolm.fit_step(p, squares, y, x, 0.1)
    for name, at in (("word_b", (y[0] // 64, y[0] % 64)), ("class_b", (3,)), ("bias", (2,)), ("inputs", (0, pseudolm.EDGE, 5)), ("inputs", (1, x[7, 1], 3))):
        step = {k: v.copy() for k, v in before.items()}
        step[name][at] += 1e-2
        up = loss(step)
        step[name][at] -= 2e-2
        slope = (up - loss(step)) / 2e-2
        assert squares[name][at] == pytest.approx(1e-6 + slope * slope, rel=0.05, abs=2e-8)
        assert before[name][at] - p[name][at] == pytest.approx(0.1 * slope / np.sqrt(1e-6 + slope * slope), rel=0.05, abs=2e-3)
    unmet = np.setdiff1d(np.arange(pseudolm.CLASSES), y // 64)
    assert len(unmet) and np.array_equal(p["word_w"][unmet], before["word_w"][unmet])
    calls, crc32 = [], zlib.crc32
    monkeypatch.setattr(pseudolm.zlib, "crc32", lambda b: calls.append(b) or crc32(b))
    vocabulary, text = pseudolm.Vocabulary(["a", "b"]), "a Rare\x0bWort b\x1cc rare\u00a0x  rare\ud800 \n" * 50
    assert vocabulary.text_ids(text).tolist() == vocabulary.ids(pseudolm.split_words(text)).tolist()
    assert len(calls) == len(set(calls)) == 5


def test_texts_encoded_once_train_and_score_alike(spark, docs, monkeypatch):  # noqa: F811
    edge = [("",), (None,), (" \n",), ("Rare x ÄB rare Äb\x0bc",), ("solo",), ("solo",)]
    frame = docs.limit(80).select("text").union(spark.createDataFrame(edge, "text string")).coalesce(1).localCheckpoint()
    blocks = pseudolm.encoded(frame).localCheckpoint()
    counts = pseudolm.word_counts(frame).localCheckpoint()
    plain = {r["word"]: r["n"] for r in counts.collect()}
    assert {r["word"]: r["n"] for r in pseudolm.word_counts(blocks).collect()} == plain
    split, calls = pseudolm._split_run, []
    monkeypatch.setattr(pseudolm, "_split_run", lambda texts: calls.append(len(texts)) or split(texts))
    runs, texts = blocks.toPandas(), [r["text"] or "" for r in frame.collect()]
    words = [w for t in texts for w in t.lower().encode().split()]
    vocabulary = pseudolm.Vocabulary(sorted(plain)[:100])
    met = list(pseudolm._numbered_runs(runs, vocabulary))
    assert not calls and np.concatenate([ids for ids, _, _ in met]).tolist() == vocabulary.of(words).tolist()
    (ids, sizes, firsts), = met
    begin = np.cumsum(sizes) - sizes
    for turn in range(3):
        at = pseudolm._run_targets(sizes, firsts, turn, 3)
        one = [(pseudolm.targets(t, n, turn, 3), a) for t, n, a in zip(texts, sizes.tolist(), begin.tolist())]
        assert at.tolist() == [a + i for own, a in one for i in own.tolist()]
        around = [pseudolm.windows(ids[a:a + n], own) for (own, a), n in zip(one, sizes.tolist())]
        assert np.array_equal(pseudolm._run_windows(ids, sizes, at), np.concatenate(around))
    (_, p), (_, q) = pseudolm.fit(frame, counts=counts), pseudolm.fit(blocks, counts=counts)
    assert all(np.array_equal(p[k], q[k]) for k in p)
    model = (vocabulary, p)
    found = []
    for heavy in (0, 5, 1 << 16):  # shares told to the tasks or joined
        monkeypatch.setattr(pseudolm, "HEAVY", heavy)
        found.append({r["text"]: (r["n_words"], r["log_prob"]) for r in pseudolm.score(frame, model, counts, blocks=blocks).collect()})
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        assert all(other[t] == pytest.approx(found[0][t], rel=1e-9) for t in other)
