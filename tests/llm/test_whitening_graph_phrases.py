"""Whitening, hierarchical graphs and phrases against brute-force versions."""

from __future__ import annotations

import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from conftest import SF, rows, spark  # noqa: E402,F401
from parcelwatt.llm import hnsw, phrases, queries, whitening  # noqa: E402


@pytest.mark.parametrize("case", ["random", "equal eigenvalues", "deflated", "few rows"])
def test_rank_one_updates_keep_the_scatter(case):
    rng = np.random.default_rng(4)
    width, n = 12, 6 if case == "few rows" else 90
    x = rng.integers(-20, 20, (n, width)) + 1_000_000
    if case == "equal eigenvalues":
        x = np.concatenate([np.eye(width, dtype=np.int64), -np.eye(width, dtype=np.int64)]) * 7 + 1_000_000
    if case == "deflated":
        x[:, 3], x[:, 5] = x[:, 2], 1_000_000
    whole, halves = whitening.Spectrum.empty(width), [whitening.Spectrum.empty(width) for _ in range(2)]
    for i, row in enumerate(x):
        whole.add(row)
        halves[i % 3 == 0].add(row)
    centred = x - x.mean(axis=0)
    for got in (whole, halves[0].merge(halves[1])):
        scatter = centred.T @ centred
        assert got.n == len(x) and (got.sums == x.sum(axis=0)).all()
        assert np.abs(got.basis @ np.diag(got.values) @ got.basis.T - scatter).max() < 1e-11 * np.abs(scatter).max()
        assert np.abs(got.basis.T @ got.basis - np.eye(width)).max() < 1e-12


def test_secular_roots_solve_the_equation():
    rng = np.random.default_rng(5)
    for gap in (1.0, 1e-6):
        d = np.cumsum(rng.random(30) * gap + gap / 100)
        weight = rng.random(30) * 10.0 ** rng.integers(-8, 2, 30)
        roots, _ = whitening.secular_roots(d, weight)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(weight), np.sqrt(weight)))
        assert np.abs(roots - want).max() < 1e-13 * max(1, want.max())


def white(data, width):
    """Rows (id, component, deviation, |whitened|, explained) and n, by numpy."""
    whole = [(i, [*(int(np.floor(64 * float(c))) + 1_000_000 for c in v), *[1_000_000] * (width - len(v))]) for i, v in data if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in whole}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in whole:
        apart = n * np.array(x) - sums
        for c in range(min(16, width)):
            if values[c] > 1e-12 * values[0]:
                out.append((i, c + 1, n, int((apart ** 2).sum()), abs(float(apart / n @ vectors[:, c])) / values[c] ** 0.5, values[c] / values.sum()))
    return out


def test_whitening_matches_numpy(spark):  # noqa: F811
    rng = np.random.default_rng(6)
    base = [(i, (rng.standard_normal(20) * np.linspace(1, 3, 20)).tolist()) for i in range(150)]
    data = base + [(i + 500, base[0][1]) for i in range(60)] + [(700, None), (701, [None] * 20), (702, [float("nan")] * 20), (703, []), (704, [1.0, 2.0]), (None, base[3][1]), (5, base[5][1])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("component", F.lit("x")).repartition(7)
    got = whitening.whiten(frame).collect()
    exact = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in data]
    want = white(exact, 20)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 6))
    found = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got), key=key)
    want.sort(key=key)
    assert len(found) == len(want)
    for f, w in zip(found, want):
        assert f[:4] == w[:4] and abs(f[4] - w[4]) < 1e-9 and abs(f[5] - w[5]) < 1e-12
    assert 0 <= got[0]["identity_error"] < 1e-9
    signs = {r["component"]: r["whitened"] for r in got if r["vec_id"] == 0}
    assert all(abs(r["whitened"] - signs[r["component"]]) < 1e-12 for r in got if r["vec_id"] and 500 <= r["vec_id"] < 560)
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.where("vec_id BETWEEN 500 AND 559")).count() == 0  # one vector has no variance
    assert {r["component"] for r in whitening.whiten(frame.where("vec_id < 3")).collect()} == {1, 2}


def test_incremental_basis_is_nearly_exact_before_the_last_step(spark):  # noqa: F811
    rows_, width = whitening.whole_numbers(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding", 64, 1_000_000)
    model = whitening.fit(rows_.select("x").distinct(), width, 16)
    assert model.turned < 1e-12 and model.identity_error < 1e-10


def test_large_deviations_are_exact():
    x = np.array([[3_000_000_000, -5], [1, 2]], np.int64)
    assert whitening.deviations(x, 3, np.array([7, 8])) == [(9_000_000_000 - 7) ** 2 + 23 ** 2, 16 + 4]


def nearest(data, width, k, every):
    padded = {}
    for i, v in data:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v):
            padded.setdefault(i, set()).add(tuple([*map(float, v), *[0.0] * (width - len(v))]))
    names = [(i, np.array(v)) for i, vs in padded.items() for v in sorted(vs)]
    out = []
    for q in sorted(i for i in padded if i % every == 0):
        own = np.array(min(padded[q]))
        best = sorted((-float((v * own).sum()) / (float(np.sqrt((v ** 2).sum())) * float(np.sqrt((own ** 2).sum()))), i) for i, v in names if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("options", [{}, {"shard_rows": 60, "cells": 2}, {"shard_rows": 60, "cells": 1, "beam": 4, "target": 1.0}])
def test_graph_search_matches_all_cosines(spark, options):  # noqa: F811
    rng = np.random.default_rng(8)
    base = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(400)]
    data = base + [(1000 + i, base[0][1]) for i in range(90)] + base[:20] + [(600, None), (650, [0.0] * 16), (655, [float("inf")] * 16), (700, [None] * 16), (750, []), (800, [1.0, 2.0]), (None, base[1][1]), (50, base[60][1])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("asks", F.lit("x")).repartition(5)
    got = sorted(tuple(r)[:4] for r in hnsw.search(frame, F.col("vec_id") % 50 == 0, **options).collect())
    want = nearest(data, 16, 5, 50)
    assert len(got) == len(want) and {r[:2] for r in got} == {r[:2] for r in want}
    true = {(q, i): s for q, _, i, s in want}
    met = [(q, i) for q, _, i, s in got if (q, i) in true and abs(s - true[q, i]) < 1e-12]
    assert len(met) >= (1.0 if options.get("target") == 1.0 else 0.9) * len(want)
    assert all(a[3] > b[3] or (a[3] == b[3] and a[2] < b[2]) for a, b in zip(got, got[1:]) if a[0] == b[0])
    copies = [r for r in got if r[0] == 1000]
    assert [r[2] for r in copies] == [0, 1001, 1002, 1003, 1004] and hnsw.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_graph_on_the_tenth_table_reaches_most_neighbours():
    import pyarrow.parquet as pq

    v = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist())
    x = hnsw.unit(v)
    graph = hnsw.Graph.of(x, *hnsw.Graph.build(x).flat())
    asked = x[::10]
    near = asked @ x.T
    true = np.argsort(-near, axis=1, kind="stable")[:, :6]
    got = graph.search(asked, 96)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(true, got)]) >= 0.97


def mined(data, longest=3, threshold=10, best=2000):
    """The whole result by plain counting."""
    f, n = Counter(), Counter()
    for lang, text in data:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        n[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    out = []
    candidates = {p: a for p, a in f.items() if a >= threshold and len(p[1]) > 1}
    for (lang, p), a in candidates.items():
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        held = any(q[0] == lang and len(q[1]) > len(p) and any(q[1][i:i + len(p)] == p for i in range(len(q[1]))) and 100 * b >= 50 * a for q, b in candidates.items())
        if not held:
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    got, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= best:
            got.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return got


def small_texts():
    rng = np.random.default_rng(9)
    words = np.array(["New", "york", "city", "é", "ab", "x.y", "Ünder", "the", "of", "日本", "ÀB", "a\tb"])
    data = [(["en", "de", None, "und", ""][i % 5], " ".join(rng.choice(words, 40, p=[.2, .1, .1] + [.6 / 9] * 9))) for i in range(60)]
    return data + [("en", None), ("en", ""), ("fr", " . "), ("en", "New york city! " * 400), (None, "one two\nthree " * 12), ("en", "q" * 70_000), ("de", "long " * 30_000)] + [("en", "copy of it")] * 30


@pytest.mark.parametrize("options", [{}, {"partition_chars": 900, "filter_bits": 9}])
def test_phrases_match_plain_counting(spark, options, monkeypatch):  # noqa: F811
    data = small_texts()
    frame = spark.createDataFrame(data, "lang string, text string").withColumn("phrase", F.lit(1)).repartition(6)
    got = sorted(map(tuple, phrases.collocations(phrases.phrase_counts(frame, **options)).collect()))
    assert got == sorted(mined(data))
    few = phrases.collocations(phrases.phrase_counts(frame, **options), best=3)
    assert sorted(map(tuple, few.collect())) == sorted(mined(data, best=3))
    empty = phrases.phrase_counts(frame.limit(0), **options)
    assert empty.count() == 0 and phrases.collocations(empty).count() == 0


def test_summaries_lose_no_frequent_key():
    import pandas as pd

    rng = np.random.default_rng(10)
    for threshold in (3, 10):
        draws = [np.concatenate([rng.integers(0, 3000, 4000), rng.zipf(1.4, 2000) % 5000]).astype(np.uint32) for _ in range(12)]
        chunks = [phrases.counted(d) for d in draws]
        frame = pd.DataFrame({"mass": [len(d) for d in draws], "keys": [k.tobytes() for k, _ in chunks], "counts": [phrases.packed(c) for _, c in chunks]})
        true = Counter(np.concatenate(draws).tolist())
        kept, taken = phrases.summarised(frame, threshold)
        assert taken < threshold and {k for k, f in true.items() if f >= threshold} <= set(kept.tolist())
    assert phrases.unpacked(phrases.packed(np.array([1, 254, 255, 99999, 2])), 5).tolist() == [1, 254, 255, 99999, 2]


def test_products_beyond_64_bits_stay_exact(spark):  # noqa: F811
    big = 9_000_000_000_000
    data = [("en", 0, "", 3 * big), ("en", 1, "a", big), ("en", 1, "b", big + 7), ("en", 2, "a b", big - 1)]
    got = phrases.collocations(spark.createDataFrame(data, "lang string, length int, phrase string, f long")).first()
    assert got["score"] == 10**6 * (big - 1) ** 2 // (big * (big + 7)) and (got["l"], got["r"], got["n"]) == (big, big + 7, 3 * big)


def test_registered_phrases_match_sql(spark):  # noqa: F811
    got = sorted(map(tuple, queries.phrase_collocations(spark, SF).select("a", "l", "lang", "n", "phrase", "r", "rank", "score").collect()))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(duckdb.sql(f"SELECT a, l, lang, n, phrase, r, rank, score FROM ({queries.ORACLE['op13_phrase_collocations']})").fetchall())
    assert got and got == want


def test_registered_whitening_and_neighbours(spark):  # noqa: F811
    import pyarrow.parquet as pq

    data = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    got = queries.embedding_whitening(spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert sorted((r[0], r[1], r[2], r[3]) for r in got.collect()) == sorted(w[:4] for w in white(data, 64))
    found = queries.approximate_neighbours(spark, SF)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    want = {w[:3] for w in nearest(data, 64, 5, 50)}
    assert len({tuple(r)[:3] for r in found.collect()} & want) >= 0.9 * len(want)
