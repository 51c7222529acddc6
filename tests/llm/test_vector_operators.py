"""Brute-force comparisons of the vector operators, and the registered queries on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from conftest import SF, rows, spark  # noqa: E402,F401
from parcelwatt.llm import neargraph, pivots, queries  # noqa: E402
from parcelwatt.llm.common import components  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed=1, groups=12, size=25, noise=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, 16))
    out = [(c + noise * rng.standard_normal(16) * k).tolist() for k, c in enumerate(centres, 1) for _ in range(size)]
    return out + [out[0]] * 40 + [(2 * np.array(out[1])).tolist()]


def test_graph_links_match_all_pairs(spark):  # noqa: F811
    v = vectors()
    data = [(i, x, 0) for i, x in enumerate(v)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, [], 0), (None, v[0], 0)]
    frame = spark.createDataFrame(data, SCHEMA)
    exact = np.array([[float(y) for y in r["embedding"]] for r in frame.where("vec_id < 900").orderBy("vec_id").collect()])
    unit = exact / np.linalg.norm(exact, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    label = np.arange(len(link))
    while True:
        low = np.where(link, label[None, :], len(label)).min(axis=1)
        if (low == label).all():
            break
        label = low
    for options in ({}, {"slice_rows": 40, "shard_rows": 60}):
        got = {r["vec_id"]: r for r in neargraph.near_duplicates(frame, **options).collect()}
        assert len(got) == len(data)
        assert [got[i]["n_links"] for i in range(len(link))] == (link.sum(axis=1) - 1).tolist()
        assert [got[i]["component_id"] for i in range(len(link))] == label.tolist()
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 905))
        assert got[None]["component_id"] is None and not got[None]["kept"]
    assert neargraph.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("local_pairs", [250_000, 40, 0])
def test_components_of_long_chains_and_stars(spark, local_pairs):  # noqa: F811
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    got = dict(map(tuple, components(spark.createDataFrame(chain + star + chain[:5] + [(5000, 5000)], "a long, b long"), local_pairs=local_pairs).collect()))
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(400)} == {1000} and 5000 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("blocks", [(8192, 1024), (37, 5)])
def test_top_k_matches_all_products(spark, blocks):  # noqa: F811
    rng = np.random.default_rng(3)
    whole = rng.integers(-9, 9, (160, 12)).astype(float)
    whole[40:60] = whole[0]
    data = [(i, x.tolist()) for i, x in enumerate(whole)] + [(400, None), (420, [float("inf")] * 12), (440, [None] * 12), (460, []), (461, [1.0, 2.0]), (None, [1.0] * 12)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in pivots.top_k(frame, F.col("vec_id") % 20 == 0, 20, block_rows=blocks[0], query_rows=blocks[1]).select("query_id", "rank", "vec_id", "score").collect()]
    padded = {i: np.array([*x, *[0.0] * (12 - len(x))]) for i, x in data if i is not None and i not in (400, 420, 440)}
    want = []
    for q in (i for i in padded if i % 20 == 0):
        best = sorted((-float(padded[q] @ x), i) for i, x in padded.items() if i != q)[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    assert pivots.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_registered_top_k_matches_sql(spark):  # noqa: F811
    got = sorted(map(tuple, queries.exact_top_k(spark, SF).collect()))
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == sorted(duckdb.sql(queries.ORACLE["op5_exact_top_k"]).fetchall())


COLUMNS = {
    "op1_best_fit_packing": ["doc_id", "piece", "first_word", "n_words", "bin_id", "bin_capacity", "bin_offset"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op6_source_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op8_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op9_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op10_lm_scoring": ["doc_id", "n_words", "log_prob", "mean_log_prob"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_registered_queries(spark, name):  # noqa: F811
    frame = queries.QUERIES[name](spark, SF)
    assert frame.columns == COLUMNS[name] and frame.count() >= (50 if name.startswith("op8") else 200)


def test_pipeline_stages(spark, tmp_path):  # noqa: F811
    import corpus_pipeline as c
    from parcelwatt.llm import mixing, packing, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_row", F.lit(1)).withColumn("score", F.lit("s"))
    for name, stage in c.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == docs.columns
        if name == "toxicity":
            labels = dict(map(tuple, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect()))
            gone = {r[0] for r in docs.select("doc_id").collect()} - {r[0] for r in kept.select("doc_id").collect()}
            assert sum(labels.get(i) == 0 for i in gone) <= 2
        if name == "mixing":
            assert kept.count() == sum(r["copies"] for r in mixing.mix(docs).collect())
        docs = kept
    packed = c.packed(spark, docs, SF).collect()
    assert sum(r["n_words"] for r in packed) == docs.select(F.sum(F.regexp_count("text", F.lit(packing.WORD)))).first()[0]
    assert all(s(spark, docs.limit(0), SF).count() == 0 for _, s in c.STAGES)
    assert toxicity.held_out() is not None
