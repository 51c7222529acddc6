import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelwatt.dims import values as V
from parcelwatt.operators import ml

B = "gid int, pnu string, usage_type string, structure_class string, built_year int, total_area double, floors_above int, vintage_class string"


def buildings(spark):
    return spark.createDataFrame([(1, "a", "공동주택", "RC", 2005, 3000.0, 15, "2001-2010"), (2, "b", "업무시설", "steel", 2018, 10000.0, 30, "post-2010"), (3, "c", None, None, None, None, 0, None), (4, "d", "숙박시설", "RC", 1850, 0.5, 1, "pre-1980")], B)


def test_features(spark):
    out = {r["gid"]: r for r in ml.features(buildings(spark)).collect()}
    assert [c for c in ml.features(buildings(spark)).columns if c in V.FEATURES] == list(V.FEATURES)
    one = out[1]
    assert (one["vintage_class_enc"], one["usage_type_enc"], one["structure_type_enc"], one["floors"], one["built_year_age"]) == (2.0, 0.0, 0.0, 15.0, 21.0)
    assert one["HDD18_annual"] == 1864.0 and one["CDD24_annual"] == 199.0 and abs(one["total_area_log"] - 8.006701) < 1e-6
    assert abs(one["wall_uvalue_x_HDD18"] - one["wall_uvalue"] * 1864) < 1e-9
    assert (out[2]["usage_type_enc"], out[2]["structure_type_enc"]) == (2.0, 1.0)
    assert (out[3]["built_year_age"], out[3]["floors"], out[3]["structure_type_enc"]) == (40.0, 5.0, 0.0) and out[3]["built_year"] is None
    assert out[4]["built_year_age"] == 120.0
    own = ml.features(buildings(spark).withColumn("HDD18_annual", F.lit(1000.0))).first()
    assert own["HDD18_annual"] == 1000.0


def test_training_set_and_splits(spark):
    t1 = spark.range(20).select(F.concat(F.lit("m"), F.col("id")).alias("pnu"), F.lit(100.0).alias("eui"), F.lit("x").alias("vintage_class"))
    t2 = spark.range(300).select(F.when(F.col("id") < 10, F.concat(F.lit("m"), F.col("id"))).otherwise(F.concat(F.lit("c"), F.col("id"))).alias("pnu"), F.lit(200.0).alias("primary_energy"), F.lit("office").alias("usage_key"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("vintage_class"))
    s = ml.training_set(t1, t2, convert=True)
    assert s.count() == 310 and s.filter("source_tier = 2").first()["eui"] == 90.0 and s.filter("weight = 5").count() == 20
    split = ml.split(s)
    assert split.filter("source_tier = 1 AND is_validation").count() == 0
    sizes = {r["vintage_class"]: (r["v"], r["n"]) for r in split.filter("source_tier = 2").groupBy("vintage_class").agg(F.count(F.when(F.col("is_validation"), 1)).alias("v"), F.count(F.lit(1)).alias("n")).collect()}
    assert all(v == round(0.2 * n) for v, n in sizes.values())
    assert ml.split(s).filter("is_validation").select("pnu").exceptAll(split.filter("is_validation").select("pnu")).count() == 0
    f = ml.folds(s)
    counts = [r["count"] for r in f.filter("fold IS NOT NULL AND vintage_class = 'y'").groupBy("fold").count().collect()]
    assert len(counts) == 5 and max(counts) - min(counts) <= 1 and f.filter("fold IS NULL").count() == 20


def test_synthetic_and_fit(spark):
    syn = ml.synthetic_rows(spark, 400)
    assert syn.count() == 400 and syn.filter("eui < 20").count() == 0 and syn.select("usage_type").distinct().count() == 13
    rows = ml.features(syn.withColumn("gid", F.monotonically_increasing_id()).drop("source_tier"))
    from pyspark.ml.regression import GBTRegressor

    model = ml.fit(rows, GBTRegressor(featuresCol="features", labelCol="eui", weightCol="weight", maxIter=3, maxDepth=3, seed=1))
    assert abs(sum(r["importance"] for r in ml.importance(model, spark).collect()) - 1) < 1e-9
    bands = spark.createDataFrame([("office", -5.0, 8.0)], "usage_key string, lower double, upper double")
    out = {r["gid"]: r for r in ml.predict(model, buildings(spark), bands).collect()}
    assert len(out) == 4 and all(r["confidence_low"] <= r["predicted_eui"] <= r["confidence_high"] and r["predicted_eui"] >= 10 for r in out.values())
    assert abs(out[2]["confidence_high"] - out[2]["predicted_eui"] - 8) < 1e-9 and abs(out[1]["confidence_high"] - out[1]["predicted_eui"] * 1.2) < 1e-9
    assert '"wall_uvalue"' in out[1]["features_used"]


def test_final_estimate(spark):
    cols = "data_tier int, eui double, epi_score double, usage_key string, predicted_eui double, confidence_low double, confidence_high double"
    df = spark.createDataFrame([(1, 100.0, None, "office", 50.0, 40.0, 60.0), (2, None, 200.0, "office", 100.0, 80.0, 120.0), (2, None, None, "office", 100.0, 80.0, 120.0), (4, None, None, "office", 10.0, 8.0, 12.0), (None, None, None, None, 10.0, 8.0, 12.0), (1, 0.0, None, "office", 50.0, 40.0, 60.0)], cols)
    got = [(r["final_eui"], r["final_low"], r["final_high"], r["data_tier_used"]) for r in ml.final_estimate(df).collect()]
    assert got[0] == (100.0, 90.0, pytest.approx(110.0), 1)
    assert got[1] == (pytest.approx(93.0), pytest.approx(74.4), pytest.approx(111.6), 2)
    assert got[2:] == [(100.0, 80.0, 120.0, 2), (10.0, 8.0, 12.0, 3), (10.0, 8.0, 12.0, 3), (50.0, 40.0, 60.0, 1)]


def test_accuracy_edge_cases(spark):
    p = spark.createDataFrame([(1, 10.0, 10.0), (1, 12.0, 10.0), (1, 3.0, 2.0), (1, 5.0, None)], "model_version_id long, predicted_eui double, actual_eui double")
    p = ml.errors(p).withColumns({"temporal_scale": F.lit("annual"), "target_variable": F.lit("eui"), "predicted_at": F.lit("2025-01-01")})
    versions = spark.createDataFrame([(1, 7, "v1")], "id long, model_id long, version_tag string")
    registry = spark.createDataFrame([(7, "m", "xgb", "production")], "id long, model_name string, model_type string, stage string")
    row = ml.accuracy(p, versions, registry).first()
    assert (row["prediction_count"], row["mape"], row["r_squared"], row["rmse"]) == (2, 10.0, None, 1.414)


def test_registry(spark):
    t = dt.datetime(2025, 1, 1)
    ev = spark.createDataFrame([("m", "v1", "staging", 10.0, 1.0, t, ""), ("m", "v1", "production", 10.0, 1.0, t + dt.timedelta(days=1), "")], ml.REGISTRY_SCHEMA)
    assert ml.production(ev).first()["version_tag"] == "v1"
    later = t + dt.timedelta(days=9)
    close = spark.createDataFrame([("m", "v2", "", 9.9, 1.0, later, "")], ml.REGISTRY_SCHEMA)
    assert [(r["version_tag"], r["stage"]) for r in ml.promote(ev, close).collect()] == [("v2", "staging")]
    better = spark.createDataFrame([("m", "v2", "", 9.0, 1.0, later, ""), ("n", "v1", "", 50.0, 1.0, later, "")], ml.REGISTRY_SCHEMA)
    new = ml.promote(ev, better)
    assert sorted((r["model_name"], r["version_tag"], r["stage"]) for r in new.collect()) == [("m", "v1", "archived"), ("m", "v2", "production"), ("n", "v1", "production")]
    assert {(r["model_name"], r["version_tag"]) for r in ml.production(ev.unionByName(new)).collect()} == {("m", "v2"), ("n", "v1")}
