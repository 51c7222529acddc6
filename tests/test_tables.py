import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwatt.operators import tables
from parcelwatt.operators.quantile import bucket, exact_quantiles, order_statistics


def test_bucket_keeps_order(spark):
    values = sorted([-1e300, -5.0, -2.0000001, -2.0, -1.9999999, -1e-300, 0.0, 5e-324, 1e-10, 0.5, 0.9999999999999999, 1.0, 1.0000000000000002, 2.0, 3.7, 4.0, 1e9, 1e300])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", bucket(F.col("v")).alias("b"))
    b = [r["b"] for r in df.orderBy("v").collect()]
    assert b == sorted(b) and b[0] < 0 < b[-1]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997])
def test_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    data = {"a": rng.normal(0, 100, n), "b": np.repeat(7.5, n), "c": np.round(rng.exponential(3, n), 1)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("a", float("nan"))]
    got = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    for r in got.collect():
        np.testing.assert_allclose([r["p10"], r["p50"], r["p90"]], np.percentile(data[r["k"]], [10, 50, 90]), rtol=1e-9, atol=1e-9)
        assert r["n"] == n


def test_weighted_ranks(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", 9.0, 2)], "k string, v double, w int")
    row = order_statistics(df, ["k"], "v", {"r3": F.lit(3), "r4": F.lit(4), "last": F.col("n")}, weight="w").first()
    assert (row["n"], row["r3"], row["r4"], row["last"]) == (6, 1.0, 2.0, 9.0)


def test_city_base_nearest_rank(spark):
    v = [float(x) for x in range(1, 21)]
    row = tables.build_city_base(spark.createDataFrame([("Hotel", "Seoul", x) for x in v], "building string, city string, eui double")).first()
    assert (row["median"], row["p10"], row["p90"], row["n"]) == (10.5, v[max(0, int(20 * 0.1) - 1)], v[min(19, int(20 * 0.9))], 20)
    one = tables.build_city_base(spark.createDataFrame([("Hotel", "Seoul", 5.0)], "building string, city string, eui double")).first()
    assert (one["p10"], one["p90"]) == (5.0, 5.0)


def test_calibration_rules(spark):
    lookup = spark.createDataFrame([("office", "2001_2010", "seoul", 400.0), ("office", "pre1990", "busan", 500.0), ("office", "pre1990", "jeju", 900.0)], "archetype string, vintage string, city string, median double")
    tier1 = spark.createDataFrame(
        [("1", 100.0, "업무시설", 2005), ("1", 120.0, "업무시설", 2005), ("2", 140.0, "업무시설", 1980), ("3", 150.0, "업무시설", 1970), ("4", 500.0, "업무시설", 2005), ("5", 50.0, "종교시설", None), ("6", 60.0, "판매시설", None)],
        "pnu string, eui double, usage_type string, built_year int")
    got = {r["usage_type"]: r for r in tables.calibration(tier1, lookup).collect()}
    assert (got["업무시설"]["n_tier1"], got["업무시설"]["median_tier1"], got["업무시설"]["median_simul"], got["업무시설"]["correction_factor"]) == (3, 140.0, 500.0, 0.28)
    assert (got["종교시설"]["archetype"], got["종교시설"]["correction_factor"]) == ("N/A", 1.0)
    assert got["판매시설"]["median_simul"] is None and got["판매시설"]["correction_factor"] == 1.0 and got["판매시설"]["note"] != ""


def test_eui_lookup_takes_first_runs(spark):
    rows = [("office", "pre1990", "seoul", f"r{i:03d}", float(100 + i)) for i in range(20)] + [("office", "pre1990", "seoul", "r000x", 9999.0)]
    row = tables.build_eui_lookup(spark.createDataFrame(rows, "archetype string, vintage string, city string, run_id string, eui double"), max_n=11).first()
    assert (row["n"], row["median"]) == (10, 104.5)
