import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from parcelwatt.operators import timeseries as ts

T0 = dt.datetime(2025, 1, 1)


def readings(spark, data):
    return spark.createDataFrame(data, "ts_id long, meter_type string, recorded_at timestamp_ntz, value double")


def brute(data):
    out = []
    for i, m, t, v in data:
        w = [x for j, n, u, x in data if (j, n) == (i, m) and t - dt.timedelta(hours=24) <= u <= t - dt.timedelta(seconds=1)]
        if len(w) >= 6 and np.std(w) > 0 and abs(v - np.mean(w)) / np.std(w) > 2:
            out.append((i, m, t))
    return sorted(out)


def test_anomalies_match_brute_force(spark):
    rng = np.random.default_rng(1)
    data = [(1, "gas", T0 + dt.timedelta(minutes=15 * i), float(round(rng.normal(10, 1), 2))) for i in range(500)]
    data += [(2, "gas", T0 + dt.timedelta(hours=i), 5.0) for i in range(60)] + [(3, "gas", T0 + dt.timedelta(hours=i), 5.0 + i % 2) for i in range(5)] + [(3, "gas", T0 + dt.timedelta(hours=6), 99.0)]
    data[200] = (1, "gas", data[200][2], 60.0)
    df = readings(spark, data)
    want = brute(data)
    assert (1, "gas", data[200][2]) in want
    for chunk in (dt.timedelta(days=1), dt.timedelta(days=2), dt.timedelta(days=30)):
        got = sorted((r.ts_id, r.meter_type, r.detected_at) for r in ts.anomalies(df, chunk=chunk).collect())
        assert got == want


def test_window_edges(spark):
    base = [(1, "gas", T0 + dt.timedelta(minutes=i), float(i % 3)) for i in range(6)]
    just_in = base + [(1, "gas", T0 + dt.timedelta(hours=24), 50.0)]
    just_out = base + [(1, "gas", T0 + dt.timedelta(hours=24, seconds=1), 50.0)]
    assert ts.anomalies(readings(spark, just_in)).count() == 1
    assert ts.anomalies(readings(spark, just_out)).count() == 0
    assert ts.anomalies(readings(spark, [])).count() == 0


def test_resample_is_inclusive_and_monday_based(spark, rows):
    data = [(1, "gas", dt.datetime(2025, 1, 5, 23), 1.0), (1, "gas", dt.datetime(2025, 1, 6), 2.0), (1, "gas", dt.datetime(2025, 1, 12, 23, 59), 4.0), (1, "gas", dt.datetime(2025, 1, 13), 8.0)]
    got = ts.resample(readings(spark, data), "weekly", dt.datetime(2025, 1, 5), dt.datetime(2025, 1, 13))
    assert sorted(r["value"] for r in got.collect()) == [1.0, 6.0, 8.0]


def pandas_fill(s: pd.Series) -> pd.Series:
    full = s.reindex(pd.date_range(s.index.min(), s.index.max(), freq="D"))
    return full.interpolate(method="linear", limit=7).ffill().bfill().fillna(0.0)


def test_fill_lag_and_rolling_match_pandas(spark):
    days = pd.date_range("2025-01-01", periods=120, freq="D")
    rng = np.random.default_rng(3)
    y = pd.Series(rng.normal(100, 10, 120).round(3), index=days)
    y.iloc[0:2], y.iloc[20:23], y.iloc[40:50], y.iloc[118:] = np.nan, np.nan, np.nan, np.nan
    y.iloc[60] = 0.0
    dropped = y.drop(y.index[70:74])
    df = spark.createDataFrame([("a", d.date(), None if pd.isna(v) else float(v)) for d, v in dropped.items()], "ts_id string, day date, y double")
    df = df.unionByName(spark.createDataFrame([("b", dt.date(2025, 1, 1), None)], "ts_id string, day date, y double"))
    got = ts.rolling_features(ts.lag_features(ts.fill_daily(df))).filter("ts_id = 'a'").orderBy("day").toPandas()
    want = pandas_fill(dropped)
    np.testing.assert_allclose(got["y"].astype(float), want.to_numpy(), rtol=1e-12)
    np.testing.assert_allclose(got["lag_14d"].astype(float), want.shift(14).to_numpy())
    for w in (7, 30):
        np.testing.assert_allclose(got[f"roll_mean_{w}d"].astype(float), want.shift(1).rolling(w).mean().to_numpy(), rtol=1e-9)
        np.testing.assert_allclose(got[f"roll_std_{w}d"].astype(float), want.shift(1).rolling(w).std().to_numpy(), rtol=1e-6, atol=1e-6)
    np.testing.assert_allclose(got["dev_from_7d_avg"].astype(float), (want.shift(1) - want.shift(1).rolling(7).mean()).to_numpy(), atol=1e-9)
    assert ts.fill_daily(df).filter("ts_id = 'b'").first()["y"] == 0.0


def test_calendar(spark):
    df = spark.createDataFrame([("a", dt.date(2025, 1, 1), 1.0), ("a", dt.date(2025, 1, 4), 1.0), ("a", dt.date(2025, 1, 6), 1.0)], "ts_id string, day date, y double")
    got = {r["day"].day: (r["day_of_week"], r["is_weekend"], r["is_holiday"], r["is_work_day"]) for r in ts.calendar(df).collect()}
    assert got == {1: (2, 0, 1, 0), 4: (5, 1, 0, 0), 6: (0, 0, 0, 1)}


def test_forecast_runs_per_series(spark):
    days = pd.date_range("2024-01-01", periods=400, freq="D")
    rng = np.random.default_rng(5)
    data = [("a", d.date(), float(100 * (0.5 if d.dayofweek >= 5 else 1.0) + rng.normal(0, 5))) for d in days]
    data += [("short", d.date(), 1.0) for d in days[:40]]
    out = ts.forecast(spark.createDataFrame(data, "ts_id string, day date, y double"), 7).toPandas()
    short = out[out["ts_id"] == "short"]
    assert len(short) == 1 and short["day"].isna().all() and short["y_pred"].isna().all() and "30" in short["reason"].iloc[0]
    out = out[out["ts_id"] != "short"]
    assert set(out["ts_id"]) == {"a"} and len(out) == 7 and out["reason"].isna().all()
    assert (out["y_lower"] <= out["y_pred"]).all() and (out["y_pred"] <= out["y_upper"]).all() and (out["y_lower"] >= 0).all()
    assert out["day"].min() == (days[-1] + pd.Timedelta(days=1)).date() and out["val_rmse"].iloc[0] < 20


def test_compare_and_summary(spark, rows):
    mon = spark.createDataFrame([(1, "A", "p", 10.0), (2, "B", "q", None)], "ts_id long, alias string, pnu string, total_area double")
    r = readings(spark, [(1, "gas", T0, 50.0), (1, "electricity", T0 - dt.timedelta(days=40), 7.0), (2, "gas", T0, 5.0)])
    ids = spark.createDataFrame([(1,), (2,), (9,)], "ts_id long")
    assert rows(ts.compare(mon, r, ids, 30, "eui", T0), "ts_id", "alias", "value") == [(1, "A", 5.0), (2, "B", None), (9, None, None)]
    assert rows(ts.compare(mon, r, ids, 30, "water", T0), "ts_id", "value", "unit") == [(1, None, "kWh"), (2, None, "kWh"), (9, None, "kWh")]
    got = {x["ts_id"]: x for x in ts.eui_summary(mon, r, T0).collect()}
    assert got[1]["eui_kwh_m2_1yr"] == 5.7 and got[1]["meter_count"] == 2 and got[2]["eui_kwh_m2_1yr"] is None


def test_daily_rollup(spark):
    r = readings(spark, [(1, "gas", T0 + dt.timedelta(minutes=15 * i), 1.0 if i else None) for i in range(48)])
    row = ts.daily_rollup(r).first()
    assert (row["total_kwh"], row["ok_count"], row["missing_count"], row["coverage_pct"]) == (47.0, 47, 49, 48.96)


def test_training_frame_needs_thirty_rows(spark):
    days = pd.date_range("2025-01-01", periods=70, freq="D")
    df = spark.createDataFrame([("a", d.date(), float(i)) for i, d in enumerate(days)] + [("b", d.date(), 1.0) for d in days[:50]], "ts_id string, day date, y double")
    out = ts.training_frame(df)
    assert out.count() == 40 and out.filter(F.col("ts_id") == "b").count() == 0
