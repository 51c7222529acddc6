import datetime as dt

import pytest

from pyspark.sql import functions as F

from parcelwatt import schemas
from parcelwatt.operators import timeseries as ts
from parcelwatt.streaming import keyed, streams as S

T0 = dt.datetime(2025, 1, 6)


def land(spark, path, name, rows):
    spark.createDataFrame(rows, schemas.READING).coalesce(1).write.parquet(f"{path}/{name}")


def reading(minutes, value, ts_id=1):
    return (ts_id, "gas", T0 + dt.timedelta(minutes=minutes), float(value), "kWh")


def open_stream(spark, path, **options):
    return S.readings(spark, path, schemas.READING, recursiveFileLookup="true", **options)


def test_dedup_across_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, src, "a", [reading(0, 1), reading(0, 9), reading(15, 2)])
    S.to_files(open_stream(spark, src), out, str(tmp_path / "c")).awaitTermination()
    land(spark, src, "b", [reading(15, 7), reading(30, 3)])
    S.to_files(open_stream(spark, src), out, str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 3 and got.select("recorded_at").distinct().count() == 3


def test_anomalies_keep_batch_parity_with_late_rows(spark, tmp_path):
    src, at = str(tmp_path / "in"), lambda p: str(tmp_path / p)
    rows = [reading(15 * i, 10 + i % 3) for i in range(150)]
    rows[60], rows[120] = reading(15 * 60, 90), reading(15 * 120, 95)
    parts = {"a": rows[:70], "b": rows[90:], "c": rows[70:90] + rows[60:62]}
    run = lambda: S.anomalies(open_stream(spark, src, dedup=False), at("h"), at("e"), at("c")).awaitTermination()
    for name, part in parts.items():
        land(spark, src, name, part)
        run()
    found = {r["detected_at"] for r in spark.read.parquet(at("e")).collect()}
    batch = spark.createDataFrame(rows, schemas.READING)
    want = {r["detected_at"] for r in ts.anomalies(batch).collect()}
    assert want <= found and spark.read.parquet(at("h")).count() == 150
    assert spark.read.parquet(at("e")).count() == len(found)


def test_weather_dedup_and_current(spark, tmp_path):
    src, at = str(tmp_path / "in"), lambda p: str(tmp_path / p)
    obs = [(1, 1, 127.0, 37.5, 90.0, 2.0, T0), (1, 1, 127.0, 37.5, 90.0, 2.0, T0), (1, 1, 127.0, 37.5, 180.0, 4.0, T0 + dt.timedelta(hours=1)), (2, 1, 127.0, 37.5, 90.0, 2.0, T0 + dt.timedelta(hours=1))]
    for name in ("a", "b"):
        spark.createDataFrame(obs, schemas.WEATHER).write.parquet(f"{src}/{name}")
        stream = spark.readStream.schema(schemas.WEATHER).option("recursiveFileLookup", "true").parquet(src)
        S.weather(stream, at("o"), at("w"), at("c")).awaitTermination()
    assert spark.read.parquet(at("o")).count() == 3
    row = spark.read.parquet(at("w")).first()
    assert (row["wind_direction"], row["wind_speed"], row["observations"]) == (135.0, 3.0, 2)


def test_latest_snapshot(spark, tmp_path):
    src, at = str(tmp_path / "in"), lambda p: str(tmp_path / p)
    land(spark, src, "a", [reading(0, 1), reading(30, 3), reading(15, 9), reading(5, 4, ts_id=2)])
    S.to_snapshot(S.latest(open_stream(spark, src, dedup=False)), at("o"), at("c")).awaitTermination()
    assert {r["ts_id"]: r["value"] for r in spark.read.parquet(at("o")).select("ts_id", F.col("value")).collect()} == {1: 3.0, 2: 4.0}


def keyed_run(spark, src, at, **rule):
    keyed.anomaly_changes(open_stream(spark, src, dedup=False), at("out"), at("check"), **rule).awaitTermination()
    return keyed.said(spark, at("out"))


def verdict_rows(df):
    return sorted((r["ts_id"], r["detected_at"], round(r["window_mean"], 9), round(r["window_std"], 9), r["offending_value"], round(r["z_score"], 9)) for r in df.collect())


def test_keyed_anomalies_follow_disorder_repeats_and_refuse_old_rows(spark, tmp_path):
    src, at = str(tmp_path / "in"), lambda p: str(tmp_path / p)
    rows = [reading(15 * i, 10 + i % 3, ts_id=1 + i % 2) for i in range(260)]
    rows[60], rows[121], rows[200] = reading(15 * 60, 90, 1), reading(15 * 121, 95, 2), reading(15 * 200, 60, 1)
    rows += [reading(15 * i, 5, ts_id=3) for i in range(40)] + [reading(15 * 41, 5.5, ts_id=3)]  # no deviation, no verdict
    old = reading(-60 * 24 * 3650, 7)
    # the quiet rows before the peak come last: they make new verdicts and withdraw old ones
    landings = [rows[40:60] + rows[60:130], rows[130:] + rows[60:70], rows[:40] + [old] + rows[:10]]
    taken = []
    for i, part in enumerate(landings):
        land(spark, src, str(i), part)
        written = keyed_run(spark, src, at, late=dt.timedelta(hours=72))
        taken += [r for r in part if r is not old]
        batch = spark.createDataFrame(taken, schemas.READING).dropDuplicates(["ts_id", "meter_type", "recorded_at"])
        assert verdict_rows(keyed.verdicts(written)) == verdict_rows(ts.anomalies(batch)) != []
    late = keyed.refused(written).collect()
    assert [(r["ts_id"], r["value"]) for r in late] == [(1, 7.0)]
    assert written.filter("kind = 'anomaly' AND batch > 0").count() > 0


def test_keyed_state_keeps_only_what_later_verdicts_need(spark, tmp_path):
    src, at = str(tmp_path / "in"), lambda p: str(tmp_path / p)
    rule = {"window": dt.timedelta(hours=2), "late": dt.timedelta(hours=1), "min_count": 3}
    land(spark, src, "a", [reading(15 * i, 10 + i % 4) for i in range(400)])
    keyed_run(spark, src, at, **rule)
    buffer = spark.read.format("statestore").option("stateVarName", "buffer").load(at("check"))
    assert [len(r["value"]["us"]) for r in buffer.collect()] == [13]  # three hours of quarters, both ends
    land(spark, src, "b", [reading(15 * 399 - 61, 50), reading(15 * 399 - 59, 50), (2, "gas", None, 1.0, "kWh"), (2, "gas", T0, None, "kWh")])
    written = keyed_run(spark, src, at, **rule)
    assert [r["value"] for r in keyed.refused(written).collect()] == [50.0]
    assert {r["offending_value"] for r in keyed.verdicts(written).collect()} == {13.0, 50.0}  # 13 after 10, 11, 12


def test_time_to_live_needs_a_query_that_runs_on(spark, tmp_path):
    land(spark, str(tmp_path / "in"), "a", [reading(15 * i, 10 + i % 4) for i in range(20)])
    stream, at = open_stream(spark, str(tmp_path / "in"), dedup=False), lambda p: str(tmp_path / p)
    with pytest.raises(ValueError):
        keyed.anomaly_changes(stream, at("out"), at("check"), keep=dt.timedelta(days=1))
    query = keyed.anomaly_changes(stream, at("out"), at("check"), every="1 second", keep=dt.timedelta(days=1))
    try:
        assert not query.awaitTermination(15) and query.lastProgress is not None
    finally:
        query.stop()


def test_keyed_state_holds_many_series_in_a_shard(spark, tmp_path):
    src, at = str(tmp_path / "in"), lambda p: str(tmp_path / p)
    rows = [reading(15 * i, 90 if i == 30 + s % 9 else 10 + (i + s) % 3, ts_id=s) for s in range(60) for i in range(45)]
    for name, part in (("a", rows[1::2]), ("b", rows[::2] + [reading(-60 * 24 * 30, 1, ts_id=7), (None, "gas", T0, 3.0, "kWh")])):
        land(spark, src, name, part)
        written = keyed_run(spark, src, at, shards=4, late=dt.timedelta(days=20))
    assert spark.read.format("statestore").option("stateVarName", "buffer").load(at("check")).count() <= 4
    assert verdict_rows(keyed.verdicts(written)) == verdict_rows(ts.anomalies(spark.createDataFrame(rows, schemas.READING))) != []
    assert [(r["ts_id"], r["value"]) for r in keyed.refused(written).collect()] == [(7, 1.0)]


def test_time_to_live_drops_buffers_but_not_the_newest_time(spark, tmp_path):
    src, at = str(tmp_path / "in"), lambda p: str(tmp_path / p)
    land(spark, src, "a", [reading(15 * i, 10 + i % 4) for i in range(20)])
    stream = open_stream(spark, src, dedup=False)
    query = keyed.anomaly_changes(stream, at("out"), at("check"), every="1 second", keep=dt.timedelta(seconds=4), late=dt.timedelta(hours=1))
    try:
        assert not query.awaitTermination(25)
    finally:
        query.stop()
    held = spark.read.format("statestore").option("stateVarName", "buffer").load(at("check")).collect()
    assert [(len(r["value"]["us"]), len(r["value"]["newest"])) for r in held] == [(0, 1)]


@pytest.mark.parametrize("length, step", [("24 hours", "1 hour"), ("100 minutes", "30 minutes"), ("1 hour", "1 hour")])
def test_sliding_windows_over_batches_keep_each_reading_once(spark, tmp_path, length, step):
    src, at = str(tmp_path / "in"), lambda p: str(tmp_path / p)
    rows = [reading(37 * i * (1 + i % 2), 1e6 + i % 7, ts_id=1 + i % 3) for i in range(180)] + [reading(60 * 24 * 40, 5), reading(60 * 24 * 40, 5)]
    rows[11] = rows[11][:3] + (None,) + rows[11][4:]
    rows.sort(key=lambda r: r[2])
    # the second landing holds readings of windows that are still open
    for name, part in (("a", rows[:50] + rows[50:60:2]), ("b", rows[51:60:2] + rows[60:120]), ("c", rows[120:])):
        land(spark, src, name, part)
        S.sliding(open_stream(spark, src, dedup=False), at("out"), at("history"), at("check"), length, step).awaitTermination()
    got, newest = spark.read.parquet(at("out")), max(r[2] for r in rows)
    want = spark.createDataFrame(rows, schemas.READING).groupBy(F.window(F.col("recorded_at").cast("timestamp"), length, step).alias("w"), *ts.SERIES).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n")).filter(F.col("w.end") <= F.lit(newest) - F.expr(f"INTERVAL {S.LATE}"))
    columns = [*ts.SERIES, "ts", "ts_end", "n", F.round("mean", 6), F.round("std", 6)]
    assert sorted(got.select(columns).collect(), key=str) == sorted(want.withColumns({"ts": F.col("w.start"), "ts_end": F.col("w.end")}).select(columns).collect(), key=str) != []
    assert spark.read.parquet(at("history") + "/readings").count() == len(rows)
