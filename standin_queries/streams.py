"""Streams over the landed event files, run to completion into files on the shared folder."""

from __future__ import annotations

import os
import uuid
from datetime import timedelta

from pyspark.sql import Window, functions as F

from parcelwatt.operators import timeseries as ts
from parcelwatt.session import shared_dir
from parcelwatt.streaming import keyed, streams as S
from standin_queries.base import READING, R, TS, query, reading_columns, rounded, table
from standin_queries.meters import ANOMALY, Z

# Windows still open at the end of an append-mode stream: those ending after the newest event minus 48 hours.
_OPEN = "(SELECT max(ts) - INTERVAL 48 HOURS FROM events)"


def _folder(spark, name):
    base = os.path.join(shared_dir(spark), f"stream-{name}-{uuid.uuid4().hex}")
    return lambda part: os.path.join(base, part)


def _stream(spark, sf, **options):
    schema = table(spark, sf, "events").schema
    return S.readings(spark, sf, schema, reading_columns, pathGlobFilter="events.parquet", **options)


def _run(q):
    q.awaitTermination()


@query("stream_dedup", f"""WITH {READING} SELECT meter_type, count(*) AS n, {R('sum(value)', 3)} AS total FROM reading GROUP BY 1""")
def stream_dedup(spark, sf):
    """Every reading lands twice."""
    at = _folder(spark, "dedup")
    events = table(spark, sf, "events")
    for name in ("a", "b"):
        events.write.parquet(at(f"in/{name}"))
    stream = S.readings(spark, at("in"), events.schema, reading_columns, recursiveFileLookup="true")
    _run(S.to_files(stream, at("out"), at("check")))
    return rounded(spark.read.parquet(at("out")).groupBy("meter_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 3, "total")


def _windows(step, length):
    return f"""WITH {READING} SELECT ts_id, meter_type, {TS(f"CAST(date_trunc('{step}', recorded_at) AS TIMESTAMP)")} AS ts, {R('sum(value)', 3)} AS value, count(*) AS n FROM reading
 WHERE date_trunc('{step}', recorded_at) + INTERVAL {length} <= {_OPEN} GROUP BY 1, 2, 3"""


@query("stream_resample", _windows("day", "1 DAY"))
def stream_resample(spark, sf):
    at = _folder(spark, "resample")
    _run(S.to_files(S.resample(_stream(spark, sf, dedup=False), "daily"), at("out"), at("check")))
    return rounded(spark.read.parquet(at("out")), 3, "value")


@query("stream_weekly", _windows("week", "7 DAYS"))
def stream_weekly(spark, sf):
    at = _folder(spark, "weekly")
    _run(S.to_files(S.resample(_stream(spark, sf, dedup=False), "weekly"), at("out"), at("check")))
    return rounded(spark.read.parquet(at("out")), 3, "value")


@query("stream_sliding", f"""WITH {READING}, s AS (SELECT *, unnest(range(0, 24)) AS k FROM reading), w AS (SELECT *, date_trunc('hour', recorded_at) - k * INTERVAL 1 HOUR AS ts FROM s)
 SELECT ts_id, meter_type, {TS('CAST(ts AS TIMESTAMP)')} AS ts, {R('avg(value)', 4)} AS mean, {R('stddev_pop(value)', 4)} AS std, count(*) AS n FROM w WHERE w.ts + INTERVAL 24 HOURS <= {_OPEN} GROUP BY ts_id, meter_type, w.ts""")
def stream_sliding(spark, sf):
    at = _folder(spark, "sliding")
    _run(S.sliding(_stream(spark, sf, dedup=False), at("out"), at("history"), at("check")))
    return rounded(spark.read.parquet(at("out")).drop("ts_end", "batch"), 4, "mean", "std")


@query("stream_latest", f"""WITH {READING} SELECT ts_id, meter_type, {TS('recorded_at')} AS recorded_at, value FROM reading QUALIFY row_number() OVER (PARTITION BY ts_id, meter_type ORDER BY recorded_at DESC, value DESC) = 1""")
def stream_latest(spark, sf):
    at = _folder(spark, "latest")
    _run(S.to_snapshot(S.latest(_stream(spark, sf, dedup=False)), at("out"), at("check")))
    return spark.read.parquet(at("out"))


@query("stream_anomaly", f"""WITH {READING}, {ANOMALY} SELECT ts_id, meter_type, {TS('detected_at')} AS detected_at, {R('window_mean', 4)} AS window_mean, {R('window_std', 4)} AS window_std, offending_value, {R('z_score', 3)} AS z_score FROM anomaly""")
def stream_anomaly(spark, sf):
    at = _folder(spark, "anomaly")
    _run(S.anomalies(_stream(spark, sf, dedup=False), at("history"), at("events"), at("check"), min_count=2, z=Z))
    found = spark.read.parquet(at("events")).drop("day")
    return rounded(rounded(found, 4, "window_mean", "window_std"), 3, "z_score")


_STALE = "INTERVAL 10 YEARS"


@query("stream_keyed_anomaly", f"""WITH {READING}, {ANOMALY} SELECT 'anomaly' AS kind, ts_id, meter_type, {TS('detected_at')} AS at, {R('window_mean', 4)} AS window_mean, {R('window_std', 4)} AS window_std, offending_value AS value, {R('z_score', 3)} AS z_score FROM anomaly
 UNION ALL SELECT 'late', ts_id, meter_type, {TS(f'recorded_at - {_STALE}')}, NULL, NULL, value, NULL FROM reading""")
def stream_keyed_anomaly(spark, sf):
    """Keyed state over readings that land in disorder, some twice, with a copy of each that is ten years old."""
    at = _folder(spark, "keyed")
    events = table(spark, sf, "events")
    second = F.pmod(F.xxhash64("user_id", "ts", "event_type"), F.lit(2)) == 1
    stale = events.withColumn("ts", F.col("ts") - F.expr(_STALE))
    # the first landing holds the newest reading of every series, so that the stale copies find it
    newest = Window.partitionBy("user_id", "event_type")
    first = events.withColumn("_new", F.max("ts").over(newest)).filter(~second | (F.col("ts") == F.col("_new"))).drop("_new")
    for name, part in (("a", first), ("b", events.filter(second).unionByName(first).unionByName(stale))):
        part.write.parquet(at(f"in/{name}"))
        stream = S.readings(spark, at("in"), events.schema, reading_columns, dedup=False, recursiveFileLookup="true")
        _run(keyed.anomaly_changes(stream, at("out"), at("check"), late=timedelta(days=60), min_count=2, z=Z))
    written = keyed.said(spark, at("out"))
    none = F.lit(None).cast("double")
    found = keyed.verdicts(written).select(F.lit("anomaly").alias("kind"), *ts.SERIES, F.col("detected_at").alias("at"), "window_mean", "window_std", F.col("offending_value").alias("value"), "z_score")
    late = keyed.refused(written).select(F.lit("late").alias("kind"), *ts.SERIES, F.col("recorded_at").alias("at"), none.alias("window_mean"), none.alias("window_std"), "value", none.alias("z_score"))
    return rounded(rounded(found.unionByName(late), 4, "window_mean", "window_std"), 3, "z_score")


@query("stream_events", f"""WITH {READING}, {ANOMALY} SELECT ts_id, meter_type, {TS('detected_at')} AS detected_at, offending_value FROM anomaly""")
def stream_events(spark, sf):
    """Anomaly events as JSON lines."""
    at = _folder(spark, "events")
    _run(S.anomalies(_stream(spark, sf, dedup=False), at("history"), at("found"), at("check"), min_count=2, z=Z))
    found = spark.readStream.schema(spark.read.parquet(at("found")).schema).parquet(at("found")).drop("day")
    _run(S.to_files(found, at("out"), at("check2"), fmt="json"))
    return spark.read.schema("ts_id LONG, meter_type STRING, detected_at TIMESTAMP, offending_value DOUBLE").json(at("out"))


@query("stream_weather")
def stream_weather(spark, sf):
    at = _folder(spark, "weather")
    raw = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    obs = raw.select(
        (F.col("user_id") % 10).cast("int").alias("grid_x"), F.lit(0).alias("grid_y"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("measured_at"),
        (F.col("value") % 360).alias("wind_direction"), (F.col("value") / 20).alias("wind_speed"))
    _run(S.weather(obs, at("obs"), at("current"), at("check")))
    return spark.read.parquet(at("current"))


