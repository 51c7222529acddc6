"""Structured Streaming forms of the meter and weather jobs.

Event time is ``recorded_at`` as TIMESTAMP. Late rows are judged for 48 hours.
"""

from __future__ import annotations

from datetime import timedelta
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelwatt.operators import timeseries as ts
from parcelwatt.operators.fire import current_wind
from parcelwatt.operators.upsert import insert_ignore

LATE = "48 hours"
KEY = ["ts_id", "meter_type", "recorded_at"]


def readings(spark: SparkSession, path: str, schema: str, prepare: Callable[[DataFrame], DataFrame] | None = None,
             late: str = LATE, dedup: bool = True, **options) -> DataFrame:
    """Stream of readings from landed Parquet files, each (ts_id, meter_type, recorded_at) once.

    ``prepare`` maps file columns to the reading columns.
    """
    raw = spark.readStream.schema(schema).options(**options).parquet(path)
    df = prepare(raw) if prepare else raw
    df = df.withColumn("recorded_at", F.col("recorded_at").cast("timestamp")).withWatermark("recorded_at", late)
    return df.dropDuplicatesWithinWatermark(KEY) if dedup else df


def resample(stream: DataFrame, resolution: str) -> DataFrame:
    """Tumbling hour, day or Monday-week sums."""
    window = {
        "hourly": F.window("recorded_at", "1 hour"),
        "daily": F.window("recorded_at", "1 day"),
        "weekly": F.window("recorded_at", "7 days", "7 days", "4 days"),
    }[resolution]
    agg = stream.groupBy(window.alias("w"), *ts.SERIES).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return agg.select(*ts.SERIES, F.col("w.start").alias("ts"), "value", "n")


_WINDOW = [("ts", "timestamp"), ("ts_end", "timestamp"), ("mean", "double"), ("std", "double"), ("n", "long")]


def _micros(spark: SparkSession, span: str) -> int:
    return spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {span}"))).first()[0]


def _window_runs(rows: DataFrame, length: int, step: int, after: int, until: int) -> DataFrame:
    """Runs of sliding windows that hold the same readings: ts_id, meter_type, first and last start, mean, std, n, in microseconds.

    ``rows``: ts_id, meter_type, us, value. Windows that end after ``after`` and not after ``until``. A reading enters one window and leaves another; in
    between nothing changes, so the windows are computed at these two starts only. Series are cut into blocks of starts, which take the readings
    their windows need.
    """
    us, block = F.col("us"), step * -(-32 * length // step)
    on_step = lambda v: F.floor(v / F.lit(step)) * step
    # first and last start of the windows that hold a reading, within those asked for
    enter = F.greatest(on_step(us - length) + step, F.lit((after - length) // step * step + step))
    last = F.least(on_step(us), F.lit((until - length) // step * step))
    held = rows.select(*ts.SERIES, "us", "value", enter.alias("_in"), last.alias("_last")).filter("_in <= _last")
    held = held.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_in") / F.lit(block)), F.floor(F.col("_last") / F.lit(block)))))
    key, start = [*ts.SERIES, "_block"], F.col("_block") * block
    marks = held.select(*key, F.explode(F.array(F.greatest("_in", start), F.col("_last") + step)).alias("us")).filter(us < start + block).distinct()
    both = held.select(*key, "us", "value", F.lit(False).alias("_mark")).unionByName(marks.select(*key, "us", F.lit(None).cast("double").alias("value"), F.lit(True).alias("_mark")))
    seen = Window.partitionBy(*key).orderBy("us").rangeBetween(0, length - 1)
    runs = both.withColumns({"mean": F.avg("value").over(seen), "std": F.stddev_pop("value").over(seen), "n": F.count(F.when(~F.col("_mark"), 1)).over(seen)}).filter("_mark")
    following = F.lead("us").over(Window.partitionBy(*key).orderBy("us"))
    latest_start = F.least(F.coalesce(following, start + block) - step, F.lit((until - length) // step * step))
    return runs.select(*ts.SERIES, F.col("us").alias("first"), latest_start.alias("last"), "mean", "std", "n").filter("n > 0 AND first <= last")


def sliding(stream: DataFrame, path: str, history_path: str, checkpoint: str, length: str = "24 hours", step: str = "1 hour", late: str = LATE) -> StreamingQuery:
    """Mean, population deviation and count per sliding window that has closed, as Parquet files: ts_id, meter_type, ts, ts_end, mean, std, n.

    A window closes ``late`` behind the newest reading; a reading counts in those still open. Readings are kept once, by day under
    ``history_path``, and not once for each window that holds them; a batch reads the days of the windows it closes. A batch
    that is run again replaces what it wrote.
    """
    spark = stream.sparkSession
    length_us, step_us, late_us = (_micros(spark, v) for v in (length, step, late))

    def step_of(batch: DataFrame, number: int) -> None:
        spark, mine = batch.sparkSession, f"batch={number}"
        earlier = lambda folder: (df := _read_or_none(spark, folder)) and df.filter(F.col("batch") < number)
        rows = batch.select(*ts.SERIES, F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("us"), F.col("value").cast("double").alias("value")).filter("us IS NOT NULL")
        rows.withColumn("day", F.floor(F.col("us") / F.lit(86_400_000_000))).write.mode("overwrite").partitionBy("day").parquet(f"{history_path}/readings/{mine}")
        seen = earlier(f"{history_path}/newest")
        before = seen.agg(F.max("us")).first()[0] if seen is not None else None
        if before is None:
            first, newest = rows.agg(F.min("us"), F.max("us")).first()
        else:
            newest = max(before, rows.agg(F.max("us")).first()[0] or before)
        if newest is None:
            batch.limit(0).select(*ts.SERIES, *[F.lit(None).cast(t).alias(c) for c, t in _WINDOW]).write.mode("overwrite").parquet(f"{path}/{mine}")
            return
        after = before - late_us if before is not None else first - 1
        until = newest - late_us
        held = spark.read.option("basePath", f"{history_path}/readings").parquet(f"{history_path}/readings")
        days = F.col("day").between((after - length_us) // 86_400_000_000, until // 86_400_000_000)
        runs = _window_runs(held.filter(days & (F.col("batch") <= number)), length_us, step_us, after, until)
        windows = runs.withColumn("us", F.explode(F.sequence("first", "last", F.lit(step_us).cast("long"))))
        out = windows.select(*ts.SERIES, F.timestamp_micros("us").alias("ts"), F.timestamp_micros(F.col("us") + length_us).alias("ts_end"), "mean", "std", "n")
        out.write.mode("overwrite").parquet(f"{path}/{mine}")
        spark.range(1).select(F.lit(newest).alias("us")).coalesce(1).write.mode("overwrite").parquet(f"{history_path}/newest/{mine}")

    return stream.writeStream.foreachBatch(step_of).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(stream: DataFrame) -> DataFrame:
    """Newest value of every series (update or complete mode)."""
    return stream.groupBy(*ts.SERIES).agg(
        F.max("recorded_at").alias("recorded_at"), F.max(F.struct("recorded_at", "value"))["value"].alias("value")
    )


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(p) else None


def anomalies(stream: DataFrame, history_path: str, events_path: str, checkpoint: str,
              window: timedelta = timedelta(hours=24), **rule) -> StreamingQuery:
    """Exact rolling z-score per reading with batch parity; new anomalies land as Parquet files.

    Every micro-batch is joined to the readings of the window around it (kept by day under
    ``history_path``): all readings that the batch may change are judged again, and anomalies not yet
    under ``events_path`` are appended. Re-running a batch after a failure adds nothing twice. A batch reads the days its
    readings span; ``keyed`` reads none, and refuses readings that come too late.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*KEY, "value").persist()
        low, high = rows.agg(F.min("recorded_at"), F.max("recorded_at")).first()
        if low is None:
            rows.unpersist()
            return
        past = _read_or_none(spark, history_path)
        start, end = low - window, high + window
        if past is not None:
            near = past.filter(F.col("day").between(F.lit(start.date()), F.lit(end.date()))).select(*KEY, "value")
            fresh = insert_ignore(near, rows, KEY, [F.col("value")])
        else:
            near, fresh = rows.limit(0), insert_ignore(rows.limit(0), rows, KEY, [F.col("value")])
        fresh = fresh.persist()
        touched = fresh.select(*ts.SERIES).distinct()
        span = near.filter(F.col("recorded_at").between(F.lit(start), F.lit(end))).unionByName(fresh).join(touched, ts.SERIES, "left_semi")
        found = ts.anomalies(span, window, **rule).filter(F.col("detected_at").between(F.lit(low), F.lit(end)))
        known = _read_or_none(spark, events_path)
        key = [*ts.SERIES, "detected_at"]
        if known is not None:
            recent = known.filter(F.col("day").between(F.lit(start.date()), F.lit(end.date())))
            found = found.join(recent.select(*key), key, "left_anti")
        by_day = lambda df, c: df.withColumn("day", F.to_date(c)).write.mode("append").partitionBy("day").parquet
        by_day(found, "detected_at")(events_path)
        by_day(fresh, "recorded_at")(history_path)
        fresh.unpersist()
        rows.unpersist()

    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> StreamingQuery:
    """Append-mode file sink; processes what has landed and stops."""
    return (
        stream.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")  # text formats keep milliseconds only by default
        .trigger(availableNow=True).start()
    )


def to_snapshot(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Complete-mode result kept as one overwritten snapshot."""
    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weather(stream: DataFrame, path: str, current_path: str, checkpoint: str) -> StreamingQuery:
    """Append new observations once per (grid_x, grid_y, measured_at) and refresh the current wind.

    Observations are kept by day; a batch touches only its own days and the newest one.
    """
    keys = ["grid_x", "grid_y", "measured_at"]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("day", F.to_date("measured_at")).persist()
        low, high = rows.agg(F.min("day"), F.max("day")).first()
        if low is not None:
            past, shown = _read_or_none(spark, path), _read_or_none(spark, current_path)
            known = rows.limit(0) if past is None else past.filter(F.col("day").between(F.lit(low), F.lit(high)))
            one = insert_ignore(known, rows, keys, [F.col("wind_direction"), F.col("wind_speed")])
            one.write.mode("append").partitionBy("day").parquet(path)
            newest = max([high] + ([r.measured_at.date() for r in shown.take(1)] if shown is not None else []))
            latest_day = spark.read.parquet(path).filter(F.col("day") >= F.lit(newest))
            current_wind(latest_day).write.mode("overwrite").parquet(current_path)
        rows.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
