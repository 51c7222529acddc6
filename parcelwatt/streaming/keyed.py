"""Rolling anomalies with keyed state: each series keeps the readings its next verdicts need, and no history is read again.

A series holds the readings of the last ``late + window`` before its newest one. A new reading changes the verdicts of
readings in the ``window`` after it; those that differ from what was said before go out as changes: ``anomaly`` with its figures, or
``retracted``. The newest change of a reading is its verdict, so after every batch ``verdicts`` equals the batch rule on all readings
taken so far, whatever their order. Readings older than the newest of their series by more than ``late`` go out as ``late`` and take no part; a
reading that comes again is passed over. With ``keep``, buffers of series without readings for that long go (processing-time
timers, which need a query that runs on); the newest time of a series stays, so old readings are still refused.

A key of the state is a shard of series, because a key costs many calls to the state store and a series may have few readings. State,
and the work of a batch in one shard, follow the readings of its series in ``late + window``; ``shards`` keeps them small. A first
load of a long history should be admitted in time order by ``maxFilesPerTrigger``.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from parcelwatt.operators import timeseries as ts

SECOND = 1_000_000
CHANGES = "series string, us long, kind string, window_mean double, window_std double, value double, z_score double"
CHANGED = ["kind", "window_mean", "window_std", "value", "z_score"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(span: timedelta) -> int:
    return int(span.total_seconds() * SECOND)


def judge(us: np.ndarray, value: np.ndarray, first: int, window: int, min_count: int, z: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window mean, window deviation and score of the readings from position ``first`` on, by rising time; the score is 0 unless above ``z``."""
    n = len(us) - first
    mean, std, score = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n)
    low = np.searchsorted(us, us[first:] - window, "left")
    high = np.searchsorted(us, us[first:] - SECOND, "right")
    for i in np.flatnonzero(high - low >= min_count):
        seen = value[low[i]:high[i]]
        seen = seen[~np.isnan(seen)]
        own = value[first + i]
        if not len(seen) or np.isnan(own) or seen.min() == seen.max():
            continue
        mean[i], std[i] = seen.mean(), seen.std()
        if std[i] > 0 and abs(own - mean[i]) / std[i] > z:
            score[i] = abs(own - mean[i]) / std[i]
    return mean, std, score


BUFFER = "series array<string>, newest array<long>, touched array<long>, size array<long>, us array<long>, said binary"
SHARDS = 512
NEVER = np.iinfo(np.int64).min


class Rolling(StatefulProcessor):
    """State of a shard: of each series its newest time, the time it was touched, and its readings by rising time with the score last said of each."""

    def __init__(self, window: int, late: int, keep: int | None, min_count: int, z: float):
        self.window, self.late, self.keep, self.min_count, self.z = window, late, keep, min_count, z

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getValueState("buffer", BUFFER)

    def _held(self, now: int):
        """series, newest, touched; number of the series, time, and value, mean and score of the readings kept."""
        state = self.buffer.get()
        if state is None:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((3, 0))
        newest, touched, size, us = (np.asarray(c, np.int64) for c in state[1:5])
        owner, said = np.repeat(np.arange(len(size)), size), np.frombuffer(state[5], np.float64).reshape(3, -1)
        if self.keep is not None:
            live = (touched >= now - self.keep)[owner]
            owner, us, said = owner[live], us[live], said[:, live]
        return list(state[0]), newest, touched, owner, us, said

    def _hold(self, names: list[str], newest: np.ndarray, touched: np.ndarray, owner: np.ndarray, us: np.ndarray, said: np.ndarray, now: int) -> None:
        size = np.bincount(owner, minlength=len(names))
        self.buffer.update((names, newest.tolist(), touched.tolist(), size.tolist(), us.tolist(), np.ascontiguousarray(said).tobytes()))
        if self.keep is not None and size.any():
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
            self.handle.registerTimer(int(touched[size > 0].min()) + self.keep + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.keep is not None else 0
        names, newest, touched, owner, us, said = self._held(now)
        new = pd.concat(list(rows))
        code, found = pd.factorize(new["series"])
        number = {name: i for i, name in enumerate(names)}
        at = np.array([number.setdefault(name, len(number)) for name in found], np.int64)[code]
        names = list(number)
        more = len(names) - len(newest)
        newest, touched = np.append(newest, np.full(more, NEVER)), np.append(touched, np.full(more, now))
        new_us, new_value = new["us"].to_numpy(np.int64), new["value"].to_numpy(np.float64)
        refused = (newest[at] != NEVER) & (new_us < newest[at] - self.late)
        # held readings come before new ones of their time, those by rising value
        owner_all, us_all = np.append(owner, at[~refused]), np.append(us, new_us[~refused])
        said_all = np.concatenate([said, np.stack([new_value[~refused], *np.zeros((2, (~refused).sum()))])], axis=1)
        fresh = np.arange(len(us_all)) >= len(us)
        order = np.lexsort((said_all[0], fresh, us_all, owner_all))
        owner_all, us_all, said_all, fresh = owner_all[order], us_all[order], said_all[:, order], fresh[order]
        once = np.append(True, (owner_all[1:] != owner_all[:-1]) | (us_all[1:] != us_all[:-1])) if len(us_all) else np.zeros(0, bool)
        owner, us, said, fresh = owner_all[once], us_all[once], said_all[:, once], fresh[once]
        ends = np.searchsorted(owner, np.arange(len(names) + 1))
        mean, std, score = said[1].copy(), np.full(len(us), np.nan), said[2].copy()
        first_new = np.flatnonzero(fresh)
        series, place = np.unique(owner[first_new], return_index=True)
        for i, first in zip(series.tolist(), first_new[place].tolist()):
            low, high = ends[i], ends[i + 1]
            mean[first:high], std[first:high], score[first:high] = judge(us[low:high], said[0, low:high], first - low, self.window, self.min_count, self.z)
        changed = (score != said[2]) | ((score > 0) & (mean != said[1]))
        said = np.stack([said[0], np.where(score > 0, mean, 0.0), score])
        newest[series], touched[series] = np.maximum(newest[series], us[ends[series + 1] - 1]), now
        kept = us >= newest[owner] - self.late - self.window
        self._hold(names, newest, touched, owner[kept], us[kept], said[:, kept], now)
        labels = np.array(names, object)
        if refused.any():
            yield self._rows(labels[at[refused]], new_us[refused], "late", new_value[refused])
        if changed.any():
            kind = np.where(score[changed] > 0, "anomaly", "retracted")
            yield self._rows(labels[owner[changed]], us[changed], kind, said[0, changed], mean[changed], std[changed], score[changed])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        self._hold(*self._held(now), now)
        yield from ()

    @staticmethod
    def _rows(series, us, kind, value, mean=np.nan, std=np.nan, score=np.nan) -> pd.DataFrame:
        return pd.DataFrame({"series": series, "us": us, "kind": kind, "window_mean": mean, "window_std": std, "value": value, "z_score": score})

    def close(self) -> None:
        pass


def changes(stream: DataFrame, window: timedelta = timedelta(hours=24), late: timedelta = timedelta(hours=48), keep: timedelta | None = None,
            min_count: int = 6, z: float = 2.0, shards: int = SHARDS) -> DataFrame:
    """ts_id, meter_type, recorded_at, kind, window_mean, window_std, value, z_score: changes and refused rows of a stream of readings (no watermark needed)."""
    id_type = stream.schema["ts_id"].dataType.simpleString()
    series = F.to_json(F.struct(*ts.SERIES))
    times = stream.select(series.alias("series"), F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("us"), F.col("value").cast("double").alias("value"))
    keyed = times.filter("us IS NOT NULL").withColumn("shard", F.pmod(F.xxhash64("series"), F.lit(shards))).groupBy("shard")
    processor = Rolling(_micros(window), _micros(late), None if keep is None else _micros(keep) // 1000, min_count, z)
    mode = "None" if keep is None else "ProcessingTime"
    out = keyed.transformWithStateInPandas(processor, CHANGES, "Update", mode)
    return out.select(F.from_json("series", f"ts_id {id_type}, meter_type string").alias("_s"), F.timestamp_micros("us").alias("recorded_at"),
                      *CHANGED).select("_s.*", "recorded_at", *CHANGED)


def anomaly_changes(stream: DataFrame, path: str, checkpoint: str, every: str | None = None, **rule) -> StreamingQuery:
    """Writes the changes of each batch under ``path``/batch=<number>; a batch that is run again replaces its own folder.

    Runs over what has landed and stops, or runs on with a batch ``every`` so often. The state store is RocksDB, as keyed state needs.
    """
    if rule.get("keep") is not None and every is None:
        raise ValueError("keep needs a query that runs on: with a time to live there is always another batch, so it would never stop")
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)  # a started query keeps the settings it was started with
    try:
        writer = changes(stream, **rule).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
    finally:
        spark.conf.set(name, before)


def said(spark: SparkSession, path: str) -> DataFrame:
    """All changes written so far, with the number of their batch."""
    return spark.read.option("basePath", path).parquet(path)


def verdicts(written: DataFrame) -> DataFrame:
    """The anomalies that stand, from the written changes: the newest change of each reading, unless it was retracted."""
    key = [*ts.SERIES, "recorded_at"]
    last = written.filter("kind <> 'late'").groupBy(*key).agg(F.max_by(F.struct("kind", "window_mean", "window_std", "value", "z_score"), "batch").alias("_m"))
    return last.filter("_m.kind = 'anomaly'").select(
        *ts.SERIES, F.col("recorded_at").alias("detected_at"), "_m.window_mean", "_m.window_std", F.col("_m.value").alias("offending_value"), "_m.z_score")


def refused(written: DataFrame) -> DataFrame:
    """Readings that came too late."""
    return written.filter("kind = 'late'").select(*ts.SERIES, "recorded_at", "value")
