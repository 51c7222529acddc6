"""Writers: snapshots, partitioned readings, region replace, exports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelwatt.operators.query import EXPORT_COLUMNS


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def rebalanced(df: DataFrame, *columns: str) -> DataFrame:
    """Gather rows by folder column before a partitioned write; large folders are split, small ones joined."""
    return df.sparkSession.sql(f"SELECT /*+ REBALANCE({', '.join(columns)}) */ * FROM {{rows}}", rows=df)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace the table at ``path``: written beside it first, then swapped, so readers of the old
    snapshot (also ``df`` itself) are complete before it goes.

    The old table is moved aside and deleted only once the new one is in place; if that fails it is moved back.
    A run that died between the moves leaves it at ``path``.old, and the next run brings it back first."""
    spark = df.sparkSession
    target, fs, jvm = _fs(spark, path)
    beside, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in (".next", ".old"))
    if fs.exists(old) and not fs.exists(target):
        fs.rename(old, target)
    df.write.mode("overwrite").parquet(beside.toString())
    fs.delete(old, True)
    replaced = fs.exists(target)
    if replaced and not fs.rename(target, old):
        raise OSError(f"could not move the old snapshot at {path} aside")
    if not fs.rename(beside, target):
        if replaced:
            fs.rename(old, target)
        raise OSError(f"could not move the new snapshot to {path}")
    fs.delete(old, True)


def write_readings(df: DataFrame, path: str, when: str = "recorded_at", mode: str = "append") -> None:
    """Append by year and month."""
    parts = df.withColumns({"year": F.year(when), "month": F.month(when)})
    rebalanced(parts, "year", "month").write.mode(mode).partitionBy("year", "month").parquet(path)


def read_readings(spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None, when: str = "recorded_at") -> DataFrame:
    """Readings of a closed time range; the range also prunes the month folders."""
    df = spark.read.parquet(path)
    ym = F.col("year") * 12 + F.col("month")
    if start is not None:
        df = df.filter((ym >= start.year * 12 + start.month) & (F.col(when) >= F.lit(start)))
    if end is not None:
        df = df.filter((ym <= end.year * 12 + end.month) & (F.col(when) <= F.lit(end)))
    return df.drop("year", "month")


def write_predictions(df: DataFrame, path: str) -> None:
    rebalanced(df.withColumn("year", F.year("predicted_at")), "year").write.mode("append").partitionBy("year").parquet(path)


def replace_region(df: DataFrame, path: str, key: str = "pnu") -> None:
    """Replace exactly the districts present in ``df``; other districts stay untouched."""
    (
        rebalanced(df.withColumn("sgg", F.substring(key, 1, 5)), "sgg").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("sgg").parquet(path)
    )


def export_csv(df: DataFrame, path: str) -> None:
    """The fixed export columns as CSV with a header; nulls are empty."""
    df.select(*EXPORT_COLUMNS).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def export_geojson_lines(df: DataFrame, path: str, properties: list[str], lng: str = "lng", lat: str = "lat") -> None:
    """One GeoJSON Feature per line."""
    from parcelwatt.functions.geo import point_geojson, to_feature

    df.select(to_feature(point_geojson(F.col(lng), F.col(lat)), properties).alias("value")).write.mode("overwrite").text(path)


def merge_evolved(spark: SparkSession, path: str, defaults: dict) -> DataFrame:
    """Read a table whose columns were added over time, filling missing values with defaults."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    return df.withColumns({c: F.coalesce(F.col(c) if c in df.columns else F.lit(None), F.lit(v)) for c, v in defaults.items()})
