"""Meter, weather, shelter, certificate and simulation readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelwatt import schemas
from parcelwatt.functions import hazard
from parcelwatt.functions.geo import in_bbox
from parcelwatt.functions.rounding import filled
from parcelwatt.sources.buildings import allow_encoding, detect_encoding

# Header names of time and value columns, and time formats of meter files.
TIME_HEADERS = {"측정시각", "검침일시", "datetime", "ts", "timestamp", "date_time", "time"}
VALUE_HEADERS = {"전력량(kwh)", "사용량(m3)", "value", "kwh", "consumption", "usage"}
TIME_FORMATS = ("y-M-d H:m:s", "y-M-d'T'H:m:s", "y/M/d H:m", "yyyyMMddHHmm", "y-M-d H:m", "yyyyMMdd H:m")


def parse_time(col: Column) -> Column:
    text = F.trim(col)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in TIME_FORMATS])


def meter_columns(header: list[str]) -> tuple[str, str]:
    """Time and value column of a meter file: by known names, else the first two."""
    clean = [h.lstrip("﻿").strip().lower() for h in header]
    pick = lambda known, at: next((h for h, c in reversed(list(zip(header, clean))) if c in known), header[at] if len(header) > at else None)
    ts, value = pick(TIME_HEADERS, 0), pick(VALUE_HEADERS, 1)
    if ts is None or value is None:
        raise ValueError("a meter file needs a time and a value column")
    return ts, value


def parse_meter_rows(raw: DataFrame, ts_id: int, meter: str, unit: str) -> tuple[DataFrame, DataFrame]:
    """Text rows -> (readings, rejects); rejects keep the raw texts."""
    ts, value = (F.col("`" + c.replace("`", "``") + "`") for c in meter_columns(raw.columns))
    parsed = raw.select(
        ts.alias("raw_ts"), value.alias("raw_value"), parse_time(ts).alias("recorded_at"),
        F.regexp_replace(F.trim(value), ",", "").try_cast("double").alias("value"),
    )
    ok = F.col("recorded_at").isNotNull() & F.col("value").isNotNull()
    good = parsed.filter(ok).select(F.lit(ts_id).cast("long").alias("ts_id"), F.lit(meter).alias("meter_type"), "recorded_at", "value", F.lit(unit).alias("unit"))
    return good, parsed.filter(~ok).select("raw_ts", "raw_value")


def read_meter_csv(spark: SparkSession, path: str, ts_id: int, meter: str, unit: str = "kWh", encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Meter CSV of any size -> (readings, rejects)."""
    enc = allow_encoding(spark, encoding or detect_encoding(spark, path))
    raw = spark.read.option("header", True).option("encoding", enc).option("mode", "PERMISSIVE").csv(path)
    return parse_meter_rows(raw, ts_id, meter, unit)


def read_weather_text(spark: SparkSession, path: str, encoding: str = "EUC-KR") -> DataFrame:
    """Wind from the forecast text feed: region, forecast time, direction, speed."""
    raw = spark.read.option("encoding", allow_encoding(spark, encoding)).option("sep", "\u0001").option("quote", "").option("header", False).csv(path)
    return weather_from_lines(raw.toDF("value"))


def weather_from_lines(lines: DataFrame) -> DataFrame:
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(~F.trim("value").startswith("#") & (F.size(p) >= 12))
    direction = hazard.compass_degrees(p[11], p[9])
    return rows.select(
        p[0].alias("reg"), F.try_to_timestamp(p[2], F.lit("yyyyMMddHHmm")).alias("measured_at"),
        direction.alias("wind_direction"), hazard.wind_level_speed(p[10]).alias("wind_speed"),
    ).filter(F.col("wind_direction").isNotNull())


WEATHER_PAGE = (
    "response STRUCT<body: STRUCT<items: STRUCT<item: ARRAY<STRUCT<category: STRING, fcstDate: STRING, fcstTime: STRING, "
    "fcstValue: STRING, nx: INT, ny: INT>>>>>"
)


def read_weather_json(spark: SparkSession, path: str) -> DataFrame:
    pages = spark.read.schema(WEATHER_PAGE).option("multiLine", True).json(path)
    return weather_from_items(pages.select(F.explode("response.body.items.item").alias("i")).select("i.*"))


def weather_from_items(items: DataFrame) -> DataFrame:
    """Pivot VEC / WSD items of a grid and time into wind direction and speed (both required)."""
    wide = (
        items.groupBy("nx", "ny", "fcstDate", "fcstTime").pivot("category", ["VEC", "WSD"])
        .agg(F.max(F.col("fcstValue").try_cast("double")))
    )
    return wide.filter("VEC IS NOT NULL AND WSD IS NOT NULL").select(
        F.col("nx").alias("grid_x"), F.col("ny").alias("grid_y"), F.col("VEC").alias("wind_direction"), F.col("WSD").alias("wind_speed"),
        F.try_to_timestamp(F.concat("fcstDate", "fcstTime"), F.lit("yyyyMMddHHmm")).alias("measured_at"),
    )


SHELTER_PAGE = (
    "TBSHLTRRSVTBSH STRUCT<row: ARRAY<STRUCT<FCLT_NM: STRING, XCRD: STRING, REFINE_ROADNM_ADDR: STRING, "
    "REFINE_WGS84_LOGT: STRING, REFINE_WGS84_LAT: STRING>>>"
)


def read_shelters(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Shelters, capacity as a number or null; with ``bbox`` (west, south, east, north) only those inside it."""
    pages = spark.read.schema(SHELTER_PAGE).option("multiLine", True).json(path)
    r = pages.select(F.explode("TBSHLTRRSVTBSH.row").alias("r")).select("r.*")
    df = r.select(
        F.coalesce("FCLT_NM", F.lit("대피소")).alias("name"), F.lit("지정대피소").alias("category"),
        F.col("XCRD").try_cast("int").alias("capacity"), F.coalesce("REFINE_ROADNM_ADDR", F.lit("")).alias("address"),
        F.col("REFINE_WGS84_LOGT").try_cast("double").alias("lng"), F.col("REFINE_WGS84_LAT").try_cast("double").alias("lat"),
    )
    return df if bbox is None else df.filter(in_bbox(F.col("lng"), F.col("lat"), *bbox))


MONTHLY_PAGE = "pnu STRING, useYm STRING, useQty STRING, elecUseQnt STRING, gasUseQnt STRING"


def read_monthly(spark: SparkSession, path: str) -> DataFrame:
    """Landed monthly consumption items (JSON lines): pnu, ym, kwh."""
    raw = spark.read.schema(MONTHLY_PAGE).json(path)
    filled_number = lambda c: F.nullif(F.col(c).try_cast("double"), F.lit(0.0))
    return raw.select("pnu", F.col("useYm").alias("ym"), F.coalesce(*[filled_number(c) for c in ("useQty", "elecUseQnt", "gasUseQnt")], F.lit(0.0)).alias("kwh"))


CERTIFICATE_PAGE = (
    "response STRUCT<body: STRUCT<items: STRUCT<item: ARRAY<STRUCT<RGN_SCT_NAME: STRING, LOC_ADDR: STRING, "
    "W_1ST_ENERGY_REQUIRE6: STRING, BLD_NM: STRING, GRD_NAME: STRING>>>>>"
)


def read_certificates(spark: SparkSession, path: str, region: str | None = None) -> DataFrame:
    """Efficiency certificates with an address and a numeric demand, of one region where given."""
    pages = spark.read.schema(CERTIFICATE_PAGE).option("multiLine", True).json(path)
    i = pages.select(F.explode("response.body.items.item").alias("i")).select("i.*")
    if region is not None:
        i = i.filter(F.col("RGN_SCT_NAME") == region)
    df = i.select(
        filled(F.col("LOC_ADDR")).alias("address"), F.col("W_1ST_ENERGY_REQUIRE6").try_cast("double").alias("eui"),
        F.col("BLD_NM").alias("bld_nm"), F.col("GRD_NAME").alias("grade"),
    ).filter("address IS NOT NULL AND eui IS NOT NULL")
    return df.withColumn("id", F.xxhash64("address", "bld_nm", "eui", "grade"))


SIM_METADATA = "ems STRING, building STRING, city STRING, validation STRUCT<valid: BOOLEAN, energy_j: DOUBLE>"


def read_sim_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Simulation metadata (JSON lines): ems, building, city, valid, energy_j."""
    raw = spark.read.schema(SIM_METADATA).json(path)
    return raw.select("ems", "building", "city", F.coalesce("validation.valid", F.lit(False)).alias("valid"), F.col("validation.energy_j").alias("energy_j"))


# Run name layout and the cities and vintages it may contain.
RUN_PATTERN = (
    r"^(.+)_(v1_pre1990|v2_1991_2000|v3_2001_2010|v4_2011_2017|v5_2018_plus)_"
    r"(seoul|busan|daegu|gangneung|jeju|chuncheon|wonju|incheon|daejeon|sejong|gwangju|ulsan)_tmy_p\d+$"
)


def parse_run_id(col: Column) -> Column:
    """archetype, vintage, city of a run name; null for other names."""
    part = lambda i: F.regexp_extract(col, RUN_PATTERN, i)
    return F.when(
        col.rlike(RUN_PATTERN),
        F.struct(part(1).alias("archetype"), F.regexp_replace(part(2), r"^v\d_", "").alias("vintage"), part(3).alias("city")),
    )


def read_hourly_runs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Long-form hourly results (run_id, hour, kwh) with the parts of the run name."""
    raw = spark.read.format(fmt).option("header", True).load(path)
    df = raw.select("run_id", F.col("hour").try_cast("int").alias("hour"), F.col("kwh").try_cast("double").alias("kwh"))
    return df.withColumn("_r", parse_run_id(F.col("run_id"))).filter("_r IS NOT NULL").select("run_id", "hour", "kwh", "_r.*")


def read_tier1_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pnu STRING, eui DOUBLE, usage_type STRING, built_year INT").option("header", True).csv(path)


def read_shelter_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SHELTER).parquet(path)
