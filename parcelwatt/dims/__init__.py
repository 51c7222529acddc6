"""Fixed-size dimension tables shipped with the package, as local relations."""

from __future__ import annotations

import csv
from importlib import resources

from pyspark.sql import DataFrame, SparkSession

from parcelwatt.dims import values as V


def _rows(name: str) -> list[dict[str, str]]:
    text = resources.files(__package__).joinpath(name).read_text(encoding="utf-8")
    return list(csv.DictReader(line for line in text.splitlines() if not line.startswith("#")))


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return repr(value)


def local_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A tiny inline table; the optimizer knows its exact size and may broadcast it safely."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def archetypes(spark: SparkSession) -> DataFrame:
    """usage, vintage, structure -> envelope U-values, window ratio, reference demand."""
    rows = _rows("archetypes.csv")
    columns = list(rows[0])
    return local_table(spark, columns, [tuple(r[c] if i < 3 else float(r[c]) for i, c in enumerate(columns)) for r in rows])


def end_use_ratios(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["usage", *V.END_USES], [(k, *v) for k, v in V.END_USE_RATIOS.items()])


def fuel_mix(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["usage_type", "elec", "gas", "district_heat"], [(k, *v) for k, v in V.FUEL_MIX.items()])


def correction_factors(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["usage_type", "correction_factor"], list(V.CORRECTION_FACTORS.items()))


def city_medians(spark: SparkSession) -> DataFrame:
    """building, city -> median simulated EUI."""
    rows = [(r["building"], city, float(v)) for r in _rows("city_medians.csv") for city, v in r.items() if city != "building"]
    return local_table(spark, ["building", "city", "median"], rows)


def simulated_building(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["archetype", "building"], list(V.ARCHETYPE_BUILDING.items()))


def floor_areas(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["building", "floor_area"], list(V.SIMULATED_AREA.items()))


def archetype_areas(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["archetype", "floor_area"], list(V.ARCHETYPE_AREA.items()))


def districts(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["sigungu_cd", "name"], district_pairs())


def district_pairs(prefix: str = "") -> list[tuple[str, str]]:
    return [(r["sigungu_cd"], r["name"]) for r in _rows("sigungu.csv") if r["sigungu_cd"].startswith(prefix)]


def monthly_weather(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["month", "hdd18", "cdd24", "solar_rad", "avg_temp"], [(m, *v) for m, v in V.MONTHLY_WEATHER.items()])


def holidays(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["holiday"], [(d,) for d in V.HOLIDAYS]).selectExpr("CAST(holiday AS DATE) AS day")


def stations(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["name", "station_type", "district", "lng", "lat"],
                       [(n, "fire_station", d, x, y) for n, d, x, y in V.STATIONS])


def shelters(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["name", "category", "capacity", "lng", "lat"], V.SHELTERS)


def data_sources(spark: SparkSession) -> DataFrame:
    """Reference rows of the data source registry (key, tier, kind, cadence)."""
    return local_table(spark, ["source_key", "data_tier", "source_type", "update_cadence"], V.DATA_SOURCES)
