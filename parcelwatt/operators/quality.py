"""Row checks and the data-quality report."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from parcelwatt.functions.classify import MAX_HEIGHT, YEAR_RANGE

# Accepted meters and units.
METERS = ("electricity", "gas", "heat", "water")
UNITS = ("kWh", "m3", "Nm3", "Gcal", "MJ")


def pnu_ok(col: Column) -> Column:
    return F.coalesce(col.rlike(r"^\d{19,25}$"), F.lit(False))


def meter_ok(col: Column) -> Column:
    return F.coalesce(col.isin(*METERS), F.lit(False))


def unit_ok(col: Column) -> Column:
    return F.coalesce(col.isin(*UNITS), F.lit(False))


def tier_ok(col: Column) -> Column:
    return F.coalesce(col.between(1, 4), F.lit(False))


def range_ok(start: Column, end: Column, max_days: int = 366) -> Column:
    return F.coalesce((end > start) & (F.datediff(end, start) <= max_days), F.lit(False))


def period_days(text: str) -> int:
    """``30d`` -> 30; 1 to 365 days."""
    match = re.fullmatch(r"(\d+)d", text.strip().lower())
    if not match or not 1 <= int(match.group(1)) <= 365:
        raise ValueError(f"period must look like 30d, between 1d and 365d: {text!r}")
    return int(match.group(1))


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reasons``: the names of the rules a row breaks."""
    broken = [F.when(~rule, F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def check(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split into rows that pass every rule and rejects with their reasons."""
    tagged = with_reasons(df, rules)
    return tagged.filter(F.size("reasons") == 0).drop("reasons"), tagged.filter(F.size("reasons") > 0)


def report(buildings: DataFrame, results: DataFrame, known_usages: tuple[str, ...] = ()) -> DataFrame:
    """One row of issue counts over buildings and current results, in one aggregation."""
    of_building = {
        "year_out_of_range": ~F.col("built_year").between(*YEAR_RANGE), "extreme_height": F.col("height") >= MAX_HEIGHT,
        "unclassified_usage": ~F.coalesce(F.col("usage_type").isin(*known_usages), F.lit(False)),
    }
    of_result = {"null_co2": F.col("co2_kg_m2").isNull(), "negative_eui": F.col("total_energy") < 0}
    flags = lambda df, rules: df.select(*[rule.alias(name) for name, rule in rules.items()])
    every = flags(buildings, of_building).unionByName(flags(results.filter("is_current"), of_result), allowMissingColumns=True)
    return every.agg(*[F.count(F.when(F.col(c), 1)).alias(c) for c in [*of_building, *of_result]])
