"""District, grade and coverage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelwatt.dims import values as V
from parcelwatt.functions.energy import eui
from parcelwatt.functions.geo import bbox_intersects, check_bbox
from parcelwatt.functions.rounding import half_up
from parcelwatt.operators.energy import with_current


def _with_eui(buildings: DataFrame, results: DataFrame) -> DataFrame:
    """Buildings with their current result, metered totals brought to kWh/m2 first."""
    joined = with_current(buildings, results)
    return joined.withColumn("eui", eui(F.col("total_energy"), F.col("total_area"), F.col("simulation_type")))


def by_district(buildings: DataFrame, results: DataFrame, zeb: float = V.ZEB_THRESHOLD) -> DataFrame:
    """EUI statistics and zero-energy shares per district, over rows with a positive EUI."""
    zeb_count, other = F.count(F.when(F.col("eui") <= zeb, 1)), F.count(F.when(F.col("eui") > zeb, 1))
    return (
        _with_eui(buildings, results).filter(F.col("eui") > 0)
        .groupBy(F.substring("pnu", 1, 5).alias("sigungu_cd"))
        .agg(
            F.count(F.lit(1)).alias("building_count"),
            half_up(F.avg("eui"), 1).alias("avg_eui"), half_up(F.min("eui"), 1).alias("min_eui"),
            half_up(F.max("eui"), 1).alias("max_eui"),
            zeb_count.alias("zeb_count"), other.alias("non_zeb_count"),
            F.coalesce(half_up(zeb_count * 100.0 / F.nullif(zeb_count + other, F.lit(0)), 1), F.lit(0.0)).alias("zeb_pct"),
            F.avg("cx").alias("center_lng"), F.avg("cy").alias("center_lat"),
        )
    )


def _base(buildings: DataFrame, results: DataFrame, bbox) -> DataFrame:
    df = with_current(buildings, results)
    if bbox is None:
        return df
    west, south, east, north = check_bbox(bbox)
    if "xmin" in df.columns:
        return df.filter(bbox_intersects(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), west, south, east, north))
    return df.filter(F.col("cx").between(west, east) & F.col("cy").between(south, north))


def bundle_long(buildings: DataFrame, results: DataFrame, bbox=None) -> DataFrame:
    """dimension (grade / usage), value, n, energy sum and count: one pass, one small shuffle."""
    kinds = F.array(
        F.struct(F.lit("grade").alias("dimension"), F.coalesce("energy_grade", F.lit("unknown")).alias("value")),
        F.struct(F.lit("usage").alias("dimension"), F.coalesce("usage_type", F.lit("unknown")).alias("value")),
    )
    return (
        _base(buildings, results, bbox)
        .select(F.explode(kinds).alias("k"), "total_energy")
        .groupBy("k.dimension", "k.value")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("total_energy").alias("energy_sum"), F.count("total_energy").alias("energy_count"))
    )


def bundle(buildings: DataFrame, results: DataFrame, bbox=None) -> DataFrame:
    """One row: total_count, avg_energy and both distributions as maps."""
    long = bundle_long(buildings, results, bbox)
    is_grade = F.col("dimension") == "grade"
    entries = lambda d: F.map_from_entries(
        F.array_compact(F.sort_array(F.collect_list(F.when(F.col("dimension") == d, F.struct("value", "n")))))
    )
    return long.agg(
        F.sum(F.when(is_grade, F.col("n"))).alias("total_count"),
        (F.sum(F.when(is_grade, F.col("energy_sum"))) / F.nullif(F.sum(F.when(is_grade, F.col("energy_count"))), F.lit(0))).alias("avg_energy"),
        entries("grade").alias("grade_distribution"),
        entries("usage").alias("usage_distribution"),
    )


def filter_options(buildings: DataFrame) -> DataFrame:
    """One row with the sorted distinct non-blank uses, vintages and grades."""
    options = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    return buildings.agg(
        options("usage_type").alias("usage_types"),
        options("vintage_class").alias("vintage_classes"),
        options("energy_grade").alias("energy_grades"),
    )


def coverage(buildings: DataFrame, results: DataFrame, sources: tuple[str, ...] = ("energy_grade", "seoul_green_cert", "archetype")) -> DataFrame:
    """One row: buildings, buildings with a result, buildings per source, mean."""
    joined = buildings.select("pnu").join(
        results.select("pnu", "simulation_type", "total_energy", F.lit(1).alias("_has")), "pnu", "left"
    )
    return joined.agg(
        F.count("_has").alias("with_energy"), F.count(F.lit(1)).alias("total_buildings"),
        *[F.count(F.when(F.col("simulation_type") == s, 1)).alias(f"from_{s}") for s in sources],
        half_up(F.avg("total_energy"), 1).alias("avg_eui"),
    )


def by_source(results: DataFrame) -> DataFrame:
    return results.groupBy("simulation_type").agg(
        F.count(F.lit(1)).alias("cnt"), half_up(F.avg("total_energy"), 1).alias("avg_eui")
    )


def year_coverage(buildings: DataFrame) -> DataFrame:
    """Per district: buildings, buildings with a known year, share in percent."""
    known = F.count("built_year")
    return buildings.groupBy(F.substring("pnu", 1, 5).alias("sigungu_cd")).agg(
        F.count(F.lit(1)).alias("total"), known.alias("with_year"),
        half_up(known * 100.0 / F.count(F.lit(1)), 1).alias("year_pct"),
    )


def grade_stats(risk: DataFrame) -> DataFrame:
    """Fire grade -> count and mean score."""
    return risk.groupBy("risk_grade").agg(
        F.count(F.lit(1)).alias("count"), half_up(F.avg("total_score"), 1).alias("avg_score")
    )


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return half_up(part * 100.0 / F.nullif(whole, F.lit(0)), digits)
