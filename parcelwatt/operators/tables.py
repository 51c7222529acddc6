"""Lookup tables built from simulation and meter samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelwatt import dims
from parcelwatt.dims import values as V
from parcelwatt.functions.classify import literal_map, vintage5
from parcelwatt.functions.rounding import half_up
from parcelwatt.operators.join import distinct_on, top_k
from parcelwatt.operators.quantile import exact_quantiles, order_statistics

GROUP = ["archetype", "vintage", "city"]


def build_eui_lookup(samples: DataFrame, max_n: int | None = None, low: float = 5.0, high: float = 5000.0) -> DataFrame:
    """archetype, vintage, city -> exact median, p10, p90, n over all runs, or over the first ``max_n`` runs by id if given.

    Implausible EUIs are dropped after that choice.
    """
    first = samples if max_n is None else top_k(samples, GROUP, [F.col("run_id")], max_n)
    kept = first.filter((F.col("eui") > low) & (F.col("eui") < high)).withColumn("eui", half_up(F.col("eui"), 2))
    q = exact_quantiles(kept, GROUP, "eui", {"median": 0.5, "p10": 0.1, "p90": 0.9})
    return q.select(*GROUP, *[half_up(F.col(c), 1).alias(c) for c in ("median", "p10", "p90")], "n")


def calibration(tier1: DataFrame, lookup: DataFrame, city: str = "seoul") -> DataFrame:
    """usage_type -> median metered over median simulated EUI, each building counting its own vintage.

    A vintage without the city's value takes the first other city that has one. Uses that map to
    no simulated archetype, or without any simulated value, keep factor 1.0.
    """
    kept = distinct_on(tier1.filter(F.col("eui").between(10, 400)), ["pnu"], [F.col("eui")])
    rows = kept.withColumns({
        "archetype": literal_map(V.CALIBRATION_ARCHETYPE)[F.col("usage_type")],
        "vintage": vintage5(F.col("built_year")),
    })
    ordered = [city, *[c for c in V.CALIBRATION_CITIES if c != city]]
    simulated = lookup.filter(F.col("city").isin(*ordered) & F.col("archetype").isin(*set(V.CALIBRATION_ARCHETYPE.values())))
    per_city = simulated.groupBy("archetype", "vintage").agg(
        F.coalesce(*[F.max(F.when(F.col("city") == c, F.col("median"))) for c in ordered]).alias("simulated")
    )
    joined = rows.join(F.broadcast(per_city), ["archetype", "vintage"], "left")
    measured = exact_quantiles(joined, ["usage_type"], "eui", {"median_tier1": 0.5})
    model = exact_quantiles(joined, ["usage_type"], "simulated", {"median_simul": 0.5}).drop("n")
    arch = joined.groupBy("usage_type").agg(F.max("archetype").alias("archetype"))
    ratio = half_up(F.col("median_tier1") / F.when(F.col("median_simul") > 0, F.col("median_simul")), 4)
    note = F.when(F.col("archetype").isNull(), "매핑 불가 → 미보정").when(F.col("median_simul").isNull(), "시뮬 데이터 없음 → 미보정").otherwise("")
    return (
        measured.join(arch, "usage_type").join(model, "usage_type", "left")
        .select(
            "usage_type", F.coalesce("archetype", F.lit("N/A")).alias("archetype"), F.col("n").alias("n_tier1"),
            half_up(F.col("median_tier1"), 1).alias("median_tier1"), half_up(F.col("median_simul"), 1).alias("median_simul"),
            F.coalesce(ratio, F.lit(1.0)).alias("correction_factor"), note.alias("note"),
        )
    )


def simulated_eui(metadata: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """Valid baseline runs -> building, city, eui (J -> kWh over the building's floor area)."""
    if areas is None:
        areas = F.broadcast(dims.floor_areas(metadata.sparkSession))
    valid = metadata.filter((F.col("ems") == "E0") & F.col("valid"))
    return valid.join(areas, "building").select(
        "building", "city", (F.col("energy_j") / V.JOULES_PER_KWH / F.col("floor_area")).alias("eui")
    )


def build_city_base(runs: DataFrame) -> DataFrame:
    """building, city -> median and the nearest-rank p10 / p90 of ``eui``."""
    n = F.col("n")
    ranks = {
        "_m1": F.floor((n + 1) / 2), "_m2": F.floor(n / 2) + 1,
        "p10": F.greatest(F.lit(0), F.floor(n * F.lit(0.10)) - 1) + 1,
        "p90": F.least(n - 1, F.floor(n * F.lit(0.90))) + 1,
    }
    s = order_statistics(runs, ["building", "city"], "eui", ranks)
    return s.select(
        "building", "city", half_up((F.col("_m1") + F.col("_m2")) / 2, 1).alias("median"),
        half_up(F.col("p10"), 1).alias("p10"), half_up(F.col("p90"), 1).alias("p90"), "n",
    )


def annual_from_hourly(hourly: DataFrame) -> DataFrame:
    """run_id with archetype, vintage, city and hourly kwh rows -> run_id, group, annual EUI."""
    areas = dims.archetype_areas(hourly.sparkSession)
    totals = hourly.filter(~F.isnan("kwh")).groupBy("run_id", *GROUP).agg(F.sum("kwh").alias("_kwh")).filter(F.col("_kwh") > 0)
    return totals.join(F.broadcast(areas), "archetype").select("run_id", *GROUP, (F.col("_kwh") / F.col("floor_area")).alias("eui"))


def write_lookup(df: DataFrame, path: str) -> None:
    """Persist a lookup table as Parquet (a few hundred rows: one file)."""
    df.coalesce(1).write.mode("overwrite").parquet(path)
