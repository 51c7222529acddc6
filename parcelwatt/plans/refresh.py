"""End-to-end jobs over tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelwatt.operators import carbon, energy, enrich, fire, ml, upsert
from parcelwatt.sources.sinks import write_snapshot


def refresh(spark: SparkSession, paths: dict[str, str]) -> None:
    """Recompute the snapshots in dependency order: buildings, centroids, fire risk, accuracy.

    ``paths`` names footprints, ledger, buildings, centroids, risk and optionally predictions,
    versions, registry, accuracy.
    """
    read = lambda k: spark.read.parquet(paths[k])
    write_snapshot(enrich.buildings(read("footprints"), read("ledger")), paths["buildings"])
    write_snapshot(enrich.centroids(read("buildings")), paths["centroids"])
    write_snapshot(fire.score(read("buildings")), paths["risk"])
    if "accuracy" in paths:
        write_snapshot(ml.accuracy(read("predictions"), read("versions"), read("registry")), paths["accuracy"])


def estimate_results(buildings: DataFrame, current: DataFrame, lookup: DataFrame | None, as_of_year: int) -> DataFrame:
    """Current results after filling every parcel: graded rows by tier, then tier-4 estimates, then carbon."""
    graded = energy.from_grade(buildings).drop("grade").withColumn("is_current", F.lit(True))
    merged = upsert.by_tier(current, graded, tie=[F.col("total_energy").desc_nulls_last()])
    one = upsert.top_k(buildings.filter("pnu IS NOT NULL"), ["pnu"], [F.col("gid")])
    estimated = energy.estimate_calibrated(one, lookup, as_of_year) if lookup is not None else energy.estimate(one, as_of_year)
    tier4 = estimated.select(
        "pnu", "total_energy", "heating", "cooling", "hot_water", "lighting", "ventilation", "simulation_type",
    ).withColumns({"data_tier": F.lit(4), "is_current": F.lit(True)})
    return carbon.apply(upsert.protect(merged, tier4), buildings)
