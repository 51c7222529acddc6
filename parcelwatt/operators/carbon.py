"""CO2 and primary energy of result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelwatt import dims
from parcelwatt.dims import values as V
from parcelwatt.functions.energy import carbon, weighted
from parcelwatt.functions.rounding import half_up
from parcelwatt.operators.join import distinct_on

COLUMNS = ("co2_kg_yr", "co2_kg_m2", "primary_energy_kwh_yr", "primary_energy_kwh_m2")


def _with_mix(df: DataFrame) -> DataFrame:
    mix = dims.fuel_mix(df.sparkSession).select(
        "usage_type", F.col("elec").alias("_e"), F.col("gas").alias("_g"), F.col("district_heat").alias("_d")
    )
    joined = df.join(F.broadcast(mix), "usage_type", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip(("_e", "_g", "_d"), V.DEFAULT_FUEL_MIX)})


def of_totals(df: DataFrame) -> DataFrame:
    """Row form: total_energy_kwh, area_m2, usage_type, elec_kwh, gas_kwh, dh_kwh -> the four measures."""
    out = carbon(
        F.col("total_energy_kwh"), F.col("area_m2"), (F.col("_e"), F.col("_g"), F.col("_d")),
        F.col("elec_kwh"), F.col("gas_kwh"), F.col("dh_kwh"),
    )
    return _with_mix(df).withColumn("_c", out).select(*df.columns, *[f"_c.{c}" for c in COLUMNS])


def apply(results: DataFrame, buildings: DataFrame) -> DataFrame:
    """Recompute the four measures of every result with a positive total and a known building.

    Metered rows use their own fuels (absolute kWh); other rows hold kWh/m2 and use the fuel mix.
    ``source_metadata`` may be absent, a struct with elec/gas/dh kWh, or the three plain columns.
    """
    names = ("elec_kwh", "gas_kwh", "dh_kwh")
    if "source_metadata" in results.columns:
        fuels = [F.col(f"source_metadata.{n}") for n in names]
    else:
        fuels = [F.col(n) if n in results.columns else F.lit(None).cast("double") for n in names]
    clamped = [F.greatest(F.coalesce(f.try_cast("double"), F.lit(0.0)), F.lit(0.0)) for f in fuels]
    attrs = distinct_on(buildings, ["pnu"], [F.col("gid")]).select(
        "pnu", F.col("usage_type"), F.nullif(F.col("total_area"), F.lit(0.0)).alias("_area"), F.lit(True).alias("_known")
    )
    base = results.drop("usage_type", *COLUMNS).join(attrs, "pnu", "left")
    df = _with_mix(base)
    metered = F.coalesce(F.col("simulation_type") == "tier_c_metered", F.lit(False))
    has_own = F.col("source_metadata").isNotNull() if "source_metadata" in results.columns else F.lit(True)
    due = F.coalesce(F.col("_known") & (F.col("total_energy") > 0) & (~metered | has_own), F.lit(False))
    mix = [F.col("total_energy") * F.col(c) for c in ("_e", "_g", "_d")]
    area = F.col("_area")

    def pair(factors, digits_m2: int):
        own, per_m2 = weighted(tuple(clamped), factors), weighted(tuple(mix), factors)
        yearly = F.when(metered, half_up(own, 1)).otherwise(half_up(per_m2 * area, 1))
        intensity = F.when(metered, half_up(own / area, digits_m2)).otherwise(half_up(per_m2, digits_m2))
        return F.when(due, yearly), F.when(due, intensity)

    co2, co2_m2 = pair(V.CO2_FACTORS, 2)
    pe, pe_m2 = pair(V.PRIMARY_FACTORS, 1)
    return df.withColumns(dict(zip(COLUMNS, (co2, co2_m2, pe, pe_m2)))).drop("_e", "_g", "_d", "_area", "_known", "usage_type")
