"""Energy estimation, calibration and per-building energy assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelwatt import dims
from parcelwatt.dims import values as V
from parcelwatt.functions import classify, energy as E
from parcelwatt.functions.rounding import half_up
from parcelwatt.operators.join import distinct_on

_PARAMS = tuple(V.DEFAULT_ARCHETYPE)


def with_current(buildings: DataFrame, results: DataFrame) -> DataFrame:
    """Left join the current result of each key (one per key, best tier first)."""
    current = distinct_on(
        results.filter("is_current"), ["pnu"],
        [F.col("data_tier").asc_nulls_last(), F.col("total_energy").desc_nulls_last()],
    )
    return buildings.join(current, "pnu", "left")


def match_archetype(buildings: DataFrame, as_of_year: int, strict_compat: bool = False) -> DataFrame:
    """Add archetype parameters with aged U-values.

    Fallback chain: (use, vintage, structure), (use, vintage, RC), (apartment, vintage, RC),
    constants. ``strict_compat`` upper-cases the structure so that only RC can match directly.
    Adds ``usage_key``, ``match_vintage``, ``match_structure``, ``wall_base`` and the parameters.
    """
    spark = buildings.sparkSession
    table = dims.archetypes(spark)
    raw = F.upper(F.trim(F.coalesce(F.col("structure_class"), F.lit(""))))
    structure = F.when(raw == "", "RC").otherwise(raw)
    if not strict_compat:
        structure = F.when(structure.isin("STEEL", "MASONRY"), F.lower(structure)).otherwise(structure)
    df = buildings.withColumns({
        "usage_key": classify.usage_key(F.col("usage_type")),
        "match_vintage": classify.vintage(F.col("built_year")),
        "match_structure": structure,
    })

    def level(name: str, structure_value: str | None, usage_value: str | None):
        part = table
        if structure_value:
            part = part.filter(F.col("structure") == structure_value)
        if usage_value:
            part = part.filter(F.col("usage") == usage_value)
        keys = [F.col("vintage").alias("match_vintage")]
        if not usage_value:
            keys.append(F.col("usage").alias("usage_key"))
        if not structure_value:
            keys.append(F.col("structure").alias("match_structure"))
        names = [k for k in ("usage_key", "match_vintage", "match_structure")
                 if not (k == "usage_key" and usage_value) and not (k == "match_structure" and structure_value)]
        return part.select(*keys, F.struct(*_PARAMS).alias(name)), names

    for name, sv, uv in (("_exact", None, None), ("_rc", "RC", None), ("_apartment", "RC", "apartment")):
        part, names = level(name, sv, uv)
        df = df.join(F.broadcast(part), names, "left")
    constants = F.struct(*[F.lit(v).alias(k) for k, v in V.DEFAULT_ARCHETYPE.items()])
    df = df.withColumn("_params", F.coalesce("_exact", "_rc", "_apartment", constants))
    ageing = E.degradation(F.col("built_year"), as_of_year)
    return df.withColumns({
        **{p: F.col(f"_params.{p}") * ageing if p.endswith("uvalue") else F.col(f"_params.{p}") for p in _PARAMS},
        "wall_base": F.col("_exact.wall_uvalue"),
    }).drop("_exact", "_rc", "_apartment", "_params")


def _ratio_columns(df: DataFrame) -> DataFrame:
    """Join end-use shares by ``usage_key`` as ``_r_<use>``, defaulting unknown uses."""
    ratios = dims.end_use_ratios(df.sparkSession)
    renamed = ratios.select(F.col("usage").alias("usage_key"), *[F.col(u).alias(f"_r_{u}") for u in V.END_USES])
    joined = df.join(F.broadcast(renamed), "usage_key", "left")
    return joined.withColumns({
        f"_r_{u}": F.coalesce(f"_r_{u}", F.lit(d)) for u, d in zip(V.END_USES, V.DEFAULT_END_USE)
    })


def estimate(buildings: DataFrame, as_of_year: int, strict_compat: bool = False) -> DataFrame:
    """Archetype demand by end use (kWh/m2/yr), envelope ageing raising heating and, partly, cooling."""
    df = _ratio_columns(match_archetype(buildings, as_of_year, strict_compat))
    ratio = F.when(F.col("wall_base") > 0, F.col("wall_uvalue") / F.nullif(F.col("wall_base"), F.lit(0.0)))
    ratio = F.coalesce(ratio, F.lit(1.0))
    scale = {"heating": ratio, "cooling": 1.0 + (ratio - 1.0) * 0.3}
    parts = {u: F.col("ref_total") * F.col(f"_r_{u}") * scale.get(u, F.lit(1.0)) for u in V.END_USES}
    total = sum(parts.values(), F.lit(0.0))
    df = df.withColumns({**{u: half_up(p, 2) for u, p in parts.items()}, "total_energy": half_up(total, 2)})
    return df.withColumn("simulation_type", F.lit("archetype")).drop(*[f"_r_{u}" for u in V.END_USES])


def city_ratio(spark, reference: str = "seoul") -> DataFrame:
    """archetype, city -> median of the city over the reference city's, rounded to 4."""
    medians = dims.city_medians(spark)
    base = medians.filter(F.col("city") == reference).select("building", F.col("median").alias("_base"))
    per_building = medians.join(F.broadcast(base), "building").filter(F.col("_base") != 0)
    return (
        dims.simulated_building(spark)
        .join(per_building, "building")
        .select("archetype", "city", half_up(F.col("median") / F.col("_base"), 4).alias("ratio"))
    )


CITIES = tuple(sorted(set(V.CITY_BY_PREFIX.values())))


def _wide_lookup(lookup: DataFrame) -> DataFrame:
    """One row per known archetype and vintage with a column per city: at most 14 x 5 rows."""
    known = lookup.filter(
        F.col("archetype").isin(*V.ARCHETYPE_AREA)
        & F.col("vintage").isin("pre1990", "1991_2000", "2001_2010", "2011_2017", "2018_plus")
    )
    return known.groupBy("archetype", F.col("vintage").alias("vintage5")).agg(
        *[F.max(F.when(F.col("city") == c, F.col("median"))).alias(f"_in_{c}") for c in CITIES]
    )


def lookup_eui(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Add ``lookup_median`` for (archetype, vintage5, city).

    A city missing from ``lookup`` (archetype, vintage, city, median: one row per combination, see
    ``tables.build_eui_lookup``) takes the seoul value times the city ratio.
    """
    own = F.coalesce(*[F.when(F.col("city") == c, F.col(f"_in_{c}")) for c in CITIES])
    seoul, ratio = F.col("_in_seoul"), F.coalesce(F.col("ratio"), F.lit(1.0))
    return (
        df.join(F.broadcast(_wide_lookup(lookup)), ["archetype", "vintage5"], "left")
        .join(F.broadcast(city_ratio(df.sparkSession)), ["archetype", "city"], "left")
        .withColumn("lookup_median", F.coalesce(own, F.when(ratio == 1.0, seoul).otherwise(half_up(seoul * ratio, 1))))
        .drop("ratio", *[f"_in_{c}" for c in CITIES])
    )


def estimate_calibrated(buildings: DataFrame, lookup: DataFrame, as_of_year: int,
                        factors: DataFrame | None = None) -> DataFrame:
    """Simulation lookup x metered calibration, split by end use; archetype estimate where absent.

    ``lookup`` is keyed by (archetype, vintage, city). ``factors`` (usage_type, correction_factor)
    defaults to the shipped calibration. ``simulation_type`` tells which way a row went.
    """
    base = estimate(buildings, as_of_year)
    low = F.coalesce(F.col("floors_above") <= 5, F.lit(False))
    archetype = F.when(F.col("usage_key") == "apartment", F.when(low, "apartment_midrise").otherwise("apartment_highrise")).otherwise(
        F.coalesce(classify.literal_map(V.SIMULATED_ARCHETYPE)[F.col("usage_key")], F.lit("small_office"))
    )
    df = base.withColumns({
        "archetype": F.when(F.col("usage_key") != "datacenter", archetype),
        "vintage5": classify.vintage5(F.col("built_year")),
        "city": E.city_of(F.substring("pnu", 1, 5)),
    })
    df = lookup_eui(df, lookup)
    if factors is None:
        factors = F.broadcast(dims.correction_factors(buildings.sparkSession))
    df = df.join(factors.select("usage_type", "correction_factor"), "usage_type", "left")
    eui = half_up(F.col("lookup_median") * F.coalesce(F.col("correction_factor"), F.lit(1.0)), 1)
    df = _ratio_columns(df.withColumn("_eui", eui))
    split = {u: F.when(F.col("_eui").isNull(), F.col(u)).otherwise(half_up(F.col("_eui") * F.col(f"_r_{u}"), 2)) for u in V.END_USES}
    return (
        df.withColumns({
            **split,
            "total_energy": F.coalesce("_eui", "total_energy"),
            "simulation_type": F.when(F.col("_eui").isNull(), "archetype_fallback").otherwise("korean_bb_calibrated"),
        })
        .drop("_eui", "correction_factor", "lookup_median", *[f"_r_{u}" for u in V.END_USES])
    )


def _split_by_word(df: DataFrame, eui_col: str, usage_col: str) -> DataFrame:
    shares = E.end_use_by_word(F.coalesce(F.col(usage_col), F.lit("")))
    df = df.withColumn("_s", shares)
    return df.withColumns({u: half_up(F.col(eui_col) * F.col(f"_s.{u}"), 2) for u in V.END_USES}).drop("_s")


def from_grade(buildings: DataFrame) -> DataFrame:
    """Tier-2 results for buildings whose register row carries an efficiency grade."""
    graded = buildings.filter(F.col("pnu").isNotNull()).withColumn("total_energy", E.grade_eui(F.col("energy_grade")))
    split = _split_by_word(graded.filter(F.col("total_energy").isNotNull()), "total_energy", "usage_type")
    return split.select(
        "pnu", "total_energy", *V.END_USES, F.lit("energy_grade").alias("simulation_type"), F.lit(2).alias("data_tier"),
        F.col("energy_grade").alias("grade"),
    )


def annualise_monthly(monthly: DataFrame) -> DataFrame:
    """pnu, ym, kwh (one row per fuel and month) -> annual kWh for parcels with a latest month.

    ``total x 12 / months with consumption``; a parcel without consumption in the newest month of
    the whole feed is left out, as its series has ended.
    """
    per_month = monthly.groupBy("pnu", "ym").agg(F.sum("kwh").alias("kwh")).filter(F.col("kwh") > 0)
    newest = monthly.agg(F.max("ym")).scalar()
    per_pnu = per_month.groupBy("pnu").agg(
        F.sum("kwh").alias("_total"), F.count(F.lit(1)).alias("months"), F.max("ym").alias("_last")
    )
    return (
        per_pnu.filter(F.col("_last") == newest)
        .select("pnu", "months", (F.col("_total") * 12 / F.col("months")).alias("annual_kwh"))
    )


def from_monthly(buildings: DataFrame, monthly: DataFrame) -> DataFrame:
    """Tier-1 results from the monthly feed: annual kWh over area, split by end use."""
    annual = annualise_monthly(monthly)
    one = distinct_on(buildings.filter(F.col("total_area") > 0), ["pnu"], [F.col("total_area").desc(), F.col("gid")])
    joined = one.join(annual, "pnu").withColumn("total_energy", half_up(F.col("annual_kwh") / F.col("total_area"), 1))
    return _split_by_word(joined, "total_energy", "usage_type").select(
        "pnu", "total_energy", *V.END_USES, F.lit("bldg_energy_hub").alias("simulation_type"), F.lit(1).alias("data_tier")
    )


def from_certificates(certificates: DataFrame) -> DataFrame:
    """Tier-2 results from resolved certificates (pnu, eui, usage_type, grade)."""
    split = _split_by_word(certificates.filter("pnu IS NOT NULL AND eui IS NOT NULL"), "eui", "usage_type")
    return split.select(
        "pnu", F.col("eui").alias("total_energy"), *V.END_USES,
        F.lit("kea_cert").alias("simulation_type"), F.lit(2).alias("data_tier"), "grade",
    )


def annual_metered(daily: DataFrame, monitored: DataFrame, year: int, min_coverage: float = 50.0) -> DataFrame:
    """Annual metered totals per parcel and meter point, days below the coverage threshold left out."""
    kept = daily.filter(
        F.col("day").between(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date"))
        & F.col("total_kwh").isNotNull()
        & (F.col("coverage_pct").isNull() | (F.col("coverage_pct") >= min_coverage))
    )
    of = lambda m: F.sum(F.when(F.col("meter_type") == m, F.col("total_kwh")).otherwise(0.0))
    agg = kept.groupBy("ts_id").agg(
        of("electricity").alias("elec_kwh"), of("gas").alias("gas_kwh"), of("heat").alias("dh_kwh"),
        F.sum(F.when(F.col("meter_type") != "water", F.col("total_kwh")).otherwise(0.0)).alias("total_kwh"),
        F.countDistinct("meter_type").alias("meter_count"), F.avg("coverage_pct").alias("avg_coverage"),
    ).filter(F.col("total_kwh") > 0)
    return monitored.filter(F.col("pnu").isNotNull()).select("ts_id", "pnu").join(agg, "ts_id")


def metered_results(annual: DataFrame, year: int) -> DataFrame:
    """Annual metered totals as tier-1 result rows (absolute kWh, fuels in the metadata)."""
    return annual.select(
        "pnu", F.col("total_kwh").alias("total_energy"), (F.col("gas_kwh") + F.col("dh_kwh")).alias("heating"),
        F.lit(0.0).alias("cooling"), F.lit(1).alias("data_tier"), F.lit(year).alias("reference_year"),
        F.lit(True).alias("is_current"), F.lit("tier_c_metered").alias("simulation_type"),
        F.struct("elec_kwh", "gas_kwh", "dh_kwh", "meter_count", half_up(F.col("avg_coverage"), 1).alias("avg_coverage"),
                 F.lit(year).alias("reference_year")).alias("source_metadata"),
    )
