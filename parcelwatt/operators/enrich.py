"""Entity resolution: building footprints x register -> one wide row per building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelwatt.functions import classify, pnu
from parcelwatt.functions.rounding import filled
from parcelwatt.operators.join import fallback_left

_ENERGY = ("enrgy_eff_rate", "epi_score", "main_purps_nm", "bld_nm", "tot_area", "bld_area", "use_apr_day")
_BEST = ("main_purps_nm", "bld_nm", "strct_nm", "grnd_flr_cnt", "ugrnd_flr_cnt", "bld_ht", "tot_area", "bld_area", "use_apr_day")


def _max_row(columns: tuple[str, ...], order: list[Column], where: Column | None = None) -> Column:
    """The row with the largest ``order`` (nulls last), all other columns breaking ties."""
    row = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in columns])
    return F.max(F.when(where, row) if where is not None else row)


def register_summary(ledger: DataFrame) -> DataFrame:
    """Per key: the largest graded row (``energy``) and the tallest, then largest row (``best``).

    Both top-1 picks come from one aggregation with partial results per task, so the register is
    shuffled once and a key holding a third of it is reduced before it moves.
    """
    return ledger.filter(F.col("pnu").isNotNull()).groupBy("pnu").agg(
        _max_row(_ENERGY, [F.col("tot_area")], F.col("enrgy_eff_rate").isNotNull()).alias("energy"),
        _max_row(_BEST, [F.col("grnd_flr_cnt"), F.col("tot_area")]).alias("best"),
    )


def buildings(footprints: DataFrame, ledger: DataFrame) -> DataFrame:
    """The enriched building table.

    Attribute priority: graded register row, best register row, parent-lot register row (only when
    the best row has no use), footprint. One output row per footprint row.
    """
    register = register_summary(ledger)
    joined = footprints.join(register, "pnu", "left")
    parents = register.select("pnu", F.col("best").alias("parent"))
    joined = fallback_left(joined, parents, "pnu", pnu.parent(F.col("pnu")), F.col("best.main_purps_nm").isNull())

    def pick(name: str, *sources: str) -> list[Column]:
        return [F.col(f"{s}.{name}") for s in sources]

    all_three = ("energy", "best", "parent")
    structure = F.coalesce(*pick("strct_nm", "best", "parent"))
    floors = F.coalesce(*pick("grnd_flr_cnt", "best", "parent"), F.col("grnd_flr"), F.lit(3))
    area = F.coalesce(*pick("tot_area", *all_three), F.lit(0.0))
    register_day = F.coalesce(*pick("use_apr_day", *all_three))
    year = classify.built_year(register_day, F.col("approval_date"))
    class_year = F.coalesce(
        filled(F.substring(filled(register_day), 1, 4)).try_cast("int"),
        filled(F.substring(filled(F.col("approval_date")), 1, 4)).try_cast("int"),
        F.lit(1970),
    )
    keep = [c for c in ("rings", "cx", "cy", "xmin", "ymin", "xmax", "ymax") if c in footprints.columns]
    return joined.select(
        "gid",
        "pnu",
        F.coalesce(*pick("bld_nm", *all_three), F.col("bld_nm"), F.lit("")).alias("building_name"),
        F.coalesce(*pick("main_purps_nm", *all_three), F.col("usage_type"), F.lit("미분류")).alias("usage_type"),
        structure.alias("structure_type"),
        classify.height(F.col("height"), F.coalesce(*pick("bld_ht", "best", "parent")), floors).alias("height"),
        floors.alias("floors_above"),
        F.coalesce(*pick("ugrnd_flr_cnt", "best", "parent"), F.col("ugrnd_flr"), F.lit(0)).alias("floors_below"),
        area.alias("total_area"),
        F.coalesce(*pick("bld_area", *all_three), F.lit(0.0)).alias("building_area"),
        year.alias("built_year"),
        F.col("energy.enrgy_eff_rate").alias("energy_grade"),
        F.col("energy.epi_score").alias("epi_score"),
        classify.vintage(class_year).alias("vintage_class"),
        classify.size_class(area).alias("size_class"),
        classify.structure_class(structure).alias("structure_class"),
        *keep,
    )


def display_name(name: Column, key: Column) -> Column:
    """The name, else ``<main>-<sub>번지`` from the key (no sub part when it is zero)."""
    bon, ji = F.substring(key, 12, 4).try_cast("int"), F.substring(key, 16, 4).try_cast("int")
    lot = F.concat_ws("", bon.cast("string"), F.when(ji > 0, F.concat(F.lit("-"), ji.cast("string"))), F.lit("번지"))
    return F.coalesce(filled(name), lot)


def report_name(name: Column, usage: Column) -> Column:
    """The name, else ``<use> 건물``, else ``미분류 건물``."""
    return F.coalesce(filled(name), F.concat(filled(usage), F.lit(" 건물")), F.lit("미분류 건물"))


def centroids(buildings_df: DataFrame) -> DataFrame:
    """One centroid per key (the smallest gid wins where several buildings share a parcel)."""
    from parcelwatt.operators.join import distinct_on

    one = distinct_on(buildings_df.filter(F.col("pnu").isNotNull() & F.col("cx").isNotNull()), ["pnu"], [F.col("gid")])
    return one.select("pnu", F.col("cx").alias("lng"), F.col("cy").alias("lat"))
