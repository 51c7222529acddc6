"""Retrofit what-if: measures applied one after another on the demand that remains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelwatt.dims import values as V
from parcelwatt.functions.classify import literal_map
from parcelwatt.functions.energy import energy_price
from parcelwatt.functions.rounding import half_up


def _by_vintage(table: tuple[float, ...] | None) -> Column:
    if table is None:
        return F.lit(0.0)
    return F.coalesce(literal_map(dict(zip(V.VINTAGES, table)))[F.col("vintage_class")], F.lit(table[-1]))


def _measures(selected: list[str] | None) -> Column:
    """Array of the chosen measures in the order given (all of them by default)."""
    known = {m[0]: m for m in V.RETROFIT}
    ids = [m for m in (selected if selected is not None else list(known)) if m in known]
    heat_share, cool_share, light_share = V.RETROFIT_SHARES
    rows = []
    for mid in ids:
        _, label, cost, heating, cooling, lighting = known[mid]
        rows.append(F.struct(
            F.lit(mid).alias("id"), F.lit(label).alias("label"), F.lit(cost).alias("cost"),
            F.lit(lighting is not None).alias("of_original"),
            (_by_vintage(lighting) * light_share if lighting
             else _by_vintage(heating) * heat_share + _by_vintage(cooling) * cool_share).alias("share"),
        ))
    if not rows:
        empty = "array<struct<id:string,label:string,cost:int,of_original:boolean,share:double>>"
        return F.array().cast(empty)
    return F.array(*rows)


_STEP = "struct<remaining:double,total:double,cost:int,steps:array<struct<id:string,label:string,cost:int,saving:double>>>"


def project(df: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """Per building: combined effect plus ``measures``, an array with one entry per measure.

    Needs pnu, eui_kwh_m2 (> 0, other rows are dropped), co2_kg_m2, total_area_m2, vintage_class,
    usage_type. Each measure saves a share of the demand left by the earlier ones; lighting saves a
    share of the original demand. Cost and savings are truncated to whole KRW.
    """
    eui, area, co2 = F.col("eui_kwh_m2"), F.col("total_area_m2"), F.col("co2_kg_m2")
    start = F.struct(
        eui.cast("double").alias("remaining"), F.lit(0.0).alias("total"), F.lit(0).alias("cost"),
        F.array().cast("array<struct<id:string,label:string,cost:int,saving:double>>").alias("steps"),
    )

    def apply(acc: Column, m: Column) -> Column:
        saving = F.greatest(F.when(m["of_original"], eui).otherwise(acc["remaining"]) * m["share"], F.lit(0.0))
        return F.struct(
            F.greatest(acc["remaining"] - saving, F.lit(0.0)).alias("remaining"),
            (acc["total"] + saving).alias("total"),
            (acc["cost"] + m["cost"]).alias("cost"),
            F.concat(acc["steps"], F.array(F.struct(
                m["id"].alias("id"), m["label"].alias("label"), m["cost"].alias("cost"), saving.alias("saving")
            ))).alias("steps"),
        ).cast(_STEP)

    has_area = F.coalesce(area != 0, F.lit(False))
    price = F.col("_price")
    won = lambda v: F.when(has_area, v.cast("long")).otherwise(F.lit(0).cast("long"))

    def payback(cost: Column, saved: Column) -> Column:
        return F.when(saved > 0, half_up(cost / F.nullif(saved, F.lit(0)), 1))

    def detail(s: Column) -> Column:
        cost, saved = won(s["cost"] * area), won(s["saving"] * area * price)
        return F.struct(
            s["id"].alias("id"), s["label"].alias("label"),
            half_up(s["saving"], 2).alias("eui_saving_kwh_m2"),
            half_up(s["saving"] / eui, 4).alias("saving_pct"),
            half_up(s["saving"] * (F.nullif(co2, F.lit(0.0)) / eui), 2).alias("co2_saving_kg_m2"),
            s["cost"].alias("cost_per_m2"), cost.alias("cost_total_krw"), saved.alias("annual_saving_krw"),
            payback(cost, saved).alias("payback_years"),
        )

    folded = (
        df.filter(eui > 0)
        .withColumn("_price", energy_price(F.col("usage_type")))
        .withColumn("_fold", F.aggregate(_measures(measures), start.cast(_STEP), apply))
    )
    after = F.greatest(eui - F.col("_fold.total"), F.lit(0.0))
    co2_after = half_up(co2 * (after / eui), 2)
    cost, saved = won(F.col("_fold.cost") * area), won(F.col("_fold.total") * area * price)
    return folded.select(
        *df.columns,
        half_up(after, 1).alias("eui_after"),
        half_up(F.col("_fold.total"), 2).alias("eui_saving_kwh_m2"),
        half_up(F.col("_fold.total") / eui, 4).alias("saving_pct"),
        co2_after.alias("co2_after_kg_m2"),
        half_up(co2 - co2_after, 2).alias("co2_saving_kg_m2"),
        cost.alias("cost_total_krw"), saved.alias("annual_saving_krw"), payback(cost, saved).alias("payback_years"),
        F.transform("_fold.steps", detail).alias("measures"),
    )
