"""Energy, carbon and grade expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from parcelwatt.dims import values as V
from parcelwatt.functions.classify import literal_map
from parcelwatt.functions.rounding import half_even, half_up


def eui(total: Column, area: Column, simulation_type: Column) -> Column:
    """kWh/m2: metered rows hold absolute kWh and need the area, all others are per m2 already."""
    per_area = half_even(total / F.nullif(area, F.lit(0.0)), 1)
    return F.when(simulation_type == "tier_c_metered", per_area).otherwise(total)


def normal_grade(raw: Column) -> Column:
    """Canonical efficiency grade, null when unknown."""
    text = F.trim(raw)
    known = literal_map({**{g: g for g in V.GRADE_EUI}, **V.GRADE_ALIASES})
    return known[text]


def grade_eui(raw: Column) -> Column:
    return literal_map(V.GRADE_EUI)[normal_grade(raw)]


def end_use_by_word(usage: Column) -> Column:
    """End-use shares chosen by a word inside the use name."""
    share = lambda t: F.struct(*[F.lit(v).alias(n) for n, v in zip(V.END_USES, t)])
    first, *rest = V.END_USE_BY_WORD
    pick = reduce(lambda acc, wt: acc.when(usage.contains(wt[0]), share(wt[1])), rest,
                  F.when(usage.contains(first[0]), share(first[1])))
    return pick.otherwise(share(V.DEFAULT_END_USE))


def degradation(year: Column, as_of_year: int) -> Column:
    """Factor on envelope U-values by age; an unknown year counts as 40 years old."""
    age = F.coalesce(F.greatest(F.lit(0), F.lit(as_of_year) - year), F.lit(40))
    age = F.when(year.isNull(), F.lit(40)).otherwise(age)
    return F.when(age <= 10, 1.0).when(age <= 20, 1.3).when(age <= 30, 1.7).otherwise(2.0)


def city_of(sigungu: Column) -> Column:
    """Simulated city of a district code."""
    longest_first = sorted(V.CITY_BY_PREFIX.items(), key=lambda kv: -len(kv[0]))
    return F.coalesce(*[F.when(sigungu.startswith(p), F.lit(c)) for p, c in longest_first], F.lit("seoul"))


def weighted(parts: tuple[Column, Column, Column], factors: tuple[float, float, float]) -> Column:
    return parts[0] * factors[0] + parts[1] * factors[1] + parts[2] * factors[2]


def carbon(total_kwh: Column, area: Column, mix: tuple[Column, Column, Column],
           elec: Column, gas: Column, heat: Column) -> Column:
    """CO2 and primary energy of one building and year.

    Metered fuels are used when both electricity and gas are known, else the use's fuel mix.
    Totals of zero or less give zeros; intensities need an area.
    """
    metered = elec.isNotNull() & gas.isNotNull()
    clamp = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    fuels = tuple(
        F.when(metered, clamp(own)).otherwise(total_kwh * share) for own, share in zip((elec, gas, heat), mix)
    )
    size = F.nullif(area, F.lit(0.0))
    co2, primary = weighted(fuels, V.CO2_FACTORS), weighted(fuels, V.PRIMARY_FACTORS)
    none = total_kwh <= 0
    zero_per_area = F.when(size.isNotNull(), 0.0)
    return F.struct(
        F.when(none, 0.0).otherwise(half_up(co2, 1)).alias("co2_kg_yr"),
        F.when(none, zero_per_area).otherwise(half_up(co2 / size, 2)).alias("co2_kg_m2"),
        F.when(none, 0.0).otherwise(half_up(primary, 1)).alias("primary_energy_kwh_yr"),
        F.when(none, zero_per_area).otherwise(half_up(primary / size, 1)).alias("primary_energy_kwh_m2"),
    )


def energy_price(usage: Column) -> Column:
    """KRW per kWh, weighted by the electricity share priced for the use."""
    share = F.coalesce(literal_map(V.PRICE_ELEC_SHARE)[usage], F.lit(V.DEFAULT_PRICE_ELEC_SHARE))
    return share * V.PRICES[0] + (1.0 - share) * V.PRICES[1]


def primary_to_final(primary: Column, usage_key: Column) -> Column:
    return primary * F.coalesce(literal_map(V.PRIMARY_TO_FINAL)[usage_key], F.lit(V.DEFAULT_PRIMARY_TO_FINAL))


def to_kwh(value: Column, unit: Column) -> Column:
    """kWh of a reading by unit: Nm3 of gas, Gcal of heat, MJ; kWh passes through."""
    u = F.lower(F.trim(unit))
    return (
        F.when(u.isin("nm3", "nm³", "m3", "m³"), value * 10.55)
        .when(u == "gcal", value * 1163.0)
        .when(u == "mj", value * 0.27778)
        .when(u == "kwh", value)
    )


def total_kwh(total: Column, elec: Column, gas: Column) -> Column:
    """The total, else electricity plus gas; null only when all three are null."""
    parts = F.coalesce(elec, F.lit(0.0)) + F.coalesce(gas, F.lit(0.0))
    return F.coalesce(total, F.when(elec.isNotNull() | gas.isNotNull(), parts))
