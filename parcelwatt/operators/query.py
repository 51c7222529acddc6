"""Interactive look-ups over buildings: filters, pages, search, rankings, pair comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelwatt.dims import values as V
from parcelwatt.functions import geo
from parcelwatt.functions.energy import eui
from parcelwatt.functions.rounding import half_even, half_up
from parcelwatt.operators.energy import with_current
from parcelwatt.operators.enrich import display_name, report_name
from parcelwatt.operators.join import distinct_on

EXPORT_COLUMNS = (
    "pnu", "building_name", "usage_type", "vintage_class", "built_year", "total_area", "floors_above", "height",
    "structure_type", "energy_grade", "total_energy", "co2_kg_m2", "lng", "lat",
)


def filter_buildings(df: DataFrame, grades=(), vintages=(), usages=(), bbox=None, centroids: DataFrame | None = None) -> DataFrame:
    """Rows matching every given list (an empty list is no constraint) and the bounding box.

    With ``centroids`` (pnu, lng, lat) a building stays when any centroid of its parcel is inside;
    otherwise its own cx, cy decides.
    """
    lists = (("energy_grade", grades), ("vintage_class", vintages), ("usage_type", usages))
    conditions = [F.col(c).isin(*values) for c, values in lists if values]
    out = df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df
    if bbox is None or len(bbox) == 0:
        return out
    west, south, east, north = geo.check_bbox(bbox)
    if centroids is None:
        return out.filter(geo.in_bbox(F.col("cx"), F.col("cy"), west, south, east, north))
    inside = centroids.filter(geo.in_bbox(F.col("lng"), F.col("lat"), west, south, east, north)).select("pnu")
    return out.join(inside, "pnu", "left_semi")


def list_buildings(df: DataFrame, grade: str | None = None, usage: str | None = None, vintage: str | None = None,
                   sigungu: str | None = None, bbox=None) -> DataFrame:
    """Equality filters plus a readable name."""
    for column, value in (("energy_grade", grade), ("usage_type", usage), ("vintage_class", vintage)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    if sigungu is not None:
        df = df.filter(F.col("pnu").startswith(sigungu))
    if bbox is not None:
        df = in_bbox(df, *geo.check_bbox(bbox))
    return df.withColumn("display_name", display_name(F.col("building_name"), F.col("pnu")))


def in_bbox(df: DataFrame, west: float, south: float, east: float, north: float, mode: str = "intersects") -> DataFrame:
    """``intersects`` compares extents (xmin..ymax), ``within`` the centroid strictly inside."""
    if mode == "within":
        return df.filter(geo.in_bbox(F.col("cx"), F.col("cy"), west, south, east, north))
    return df.filter(geo.bbox_intersects(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), west, south, east, north))


def search(df: DataFrame, text: str, column: str = "building_name", limit: int = 10, order: list[Column] | None = None) -> DataFrame:
    """Case-insensitive substring search; every character of ``text`` is literal."""
    hit = F.instr(F.lower(F.col(column)), F.lower(F.lit(text))) > 0
    return df.filter(hit).orderBy(*(order or [F.col("pnu").asc_nulls_last()])).limit(limit)


def page(df: DataFrame, limit: int, offset: int = 0, order: list[Column] | None = None) -> DataFrame:
    return df.orderBy(*(order or [F.col("pnu").asc_nulls_last(), F.col("gid").asc_nulls_last()])).offset(offset).limit(limit)


def page_with_total(df: DataFrame, limit: int, offset: int = 0, order: list[Column] | None = None) -> tuple[list, int]:
    """One page and the total; the count is skipped when the first page is already short."""
    rows = page(df, limit, offset, order).collect()
    total = len(rows) if offset == 0 and len(rows) < limit else df.count()
    return rows, total


def by_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """One centroid per requested key."""
    hit = df.join(keys.select("pnu").distinct(), "pnu", "left_semi")
    return distinct_on(hit, ["pnu"], [F.col("gid")]).select("pnu", F.col("cx").alias("lng"), F.col("cy").alias("lat"))


def top_risk(risk: DataFrame, limit: int) -> DataFrame:
    return risk.orderBy(F.col("total_score").desc_nulls_last(), F.col("pnu").asc_nulls_last()).limit(limit)


def sample_hash(df: DataFrame, n: int, seed: int = 42, key: str = "pnu") -> DataFrame:
    """Repeatable random sample of ``n`` rows: smallest keyed hashes first."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)


def overlay(centroids: DataFrame, results: DataFrame, buildings: DataFrame, kind: str, bbox, n: int | None = None, seed: int = 42) -> DataFrame:
    """Map points inside ``bbox``: ``co2``, ``zeb`` or ``hourly`` (daily EUI), sampled to ``n`` where given."""
    pick = lambda df: df if n is None else sample_hash(df, n, seed)
    west, south, east, north = geo.check_bbox(bbox)
    points = centroids.filter(geo.in_bbox(F.col("lng"), F.col("lat"), west, south, east, north))
    current = results.filter("is_current")
    if kind == "co2":
        df = points.join(current.filter("co2_kg_m2 IS NOT NULL"), "pnu").select(
            "pnu", "lng", "lat", half_up(F.col("co2_kg_m2"), 1).alias("co2"), half_up(F.col("primary_energy_kwh_m2"), 1).alias("pe")
        )
        return pick(df)
    one = distinct_on(buildings, ["pnu"], [F.col("gid")]).select("pnu", "usage_type", "total_area")
    joined = points.join(current.filter("total_energy > 0"), "pnu").join(one, "pnu")
    value = eui(F.col("total_energy"), F.col("total_area"), F.col("simulation_type"))
    if kind == "zeb":
        df = joined.select("pnu", "lng", "lat", half_up(value, 1).alias("eui"), (value <= V.ZEB_THRESHOLD).alias("is_zeb"))
    elif kind == "hourly":
        df = joined.select("pnu", "lng", "lat", half_up(value / 365.0, 3).alias("eui_daily"), F.coalesce("usage_type", F.lit("기타")).alias("usage_type"))
    else:
        raise ValueError("kind must be co2, zeb or hourly")
    return pick(df)


def retrofit_priority(buildings: DataFrame, results: DataFrame, limit: int = 20, sigungu: str | None = None,
                      vintage: str | None = None, usage: str | None = None, min_eui: float = V.ZEB_THRESHOLD) -> DataFrame:
    """Largest consumers above ``min_eui``: one row per parcel, ranked by EUI x area."""
    df = with_current(list_filters(buildings, sigungu, vintage, usage).filter(F.col("total_area") > 0), results)
    value = eui(F.col("total_energy"), F.col("total_area"), F.col("simulation_type"))
    df = df.withColumn("eui", value).filter(F.col("eui") > min_eui).withColumn("_kwh", F.col("eui") * F.col("total_area"))
    one = distinct_on(df, ["pnu"], [F.col("_kwh").desc(), F.col("gid")])
    top = one.orderBy(F.col("_kwh").desc(), F.col("pnu")).limit(limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("_kwh").desc(), F.col("pnu"))))
    return ranked.select(
        "rank", "pnu", report_name(F.col("building_name"), F.col("usage_type")).alias("building_name"),
        "usage_type", "vintage_class", "built_year", half_up(F.col("total_area"), 0).alias("total_area"), "floors_above",
        "energy_grade", F.substring("pnu", 1, 5).alias("sigungu_cd"), half_up(F.col("eui"), 1).alias("eui"),
        half_up(F.col("_kwh"), 0).alias("total_kwh_yr"), half_up(F.col("eui") - min_eui, 1).alias("zeb_gap"), "data_tier",
    )


def list_filters(df: DataFrame, sigungu: str | None, vintage: str | None, usage: str | None) -> DataFrame:
    if sigungu:
        df = df.filter(F.col("pnu").startswith(sigungu))
    if vintage:
        df = df.filter(F.col("vintage_class") == vintage)
    if usage:
        df = df.filter(F.col("usage_type") == usage)
    return df


def _of_keys(buildings: DataFrame, results: DataFrame, keys: DataFrame) -> DataFrame:
    """One building of each key with its current result; both sides are reduced to the keys before they are ranked."""
    wanted = keys.distinct()
    hit = distinct_on(buildings.join(wanted, "pnu", "left_semi"), ["pnu"], [F.col("gid")])
    return with_current(hit, results.join(wanted, "pnu", "left_semi"))


def detail(buildings: DataFrame, results: DataFrame, keys: DataFrame) -> DataFrame:
    """Attributes, energy breakdown and envelope of the requested parcels (one row per parcel)."""
    df = _of_keys(buildings, results, keys.select("pnu"))
    have = set(df.columns)
    part = lambda names: F.struct(*[n for n in names if n in have])
    value = eui(F.col("total_energy"), F.col("total_area"), F.col("simulation_type"))
    return df.select(
        "pnu", display_name(F.col("building_name"), F.col("pnu")).alias("building_name"), "usage_type", "vintage_class",
        "built_year", "total_area", "floors_above", "height", "structure_type", "energy_grade",
        value.alias("eui_kwh_m2"), part(("heating", "cooling", "hot_water", "lighting", "ventilation", "total_energy")).alias("energy"),
        part(("wall_uvalue", "roof_uvalue", "window_uvalue", "wwr")).alias("envelope"),
        *[c for c in ("data_tier", "simulation_type", "co2_kg_m2", "primary_energy_kwh_m2") if c in have],
    )


def compare_pair(buildings: DataFrame, results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Second minus first building for every (pnu1, pnu2) in ``pairs``; nulls where a value is missing."""
    df = _of_keys(buildings, results, pairs.select(F.explode(F.array("pnu1", "pnu2")).alias("pnu")))
    measures = ("eui_kwh_m2", "co2_kg_m2", "total_area", "built_year")
    df = df.withColumn("eui_kwh_m2", eui(F.col("total_energy"), F.col("total_area"), F.col("simulation_type")))
    side = lambda i: df.select(F.col("pnu").alias(f"pnu{i}"), F.struct(*measures).alias(f"b{i}"))
    joined = pairs.select("pnu1", "pnu2").join(side(1), "pnu1").join(side(2), "pnu2")
    gap = lambda i: half_even(F.col(f"b{i}.eui_kwh_m2") - V.ZEB_THRESHOLD, 1)
    return joined.select(
        "pnu1", "pnu2", gap(1).alias("zeb_gap1"), gap(2).alias("zeb_gap2"),
        *[half_even((F.col(f"b2.{m}") - F.col(f"b1.{m}")).cast("double"), 1).alias(f"diff_{m}") for m in measures],
    )


def filter_monitored(df: DataFrame, meter: str | None = None, text: str | None = None) -> DataFrame:
    """Meter points with a given meter whose alias or use contains ``text``."""
    if meter:
        df = df.filter(F.array_contains("meter_types", meter))
    if text:
        q = F.lower(F.lit(text))
        has = lambda c: F.coalesce(F.contains(F.lower(F.col(c)), q), F.lit(False))
        df = df.filter(has("alias") | has("usage_type"))
    return df


def latest_k(df: DataFrame, keys: list[str], when: str, k: int = 1, tie: list[Column] | None = None) -> DataFrame:
    """The ``k`` newest rows of every key."""
    from parcelwatt.operators.join import top_k

    return top_k(df, keys, [F.col(when).desc_nulls_last(), *(tie or [])], k)


def newest(df: DataFrame, when: str, limit: int, since: Column | None = None, tie: list[Column] | None = None) -> DataFrame:
    """The newest ``limit`` rows overall, optionally from ``since`` on."""
    if since is not None:
        df = df.filter(F.col(when) >= since)
    return df.orderBy(F.col(when).desc_nulls_last(), *(tie or [])).limit(limit)
