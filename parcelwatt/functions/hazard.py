"""Fire-risk, spread and weather expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parcelwatt.dims import values as V
from parcelwatt.functions.classify import literal_map
from parcelwatt.functions.geo import bearing
from parcelwatt.functions.rounding import half_up


def _has(col: Column, *words: str) -> Column:
    hit = col.contains(words[0])
    for word in words[1:]:
        hit = hit | col.contains(word)
    return hit


def structure_score(name: Column) -> Column:
    return F.when(_has(name, "목"), 40).when(_has(name, "조적", "벽돌"), 30).when(_has(name, "철골", "S조"), 20).otherwise(15)


def age_score(year: Column, floors: Column) -> Column:
    """Old high-rises (10+ floors before 1990) are treated as unknown years."""
    return (
        F.when(year.isNull(), 25)
        .when((floors >= 10) & (year < 1990), 25)
        .when(year < 1980, 30)
        .when(year < 2000, 20)
        .when(year < 2010, 12)
        .otherwise(5)
    )


# Words in the use name and their score; the first matching line wins.
USAGE_SCORES = (
    (("공장", "창고"), 20), (("위험물",), 20), (("위락",), 15), (("노유자", "의료"), 18), (("숙박", "고시원"), 16),
    (("교육", "문화", "집회"), 14), (("단독주택",), 12), (("종교", "근린"), 12), (("공동주택", "아파트"), 10),
    (("사무", "업무", "판매"), 8),
)
OTHER_USAGE_SCORE = 10


def usage_score(usage: Column) -> Column:
    return F.coalesce(*[F.when(_has(usage, *words), F.lit(s)) for words, s in USAGE_SCORES], F.lit(OTHER_USAGE_SCORE))


def height_score(floors: Column) -> Column:
    return F.least(F.greatest(F.coalesce(floors, F.lit(3)) - 3, F.lit(0)) * 2, F.lit(10))


def grade(score: Column) -> Column:
    return F.when(score >= 60, "HIGH").when(score >= 35, "MEDIUM").otherwise("LOW")


def spread_weight(distance: Column, source_class: Column, target_class: Column,
                  radius: float, mode: str = "source") -> Column:
    """Edge weight falling linearly with distance.

    ``source`` scales by the burning building's structure, ``either`` by masonry on either end.
    """
    if mode == "source":
        factor = F.when(source_class == "masonry", 1.4).when(source_class == "steel", 1.0).otherwise(0.8)
    elif mode == "either":
        either = F.coalesce(source_class == "masonry", F.lit(False)) | F.coalesce(target_class == "masonry", F.lit(False))
        factor = F.when(either, 1.2).otherwise(0.8)
    else:
        raise ValueError("mode must be 'source' or 'either'")
    return F.greatest(F.lit(0.0), (1.0 - distance / radius) * factor)


def wind_factor(direction: Column, wind_from: Column, speed: Column) -> Column:
    """Weight of spreading towards ``direction`` under wind from ``wind_from`` at ``speed`` m/s."""
    away = F.radians(direction - (wind_from + 180.0))
    return F.greatest(F.lit(0.0), 1.0 + (speed / 20.0) * F.cos(away))


def wind_between(lng1: Column, lat1: Column, lng2: Column, lat2: Column, wind_from: Column, speed: Column) -> Column:
    return wind_factor(bearing(lng1, lat1, lng2, lat2), wind_from, speed)


def response_minutes(metres: Column) -> Column:
    """Minutes at 30 km/h."""
    return half_up(metres / 500.0, 1)


def compass_degrees(*points: Column) -> Column:
    """Degrees of the first known compass point; north is 0, not missing."""
    table = literal_map(V.COMPASS)
    return F.coalesce(*[table[F.upper(F.trim(p))] for p in points])


def wind_level_speed(level: Column) -> Column:
    return F.coalesce(literal_map(V.WIND_LEVEL)[level.try_cast("int")], F.lit(V.DEFAULT_WIND_SPEED))


def season_wind(month: Column) -> Column:
    """Placeholder wind by season when no observation exists."""
    direction = F.when(month.between(3, 5), 210.0).when(month.between(6, 8), 180.0).when(month.between(9, 11), 0.0).otherwise(315.0)
    return F.struct(direction.alias("wind_direction"), F.lit(3.0).alias("wind_speed"))
