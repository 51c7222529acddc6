"""Classification of buildings by year, size, structure and use."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parcelwatt.functions.rounding import filled

# Register use name -> archetype key.
USAGE_KEYS = {
    "공동주택": "apartment", "아파트": "apartment", "연립주택": "apartment", "다세대주택": "apartment",
    "단독주택": "residential_single", "다가구주택": "residential_single", "다중주택": "residential_single",
    "업무시설": "office", "사무소": "office",
    "판매시설": "retail", "근린생활시설": "retail", "제1종근린생활시설": "retail", "제2종근린생활시설": "retail",
    "교육연구시설": "education", "학교": "education", "수련시설": "education", "도서관": "education",
    "의료시설": "hospital", "병원": "hospital", "노유자시설": "hospital", "사회복지시설": "hospital",
    "창고시설": "warehouse", "공장": "warehouse", "산업시설": "warehouse", "위험물저장및처리시설": "warehouse",
    "자동차관련시설": "warehouse", "운수시설": "warehouse",
    "문화및집회시설": "cultural", "종교시설": "cultural", "집회시설": "cultural", "관람집회시설": "cultural",
    "전시시설": "cultural", "장례시설": "cultural",
    "숙박시설": "mixed_use", "운동시설": "mixed_use", "복합건축물": "mixed_use", "관광휴게시설": "mixed_use",
    "지역난방공동주택": "apartment_district_heating", "지역난방아파트": "apartment_district_heating",
    "온돌주택": "apartment_ondol",
    "데이터센터": "datacenter", "정보통신시설": "datacenter", "전산센터": "datacenter", "통신시설": "datacenter",
    "주거복합": "mixed_residential_commercial", "복합용도": "mixed_residential_commercial",
}

# Bounds of a believable completion year.
YEAR_RANGE = (1900, 2026)

METRES_PER_FLOOR = 3.3
MAX_HEIGHT = 650.0


def literal_map(mapping: dict) -> Column:
    """A constant map column from a plain dictionary of texts and numbers."""
    def text(v) -> str:
        if isinstance(v, str):
            return "'" + v.replace("'", "\\'") + "'"
        return f"{v!r}D" if isinstance(v, float) else repr(v)

    return F.expr("map(" + ", ".join(f"{text(k)}, {text(v)}" for k, v in mapping.items()) + ")")


def vintage(year: Column, unknown: str = "1980-2000") -> Column:
    """Four-class vintage of a completion year; ``unknown`` names the class of a null year."""
    return (
        F.when(year.isNull(), F.lit(unknown))
        .when(year < 1980, "pre-1980")
        .when(year <= 2000, "1980-2000")
        .when(year <= 2010, "2001-2010")
        .otherwise("post-2010")
    )


def vintage5(year: Column) -> Column:
    """Five-class vintage used by the simulation lookup; null years fall in the middle class."""
    return (
        F.when(year.isNull(), "2001_2010")
        .when(year < 1990, "pre1990")
        .when(year < 2001, "1991_2000")
        .when(year < 2011, "2001_2010")
        .when(year < 2018, "2011_2017")
        .otherwise("2018_plus")
    )


def size_class(area: Column) -> Column:
    known = F.coalesce(area, F.lit(0.0))
    return F.when(known < 500, "small").when(known < 3000, "medium").otherwise("large")


def structure_class(name: Column) -> Column:
    """RC / steel / masonry from a free structure name; anything unknown counts as RC."""
    has = lambda *words: _any_of(name, words)
    return (
        F.when(has("철근콘크리트", "RC"), "RC")
        .when(has("철골", "S조"), "steel")
        .when(has("조적", "벽돌", "목"), "masonry")
        .otherwise("RC")
    )


def _any_of(col: Column, words: tuple[str, ...]) -> Column:
    hit = col.contains(words[0])
    for word in words[1:]:
        hit = hit | col.contains(word)
    return hit


def usage_key(usage: Column) -> Column:
    """Archetype key of a use name: blank -> apartment, unknown names pass through in lower case."""
    trimmed = filled(usage)
    return F.coalesce(literal_map(USAGE_KEYS)[trimmed], F.lower(trimmed), F.lit("apartment"))


def height(own: Column, register: Column, floors: Column) -> Column:
    """Footprint height, else register height, else floors x 3.3 (at least one floor), capped."""
    return F.least(
        F.coalesce(
            F.nullif(own, F.lit(0.0)),
            F.nullif(register, F.lit(0.0)),
            F.greatest(floors.cast("double"), F.lit(1.0)) * METRES_PER_FLOOR,
            F.lit(10.0),
        ),
        F.lit(MAX_HEIGHT),
    )


def year_of(day: Column) -> Column:
    """First four characters of a ``yyyyMMdd`` text as a year, null when outside the known range."""
    year = F.substring(day, 1, 4).try_cast("int")
    return F.when(year.between(*YEAR_RANGE), year)


def built_year(register_day: Column, own_day: Column) -> Column:
    """A non-blank register date decides alone; the footprint date only fills its absence."""
    has_register = F.coalesce(register_day, F.lit("")) != ""
    return F.when(has_register, year_of(register_day)).otherwise(year_of(own_day))
