"""Point and polygon expressions on plain columns (EPSG:4326 degrees, metres on a sphere)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6_371_008.8
METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180.0

RING = "array<struct<x:double,y:double>>"
POLYGON = f"array<{RING}>"


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle metres (within 0.5 % of the ellipsoid distance); null if any coordinate is."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def bearing(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Initial bearing in degrees, 0 = north, clockwise."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def eps_degrees(metres: float, latitude: float = 37.5) -> float:
    """Degrees of longitude that span ``metres`` at a reference latitude."""
    return metres / (111_000.0 * math.cos(math.radians(latitude)))


# ── grid cells ───────────────────────────────────────────────────────────────
# Rows are ``size`` metres of latitude. Inside a row the cell width is ``size`` metres at the row's
# (and its neighbours') largest absolute latitude, so two points within ``size`` metres are never
# more than one row and one column apart, at any latitude.

_SLACK = 1.0001


def cell_row(lat: Column, size_m: float) -> Column:
    return F.floor(lat / (size_m * _SLACK / METRES_PER_DEGREE)).cast("long")


def _column_width(row: Column, size_m: float) -> Column:
    step = size_m * _SLACK / METRES_PER_DEGREE
    extreme = F.least(F.greatest(F.abs(row - 1), F.abs(row + 2)).cast("double") * step, F.lit(89.0))
    return F.lit(step) / F.cos(F.radians(extreme))


def cell_col(lng: Column, row: Column, size_m: float) -> Column:
    return F.floor(lng / _column_width(row, size_m)).cast("long")


def cell(lng: Column, lat: Column, size_m: float) -> Column:
    row = cell_row(lat, size_m)
    return F.struct(row.alias("row"), cell_col(lng, row, size_m).alias("col"))


def neighbour_cells(lng: Column, lat: Column, size_m: float) -> Column:
    """The 3x3 block of cells that holds everything within ``size_m`` of the point."""
    def around(row: Column) -> Column:
        col = cell_col(lng, row, size_m)
        return F.transform(F.sequence(col - 1, col + 1), lambda c: F.struct(row.alias("row"), c.alias("col")))

    base = cell_row(lat, size_m)
    return F.flatten(F.transform(F.sequence(base - 1, base + 1), around))


def in_bbox(lng: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """Strictly inside; a point on the border is out."""
    return (lng > west) & (lng < east) & (lat > south) & (lat < north)


def bbox_intersects(xmin: Column, ymin: Column, xmax: Column, ymax: Column,
                    west: float, south: float, east: float, north: float) -> Column:
    return (xmin <= east) & (xmax >= west) & (ymin <= north) & (ymax >= south)


def check_bbox(bbox) -> tuple[float, float, float, float]:
    """Validate ``(west, south, east, north)``."""
    if len(bbox) != 4:
        raise ValueError("bbox needs west, south, east, north")
    west, south, east, north = map(float, bbox)
    if not (-180 <= west <= 180 and -180 <= east <= 180 and -90 <= south <= 90 and -90 <= north <= 90):
        raise ValueError("bbox coordinates out of range")
    if west >= east or south >= north:
        raise ValueError("bbox must have west < east and south < north")
    return west, south, east, north


# ── polygons: array of rings, a ring is an array of (x, y) ───────────────────

def _edges(ring: Column) -> Column:
    """Consecutive point pairs of a closed ring."""
    n = F.size(ring)
    head = F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0)))
    tail = F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.arrays_zip(head.alias("p"), tail.alias("q"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def ring_area(ring: Column) -> Column:
    """Signed shoelace area in square degrees."""
    return _sum(F.transform(_edges(ring), lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2.0


def ring_centroid(ring: Column) -> Column:
    """Area centroid of a ring, computed about its first point; the plain mean when it has no area."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    cross = lambda e: (e["p"]["x"] - x0) * (e["q"]["y"] - y0) - (e["q"]["x"] - x0) * (e["p"]["y"] - y0)
    edges = _edges(ring)
    twice = _sum(F.transform(edges, cross))
    mx = _sum(F.transform(edges, lambda e: (e["p"]["x"] + e["q"]["x"] - 2 * x0) * cross(e)))
    my = _sum(F.transform(edges, lambda e: (e["p"]["y"] + e["q"]["y"] - 2 * y0) * cross(e)))
    n = F.size(ring)
    mean = lambda axis: _sum(F.transform(ring, lambda p: p[axis])) / n
    return F.when(
        twice != 0,
        F.struct((x0 + mx / (3 * F.nullif(twice, F.lit(0.0)))).alias("x"), (y0 + my / (3 * F.nullif(twice, F.lit(0.0)))).alias("y")),
    ).otherwise(F.struct(mean("x").alias("x"), mean("y").alias("y")))


def centroid(rings: Column) -> Column:
    """Centroid of a polygon without its holes counted twice: weighted over ring areas."""
    parts = F.transform(
        rings,
        lambda r: F.struct(ring_area(r).alias("a"), ring_centroid(r).alias("c")),
    )
    outer = F.abs(parts[0]["a"])
    weight = lambda i, p: F.when(i == 0, F.abs(p["a"])).otherwise(-F.abs(p["a"]))
    total = _sum(F.transform(parts, lambda p, i: weight(i, p)))
    axis = lambda k: _sum(F.transform(parts, lambda p, i: weight(i, p) * p["c"][k])) / F.nullif(total, F.lit(0.0))
    return F.when((outer > 0) & (F.size(rings) > 1), F.struct(axis("x").alias("x"), axis("y").alias("y"))).otherwise(
        parts[0]["c"]
    )


def bbox(rings: Column) -> Column:
    xs = F.transform(F.flatten(rings), lambda p: p["x"])
    ys = F.transform(F.flatten(rings), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                    F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def is_valid(rings: Column) -> Column:
    """Every ring closed, at least four points, non-zero area (self-crossing is not tested)."""
    ok = lambda r: (F.size(r) >= 4) & (r[0] == F.element_at(r, -1)) & (F.abs(ring_area(r)) > 0)
    return F.coalesce((F.size(rings) >= 1) & F.forall(rings, ok), F.lit(False))


def edges(rings: Column) -> Column:
    """The edges of all rings: array of (p, q)."""
    return F.flatten(F.transform(rings, _edges))


def odd_crossings(edges: Column, x: Column, y: Column) -> Column:
    """True where the ray from a point to the east crosses an odd number of ``edges``."""
    def crossing(e: Column) -> Column:
        (x1, y1), (x2, y2) = (e["p"]["x"], e["p"]["y"]), (e["q"]["x"], e["q"]["y"])
        straddles = (y1 > y) != (y2 > y)
        at = (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1
        return F.when(straddles & (x < at), 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + crossing(e)) % 2 == 1


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting over all rings (holes fall out by parity)."""
    return odd_crossings(edges(rings), x, y)


def largest_part(polygons: Column) -> Column:
    """The polygon with the largest outer ring of a multipolygon."""
    ranked = F.transform(polygons, lambda p: F.struct(F.abs(ring_area(p[0])).alias("a"), p.alias("polygon")))
    best = F.aggregate(
        ranked, F.element_at(ranked, 1), lambda acc, v: F.when(v["a"] > acc["a"], v).otherwise(acc)
    )
    return best["polygon"]


def from_geojson(text: Column) -> Column:
    """Polygon or MultiPolygon GeoJSON text -> array of polygons."""
    kind = F.get_json_object(text, "$.type")
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    coords = F.get_json_object(text, "$.coordinates")
    one = F.from_json(coords, "array<array<array<double>>>")
    many = F.from_json(F.when(kind == "MultiPolygon", coords), "array<array<array<array<double>>>>")
    return F.when(kind == "MultiPolygon", F.transform(many, lambda p: F.transform(p, ring))).when(
        kind == "Polygon", F.array(F.transform(one, ring))
    )


def point_geojson(lng: Column, lat: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates")))


def to_feature(geometry_json: Column, properties: list[str]) -> Column:
    """A GeoJSON Feature text from geometry text and property columns."""
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry_json, F.lit(',"properties":'), props, F.lit("}"))
