"""Validity of polygons, self-crossing included.

The segments of all rings are put on a grid of their own polygon, as fine as the number of its segments asks for, and only
segments of one cell are compared. So a ring of many points is spread over tasks, and equal geometries are judged once.

Reasons, the first that holds: ``empty`` (no ring), ``ring`` (a ring with under four points, open, without area, or with a
coordinate that is null or not finite), ``crossing`` (a ring meets itself: segments that cross, touch or run back on each
other), ``rings`` (two rings cross or share a piece of a line; touching in a point is allowed), ``hole`` (a hole outside its
shell or inside another hole). Points repeated in a row count once. A hole is placed by the middle of its first segment, so one
that leaves the shell through corners of the shell alone is not found, nor is an interior cut in two by touching holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelwatt.functions import geo
from parcelwatt.operators.spatial import split_hot
from parcelwatt.session import cut

MARGIN = 1e-6  # in cells


def _side(a: str, b: str, c: str) -> Column:
    """1, 0, -1: the side of the line a -> b on which c lies; names are prefixes of x and y columns."""
    x, y = (lambda p: F.col(f"{p}x")), (lambda p: F.col(f"{p}y"))
    return F.signum((x(b) - x(a)) * (y(c) - y(a)) - (y(b) - y(a)) * (x(c) - x(a)))


def _segments(shapes: DataFrame) -> DataFrame:
    """_key, ring, seg, segs (number in the ring) and both ends (px, py, qx, qy) of every segment of every ring."""
    fresh = lambda r: F.filter(r, lambda p, i: (i == 0) | ~p.eqNullSafe(F.try_element_at(r, F.greatest(i, F.lit(1)))))
    rings = shapes.select("_key", F.posexplode("rings").alias("ring", "_r")).select("_key", "ring", fresh(F.col("_r")).alias("_r"))
    ends = F.arrays_zip(F.slice("_r", 1, F.size("_r") - 1).alias("p"), F.slice("_r", 2, F.size("_r") - 1).alias("q"))
    return rings.filter(F.size("_r") > 1).select("_key", "ring", (F.size("_r") - 1).alias("segs"), F.posexplode(ends).alias("seg", "_s")).select(
        "_key", "ring", "seg", "segs", F.col("_s.p.x").alias("px"), F.col("_s.p.y").alias("py"), F.col("_s.q.x").alias("qx"), F.col("_s.q.y").alias("qy"))


def _on_grid(segments: DataFrame) -> DataFrame:
    """The segments in every cell they pass (_row, _col); a polygon's grid has about as many cells as it has segments."""
    low, high = (lambda f, c: f(f"p{c}").alias(f"_{c}0")), (lambda f, c: f(f"p{c}").alias(f"_{c}1"))
    grid = segments.groupBy("_key").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_g"), low(F.min, "x"), low(F.min, "y"), high(F.max, "x"), high(F.max, "y"))
    scale = lambda c: F.col("_g") / F.nullif(F.col(f"_{c}1") - F.col(f"_{c}0"), F.lit(0.0))
    at = lambda end, c: F.coalesce((F.col(f"{end}{c}") - F.col(f"_{c}0")) * scale(c), F.lit(0.0))
    placed = segments.join(grid, "_key").withColumns({"_pu": at("p", "x"), "_pv": at("p", "y"), "_qu": at("q", "x"), "_qv": at("q", "y")})
    cells = lambda a, b: F.sequence(F.floor(F.least(a, b) - MARGIN).cast("long"), F.floor(F.greatest(a, b) + MARGIN).cast("long"))
    rows = placed.withColumn("_row", F.explode(cells(F.col("_pv"), F.col("_qv"))))
    # the part of the segment within the row
    slope = (F.col("_qu") - F.col("_pu")) / F.nullif(F.col("_qv") - F.col("_pv"), F.lit(0.0))
    inside = lambda v: F.least(F.greatest(v, F.least("_pv", "_qv")), F.greatest("_pv", "_qv"))
    reach = lambda v, otherwise: F.coalesce(F.col("_pu") + (inside(v) - F.col("_pv")) * slope, otherwise)
    first, last = reach(F.col("_row") - MARGIN, F.col("_pu")), reach(F.col("_row") + 1 + MARGIN, F.col("_qu"))
    return rows.withColumn("_col", F.explode(cells(first, last))).select(*segments.columns, "_row", "_col")


def _meetings(segments: DataFrame) -> DataFrame:
    """_key, crossing, rings for every polygon with a forbidden meeting of two segments."""
    placed = _on_grid(segments)
    left = placed.toDF("_key", "ring_a", "seg_a", "segs_a", "ax", "ay", "bx", "by", "_row", "_col")
    right = placed.toDF("_key", "ring_b", "seg_b", "segs_b", "cx", "cy", "dx", "dy", "_row", "_col")
    left, right, keys = split_hot(left, right, ["_key", "_row", "_col"], F.struct("ring_a", "seg_a"), F.struct("ring_b", "seg_b"))
    met = left.join(right, keys).filter(F.struct("ring_a", "seg_a") < F.struct(F.col("ring_b").alias("ring_a"), F.col("seg_b").alias("seg_a")))
    met = met.withColumns({"s1": _side("a", "b", "c"), "s2": _side("a", "b", "d"), "s3": _side("c", "d", "a"), "s4": _side("c", "d", "b")})
    span = lambda c: F.least(F.greatest(f"a{c}", f"b{c}"), F.greatest(f"c{c}", f"d{c}")) - F.greatest(F.least(f"a{c}", f"b{c}"), F.least(f"c{c}", f"d{c}"))
    flat = (F.col("s1") == 0) & (F.col("s2") == 0)
    cross = (F.col("s1") * F.col("s2") < 0) & (F.col("s3") * F.col("s4") < 0)
    # on one line the common piece has a length; else segments whose ends do not lie strictly apart meet
    overlap = flat & (span("x") >= 0) & (span("y") >= 0) & (F.greatest(span("x"), span("y")) > 0)
    meet = F.when(flat, (span("x") >= 0) & (span("y") >= 0)).otherwise((F.col("s1") * F.col("s2") <= 0) & (F.col("s3") * F.col("s4") <= 0))
    gap = F.col("seg_b") - F.col("seg_a")
    beside = (gap == 1) | (gap == F.col("segs_a") - 1)
    same = F.col("ring_a") == F.col("ring_b")
    bad = met.select("_key", (same & F.when(beside, overlap).otherwise(meet)).alias("crossing"), (~same & (cross | overlap)).alias("rings"))
    return bad.filter("crossing OR rings").groupBy("_key").agg(F.max("crossing").alias("crossing"), F.max("rings").alias("rings"))


def _misplaced(segments: DataFrame) -> DataFrame:
    """_key of the polygons with a hole outside the shell or inside another hole."""
    middle = segments.filter("ring > 0 AND seg = 0").select("_key", F.col("ring").alias("hole"), ((F.col("px") + F.col("qx")) / 2).alias("x"), ((F.col("py") + F.col("qy")) / 2).alias("y"))
    level = (F.col("py") > F.col("y")) != (F.col("qy") > F.col("y"))
    right = F.col("x") < F.col("px") + (F.col("y") - F.col("py")) * (F.col("qx") - F.col("px")) / F.nullif(F.col("qy") - F.col("py"), F.lit(0.0))
    passed = middle.join(segments, "_key").filter("hole <> ring").groupBy("_key", "hole", "ring").agg(F.count(F.when(level & right, 1)).alias("n"))
    return passed.filter((F.col("n") % 2 == 1) != (F.col("ring") == 0)).select("_key").distinct()


def validity(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """All columns and rows of ``polygons`` with ``valid`` and ``reason`` (null where valid). Both replace columns of these names."""
    finite = F.forall(F.flatten(rings), lambda p: F.coalesce((F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")), F.lit(False)))
    whole = F.coalesce(finite, F.lit(False)) & geo.is_valid(F.col(rings))
    plain = F.when(F.coalesce(F.size(rings), F.lit(0)) < 1, "empty").when(~whole, "ring")
    judged = cut(polygons.drop("valid", "reason").withColumn("_plain", plain).withColumn("_key", F.sha2(F.to_json(rings), 256)))
    shapes = judged.filter("_plain IS NULL").select("_key", F.col(rings).alias("rings")).dropDuplicates(["_key"])
    segments = cut(_segments(shapes))
    marks = _meetings(segments).join(_misplaced(segments).withColumn("hole", F.lit(True)), "_key", "full")
    found = marks.select("_key", F.when(F.col("crossing"), "crossing").when(F.col("rings"), "rings").when(F.col("hole"), "hole").alias("_found"))
    out = judged.join(found, "_key", "left").withColumn("reason", F.coalesce("_plain", "_found"))
    return out.withColumn("valid", F.col("reason").isNull()).select(*[c for c in polygons.columns if c not in ("valid", "reason")], "valid", "reason")
