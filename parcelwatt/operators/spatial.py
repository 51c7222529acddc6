"""Distance, nearest-neighbour and polygon joins by grid cells; density clustering.

Every join is an equi-join on a cell followed by an exact filter. Cells holding more than ``HOT``
rows are divided into a square of sub-tasks on both sides, so no task meets a whole hot cell.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelwatt.functions import geo
from parcelwatt.operators.graph import connected_components
from parcelwatt.operators.join import distinct_on, top_k
from parcelwatt.session import cut

HOT = 2_000
HOT_LIST = 10_000
LITERAL_LIMIT = 1_000
LOAD = 4_000_000  # candidate pairs a task

CELL = ["_row", "_col"]


def split_hot(left: DataFrame, right: DataFrame, keys: list[str], left_id: Column, right_id: Column) -> tuple[DataFrame, DataFrame, list[str]]:
    """Prepare an inner join on ``keys`` whose right side may hold very many rows of one key.

    Keys with more than ``HOT`` right rows are divided into an s x s square of groups: a left row is
    sent to one line of the square, a right row to one column, so each pair of rows shares exactly
    one group. Returns both sides and the join keys. Nothing is added when no key is hot; a short
    list of hot keys (its length is checked) is broadcast, a long one is joined by shuffle.
    """
    crowded = (
        right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT)
        .select(*keys, F.ceil(F.sqrt(F.col("_n") / HOT)).cast("int").alias("_s"))
    )
    found = crowded.limit(HOT_LIST + 1).collect()
    if not found:
        return left, right, keys
    if len(found) <= HOT_LIST:
        crowded = F.broadcast(left.sparkSession.createDataFrame(found, crowded.schema))

    def spread(df: DataFrame, identity: Column, own_is_line: bool) -> DataFrame:
        s = F.coalesce("_s", F.lit(1))
        own = F.pmod(F.xxhash64(identity), s).cast("int")
        other = F.sequence(F.lit(0), s - 1)
        salts = F.transform(other, (lambda j: own * s + j) if own_is_line else (lambda i: i * s + own))
        return df.join(crowded, keys, "left").withColumn("_salt", F.explode(salts)).drop("_s")

    return spread(left, left_id, True), spread(right, right_id, False), [*keys, "_salt"]


def by_load(left: DataFrame, right: DataFrame, keys: list[str], load: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of an inner join dealt by ``keys`` to as many tasks as keep each at about ``load`` pairs of rows; the pairs are counted by key.

    The bytes of the sides say nothing of the pairs they make, so sizes alone would leave few tasks with nearly all of them.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    pairs = count(left, "_l").join(count(right, "_r"), keys).agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0.0
    tasks = math.ceil(pairs / (load or LOAD))
    return (left.repartition(tasks, *keys), right.repartition(tasks, *keys)) if tasks > 1 else (left, right)


def _in_cells(df: DataFrame, cells: Column) -> DataFrame:
    return df.withColumn("_cell", F.explode(cells)).withColumns({"_row": F.col("_cell.row"), "_col": F.col("_cell.col")}).drop("_cell")


def _own_cell(df: DataFrame, lng: str, lat: str, size: float) -> DataFrame:
    return df.withColumn("_row", geo.cell_row(F.col(lat), size)).withColumn("_col", geo.cell_col(F.col(lng), F.col("_row"), size))


def distance_pairs(points: DataFrame, radius_m: float, where: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Unordered pairs (id_a < id_b) at most ``radius_m`` metres apart, with ``distance_m``.

    ``points``: id, lng, lat; duplicate ids are reduced to one point first. ``where`` may refer to
    id_a and id_b. Columns named in ``carry`` come along from both ends, as ``<column>_a`` and ``<column>_b``. The number of
    result rows is the number of close pairs, by definition; the number of tasks follows the counted candidates, so
    a task holds about ``LOAD`` of them however many there are.
    """
    one = distinct_on(points.select("id", "lng", "lat", *carry).dropna(subset=["id", "lng", "lat"]), ["id"], [F.col("lng"), F.col("lat"), *map(F.col, carry)])
    side = lambda s: one.toDF(*[f"{c}_{s}" for c in one.columns])
    left = _in_cells(side("a"), geo.neighbour_cells(F.col("lng_a"), F.col("lat_a"), radius_m))
    right = _own_cell(side("b"), "lng_b", "lat_b", radius_m)
    left, right, keys = split_hot(left, right, CELL, F.col("id_a"), F.col("id_b"))
    left, right = by_load(left, right, keys)
    pairs = left.join(right, keys).filter(F.col("id_a") < F.col("id_b"))
    if where is not None:
        pairs = pairs.filter(where)
    distance = geo.haversine(F.col("lng_a"), F.col("lat_a"), F.col("lng_b"), F.col("lat_b"))
    carried = [f"{c}_{s}" for s in "ab" for c in carry]
    return pairs.withColumn("distance_m", distance).filter(F.col("distance_m") <= radius_m).select("id_a", "id_b", "distance_m", *carried)


def range_join(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """All (left, right) pairs within ``radius_m``. Both sides: id, lng, lat."""
    l = _in_cells(left.select("id", "lng", "lat").toDF("id", "_lng", "_lat"), geo.neighbour_cells(F.col("_lng"), F.col("_lat"), radius_m))
    r = _own_cell(right.select("id", "lng", "lat").toDF("target_id", "_tlng", "_tlat"), "_tlng", "_tlat", radius_m)
    l, r, keys = split_hot(l, r, CELL, F.col("id"), F.col("target_id"))
    joined = l.join(r, keys).withColumn("distance_m", geo.haversine(F.col("_lng"), F.col("_lat"), F.col("_tlng"), F.col("_tlat")))
    return joined.filter(F.col("distance_m") <= radius_m).select("id", "target_id", "distance_m")


def knn_join(left: DataFrame, right: DataFrame, k: int = 1, max_m: float | None = None, literal_limit: int = LITERAL_LIMIT) -> DataFrame:
    """The ``k`` nearest right points of every left point: id, target_id, distance_m, rank.

    Both sides: id, lng, lat. Ties go to the smaller target id. A right side proven to have at most
    ``literal_limit`` rows becomes a constant array searched inside each task, without any join.
    A larger one is searched by cells of growing size: a point leaves as soon as its ``k`` nearest
    are certain. Points without coordinates have no neighbours, and a left id that occurs several times is answered once,
    from its point of smallest coordinates, on either way.
    """
    left = top_k(left.select("id", "lng", "lat").dropna(subset=["lng", "lat"]), ["id"], [F.col("lng"), F.col("lat")], 1)
    targets = right.select("id", "lng", "lat").dropna()
    few = targets.limit(literal_limit + 1).collect()
    if len(few) <= literal_limit and all(isinstance(r.id, (int, str)) for r in few):
        return _knn_literal(left, few, targets.schema["id"].dataType.simpleString(), k, max_m)
    return _knn_rings(left, targets, k, max_m)


def _knn_literal(left: DataFrame, rows: list, id_type: str, k: int, max_m: float | None) -> DataFrame:
    text = json.dumps([{"id": r.id, "lng": float(r.lng), "lat": float(r.lat)} for r in rows])
    constant = F.from_json(F.lit(text), f"array<struct<id:{id_type},lng:double,lat:double>>")
    measured = F.transform(constant, lambda t: F.struct(
        geo.haversine(F.col("lng"), F.col("lat"), t["lng"], t["lat"]).alias("distance_m"), t["id"].alias("target_id")))
    near = F.slice(F.array_sort(measured), 1, k)
    out = left.select("id", F.posexplode(near).alias("_i", "_t")).select(
        "id", "_t.target_id", "_t.distance_m", (F.col("_i") + 1).alias("rank")
    )
    return out if max_m is None else out.filter(F.col("distance_m") <= max_m)


def _knn_rings(left: DataFrame, targets: DataFrame, k: int, max_m: float | None) -> DataFrame:
    # Of the targets sharing one spot only the k smallest ids can ever be an answer.
    targets = cut(top_k(targets, ["lng", "lat"], [F.col("id")], k).toDF("target_id", "_tlng", "_tlat"))
    box = targets.agg(
        F.count(F.lit(1)), F.min("_tlng"), F.max("_tlng"), F.min("_tlat"), F.max("_tlat")
    ).first()
    lbox = left.agg(F.min("lng"), F.max("lng"), F.min("lat"), F.max("lat")).first()
    if lbox[0] is None:
        return left.sparkSession.createDataFrame([], "id " + left.schema["id"].dataType.simpleString() + ", target_id " + targets.schema["target_id"].dataType.simpleString() + ", distance_m double, rank int")
    north_south = max(box[4], lbox[3]) - min(box[3], lbox[2])
    east_west = max(box[2], lbox[1]) - min(box[1], lbox[0])
    reach = max(north_south, east_west, 1e-6) * geo.METRES_PER_DEGREE * 1.01
    size = max(reach / math.sqrt(max(box[0], 1)) * math.sqrt(k / 3.0), 1.0)
    open_points, found = left.select("id", F.col("lng").alias("_lng"), F.col("lat").alias("_lat")), []
    while True:
        whole = size >= reach or (max_m is not None and size >= max_m)
        l = _in_cells(open_points, geo.neighbour_cells(F.col("_lng"), F.col("_lat"), size))
        r = _own_cell(targets, "_tlng", "_tlat", size)
        l, r, keys = split_hot(l, r, CELL, F.col("id"), F.col("target_id"))
        near = l.join(r, keys).withColumn("distance_m", geo.haversine(F.col("_lng"), F.col("_lat"), F.col("_tlng"), F.col("_tlat")))
        if not whole:
            near = near.filter(F.col("distance_m") <= size)
        best = top_k(near.select("id", "target_id", "distance_m"), ["id"], [F.col("distance_m"), F.col("target_id")], k, "rank")
        full = best if whole else best.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id"))).filter(F.col("_n") == k).drop("_n")
        done = cut(full)
        found.append(done)
        if whole:
            break
        open_points = cut(open_points.join(done.select("id").distinct(), "id", "left_anti"))
        if open_points.isEmpty():
            break
        size *= 2
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out if max_m is None else out.filter(F.col("distance_m") <= max_m)


def pip_join(points: DataFrame, polygons: DataFrame, size_m: float = 1_000.0) -> DataFrame:
    """(id, polygon_id) for every point inside a polygon.

    ``points``: id, lng, lat. ``polygons``: polygon_id, rings. The extent of a polygon is covered by
    cells of ``size_m``; points look up their own cell and are then tested against the rings.
    """
    box = geo.bbox(F.col("rings"))
    rows = lambda lat: geo.cell_row(lat, size_m)

    boxed = polygons.filter(F.size("rings") > 0).withColumn("_box", box)
    boxed = boxed.withColumn("_row", F.explode(F.sequence(rows(F.col("_box.ymin")), rows(F.col("_box.ymax")))))
    first = geo.cell_col(F.col("_box.xmin"), F.col("_row"), size_m)
    last = geo.cell_col(F.col("_box.xmax"), F.col("_row"), size_m)
    covered = boxed.withColumn("_col", F.explode(F.sequence(first, last))).select("polygon_id", "rings", *CELL)
    own = _own_cell(points.select("id", "lng", "lat"), "lng", "lat", size_m)
    left, right, keys = split_hot(own, covered, CELL, F.col("id"), F.col("polygon_id"))
    return left.join(right, keys).filter(geo.contains(F.col("rings"), F.col("lng"), F.col("lat"))).select("id", "polygon_id")


def bbox_join(left: DataFrame, right: DataFrame, size_m: float = 1_000.0) -> DataFrame:
    """(id, target_id) of intersecting extents. Both sides: id, xmin, ymin, xmax, ymax."""
    def covered(df: DataFrame) -> DataFrame:
        df = df.select("id", "xmin", "ymin", "xmax", "ymax")
        df = df.withColumn("_row", F.explode(F.sequence(geo.cell_row(F.col("ymin"), size_m), geo.cell_row(F.col("ymax"), size_m))))
        lo, hi = geo.cell_col(F.col("xmin"), F.col("_row"), size_m), geo.cell_col(F.col("xmax"), F.col("_row"), size_m)
        return df.withColumn("_col", F.explode(F.sequence(lo, hi)))

    l, r = covered(left), covered(right).toDF("target_id", "_x0", "_y0", "_x1", "_y1", *CELL)
    l, r, keys = split_hot(l, r, CELL, F.col("id"), F.col("target_id"))
    joined = l.join(r, keys).filter((F.col("xmin") <= F.col("_x1")) & (F.col("xmax") >= F.col("_x0")) & (F.col("ymin") <= F.col("_y1")) & (F.col("ymax") >= F.col("_y0")))
    # The pair is reported once: by the cell holding the lower-left corner of the common extent.
    y, x = F.greatest("ymin", "_y0"), F.greatest("xmin", "_x0")
    at_corner = (F.col("_row") == geo.cell_row(y, size_m)) & (F.col("_col") == geo.cell_col(x, F.col("_row"), size_m))
    return joined.filter(at_corner).select("id", "target_id")


# ── DBSCAN ───────────────────────────────────────────────────────────────────

def dbscan(points: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """Density clusters in the plane of ``lng``, ``lat``: id, cluster (null for noise), is_core.

    ``eps`` is in degrees (``geo.eps_degrees`` converts metres). A cluster is named by its smallest
    core id; a border point joins the smallest-named cluster within reach.

    Points on one spot are handled as one weighted spot. Spots are put in square cells whose
    diagonal is ``eps``: a cell with ``min_pts`` points is all core and all one cluster, without
    comparing its points. Cells are linked by their outermost points where that suffices, and by
    exact comparison of the facing points only where it does not.
    """
    side = eps / math.sqrt(2.0) * (1 - 1e-9)
    pts = points.select("id", F.col("lng").cast("double").alias("x"), F.col("lat").cast("double").alias("y")).dropna()
    spots = cut(
        pts.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("spot"))
        .withColumns({"_row": F.floor(F.col("y") / side).cast("long"), "_col": F.floor(F.col("x") / side).cast("long")})
    )
    weight = spots.groupBy(*CELL).agg(F.sum("w").alias("_cw"))
    near2 = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda i: F.transform(
            F.sequence(F.lit(-2), F.lit(2)), lambda j: F.struct(i.alias("i"), j.alias("j"))))),
        lambda c: F.abs(c["i"]) + F.abs(c["j"]) < 4,
    )

    def reach(df: DataFrame) -> DataFrame:
        """Copies of the rows in every cell that may hold points within eps."""
        d = df.withColumn("_d", F.explode(near2))
        return d.withColumns({"_row": F.col("_row") + F.col("_d.i"), "_col": F.col("_col") + F.col("_d.j")}).drop("_d")

    def close(df: DataFrame, other: DataFrame) -> DataFrame:
        """Pairs (df row, other row as o_*) within eps."""
        o = other.select(*CELL, *[F.col(c).alias(f"o_{c}") for c in other.columns if c not in CELL])
        l, r, keys = split_hot(reach(df), o, CELL, F.col("spot"), F.col("o_spot"))
        near = F.pow(F.col("x") - F.col("o_x"), 2) + F.pow(F.col("y") - F.col("o_y"), 2) <= eps * eps
        return l.join(r, keys).filter(near)

    tagged = spots.join(weight, CELL)
    dense = tagged.filter(F.col("_cw") >= min_pts).select("spot", "x", "y", *CELL)
    sparse = tagged.filter(F.col("_cw") < min_pts).select("spot", "x", "y", *CELL)
    counts = close(sparse, spots).groupBy("spot").agg(F.sum("o_w").alias("_near"))
    sparse_core = sparse.join(counts.filter(F.col("_near") >= min_pts).select("spot"), "spot", "left_semi")
    core = cut(dense.unionByName(sparse_core.select(*dense.columns)))

    # Cell level: one node per cell with core points, named by its smallest core id.
    nodes = core.groupBy(*CELL).agg(F.min("spot").alias("node"))
    corners = {f"e{i}": e for i, e in enumerate((F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")))}
    spot_xy = F.struct("x", "y")
    extremes = core.groupBy(*CELL).agg(
        F.array_distinct(F.array(*[f(spot_xy, e) for e in corners.values() for f in (F.min_by, F.max_by)])).alias("_ext")
    )
    cells = cut(nodes.join(extremes, CELL))
    here = cells.select(*CELL, "node", "_ext", F.col("_row").alias("_row0"), F.col("_col").alias("_col0"))
    there = cells.select(*CELL, F.col("node").alias("o_node"), F.col("_ext").alias("o_ext"))
    facing = reach(here).join(there, CELL).filter(F.col("node") < F.col("o_node"))
    linked = F.exists("_ext", lambda a: F.exists("o_ext", lambda b: F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2) <= eps * eps))
    facing = cut(facing.withColumn("_linked", linked))
    sure = facing.filter("_linked").select("node", "o_node")
    # Cells whose outermost points are apart may still touch: compare only points within eps of the other cell.
    gap = lambda v, o: F.greatest(o * side - v, v - (o + 1) * side, F.lit(0.0))
    def toward(own: str, row: str, col: str) -> DataFrame:
        pairs = facing.filter("NOT _linked").select(
            F.col("node"), F.col("o_node"), F.col("_row0").alias("r1"), F.col("_col0").alias("c1"), F.col("_row").alias("r2"), F.col("_col").alias("c2")
        )
        pts_ = core.withColumnsRenamed({"_row": f"r{own}", "_col": f"c{own}"})
        near = F.pow(gap(F.col("x"), F.col(col)), 2) + F.pow(gap(F.col("y"), F.col(row)), 2) <= eps * eps * (1 + 1e-9)
        return pairs.join(pts_, [f"r{own}", f"c{own}"]).filter(near).select("node", "o_node", "spot", "x", "y")

    a = toward("1", "r2", "c2")
    b = toward("2", "r1", "c1").toDF("node", "o_node", "o_spot", "o_x", "o_y")
    a, b, keys = split_hot(a, b, ["node", "o_node"], F.col("spot"), F.col("o_spot"))
    touching = F.pow(F.col("x") - F.col("o_x"), 2) + F.pow(F.col("y") - F.col("o_y"), 2) <= eps * eps
    checked = a.join(b, keys).filter(touching).groupBy("node", "o_node").agg(F.lit(1).alias("_t")).select("node", "o_node")
    edges = sure.unionByName(checked).toDF("u", "v")

    component = connected_components(edges)
    named = cells.join(component.withColumnsRenamed({"id": "node"}), "node", "left").select(
        *CELL, F.coalesce("component", "node").alias("cluster")
    )
    core_spots = core.join(named, CELL).select("spot", "x", "y", *CELL, "cluster")
    loose = sparse.join(core.select("spot"), "spot", "left_anti")
    border = close(loose, core_spots).groupBy("spot").agg(F.min("o_cluster").alias("cluster"))
    labels = core_spots.select("spot", "cluster", F.lit(True).alias("is_core")).unionByName(
        border.select("spot", "cluster", F.lit(False).alias("is_core"))
    )
    spot_labels = spots.select("x", "y", "spot").join(labels, "spot", "left").drop("spot")
    return pts.join(spot_labels, ["x", "y"], "left").select("id", "cluster", F.coalesce("is_core", F.lit(False)).alias("is_core"))
