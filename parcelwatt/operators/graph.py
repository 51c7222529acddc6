"""Iterative jobs on edge DataFrames. Each round is cut reliably; many sources run in one job."""

from __future__ import annotations

from functools import partial
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelwatt.functions import geo, hazard
from parcelwatt.operators.join import SMALL_ROWS, dealt, distinct_on, small, top_k
from parcelwatt.operators.routes import GATHER, bounded_search, gathered, laid_out, search
from parcelwatt.session import cut


def _stars(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """Every id of the pairs beside the smallest one linked with it in them."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u):]
    low = np.arange(len(ids))
    while len(a):
        x, y = low[a], low[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(low, low[low]):
            low = low[low]
    own = low != np.arange(len(ids))
    return pd.DataFrame({"u": ids[own], "v": ids[low[own]]})


def _thinned(parts, rows: int = 500_000):
    """Pairs of one task reduced to stars with the same components: no more rows than ids, whatever the number of pairs."""
    held, waiting = [], 0
    for part in parts:
        held.append(part)
        waiting += len(part)
        if waiting >= rows:
            whole = pd.concat(held)
            held, waiting = [_stars(whole["u"].to_numpy(), whole["v"].to_numpy())], 0
    if held:
        whole = pd.concat(held)
        yield _stars(whole["u"].to_numpy(), whole["v"].to_numpy())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) pairs -> id, component (the smallest id reachable), for every id with an edge.

    Alternating large-star and small-star steps: each round hangs nodes on smaller neighbours, so
    long chains collapse in logarithmically many rounds. Before them every task thins its pairs to stars, so what is
    shuffled follows the ids and not the pairs.
    """
    def smallest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("_m"))

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = smallest(both).select("u", F.least("_m", "u").alias("m"))
        return both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        low = smallest(down).select("u", F.col("_m").alias("m"))
        hung = down.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hung.unionByName(low.select("u", F.col("m").alias("v")))

    pairs = edges.filter("u <> v").select("u", "v")
    if all(f.dataType.typeName() in ("byte", "short", "integer", "long", "string") for f in pairs.schema):
        pairs = pairs.mapInPandas(_thinned, pairs.schema)
    current = cut(pairs.distinct())
    mark = None
    for _ in range(max_rounds):
        current = cut(small_star(large_star(current).distinct()).distinct())
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("connected components did not settle; raise max_rounds")
    roots = current.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    leaves = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.unionByName(roots).groupBy("id").agg(F.min("component").alias("component"))


def mirror(edges: DataFrame) -> DataFrame:
    """Complete a one-way edge table with its reverse edges; existing edges keep their values.

    An edge is moved once, to where the edges between its two ends meet, and both ways are made there. The edges are counted first, so that a task
    sorts a bounded number of them.
    """
    source, target = F.col("source_pnu"), F.col("target_pnu")
    rest = [c for c in edges.columns if c not in ("source_pnu", "target_pnu")]
    turned = source.isNotNull() & (target.isNull() | (source > target))
    ends = [F.when(turned, b).otherwise(a).alias(n) for a, b, n in ((source, target, "_low"), (target, source, "_high"))]
    met = dealt(edges.select(*ends, turned.alias("_turned"), *rest), 2 * edges.count(), ["_low", "_high"])
    # a stored edge goes before the reverse of another
    best = lambda reverse: F.min(F.struct(reverse.cast("int").alias("_r"), *rest))
    one = met.groupBy("_low", "_high").agg(best(F.col("_turned")).alias("_up"), best(~F.col("_turned")).alias("_down"))
    way = lambda s, t, v: F.struct(F.col(s).alias("source_pnu"), F.col(t).alias("target_pnu"), *[F.col(f"{v}.{c}").alias(c) for c in rest])
    up, down = way("_low", "_high", "_up"), way("_high", "_low", "_down")
    ways = F.when(F.col("_low").eqNullSafe(F.col("_high")), F.array(up)).otherwise(F.array(up, down))
    return one.select(F.explode(ways).alias("_e")).select(*[F.col(f"_e.{c}").alias(c) for c in edges.columns])


def with_endpoint_attrs(pairs: DataFrame, attrs: DataFrame, columns: list[str]) -> DataFrame:
    """Join ``columns`` of both ends: ``<column>_a`` and ``<column>_b``. ``attrs`` is unique on id."""
    side = lambda s: attrs.select(F.col("id").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return pairs.join(side("a"), "id_a", "left").join(side("b"), "id_b", "left")


def build_adjacency(points: DataFrame, attrs: DataFrame, radius_m: float = 25.0, mode: str = "source",
                    where: Column | None = None) -> DataFrame:
    """Directed spread graph of buildings within ``radius_m``: both directions of every close pair.

    ``points``: id, lng, lat. ``attrs``: id, structure_class. One job over all districts.
    """
    from parcelwatt.operators.spatial import distance_pairs

    # the class goes to the points, of which there are far fewer than pairs
    known = distinct_on(attrs.select("id", "structure_class"), ["id"], [F.col("structure_class")])
    classed = points.select("id", "lng", "lat").join(known, "id", "left")
    pairs = distance_pairs(classed, radius_m, where, ("structure_class",))
    cls = lambda s: F.coalesce(f"structure_class_{s}", F.lit("RC"))
    ends = F.explode(F.array(
        F.struct(F.col("id_a").alias("s"), F.col("id_b").alias("t"), cls("a").alias("cs"), cls("b").alias("ct")),
        F.struct(F.col("id_b").alias("s"), F.col("id_a").alias("t"), cls("b").alias("cs"), cls("a").alias("ct")),
    ))
    weight = hazard.spread_weight(F.col("distance_m"), F.col("e.cs"), F.col("e.ct"), radius_m, mode)
    return pairs.select("distance_m", ends.alias("e")).select(
        F.col("e.s").alias("source_pnu"), F.col("e.t").alias("target_pnu"), "distance_m", weight.alias("spread_weight")
    )


def _nearest(rows: pa.Table, k: int) -> pa.Table:
    """The rows of every pnu that may hold one of its ``k`` nearest neighbours: up to some distance all of them, with ``k`` different neighbours or whole."""
    code = lambda c: rows[c].combine_chunks().dictionary_encode(null_encoding="encode")
    owner, other = code("pnu"), code("neighbor_pnu")
    metres = np.asarray(rows["distance_m"].to_numpy(), np.float64) + 0.0
    # the bits of a distance that is not negative are in the order of its value
    key = owner.indices.to_numpy().astype(np.uint64) << np.uint64(40) | metres.view(np.uint64) >> np.uint64(23)
    order = np.argsort(key)
    key = key[order]
    group = (key >> np.uint64(40)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    ends, others = np.append(starts[1:], len(key)), other.indices.to_numpy()[order].astype(np.int64)
    sizes = ends - starts
    place, width = np.repeat(np.arange(len(starts)), sizes), np.full(len(starts), 4 * k)
    while True:
        last = starts + np.minimum(width, sizes) - 1
        kept = np.flatnonzero(key <= np.repeat(key[last], sizes))
        met = np.unique(place[kept] * len(other.dictionary) + others[kept]) // len(other.dictionary)
        short = (np.bincount(met, minlength=len(starts)) < k) & (width < sizes)
        if not short.any():
            return rows.take(pa.array(order[kept]))
        width[short] *= 4


def _near(batches, k: int, together: int):
    """Edges (two ends and a distance) both ways, each task's own nearest only."""
    def sent(held):
        ends = pa.Table.from_batches(held)
        names = ["pnu", "neighbor_pnu", "distance_m"]
        both = pa.concat_tables([ends.rename_columns(names), ends.select([1, 0, 2]).rename_columns(names)])
        return _nearest(both, k).to_batches()

    held, waiting = [], 0
    for batch in batches:
        held.append(batch)
        waiting += batch.num_rows
        if waiting >= together:
            yield from sent(held)
            held, waiting = [], 0
    if waiting:
        yield from sent(held)


def neighbors(edges: DataFrame, ids: DataFrame | None = None, k: int = 50) -> DataFrame:
    """The ``k`` nearest neighbours of every vertex, whichever way its edges are stored.

    Without ``ids``, a task sends on only the edges that can be among the nearest of their vertex, so what is shuffled follows the vertices; where a
    distance is missing, negative or not a number it sends all of them.
    """
    way = lambda s, t: F.struct(F.col(s).alias("pnu"), F.col(t).alias("neighbor_pnu"))
    both = edges.select(F.explode(F.array(way("source_pnu", "target_pnu"), way("target_pnu", "source_pnu"))).alias("_e"), "distance_m").select("_e.*", "distance_m")
    if ids is not None:
        both = both.join(ids.select("pnu").distinct(), "pnu", "left_semi")
    plain = F.when((F.col("distance_m") >= 0) & ~F.isnan("distance_m"), 1)
    counted, usual = (edges if ids is None else both).agg(F.count(F.lit(1)), F.count(plain)).first()
    near = both
    if ids is None and usual == counted and both.schema["distance_m"].dataType.typeName() == "double":
        ends = [F.col(c).cast(both.schema["pnu"].dataType) for c in ("source_pnu", "target_pnu")]
        near = edges.select(*ends, "distance_m").mapInArrow(partial(_near, k=k, together=GATHER), both.schema)
    rows = 2 * counted if ids is None else counted
    one = dealt(near, rows, ["pnu", "neighbor_pnu"]).groupBy("pnu", "neighbor_pnu").agg(F.min("distance_m").alias("distance_m"))
    return top_k(one, ["pnu"], [F.col("distance_m"), F.col("neighbor_pnu")], k, "rank")


def scenario_id(pnu: Column, direction: Column, speed: Column) -> Column:
    """Stable name of a spread scenario."""
    return F.md5(F.format_string("%s:%.1f:%.1f", pnu.cast("string"), direction.cast("double"), speed.cast("double")))


WINDS = 32  # winds of the seeds under which edges are judged once, before the first step
POINT_ROWS = 1_000_000  # points that are broadcast, three numbers each
PASSES = 8  # passes over the lists in which a step meets them without moving them


def _strength(bearing: Column, direction: Column, speed: Column) -> Column:
    return F.col("spread_weight") * F.when(speed > 0, hazard.wind_factor(bearing, direction, speed)).otherwise(1.0)


def _judged(live: DataFrame, centroids: DataFrame, winds: list | None, threshold: float) -> DataFrame:
    """Edges with the bearing of their ends or, if ``winds`` are given, with _mask, the bits of those under which they reach ``threshold``."""
    c = cut(distinct_on(centroids.select("id", "lng", "lat"), ["id"], [F.col("lng"), F.col("lat")]))
    c = F.broadcast(c) if c.count() <= POINT_ROWS else c
    live = live.join(c.toDF("vertex", "_x1", "_y1"), "vertex").join(c.toDF("to", "_x2", "_y2"), "to")
    live = live.withColumn("_bearing", geo.bearing(F.col("_x1"), F.col("_y1"), F.col("_x2"), F.col("_y2"))).drop("_x1", "_y1", "_x2", "_y2")
    if winds is None:
        return live
    mask = F.lit(0).cast("long")
    for i, (direction, speed) in enumerate(winds):
        reaches = _strength(F.col("_bearing"), F.lit(direction).cast("double"), F.lit(speed).cast("double")) >= threshold
        mask = mask + F.when(reaches, 1 << i).otherwise(0)
    return live.withColumn("_mask", mask).filter("_mask > 0")


def spread(edges: DataFrame, seeds: DataFrame, centroids: DataFrame | None = None, threshold: float = 0.25,
           max_steps: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """Step-wise spread from every seed at once: scenario, step, id.

    ``seeds``: scenario, id and, with ``centroids`` (id, lng, lat), wind_direction and wind_speed.
    A vertex is reached when the strongest weight x wind factor from the last step's vertices is at
    least ``threshold``. A scenario runs until nothing new is reached; if given, ``max_steps`` ends it
    earlier, and so does ``max_nodes``, once it holds that many vertices before a step begins.

    Edges are judged before the first step, by the winds of the seeds where those are ``WINDS`` at most, and kept as lists of the vertices they lead to,
    which every task makes of its own edges: the edges are never shuffled, and a step unfolds only the lists it takes.
    """
    live = edges.filter(F.col("spread_weight") > 0).select(F.col("source_pnu").alias("vertex"), F.col("target_pnu").alias("to"), "spread_weight")
    by, values, carried, passes = ["vertex"], ["to"], [], None
    if centroids is None:
        live, seeds = live.filter(F.col("spread_weight") >= threshold), seeds.select("scenario", "id")
    else:
        # no wind of the seeds lifts a weaker edge over the threshold
        top = seeds.agg(F.max(F.abs("wind_speed"))).first()[0] or 0.0
        live = live.filter(F.col("spread_weight") * (1.0 + top / 20.0) * (1 + 1e-9) >= threshold)
        seeds = seeds.select("scenario", "id", "wind_direction", "wind_speed")
        found = seeds.select("wind_direction", "wind_speed").distinct().limit(WINDS + 1).collect()
        winds = [tuple(r) for r in found] if len(found) <= WINDS else None
        live = _judged(live, centroids, winds, threshold)
        if winds is None:
            values, carried = ["to", "spread_weight", "_bearing"], ["wind_direction", "wind_speed"]
            passes = _strength(F.col("_bearing"), F.col("wind_direction"), F.col("wind_speed")) >= threshold
        else:
            by, carried = ["vertex", "_mask"], ["_bit"]
            bit = F.lit(0).cast("long")
            for i, (direction, speed) in enumerate(winds):
                bit = F.when(F.col("wind_direction").eqNullSafe(F.lit(direction)) & F.col("wind_speed").eqNullSafe(F.lit(speed)), 1 << i).otherwise(bit)
            seeds = seeds.withColumn("_bit", bit)
            passes = F.col("_mask").bitwiseAND(F.col("_bit")) > 0
    live = cut(gathered(live, by, values))
    names = cut(seeds.select("scenario").distinct().withColumn("_s", F.monotonically_increasing_id()))
    named = small(names, names.count())
    frontier = cut(seeds.join(named.withColumnRenamed("scenario", "_name"), F.col("scenario").eqNullSafe(F.col("_name"))).select("_s", *carried, "id").distinct())
    visited, late = frontier.select("_s", F.lit(0).alias("step"), "id"), []
    new = total = frontier.count()
    for step in count(1) if max_steps is None else range(1, max_steps + 1):
        going, seen = frontier, visited
        for part in late:
            seen = seen.unionByName(part)
        if max_nodes is not None and total >= max_nodes:
            full = seen.groupBy("_s").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= max_nodes)
            going = frontier.join(full.select("_s"), "_s", "left_anti")
        reached = None
        for front, rows in _parts(going.withColumnRenamed("id", "vertex"), new):
            met = live.join(small(front, rows), "vertex")
            if values == ["to"]:
                met = (met if passes is None else met.filter(passes)).select("_s", *carried, F.explode("to").alias("id"))
            else:
                met = met.select("_s", *carried, F.inline(F.arrays_zip(*values))).filter(passes).select("_s", *carried, F.col("to").alias("id"))
            reached = met if reached is None else reached.unionByName(met)
        fresh = reached.distinct().join(small(seen.select("_s", "id"), total), ["_s", "id"], "left_anti").select("_s", *carried, "id")
        frontier = cut(fresh)
        new = frontier.count()
        if new == 0:
            return seen.join(named, "_s").select("scenario", "step", "id")
        total += new
        late.append(frontier.select("_s", F.lit(step).alias("step"), "id"))
        if len(late) == MERGE_EVERY:
            visited, late = cut(seen.unionByName(late[-1]).repartition("_s", "id")), []
    for part in late:
        visited = visited.unionByName(part)
    return visited.join(named, "_s").select("scenario", "step", "id")


def _parts(front: DataFrame, rows: int) -> list[tuple[DataFrame, int]]:
    """``front`` in parts by vertex that are small enough to be told to the tasks, with a bound of their rows; whole if they would be more than ``PASSES``."""
    parts = -(-rows // SMALL_ROWS)
    if not 1 < parts <= PASSES:
        return [(front, rows)]
    # parts of hashed vertices differ a little in size, so twice the mean is taken for their bound
    return [(front.filter(F.pmod(F.xxhash64("vertex"), F.lit(2 * parts)) == i), -(-rows // parts)) for i in range(2 * parts)]


MERGE_EVERY = 8  # steps after which the vertices reached become one table, so that a step does not read a table for every step before it
TIME_PER_STEP_MIN = 5


def timeline(reached: DataFrame) -> DataFrame:
    """scenario, step, time_min, new_count, cumulative_count."""
    per = reached.groupBy("scenario", "step").agg(F.count(F.lit(1)).alias("new_count"))
    upto = Window.partitionBy("scenario").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumns({
        "time_min": F.col("step") * TIME_PER_STEP_MIN, "cumulative_count": F.sum("new_count").over(upto),
    })


def shortest_paths(roads: DataFrame, sources: DataFrame, max_hops: int | None = None, max_cost: float | None = None) -> DataFrame:
    """Cheapest cost from every source to every vertex in reach: source, vertex, cost, pred.

    ``roads``: source, target, length_m, travelled both ways. All sources move on together by cost (``routes.search``);
    with ``max_hops`` they relax one hop per round, that many rounds at most. Among equal costs the way of fewer vertices is kept, then the smaller predecessor.
    """
    if max_hops is None:
        return search(roads, sources.select(F.col("vertex").alias("source")), max_cost=max_cost).drop("hops")
    arcs = cut(
        roads.select(F.col("source").alias("vertex"), F.col("target").alias("_to"), "length_m")
        .unionByName(roads.select(F.col("target").alias("vertex"), F.col("source").alias("_to"), "length_m"))
        .groupBy("vertex", "_to").agg(F.min("length_m").alias("length_m"))
    )
    start = sources.select("vertex").distinct()
    none = F.lit(None).cast(arcs.schema["vertex"].dataType)
    best = cut(start.select(F.col("vertex").alias("source"), "vertex", F.lit(0.0).alias("cost"), none.alias("pred")))
    frontier, moved = best, best.count()
    for _ in range(max_hops):
        offers = arcs.join(small(frontier, moved), "vertex").select(
            "source", F.col("_to").alias("vertex"), (F.col("cost") + F.col("length_m")).alias("cost"), F.col("vertex").alias("pred")
        )
        if max_cost is not None:
            offers = offers.filter(F.col("cost") <= max_cost)
        offered = offers.groupBy("source", "vertex").agg(F.min(F.struct("cost", "pred")).alias("_o"))
        known = best.select("source", "vertex", F.struct("cost", "pred").alias("_k"))
        merged = known.join(offered, ["source", "vertex"], "full_outer").withColumn(
            "_better", F.col("_k").isNull() | F.coalesce(F.col("_o.cost") < F.col("_k.cost"), F.lit(False))
        )
        pick = F.when(F.col("_better"), F.col("_o")).otherwise(F.col("_k"))
        state = cut(merged.select("source", "vertex", pick.alias("_p"), "_better"))
        best = state.select("source", "vertex", "_p.cost", "_p.pred")
        frontier = state.filter("_better").select("source", "vertex", "_p.cost")
        moved = frontier.count()
        if moved == 0:
            break
    return best


def path_vertices(paths: DataFrame, ends: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Walk predecessors back from each (source, target): source, target, seq (0 = source), vertex."""
    known = ends.join(paths.select("source", F.col("vertex").alias("target")), ["source", "target"], "left_semi")
    walked = laid_out(paths, known).withColumnRenamed("seq", "back")
    if max_hops is not None:
        walked = walked.filter(F.col("back") <= max_hops)
    length = walked.groupBy("source", "target").agg(F.max("back").alias("_n"))
    return walked.join(length, ["source", "target"]).select("source", "target", (F.col("_n") - F.col("back")).alias("seq"), "vertex")


def routes(roads: DataFrame, vertices: DataFrame, origins: DataFrame, shelters: DataFrame, k: int = 3,
           max_hops: int | None = None, max_cost: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Shortest ways from each origin to its ``k`` nearest shelters.

    ``vertices`` / ``origins`` / ``shelters``: id, lng, lat. Origins and shelters enter the network at
    their nearest vertex. Returns (summary, path): summary is origin, shelter, distance_m (reachable,
    non-empty ways only); path is origin, shelter, seq, vertex.
    """
    from parcelwatt.operators.spatial import knn_join

    snap = lambda pts: knn_join(pts, vertices, 1).select("id", F.col("target_id").alias("vertex"))
    start = cut(snap(origins).toDF("origin", "source"))
    targets = knn_join(origins, shelters, k).select(F.col("id").alias("origin"), F.col("target_id").alias("shelter"))
    goal = targets.join(snap(shelters).toDF("shelter", "target"), "shelter")
    wanted = cut(start.join(goal, "origin"))
    if max_hops is None:
        # each origin is searched as far as its own shelters
        paths = bounded_search(roads, wanted.select("source", F.col("target").alias("vertex")), max_cost=max_cost)
    else:
        paths = shortest_paths(roads, start.select(F.col("source").alias("vertex")), max_hops, max_cost)
    summary = wanted.join(paths.select("source", F.col("vertex").alias("target"), F.col("cost").alias("distance_m")), ["source", "target"])
    summary = summary.filter(F.col("source") != F.col("target")).select("origin", "shelter", "source", "target", "distance_m")
    walked = path_vertices(paths, summary.select("source", "target").distinct(), max_hops)
    path = summary.select("origin", "shelter", "source", "target").join(walked, ["source", "target"]).select("origin", "shelter", "seq", "vertex")
    return summary.select("origin", "shelter", "distance_m"), path


def route_lines(path: DataFrame, vertices: DataFrame) -> DataFrame:
    """origin, shelter, line: the vertices of each way in order as an array of (lng, lat)."""
    located = path.join(vertices.select(F.col("id").alias("vertex"), "lng", "lat"), "vertex")
    ordered = F.sort_array(F.collect_list(F.struct("seq", "lng", "lat")))
    return located.groupBy("origin", "shelter").agg(F.transform(ordered, lambda p: F.struct(p["lng"], p["lat"])).alias("line"))
