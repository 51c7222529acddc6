import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwatt.functions import geo
from parcelwatt.operators import fire, graph, routes, spatial

R = geo.EARTH_RADIUS_M


def metres(a, b):
    (x1, y1), (x2, y2) = a, b
    p1, p2 = math.radians(y1), math.radians(y2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(h, 1)))


def frame(spark, pts):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, lng double, lat double")


@pytest.fixture()
def tiny_hot(monkeypatch):
    """Treat cells with more than five rows as hot, so that splitting is exercised."""
    monkeypatch.setattr(spatial, "HOT", 5)


def cloud(n, seed, lat=37.5, spread=0.01, hot=0.4):
    rng = np.random.default_rng(seed)
    pts = rng.uniform(-spread, spread, (n, 2)) + [127.0, lat]
    k = int(n * hot)
    pts[:k] = rng.normal(0, 0.0001, (k, 2)) + [127.0, lat]
    pts[:5] = pts[0]
    return [tuple(p) for p in pts]


@pytest.mark.parametrize("lat", [37.5, 0.0, -66.0])
def test_distance_pairs_match_brute_force(spark, tiny_hot, lat):
    pts = cloud(150, 7, lat)
    want = {(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if metres(pts[i], pts[j]) <= 120}
    got = {(r.id_a, r.id_b) for r in spatial.distance_pairs(frame(spark, pts), 120).collect()}
    assert got == want


def test_radius_edges(spark):
    step = 1 / geo.METRES_PER_DEGREE
    pts = [(127.0, 37.5), (127.0, 37.5 + 24.9 * step), (127.0, 37.5 - 25.1 * step)]
    assert [(r.id_a, r.id_b) for r in spatial.distance_pairs(frame(spark, pts), 25).collect()] == [(0, 1)]


def test_knn_both_ways_match_brute_force(spark, tiny_hot):
    left, right = cloud(60, 1), cloud(80, 2)
    right[10:16] = [right[10]] * 6
    left.append((129.5, 35.0))
    l, r = frame(spark, left), frame(spark, right)
    want = {(i, rank + 1, j) for i, p in enumerate(left) for rank, (_, j) in enumerate(sorted((metres(p, q), j) for j, q in enumerate(right))[:3])}
    dist = {(i, rank): metres(left[i], right[j]) for i, rank, j in want}
    for limit in (1000, 0):
        rows = spatial.knn_join(l, r, 3, literal_limit=limit).collect()
        assert len(rows) == 3 * len(left)
        assert all(abs(dist[(x.id, x.rank)] - x.distance_m) < 1e-6 for x in rows)
    near = spatial.knn_join(l, r, 3, max_m=200, literal_limit=0)
    assert near.count() == sum(d <= 200 for d in dist.values())
    assert spatial.knn_join(l, r.limit(0), 2).count() == 0


def test_range_and_pip(spark, tiny_hot):
    pts = cloud(80, 4)
    want = {(i, j) for i, p in enumerate(pts) for j, q in enumerate(pts) if metres(p, q) <= 90}
    assert {(r.id, r.target_id) for r in spatial.range_join(frame(spark, pts), frame(spark, pts), 90).collect()} == want
    x, y = 127.0, 37.5
    ring = [(x - 0.003, y - 0.002), (x + 0.003, y - 0.002), (x, y + 0.004), (x - 0.003, y - 0.002)]
    poly = spark.createDataFrame([("t", [[{"x": a, "y": b} for a, b in ring]])], "polygon_id string, rings array<array<struct<x:double,y:double>>>")

    def inside(p):
        hit = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    got = {r.id for r in spatial.pip_join(frame(spark, pts), poly, 150.0).collect()}
    assert got == {i for i, p in enumerate(pts) if inside(p)} and got


def brute_dbscan(pts, eps, k):
    n = len(pts)
    near = [[j for j in range(n) if (pts[i][0] - pts[j][0]) ** 2 + (pts[i][1] - pts[j][1]) ** 2 <= eps * eps] for i in range(n)]
    core = {i for i in range(n) if len(near[i]) >= k}
    label = {}
    for s in sorted(core):
        if s in label:
            continue
        stack = [s]
        while stack:
            i = stack.pop()
            if i not in label:
                label[i] = s
                stack += [j for j in near[i] if j in core]
    border = {i: min(label[j] for j in near[i] if j in core) for i in range(n) if i not in core and any(j in core for j in near[i])}
    return {i: (label.get(i, border.get(i)), i in core) for i in range(n)}


@pytest.mark.parametrize("seed,k", [(1, 4), (2, 3), (3, 7)])
def test_dbscan_matches_brute_force(spark, tiny_hot, seed, k):
    rng = np.random.default_rng(seed)
    blobs = np.concatenate([rng.normal(c, s, (40, 2)) for c, s in (((0, 0), 0.4), ((2.2, 0), 0.5), ((5, 5), 0.1))] + [rng.uniform(-2, 7, (40, 2)), np.repeat([[6.5, 0.0]], 6, axis=0)])
    pts = [tuple(p) for p in blobs]
    got = {r.id: (r.cluster, r.is_core) for r in spatial.dbscan(frame(spark, pts), 0.45, k).collect()}
    assert got == brute_dbscan(pts, 0.45, k)


def test_dbscan_cells_linked_only_by_inner_points(spark):
    """Two crowded cells whose outermost points are far apart but whose inner points touch."""
    eps = 1.0
    side = eps / math.sqrt(2)
    left = [(side * 0.98, side * f) for f in (0.5,)] + [(side * 0.05, side * 0.02), (side * 0.05, side * 0.98), (side * 0.5, 0.001), (side * 0.5, side * 0.99)]
    right = [(p[0] + side * 2.35, p[1]) for p in left]
    pts = left + right
    got = {r.id: (r.cluster, r.is_core) for r in spatial.dbscan(frame(spark, pts), eps, 3).collect()}
    assert got == brute_dbscan(pts, eps, 3)


def test_components_chain_cycle(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (1002, 1000)] + [(5000, 5000 + i) for i in range(1, 50)]
    out = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert len(out) == 201 + 3 + 50 and all(out[i] == 0 for i in range(201)) and out[1002] == 1000 and out[5049] == 5000


EDGE = "source_pnu string, target_pnu string, distance_m double, spread_weight double"


def test_spread_rules(spark, rows):
    e = spark.createDataFrame([("a", "b", 1.0, 0.5), ("b", "a", 1.0, 0.5), ("b", "c", 1.0, 0.25), ("c", "d", 1.0, 0.0), ("b", "e", 1.0, 0.2), ("c", "f", 1.0, 0.9), ("z", "y", 1.0, 0.9)], EDGE)
    seeds = spark.createDataFrame([("s1", "a"), ("s2", "c"), ("s3", "lonely")], "scenario string, id string")
    assert rows(graph.spread(e, seeds)) == [("s1", 0, "a"), ("s1", 1, "b"), ("s1", 2, "c"), ("s1", 3, "f"), ("s2", 0, "c"), ("s2", 1, "f"), ("s3", 0, "lonely")]
    assert rows(graph.spread(e, seeds, max_steps=1)) == [("s1", 0, "a"), ("s1", 1, "b"), ("s2", 0, "c"), ("s2", 1, "f"), ("s3", 0, "lonely")]
    assert rows(graph.spread(e, seeds, max_nodes=2).filter("scenario = 's1'")) == [("s1", 0, "a"), ("s1", 1, "b")]
    t = graph.timeline(graph.spread(e, seeds)).filter("scenario = 's1'")
    assert rows(t, "step", "time_min", "cumulative_count") == [(0, 0, 1), (1, 5, 2), (2, 10, 3), (3, 15, 4)]


def test_spread_against_the_wind(spark, rows):
    e = spark.createDataFrame([("a", "n", 1.0, 0.3), ("a", "s", 1.0, 0.3)], EDGE)
    c = spark.createDataFrame([("a", 127.0, 37.5), ("n", 127.0, 37.6), ("s", 127.0, 37.4)], "id string, lng double, lat double")
    seeds = spark.createDataFrame([("w", "a", 0.0, 10.0)], "scenario string, id string, wind_direction double, wind_speed double")
    assert rows(graph.spread(e, seeds, c)) == [("w", 0, "a"), ("w", 1, "s")]


def test_routes_and_paths(spark, rows):
    roads = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (1, 4, 5.0), (4, 3, 5.0), (3, 5, 1.0), (8, 9, 1.0), (1, 3, 30.0)], "source long, target long, length_m double")
    paths = graph.shortest_paths(roads, spark.createDataFrame([(1,)], "vertex long"))
    assert rows(paths, "vertex", "cost", "pred") == [(1, 0.0, None), (2, 5.0, 1), (3, 10.0, 2), (4, 5.0, 1), (5, 11.0, 3)]
    pt = "id long, lng double, lat double"
    v = spark.createDataFrame([(i, 127.0 + i * 0.001, 37.5) for i in (1, 2, 3, 4, 5, 8, 9)], pt)
    origins = spark.createDataFrame([(100, 127.001, 37.5001)], pt)
    shelters = spark.createDataFrame([(7, 127.0051, 37.5), (8, 127.0091, 37.5), (9, 127.001, 37.5002)], pt)
    summary, path = graph.routes(roads, v, origins, shelters, k=3)
    assert rows(summary) == [(100, 7, 11.0)]
    assert rows(path, "seq", "vertex") == [(0, 1), (1, 2), (2, 3), (3, 5)]
    assert [p["lng"] for p in graph.route_lines(path, v).first()["line"]] == [127.001, 127.002, 127.003, 127.005]


def test_adjacency_modes(spark, rows):
    step = 1 / geo.METRES_PER_DEGREE
    pts = frame(spark, [(127.0, 37.5), (127.0, 37.5 + 10 * step)])
    attrs = spark.createDataFrame([(0, "masonry"), (0, "masonry")], "id long, structure_class string")
    got = {(r.source_pnu, r.target_pnu): round(r.spread_weight, 4) for r in graph.build_adjacency(pts, attrs, 25.0).collect()}
    assert got == {(0, 1): 0.84, (1, 0): 0.48}
    either = {round(r.spread_weight, 4) for r in graph.build_adjacency(pts, attrs, 25.0, "either").collect()}
    assert either == {0.72}
    one_way = spark.createDataFrame([("a", "b", 1.0, 0.5), ("b", "a", 2.0, 0.6), ("a", "c", 3.0, 0.7)], EDGE)
    assert rows(graph.mirror(one_way), "source_pnu", "target_pnu", "distance_m") == [("a", "b", 1.0), ("a", "c", 3.0), ("b", "a", 2.0), ("c", "a", 3.0)]


def test_bounded_search_and_paths_match_plain_dijkstra(spark):
    import heapq

    import numpy as np

    rng = np.random.default_rng(3)
    chain = [(i, i + 1, 1.0) for i in range(40)]
    mesh = [(200 + int(a), 200 + int(b), float(d)) for a, b, d in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.random(150) + 0.1)]
    arcs = {}
    for a, b, d in chain + mesh:
        if a != b:
            for u, v in ((a, b), (b, a)):
                arcs.setdefault(u, {})[v] = min(d, arcs.get(u, {}).get(v, 9e9))

    def costs(s):
        best, heap = {}, [(0.0, s)]
        while heap:
            c, v = heapq.heappop(heap)
            if v not in best:
                best[v] = c
                for w, d in arcs.get(v, {}).items():
                    heapq.heappush(heap, (c + d, w))
        return best

    wanted = [(0, 40), (0, 3), (20, 19), (200, 230), (201, 259), (201, 5), (230, 230)]
    roads = spark.createDataFrame(chain + mesh + [(1, None, 2.0), (None, 2, 1.0), (5, 5, 1.0)], "source long, target long, length_m double")
    labels = routes.bounded_search(roads, spark.createDataFrame(wanted, "source long, vertex long"), delta=5.0)
    got = {(r["source"], r["vertex"]): r["cost"] for r in labels.collect()}
    for s, v in wanted:
        want = costs(s).get(v)
        assert (s, v) not in got if want is None else abs(got[s, v] - want) < 1e-9
    assert (20, 0) not in got and (20, 40) not in got  # this source was finished long before
    ends = spark.createDataFrame([(s, v) for s, v in wanted if (s, v) in got], "source long, target long")
    ways = {}
    for r in routes.laid_out(labels, ends).collect():
        ways.setdefault((r["source"], r["target"]), {})[r["seq"]] = r["vertex"]
    for (s, v), way in ways.items():
        order = [way[i] for i in range(len(way))]
        assert order[0] == v and order[-1] == s and abs(sum(arcs[a][b] for a, b in zip(order, order[1:])) - got[s, v]) < 1e-9
    assert len(ways[0, 40]) == 41 and routes.bounded_search(roads, spark.createDataFrame([], "source long, vertex long")).count() == 0


def test_hull_tree_of_one_large_cluster(spark):
    """One cluster of a million points, most of the corners on a circle, with points on the sides of a square around it in another."""
    import numpy as np

    turn = F.col("id") * (2 * np.pi / 300)
    disc = spark.range(1_000_000).select(
        F.lit(1).alias("cluster"), (F.when(F.col("id") < 300, F.cos(turn)).otherwise((F.rand(3) - 0.5))).alias("lng"), (F.when(F.col("id") < 300, F.sin(turn)).otherwise((F.rand(4) - 0.5))).alias("lat"))
    square = spark.createDataFrame([(2, x / 10, y / 10) for x in range(11) for y in range(11) if x in (0, 10) or y in (0, 10)] * 3 + [(3, 1.0, 1.0), (4, 0.1, 0.1), (4, 0.2, 0.2), (4, 0.3, 0.3), (None, 9.0, 9.0), (4, None, 0.0)], "cluster int, lng double, lat double")
    out = {}
    for r in fire.convex_hulls(disc.unionByName(square), batch=20_000, fan=3).orderBy("cluster", "seq").collect():
        out.setdefault(r["cluster"], []).append((round(r["lng"], 9), round(r["lat"], 9)))
    ring = [(round(float(np.cos(k * 2 * np.pi / 300)), 9), round(float(np.sin(k * 2 * np.pi / 300)), 9)) for k in range(300)]
    start = ring.index(min(ring))
    assert len(out[1]) == 300 and np.allclose(out[1], ring[start:] + ring[:start], atol=2e-9)
    assert out[2] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)] and out[3] == [(1.0, 1.0)] and out[4] == [(0.1, 0.1), (0.3, 0.3)] and set(out) == {1, 2, 3, 4}
    assert fire.convex_hulls(square.limit(0)).count() == 0


def test_hulls_and_wind(spark, rows):
    pts = [(0, 0), (4, 0), (4, 4), (0, 4)] + [(1 + i / 50, 1 + (i * 7 % 50) / 25) for i in range(100)]
    df = spark.createDataFrame([("c", float(x), float(y)) for x, y in pts], "cluster string, lng double, lat double")
    hull = fire.convex_hulls(df, batch=10).orderBy("seq").collect()
    assert [(r.lng, r.lat) for r in hull] == [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    obs = spark.createDataFrame([(350.0, 2.0, 2), (10.0, 4.0, 2), (90.0, 9.0, 1)], "wind_direction double, wind_speed double, measured_at int")
    assert fire.current_wind(obs).first()["wind_direction"] == 180.0
    assert fire.current_wind(obs, circular=True).first()["wind_direction"] in (0.0, 360.0)


def test_bbox_validation():
    for bad in ((1, 2, 3), (2, 0, 1, 1), (0, 0, 999, 1)):
        with pytest.raises(ValueError):
            geo.check_bbox(bad)


def test_impact(spark):
    reached = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("s", 1, "x")], "scenario string, step int, id string")
    b = spark.createDataFrame([(1, "a", 10.0, "공동주택"), (2, "a", 99.0, "공장"), (3, "b", 5.0, "업무시설")], "gid int, pnu string, building_area double, usage_type string")
    r = spark.createDataFrame([(1, "a", "HIGH"), (3, "b", "MEDIUM")], "gid int, pnu string, risk_grade string")
    row = fire.impact(reached, b, r).first()
    assert (row["total_buildings"], row["total_area_m2"], row["high_risk_count"], row["medium_risk_count"], row["residential_count"], row["commercial_count"]) == (3, 15.0, 1, 1, 1, 1)
    assert row["time_to_100_buildings_min"] is None and row["simulation_duration_min"] == 5 and not row["halted_due_to_limit"]


def test_searches_run_until_nothing_changes(spark):
    chain = [(i, i + 1, 1.0) for i in range(300)] + [(0, 12, 100.0)]
    roads = spark.createDataFrame([r for r in chain if r[0] < 12 or r[1] <= 12], "source long, target long, length_m double")
    got = {r.vertex: r.cost for r in graph.shortest_paths(roads, spark.createDataFrame([(0,)], "vertex long")).collect()}
    assert got[12] == 12.0 and len(got) == 13
    edges = spark.createDataFrame([(str(i), str(i + 1), 1.0) for i in range(35)], "source_pnu string, target_pnu string, spread_weight double")
    steps = graph.spread(edges, spark.createDataFrame([("s", "0")], "scenario string, id string"))
    assert steps.count() == 36


def test_null_coordinates_have_no_distance_and_no_neighbours(spark):
    left = spark.createDataFrame([(1, 127.0, 37.0), (1, 127.1, 37.0), (2, None, 37.0)], "id long, lng double, lat double")
    right = spark.createDataFrame([(10, 127.0, 37.0), (11, None, 37.0)], "id long, lng double, lat double")
    assert left.selectExpr("id", "lng AS x", "lat AS y").crossJoin(right.limit(1)).where("x IS NULL").select(
        geo.haversine(F.col("x"), F.col("y"), F.col("lng"), F.col("lat"))).first()[0] is None
    for limit in (1000, 0):
        assert [tuple(r) for r in spatial.knn_join(left, right, 1, literal_limit=limit).collect()] == [(1, 10, 0.0, 1)]


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """Many pairs from few bytes go to many tasks, and the steps after them too."""
    from parcelwatt.operators import join, upsert

    monkeypatch.setattr(spatial, "LOAD", 500)
    monkeypatch.setattr(join.dealt, "__defaults__", (400,))
    pts = cloud(150, 9)
    pairs = spatial.distance_pairs(frame(spark, pts).withColumn("kind", F.col("id") % 2), 120, carry=("kind",))
    got = {(r.id_a, r.id_b): (r.kind_a, r.kind_b) for r in pairs.collect()}
    assert set(got) == {(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if metres(pts[i], pts[j]) <= 120}
    assert all(v == (i % 2, j % 2) for (i, j), v in got.items())
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan(pairs)
    one_way = pairs.select(F.col("id_a").alias("source_pnu"), F.col("id_b").alias("target_pnu"), "distance_m")
    tasks = -(-2 * len(got) // 400)
    both = graph.mirror(one_way)
    assert f"{tasks}), REPARTITION_BY_NUM" in plan(both) and both.count() == 2 * len(got)
    near = graph.neighbors(both, k=2)
    assert f"{2 * tasks}), REPARTITION_BY_NUM" in plan(near) or f"{-(-4 * len(got) // 400)}), REPARTITION_BY_NUM" in plan(near)
    assert near.filter("rank = 1").count() == len({i for p in got for i in p})
    merged = upsert.prefer_new(both, both.limit(3).withColumn("distance_m", F.lit(-1.0)), ["source_pnu", "target_pnu"])
    assert "REPARTITION_BY_NUM" in plan(merged) and merged.filter("distance_m < 0").count() == 3 and merged.count() == 2 * len(got)


def test_components_thin_pairs_in_their_tasks(spark):
    """Two full cliques and a chain: the rows that leave a task follow its ids, not its pairs."""
    import pandas as pd

    clique = [(i, j) for i in range(60) for j in range(i + 1, 60)]
    pdf = pd.DataFrame(clique + [(a + 100, b + 100) for a, b in clique] + [(i, i + 1) for i in range(200, 400)], columns=["u", "v"])
    thin = pd.concat(graph._thinned(iter([pdf[:1000], pdf[1000:]]), rows=700))
    assert len(thin) == 59 + 59 + 200
    out = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(pdf).selectExpr("concat('n', u) AS u", "concat('n', v) AS v")).collect()}
    assert len(out) == 321 and out["n59"] == "n0" and out["n159"] == "n100" and out["n400"] == "n200"


def test_spread_reads_few_tables_however_many_steps(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1), 0.5) for i in range(20)] + [("0", "x", 0.24)], "source_pnu string, target_pnu string, spread_weight double")
    out = graph.spread(edges, spark.createDataFrame([("s", "0")], "scenario string, id string"))
    assert out._jdf.queryExecution().analyzed().toString().count("LogicalRDD") <= graph.MERGE_EVERY + 1
    assert {r.id: r.step for r in out.collect()} == {str(i): i for i in range(21)}


def test_searches_on_a_crowd_match_plain_relaxation(spark):
    """Many roads a vertex, in lists of several rows; buckets narrower than a road."""
    pts = cloud(60, 12, spread=0.002)
    far = {(i, j): metres(pts[i], pts[j]) for i in range(60) for j in range(i + 1, 60)}
    roads = [(i, j, d) for (i, j), d in far.items() if d <= 100 and i >= 5] + [(0, 6, 30.0)]
    best = {(s, s): 0.0 for s in (0, 7, 59)}
    for _ in range(60):
        for a, b, d in roads:
            for u, v in ((a, b), (b, a)):
                for s in (0, 7, 59):
                    if (s, u) in best:
                        best[s, v] = min(best.get((s, v), 9e9), best[s, u] + d)
    frame_ = spark.createDataFrame(roads, "source long, target long, length_m double")
    for delta in (None, 20.0):
        got = {(r["source"], r["vertex"]): r["cost"] for r in routes.search(frame_, spark.createDataFrame([(0,), (7,), (59,)], "source long"), delta=delta).collect()}
        assert set(got) == set(best) and all(abs(got[k] - best[k]) < 1e-6 for k in best)


def test_lists_hold_every_row_of_their_task(monkeypatch):
    """Keys of several types and more kinds than a digit holds, in batches, with lists of bounded length."""
    import pyarrow as pa

    monkeypatch.setattr(routes, "LONGEST", 50)
    rng = np.random.default_rng(3)
    n = 150_000
    vertex, mask, to = rng.integers(-90_000, 90_000, n), rng.integers(1, 4, n), np.arange(n)
    vertex[:200] = 7
    for keys in (pa.array(vertex), pa.array([f"p{v}" for v in vertex])):
        batches = [pa.RecordBatch.from_arrays([c.slice(i, 9_000) for c in (keys, pa.array(mask), pa.array(to))], names=["vertex", "_mask", "to"]) for i in range(0, n, 9_000)]
        out = pa.Table.from_batches(list(routes._gather(iter(batches), ["vertex", "_mask"], ["to"], 100_000)))
        got = [(v, m, t) for v, m, ts in zip(out["vertex"].to_pylist(), out["_mask"].to_pylist(), out["to"].to_pylist()) for t in ts]
        assert sorted(got, key=lambda r: r[2]) == list(zip(keys.to_pylist(), mask.tolist(), to.tolist()))
        assert out.num_rows < n and max(map(len, out["to"].to_pylist())) <= 50


def test_spread_leaves_its_edges_where_they_are(spark, monkeypatch):
    """However many edges, none is shuffled: they are brought into lists by the tasks that make them, under any number of winds."""
    held = []
    gathered = routes.gathered
    monkeypatch.setattr(graph, "gathered", lambda *a: held.append(gathered(*a)) or held[-1])
    pts = cloud(60, 5, spread=0.003)
    at = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, lng double, lat double")
    kinds = spark.createDataFrame([(i, ("masonry", "RC")[i % 2]) for i in range(60)], "id long, structure_class string")
    edges = graph.build_adjacency(at, kinds, 150.0)
    winds = [(270.0, 8.0), (90.0, 3.0), (0.0, 0.0), (10.0, None), (None, 5.0)]
    seeds = spark.createDataFrame([(f"s{i}", i % 60, *winds[i % 5]) for i in range(8)], "scenario string, id long, wind_direction double, wind_speed double")
    told = sorted(map(tuple, graph.spread(edges, seeds, at).collect()))
    monkeypatch.setattr(graph, "WINDS", 0)
    assert told == sorted(map(tuple, graph.spread(edges, seeds, at).collect())) and max(r[1] for r in told) > 2
    monkeypatch.setattr(graph, "SMALL_ROWS", 2)
    monkeypatch.setattr(graph, "PASSES", 100)
    assert told == sorted(map(tuple, graph.spread(edges, seeds, at).collect()))
    calm = graph.spread(edges, seeds.select("scenario", "id"))
    assert {r.scenario for r in calm.collect()} == {f"s{i}" for i in range(8)}
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in held]
    assert len(plans) == 4 and all("hashpartitioning(vertex" not in p and "hashpartitioning(source" not in p and "hashpartitioning(to" not in p for p in plans)


def test_neighbors_send_on_few_edges(spark, monkeypatch):
    """Edges of one crowd, some stored many times and at several distances: the tasks keep few of them, and the nearest are those of all edges."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    edges = [(int(a), int(b), float(d)) for a, b, d in zip(rng.integers(0, 40, 6000), rng.integers(40, 160, 6000), rng.uniform(0, 90, 6000).round(1))]
    edges += [(0, 41, 0.0)] * 500 + [(0, 41, 0.05 + i / 1e4) for i in range(300)] + [(0, 42, -0.0)]

    def nearest(rows, k):
        best = {}
        for a, b, d in rows:
            for u, v in ((a, b), (b, a)):
                best.setdefault(u, {}).setdefault(v, []).append(d)
        return {(u, v, min(ds, default=None)) for u, of in best.items() for v, ds in sorted(((v, [d for d in ds if d is not None]) for v, ds in of.items()), key=lambda e: (min(e[1], default=-1.0), e[0]))[:k]}

    table = pa.table({"pnu": [e[0] for e in edges], "neighbor_pnu": [e[1] for e in edges], "distance_m": [e[2] for e in edges]})
    assert graph._nearest(table, 3).num_rows < 0.5 * len(edges)
    schema = "source_pnu long, target_pnu long, distance_m double"
    whole = spark.createDataFrame(edges, schema).repartition(3)
    got = graph.neighbors(whole, k=3)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r)[:3] for r in got.collect()} == nearest(edges, 3)
    some = graph.neighbors(whole, spark.createDataFrame([(0,), (50,)], "pnu long"), 4)
    assert {tuple(r)[:3] for r in some.collect()} == {r for r in nearest(edges, 4) if r[0] in (0, 50)}
    named = graph.neighbors(whole.selectExpr("concat('p', source_pnu) AS source_pnu", "concat('p', target_pnu) AS target_pnu", "distance_m"), k=1)
    assert named.count() == len(nearest(edges, 1))
    odd = edges[:50] + [(1, 60, None), (1, 60, 5.0), (2, 61, None), (3, 62, float("nan"))]
    assert {(r.pnu, r.neighbor_pnu) for r in graph.neighbors(spark.createDataFrame(odd, schema), k=2).collect()} >= {(2, 61), (61, 2), (62, 3)}


def test_mirror_moves_an_edge_once(spark, rows, monkeypatch):
    """Stored edges both ways, repeated, from a vertex to itself and without an end; each is a row of the shuffle once."""
    from pyspark.sql import Observation
    from parcelwatt.operators import join

    moved = []
    monkeypatch.setattr(graph, "dealt", lambda df, *a: moved.append((df, Observation())) or join.dealt(df.observe(moved[-1][1], F.count(F.lit(1)).alias("n")), *a))
    stored = [("a", "b", 1.0, None), ("a", "b", 1.0, "x"), ("b", "a", 2.0, "y"), ("c", "a", 3.0, "z"), ("c", "c", 4.0, "c"), ("d", None, 5.0, "n"), (None, "e", 6.0, "m"), (None, None, 7.0, "o"), ("e", "f", None, "p"), ("e", "f", 0.0, "q")]
    best = {}
    for s, t, *v in stored:
        for key, turned in (((s, t), 0), ((t, s), 1)):
            own = (turned, *[(e is not None, e or 0) for e in v])
            if key not in best or own < best[key][0]:
                best[key] = own, v
    out = graph.mirror(spark.createDataFrame(stored, "source_pnu string, target_pnu string, distance_m double, kind string"))
    assert out.columns == ["source_pnu", "target_pnu", "distance_m", "kind"]
    assert rows(out) == sorted(((*k, *v) for k, (_, v) in best.items()), key=lambda t: tuple((v is None, str(v)) for v in t))
    assert moved[0][1].get["n"] == len(stored)


def test_roads_stay_in_their_tasks(spark, monkeypatch):
    """Repeated roads of other lengths, loops and roads without a length: the lists are made without a shuffle and the cheapest ways are found."""
    held = []
    gathered = routes.gathered
    monkeypatch.setattr(routes, "gathered", lambda *a: held.append(gathered(*a)) or held[-1])
    roads = [(i, i + 1, 3.0) for i in range(6)] + [(1, 0, 1.0), (2, 1, 2.0), (1, 2, 2.5), (3, 3, 0.1), (0, 6, None), (4, 2, 9.0)]
    found = routes.search(spark.createDataFrame(roads, "source long, target long, length_m double").repartition(4), spark.createDataFrame([(0,)], "source long"))
    assert {r.vertex: (r.cost, r.hops, r.pred) for r in found.collect()} == {0: (0.0, 0, None), 1: (1.0, 1, 0), 2: (3.0, 2, 1), 3: (6.0, 3, 2), 4: (9.0, 4, 3), 5: (12.0, 5, 4), 6: (15.0, 6, 5)}
    assert "hashpartitioning" not in held[0]._jdf.queryExecution().executedPlan().toString()
