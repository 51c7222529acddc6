"""Distance joins, graphs, fire risk."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from parcelwatt.functions import geo, hazard
from parcelwatt.operators import enrich, fire, graph, quadtree, spatial, upsert, validity
from parcelwatt.operators import query as Q, routes as routes_
from parcelwatt.operators import stats
from standin_queries.base import (
    BUILDING, EDGES, HAVERSINE, PAIRS, POINTS, R, RADIUS, STATIONS, attrs, building, edges, points, query, rounded, stations, table,
)


@query("distance_pairs", f"WITH {PAIRS} SELECT id_a, id_b, {R('distance_m', 4)} AS distance_m FROM pairs")
def distance_pairs(spark, sf):
    return rounded(spatial.distance_pairs(points(spark, sf), RADIUS), 4, "distance_m")


@query("cross_district_pairs", f"WITH {PAIRS} SELECT id_a, id_b, {R('distance_m', 4)} AS distance_m FROM pairs JOIN points a ON a.id = id_a JOIN points b ON b.id = id_b WHERE a.label <> b.label")
def cross_district_pairs(spark, sf):
    p = points(spark, sf).withColumn("key", F.struct(F.col("label"), F.col("id")))
    pairs = spatial.distance_pairs(p.select(F.col("key").alias("id"), "lng", "lat"), RADIUS, F.col("id_a.label") != F.col("id_b.label"))
    a, b = F.col("id_a.id"), F.col("id_b.id")
    return rounded(pairs.select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"), "distance_m"), 4, "distance_m")


@query("knn3", f"""WITH {STATIONS} SELECT p.id, s.id AS target_id, {R(HAVERSINE('p', 's'), 4)} AS distance_m, row_number() OVER (PARTITION BY p.id ORDER BY {HAVERSINE('p', 's')}, s.id) AS rank
 FROM points p CROSS JOIN stations s QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {HAVERSINE('p', 's')}, s.id) <= 3""")
def knn3(spark, sf):
    return rounded(spatial.knn_join(points(spark, sf), stations(spark, sf), 3), 4, "distance_m")


@query("knn_cells", f"""WITH {POINTS} SELECT p.id, s.id AS target_id, {R(HAVERSINE('p', 's'), 4)} AS distance_m, row_number() OVER (PARTITION BY p.id ORDER BY {HAVERSINE('p', 's')}, s.id) AS rank
 FROM points p JOIN points s ON p.id <> s.id OR p.id = s.id QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {HAVERSINE('p', 's')}, s.id) <= 4""")
def knn_cells(spark, sf):
    """The cell search used for large target sides."""
    p = points(spark, sf)
    return rounded(spatial.knn_join(p, p, 4, literal_limit=0), 4, "distance_m")


@query("point_in_polygon", f"""WITH {STATIONS} SELECT p.id, s.id AS polygon_id FROM points p JOIN stations s ON abs(p.lat - s.lat) < 0.004
 AND abs(p.lng - s.lng) < 0.006 * (1 - abs(p.lat - s.lat) / 0.004)""")
def point_in_polygon(spark, sf):
    """Points in a diamond around each label mean."""
    x, y = F.col("lng"), F.col("lat")
    at = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    ring = F.array(at(0.006, 0.0), at(0.0, 0.004), at(-0.006, 0.0), at(0.0, -0.004), at(0.006, 0.0))
    diamonds = stations(spark, sf).select(F.col("id").alias("polygon_id"), F.array(ring).alias("rings"))
    return spatial.pip_join(points(spark, sf), diamonds)


@query("bbox_join", f"""WITH {BUILDING} SELECT a.gid AS id, b.gid AS target_id FROM building a JOIN building b ON a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin""")
def bbox_join(spark, sf):
    b = building(spark, sf).select(F.col("gid").alias("id"), "xmin", "ymin", "xmax", "ymax")
    return spatial.bbox_join(b, b, 200.0)


def crowded(spark, sf):
    """Nine of ten points in a hundredth of the extent, every 500th far away."""
    p, far = points(spark, sf), F.col("id") % 500 == 0
    move = lambda c, middle, off: F.when(far, F.col(c) + off).when(F.col("id") % 10 < 9, middle + 0.01 * (F.col(c) - middle)).otherwise(F.col(c)).alias(c)
    return p.select("id", move("lng", 126.9, 40.0), move("lat", 37.5, -60.0))


CROWDED = POINTS + """, crowded AS (SELECT id, CASE WHEN id % 500 = 0 THEN lng + 40.0::DOUBLE WHEN id % 10 < 9 THEN 126.9::DOUBLE + 0.01::DOUBLE * (lng - 126.9::DOUBLE) ELSE lng END AS lng,
 CASE WHEN id % 500 = 0 THEN lat + -60.0::DOUBLE WHEN id % 10 < 9 THEN 37.5::DOUBLE + 0.01::DOUBLE * (lat - 37.5::DOUBLE) ELSE lat END AS lat FROM points)"""


@query("knn_tree", f"""WITH {CROWDED}, near AS (SELECT p.id, s.id AS target_id, {HAVERSINE('p', 's')} AS d FROM crowded p JOIN crowded s ON s.id >= 0)
 SELECT id, target_id, {R('d', 4)} AS distance_m, row_number() OVER (PARTITION BY id ORDER BY d, target_id) AS rank FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, target_id) <= 3""")
def knn_tree(spark, sf):
    p = crowded(spark, sf)
    return rounded(quadtree.knn(p, p, 3, capacity=64), 4, "distance_m")


@query("pip_tree", f"""WITH {CROWDED}, shapes AS (SELECT id, lng, lat, CASE WHEN id % 70 = 0 THEN 0.03::DOUBLE ELSE 0.0002::DOUBLE END AS w FROM crowded WHERE id % 7 = 0)
 SELECT p.id, s.id AS polygon_id FROM crowded p JOIN shapes s ON p.id <> s.id AND abs(p.lat - s.lat) < s.w AND abs(p.lng - s.lng) < s.w * (1 - abs(p.lat - s.lat) / s.w)""")
def pip_tree(spark, sf):
    """Points in diamonds of two sizes around every seventh point, but for the middle itself."""
    x, y, w = F.col("lng"), F.col("lat"), F.when(F.col("id") % 70 == 0, 0.03).otherwise(0.0002)
    at = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    none = F.lit(0.0)
    ring = F.array(at(w, none), at(none, w), at(-w, none), at(none, -w), at(w, none))
    shapes = crowded(spark, sf).filter("id % 7 = 0").select(F.col("id").alias("polygon_id"), F.array(ring).alias("rings"))
    return quadtree.pip(crowded(spark, sf), shapes, capacity=64).filter("id <> polygon_id")


@query("pairs_tree", f"""WITH {CROWDED} SELECT id_a, id_b, {R('distance_m', 4)} AS distance_m FROM (SELECT a.id AS id_a, b.id AS id_b, {HAVERSINE('a', 'b')} AS distance_m FROM crowded a JOIN crowded b ON a.id < b.id)
 WHERE distance_m <= 40""")
def pairs_tree(spark, sf):
    return rounded(quadtree.pairs_within(crowded(spark, sf), 40.0, capacity=64), 4, "distance_m")


_ON = "(CASE WHEN {0} = 0 AND {1} = 0 THEN sx >= 0 AND sy >= 0 ELSE {0} * {1} <= 0 AND {2} * {3} <= 0 END)".format("s1", "s2", "s3", "s4")


@query("ring_validity", f"""WITH corner AS (SELECT vec_id AS id, CAST(i AS INT) AS i, floor(16 * embedding[2 * (i % 5) + 1]::DOUBLE) AS x, floor(16 * embedding[2 * (i % 5) + 2]::DOUBLE) AS y FROM embeddings, range(6) r(i)),
 flat AS (SELECT id, sum(x * ny - nx * y) = 0 AS flat FROM (SELECT *, lead(x) OVER o AS nx, lead(y) OVER o AS ny FROM corner WINDOW o AS (PARTITION BY id ORDER BY i)) WHERE nx IS NOT NULL GROUP BY 1),
 fresh AS (SELECT id, i, x, y FROM (SELECT *, lag(x) OVER o AS ox, lag(y) OVER o AS oy FROM corner WINDOW o AS (PARTITION BY id ORDER BY i)) WHERE ox IS NULL OR ox <> x OR oy <> y),
 seg AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS k, count(*) OVER (PARTITION BY id) AS n, x AS px, y AS py, nx AS qx, ny AS qy FROM (SELECT *, lead(x) OVER o AS nx, lead(y) OVER o AS ny FROM fresh WINDOW o AS (PARTITION BY id ORDER BY i)) WHERE nx IS NOT NULL),
 pair AS (SELECT a.id, b.k - a.k IN (1, a.n - 1) AS beside,
   sign((a.qx - a.px) * (b.py - a.py) - (a.qy - a.py) * (b.px - a.px)) AS s1, sign((a.qx - a.px) * (b.qy - a.py) - (a.qy - a.py) * (b.qx - a.px)) AS s2,
   sign((b.qx - b.px) * (a.py - b.py) - (b.qy - b.py) * (a.px - b.px)) AS s3, sign((b.qx - b.px) * (a.qy - b.py) - (b.qy - b.py) * (a.qx - b.px)) AS s4,
   least(greatest(a.px, a.qx), greatest(b.px, b.qx)) - greatest(least(a.px, a.qx), least(b.px, b.qx)) AS sx,
   least(greatest(a.py, a.qy), greatest(b.py, b.qy)) - greatest(least(a.py, a.qy), least(b.py, b.qy)) AS sy FROM seg a JOIN seg b ON a.id = b.id AND a.k < b.k),
 bad AS (SELECT DISTINCT id FROM pair WHERE CASE WHEN beside THEN s1 = 0 AND s2 = 0 AND sx >= 0 AND sy >= 0 AND greatest(sx, sy) > 0 ELSE {_ON} END)
 SELECT id, NOT flat AND bad.id IS NULL AS valid, CASE WHEN flat THEN 'ring' WHEN bad.id IS NOT NULL THEN 'crossing' END AS reason FROM flat LEFT JOIN bad USING (id)""")
def ring_validity(spark, sf):
    """Rings of five corners on whole numbers: many cross, touch or run back on themselves."""
    c = lambda i: F.floor(16 * F.col("embedding")[i].cast("double")).cast("double")
    corner = [F.struct(c(2 * (i % 5)).alias("x"), c(2 * (i % 5) + 1).alias("y")) for i in range(6)]
    shapes = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.array(F.array(*corner)).alias("rings"))
    return validity.validity(shapes).drop("rings")


@query("haversine", f"""WITH {STATIONS} SELECT p.id, {R(HAVERSINE('p', 's'), 4)} AS metres FROM points p JOIN stations s ON s.id = p.label""")
def haversine(spark, sf):
    s = stations(spark, sf).toDF("label", "slng", "slat")
    d = geo.haversine(F.col("lng"), F.col("lat"), F.col("slng"), F.col("slat"))
    return rounded(points(spark, sf).join(s, "label").select("id", d.alias("metres")), 4, "metres")


_BEARING = """(degrees(atan2(sin(radians(s.lng - p.lng)) * cos(radians(s.lat)), cos(radians(p.lat)) * sin(radians(s.lat)) - sin(radians(p.lat)) * cos(radians(s.lat)) * cos(radians(s.lng - p.lng)))) + 360)"""


@query("wind_factor", f"""WITH {STATIONS}, b AS (SELECT p.id, {_BEARING} % 360 AS d, p.id % 360 AS wf FROM points p JOIN stations s ON s.id = p.label) SELECT id, {R('d', 4)} AS bearing, {R('greatest(0, 1 + 0.5 * cos(radians(d - (wf + 180))))', 6)} AS factor FROM b""")
def wind_factor(spark, sf):
    s = stations(spark, sf).toDF("label", "slng", "slat")
    d = geo.bearing(F.col("lng"), F.col("lat"), F.col("slng"), F.col("slat"))
    df = points(spark, sf).join(s, "label").select("id", d.alias("bearing"), hazard.wind_factor(d, F.col("id") % 360, F.lit(10.0)).alias("factor"))
    return rounded(rounded(df, 4, "bearing"), 6, "factor")


@query("response_min", """SELECT o_orderkey, CAST(round(CAST(o_totalprice / 500 AS DECIMAL(30,8)), 1) AS DOUBLE) AS minutes FROM orders""")
def response_min(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", hazard.response_minutes(F.col("o_totalprice")).alias("minutes"))


@query("endpoint_attrs", f"""WITH {EDGES} SELECT id_a, id_b, a.structure_class AS structure_class_a, b.structure_class AS structure_class_b FROM pairs LEFT JOIN attrs a ON a.id = id_a LEFT JOIN attrs b ON b.id = id_b""")
def endpoint_attrs(spark, sf):
    pairs = spatial.distance_pairs(points(spark, sf), RADIUS)
    return graph.with_endpoint_attrs(pairs, attrs(spark, sf), ["structure_class"]).drop("distance_m")


@query("adjacency", f"WITH {EDGES} SELECT source_pnu, target_pnu, {R('distance_m', 4)} AS distance_m, {R('spread_weight', 6)} AS spread_weight FROM edges")
def adjacency(spark, sf):
    return rounded(rounded(edges(spark, sf), 4, "distance_m"), 6, "spread_weight")


@query("spread_weight", f"""WITH {EDGES} SELECT id_a, id_b, {R(f"greatest(0, (1.0 - distance_m / {RADIUS}) * CASE WHEN a.structure_class = 'masonry' OR b.structure_class = 'masonry' THEN 1.2 ELSE 0.8 END)", 6)} AS weight
 FROM pairs JOIN attrs a ON a.id = id_a JOIN attrs b ON b.id = id_b""")
def spread_weight(spark, sf):
    df = graph.build_adjacency(points(spark, sf), attrs(spark, sf), RADIUS, mode="either").filter("source_pnu < target_pnu")
    return rounded(df.select(F.col("source_pnu").alias("id_a"), F.col("target_pnu").alias("id_b"), F.col("spread_weight").alias("weight")), 6, "weight")


@query("edges_mirror", f"WITH {PAIRS} SELECT id_a AS source_pnu, id_b AS target_pnu, {R('distance_m', 4)} AS distance_m FROM pairs UNION ALL SELECT id_b, id_a, {R('distance_m', 4)} FROM pairs")
def edges_mirror(spark, sf):
    one_way = spatial.distance_pairs(points(spark, sf), RADIUS).toDF("source_pnu", "target_pnu", "distance_m")
    return rounded(graph.mirror(one_way), 4, "distance_m")


@query("edge_upsert", f"""WITH {EDGES}, u AS (SELECT source_pnu, target_pnu, 0::DOUBLE AS w, 0 AS isnew FROM edges UNION ALL SELECT source_pnu, target_pnu, spread_weight, 1 FROM edges WHERE distance_m < 60)
 SELECT source_pnu, target_pnu, {R('w', 6)} AS spread_weight FROM u QUALIFY row_number() OVER (PARTITION BY source_pnu, target_pnu ORDER BY isnew DESC) = 1""")
def edge_upsert(spark, sf):
    e = edges(spark, sf)
    merged = upsert.prefer_new(e.withColumn("spread_weight", F.lit(0.0)), e.filter("distance_m < 60"), ["source_pnu", "target_pnu"])
    return rounded(merged.drop("distance_m"), 6, "spread_weight")


@query("neighbors", f"""WITH {EDGES} SELECT source_pnu AS pnu, target_pnu AS neighbor_pnu, {R('distance_m', 4)} AS distance_m, row_number() OVER (PARTITION BY source_pnu ORDER BY distance_m, target_pnu) AS rank FROM edges
 QUALIFY row_number() OVER (PARTITION BY source_pnu ORDER BY distance_m, target_pnu) <= 5""")
def neighbors(spark, sf):
    return rounded(graph.neighbors(edges(spark, sf), k=5), 4, "distance_m")


@query("neighbors_k", f"""WITH {EDGES}, seed AS (SELECT label, min(id) AS id FROM points GROUP BY 1) SELECT source_pnu AS pnu, target_pnu AS neighbor_pnu, {R('distance_m', 4)} AS distance_m, row_number() OVER (PARTITION BY source_pnu ORDER BY distance_m, target_pnu) AS rank
 FROM edges JOIN seed ON seed.id = source_pnu QUALIFY row_number() OVER (PARTITION BY source_pnu ORDER BY distance_m, target_pnu) <= 50""")
def neighbors_k(spark, sf):
    seed = points(spark, sf).groupBy("label").agg(F.min("id").alias("pnu"))
    return rounded(graph.neighbors(edges(spark, sf), seed, 50), 4, "distance_m")


_CORES = POINTS + """,
near AS (SELECT a.id AS a, b.id AS b FROM points a JOIN points b ON pow(a.lng - b.lng, 2) + pow(a.lat - b.lat, 2) <= 0.0015::DOUBLE * 0.0015::DOUBLE),
cores AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 4), links AS (SELECT n.a, n.b FROM near n JOIN cores x ON x.id = n.a JOIN cores y ON y.id = n.b),
reach(id, root) AS (SELECT id, id FROM cores UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
comp AS (SELECT id, min(root) AS cluster FROM reach GROUP BY 1),
labelled AS (SELECT id, cluster, true AS is_core FROM comp UNION ALL SELECT n.a, min(c.cluster), false FROM near n JOIN comp c ON c.id = n.b WHERE n.a NOT IN (SELECT id FROM cores) GROUP BY 1)"""


@query("dbscan", f"""WITH RECURSIVE {_CORES} SELECT p.id, l.cluster::DOUBLE AS cluster, coalesce(l.is_core, false) AS is_core FROM points p LEFT JOIN labelled l USING (id)""")
def dbscan(spark, sf):
    return spatial.dbscan(points(spark, sf), 0.0015, 4).withColumn("cluster", F.col("cluster").cast("double"))


@query("cluster_summary", f"""WITH RECURSIVE {_CORES} SELECT cluster, count(*) AS building_count, {R('avg(40 + id % 60)', 4)} AS avg_risk_score, CASE WHEN avg(40 + id % 60) >= 60 THEN 'HIGH' WHEN avg(40 + id % 60) >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM labelled GROUP BY 1 HAVING count(*) >= 4""")
def cluster_summary(spark, sf):
    p = points(spark, sf).withColumn("total_score", F.col("id") % 60 + 40)
    return fire.cluster_summary(p.join(spatial.dbscan(p, 0.0015, 4), "id"), 4)


_CROSS = "(q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)"


@query("cluster_hulls", f"""WITH RECURSIVE {_CORES}, grid AS MATERIALIZED (SELECT l.cluster, floor(p.lng * 1e9 + 0.5)::HUGEINT AS x, floor(p.lat * 1e9 + 0.5)::HUGEINT AS y, min([p.lng, p.lat]) AS own FROM points p JOIN labelled l USING (id) GROUP BY 1, 2, 3),
 sides AS (SELECT p.cluster, p.own AS a, q.own AS b, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM grid p JOIN grid q ON q.cluster = p.cluster AND (q.x <> p.x OR q.y <> p.y)
  WHERE NOT EXISTS (SELECT 1 FROM grid r WHERE r.cluster = p.cluster AND ({_CROSS} < 0 OR ({_CROSS} = 0 AND ((q.x - p.x) * (r.x - p.x) + (q.y - p.y) * (r.y - p.y) < 0 OR (r.x - q.x) * (q.x - p.x) + (r.y - q.y) * (q.y - p.y) > 0))))),
 corners AS (SELECT cluster, a, b FROM sides UNION ALL SELECT cluster, any_value(own), any_value(own) FROM grid GROUP BY 1 HAVING count(*) = 1)
 SELECT cluster::DOUBLE AS cluster, {R('a[1]', 7)} AS lng, {R('a[2]', 7)} AS lat, {R('b[1]', 7)} AS next_lng, {R('b[2]', 7)} AS next_lat, count(*) OVER (PARTITION BY cluster) AS corners FROM corners""")
def cluster_hulls(spark, sf):
    """Every corner with the one after it: a side that has all other members on its left."""
    p = points(spark, sf)
    hulls = fire.convex_hulls(p.join(spatial.dbscan(p, 0.0015, 4), "id"), batch=16)
    around, whole = Window.partitionBy("cluster").orderBy("seq"), Window.partitionBy("cluster")
    nxt = hulls.withColumns({f"next_{c}": F.coalesce(F.lead(c).over(around), F.first(c).over(around)) for c in ("lng", "lat")}).withColumn("corners", F.count(F.lit(1)).over(whole))
    return rounded(nxt.withColumn("cluster", F.col("cluster").cast("double")).drop("seq"), 7, "lng", "lat", "next_lng", "next_lat")


@query("components", f"""WITH RECURSIVE {PAIRS}, both_ways AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs), reach(id, root) AS (SELECT a, a FROM both_ways UNION SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.id)
 SELECT id, min(root) AS component FROM reach GROUP BY 1""")
def components(spark, sf):
    pairs = spatial.distance_pairs(points(spark, sf), RADIUS)
    return graph.connected_components(pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")))


_SEEDS = "seeds AS (SELECT md5(min(id) || ':0.0:0.0') AS scenario, min(id) AS id FROM points GROUP BY label)"
_SPREAD = f"""{EDGES}, {_SEEDS}, live AS MATERIALIZED (SELECT source_pnu, target_pnu FROM edges WHERE spread_weight >= 0.25),
 spread(scenario, step, id) USING KEY (scenario, id) AS (SELECT scenario, 0, id FROM seeds UNION SELECT w.scenario, w.step + 1, e.target_pnu FROM spread w JOIN live e ON e.source_pnu = w.id
 LEFT JOIN recurring.spread r ON r.scenario = w.scenario AND r.id = e.target_pnu WHERE r.id IS NULL)"""


def _seeds(spark, sf):
    s = points(spark, sf).groupBy("label").agg(F.min("id").alias("id"))
    return s.select(graph.scenario_id(F.col("id"), F.lit(0.0), F.lit(0.0)).alias("scenario"), "id")


def _spread(spark, sf):
    return graph.spread(edges(spark, sf), _seeds(spark, sf))


@query("spread", f"WITH RECURSIVE {_SPREAD} SELECT scenario, id, step FROM spread")
def spread(spark, sf):
    return _spread(spark, sf).select("scenario", "id", "step")


@query("spread_wind", f"""WITH RECURSIVE {EDGES}, {_SEEDS}, wind AS MATERIALIZED (SELECT e.source_pnu, e.target_pnu, e.spread_weight * greatest(0, 1 + 0.4 * cos(radians({_BEARING.replace('s.', 't.')} - 450))) AS w FROM edges e JOIN points p ON p.id = e.source_pnu JOIN points t ON t.id = e.target_pnu),
 walk(scenario, step, id) USING KEY (scenario, id) AS (SELECT md5(id || ':270.0:8.0'), 0, id FROM seeds UNION SELECT w.scenario, w.step + 1, e.target_pnu FROM walk w JOIN wind e ON e.source_pnu = w.id
 LEFT JOIN recurring.walk r ON r.scenario = w.scenario AND r.id = e.target_pnu WHERE e.w >= 0.25 AND r.id IS NULL) SELECT scenario, id, step FROM walk""")
def spread_wind(spark, sf):
    p = points(spark, sf)
    s = p.groupBy("label").agg(F.min("id").alias("id")).select("id", F.lit(270.0).alias("wind_direction"), F.lit(8.0).alias("wind_speed"))
    s = s.withColumn("scenario", graph.scenario_id(F.col("id"), F.col("wind_direction"), F.col("wind_speed")))
    return graph.spread(edges(spark, sf), s, p.select("id", "lng", "lat")).select("scenario", "id", "step")


@query("spread_timeline", f"WITH RECURSIVE {_SPREAD} SELECT scenario, step, count(*) AS new_count, step * 5 AS time_min, CAST(sum(count(*)) OVER (PARTITION BY scenario ORDER BY step) AS BIGINT) AS cumulative_count FROM spread GROUP BY 1, 2")
def spread_timeline(spark, sf):
    return graph.timeline(_spread(spark, sf))


_USE = "CASE label % 4 WHEN 0 THEN '공동주택' WHEN 1 THEN '업무시설' WHEN 2 THEN '공장' ELSE '근린생활시설' END"


@query("impact_stats", f"""WITH RECURSIVE {_SPREAD}, b AS (SELECT id, 100 + id % 50 AS area, {_USE} AS use, 30 + id % 50 AS score FROM points) SELECT scenario, count(*) AS total_buildings, CAST(sum(area) AS DOUBLE) AS total_area_m2,
 count(*) FILTER (WHERE score >= 60) AS high_risk_count, count(*) FILTER (WHERE score >= 35 AND score < 60) AS medium_risk_count, count(*) FILTER (WHERE use = '공동주택') AS residential_count,
 count(*) FILTER (WHERE use IN ('업무시설', '근린생활시설')) AS commercial_count, max(step) AS max_step_reached FROM spread JOIN b USING (id) GROUP BY 1""")
def impact_stats(spark, sf):
    p = points(spark, sf)
    use = F.element_at(F.array(*[F.lit(u) for u in ("공동주택", "업무시설", "공장", "근린생활시설")]), (F.col("label") % 4 + 1).cast("int"))
    b = p.select(F.col("id").alias("gid"), F.col("id").alias("pnu"), (F.col("id") % 50 + 100.0).alias("building_area"), use.alias("usage_type"))
    r = p.select(F.col("id").alias("gid"), F.col("id").alias("pnu"), hazard.grade(F.col("id") % 50 + 30).alias("risk_grade"))
    df = fire.impact(_spread(spark, sf), b, r)
    return df.select("scenario", "total_buildings", "total_area_m2", "high_risk_count", "medium_risk_count", "residential_count", "commercial_count", "max_step_reached")


# cheapest ways from every src until none improves; a vertex keeps its best cost
_WAYS = """ways(s, v, c) USING KEY (s, v) AS (SELECT s, s, 0::DOUBLE FROM src UNION SELECT w.s, b, min(w.c + d) FROM ways w JOIN arcs ON a = w.v
 LEFT JOIN recurring.ways r ON r.s = w.s AND r.v = b GROUP BY w.s, b, r.c HAVING r.c IS NULL OR min(w.c + d) < r.c)"""


@query("shortest_paths", f"""WITH RECURSIVE {PAIRS}, arcs AS MATERIALIZED (SELECT id_a AS a, id_b AS b, distance_m AS d FROM pairs UNION ALL SELECT id_b, id_a, distance_m FROM pairs), src AS (SELECT min(id) AS s FROM points GROUP BY label),
 {_WAYS} SELECT s AS source, v AS vertex, {R('c', 4)} AS cost FROM ways""")
def shortest_paths(spark, sf):
    roads = spatial.distance_pairs(points(spark, sf), RADIUS).toDF("source", "target", "length_m")
    src = points(spark, sf).groupBy("label").agg(F.min("id").alias("vertex"))
    return rounded(graph.shortest_paths(roads, src).drop("pred"), 4, "cost")


@query("routes", f"""WITH RECURSIVE {PAIRS}, stations AS (SELECT CAST(label AS BIGINT) AS id, {R('avg(lng)', 6)} AS lng, {R('avg(lat)', 6)} AS lat FROM points GROUP BY 1),
 arcs AS MATERIALIZED (SELECT id_a AS a, id_b AS b, distance_m AS d FROM pairs UNION ALL SELECT id_b, id_a, distance_m FROM pairs), org AS (SELECT min(id) AS id FROM points GROUP BY label),
 snap AS (SELECT s.id AS shelter, p.id AS v FROM stations s CROSS JOIN points p QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY {HAVERSINE('s', 'p')}, p.id) = 1),
 pick AS (SELECT p.id AS origin, s.id AS shelter FROM org JOIN points p ON p.id = org.id CROSS JOIN stations s QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {HAVERSINE('p', 's')}, s.id) <= 5),
 src AS (SELECT id AS s FROM org), {_WAYS}
 SELECT origin, shelter, {R('c', 4)} AS distance_m FROM pick JOIN snap USING (shelter) JOIN ways ON ways.s = origin AND ways.v = snap.v WHERE origin <> snap.v""")
def routes(spark, sf):
    p = points(spark, sf).select("id", "lng", "lat", "label")
    roads = spatial.distance_pairs(p, RADIUS).toDF("source", "target", "length_m")
    first = p.groupBy("label").agg(F.min("id").alias("id"))
    origins = p.drop("label").join(first.select("id"), "id")
    summary, _ = graph.routes(roads, p.drop("label"), origins, stations(spark, sf), k=5)
    return rounded(summary, 4, "distance_m")


@query("shelter_routes", f"""WITH RECURSIVE {PAIRS}, stations AS (SELECT CAST(label AS BIGINT) AS id, {R('avg(lng)', 6)} AS lng, {R('avg(lat)', 6)} AS lat FROM points GROUP BY 1),
 arcs AS MATERIALIZED (SELECT id_a AS a, id_b AS b, distance_m AS d FROM pairs UNION ALL SELECT id_b, id_a, distance_m FROM pairs),
 snap AS (SELECT s.id AS shelter, p.id AS v FROM stations s CROSS JOIN points p QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY {HAVERSINE('s', 'p')}, p.id) = 1),
 pick AS (SELECT p.id AS origin, s.id AS shelter FROM points p CROSS JOIN stations s QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {HAVERSINE('p', 's')}, s.id) <= 3),
 src AS (SELECT DISTINCT v AS s FROM snap), {_WAYS},
 best AS MATERIALIZED (SELECT s, v, c FROM ways), back AS MATERIALIZED (SELECT n.s, n.v, arg_min(a.b, n2.c + a.d) AS pred FROM best n JOIN arcs a ON a.a = n.v JOIN best n2 ON n2.s = n.s AND n2.v = a.b WHERE n.v <> n.s GROUP BY 1, 2),
 trips AS (SELECT origin, shelter, n.v AS s, c FROM pick JOIN snap n USING (shelter) JOIN best w ON w.s = n.v AND w.v = origin WHERE origin <> n.v),
 path(origin, shelter, s, seq, vertex) AS (SELECT origin, shelter, s, 0, origin FROM trips UNION ALL SELECT p.origin, p.shelter, p.s, p.seq + 1, k.pred FROM path p JOIN back k ON k.s = p.s AND k.v = p.vertex)
 SELECT origin, shelter, seq, vertex, {R('c', 4)} AS distance_m FROM path JOIN trips USING (origin, shelter)""")
def shelter_routes(spark, sf):
    """Every point as origin, with the vertices of its ways."""
    p = points(spark, sf).select("id", "lng", "lat")
    roads = spatial.distance_pairs(p, RADIUS).toDF("source", "target", "length_m")
    summary, path = routes_.shelter_routes(roads, p, p, stations(spark, sf))
    return rounded(path.join(summary, ["origin", "shelter"]), 4, "distance_m")


@query("station_coverage", f"""WITH {STATIONS} SELECT p.id, s.id AS station_id, row_number() OVER (PARTITION BY p.id ORDER BY {HAVERSINE('p', 's')}, s.id) AS rank, {R(HAVERSINE('p', 's'), 3)} AS distance_m, {R(HAVERSINE('p', 's') + ' / 500', 1)} AS est_response_min
 FROM points p CROSS JOIN stations s QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {HAVERSINE('p', 's')}, s.id) <= 3""")
def station_coverage(spark, sf):
    return rounded(fire.station_coverage(points(spark, sf), stations(spark, sf)), 3, "distance_m")


@query("centroids", f"WITH {BUILDING} SELECT pnu, {R('cx', 6)} AS lng, {R('cy', 6)} AS lat FROM building QUALIFY row_number() OVER (PARTITION BY pnu ORDER BY gid) = 1")
def centroids(spark, sf):
    return rounded(enrich.centroids(building(spark, sf)), 6, "lng", "lat")


_HAS = lambda *ws: "(" + " OR ".join(f"usage_type LIKE '%{w}%'" for w in ws) + ")"
_RISK = f"""risk0 AS (SELECT gid, pnu, CASE WHEN structure_type LIKE '%목%' THEN 40 WHEN structure_type LIKE '%조적%' OR structure_type LIKE '%벽돌%' THEN 30 WHEN structure_type LIKE '%철골%' OR structure_type LIKE '%S조%' THEN 20 ELSE 15 END AS structure_score,
 CASE WHEN built_year IS NULL THEN 25 WHEN floors_above >= 10 AND built_year < 1990 THEN 25 WHEN built_year < 1980 THEN 30 WHEN built_year < 2000 THEN 20 WHEN built_year < 2010 THEN 12 ELSE 5 END AS age_score,
 CASE {' '.join(f'WHEN {_HAS(*ws)} THEN {s}' for ws, s in hazard.USAGE_SCORES)} ELSE 10 END AS usage_score, least(greatest(coalesce(floors_above, 3) - 3, 0) * 2, 10) AS height_score FROM building),
risk AS (SELECT *, structure_score + age_score + usage_score + height_score AS total_score FROM risk0)"""
_GR = "CASE WHEN total_score >= 60 THEN 'HIGH' WHEN total_score >= 35 THEN 'MEDIUM' ELSE 'LOW' END"


@query("fire_score", f"WITH {BUILDING}, {_RISK} SELECT gid, pnu, structure_score, age_score, usage_score, height_score, total_score, {_GR} AS risk_grade FROM risk")
def fire_score(spark, sf):
    return fire.score(building(spark, sf))


@query("grade_stats", f"WITH {BUILDING}, {_RISK} SELECT {_GR} AS risk_grade, count(*) AS count, {R('avg(total_score)', 1)} AS avg_score FROM risk GROUP BY 1")
def grade_stats(spark, sf):
    return stats.grade_stats(fire.score(building(spark, sf)))


@query("top_risk", f"WITH {BUILDING}, {_RISK} SELECT pnu, total_score FROM risk ORDER BY total_score DESC, pnu LIMIT 100")
def top_risk(spark, sf):
    return Q.top_risk(fire.score(building(spark, sf)), 100).select("pnu", "total_score")


@query("sql_functions", f"""WITH {STATIONS} SELECT p.id, {R(HAVERSINE('p', 's'), 3)} AS metres, {R(_BEARING + ' % 360', 3)} AS bearing, lpad(CAST(p.id AS VARCHAR), 19, '0')[1:15] || '0000' AS parent FROM points p JOIN stations s ON s.id = p.label""")
def sql_functions(spark, sf):
    """The registered SQL functions over the points."""
    from parcelwatt.functions.registry import register_functions

    register_functions(spark)
    s = stations(spark, sf).toDF("label", "slng", "slat")
    df = points(spark, sf).join(s, "label").selectExpr(
        "id", "haversine_m(lng, lat, slng, slat) AS metres", "bearing_deg(lng, lat, slng, slat) AS bearing", "pnu_parent(lpad(CAST(id AS STRING), 19, '0')) AS parent")
    return rounded(df, 3, "metres", "bearing")
