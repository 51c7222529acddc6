"""Fire risk, station coverage, scenario impact and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelwatt.functions import geo, hazard
from parcelwatt.functions.rounding import half_up
from parcelwatt.operators.graph import TIME_PER_STEP_MIN, timeline
from parcelwatt.operators.join import distinct_on
from parcelwatt.operators.spatial import dbscan, knn_join
from parcelwatt.session import cut


def score(buildings: DataFrame) -> DataFrame:
    """Risk scores and grade of every building with a parcel key."""
    parts = {
        "structure_score": hazard.structure_score(F.col("structure_type")),
        "age_score": hazard.age_score(F.col("built_year"), F.col("floors_above")),
        "usage_score": hazard.usage_score(F.col("usage_type")),
        "height_score": hazard.height_score(F.col("floors_above")),
    }
    scored = buildings.filter(F.col("pnu").isNotNull()).select("gid", "pnu", *[c.cast("int").alias(n) for n, c in parts.items()])
    total = sum((F.col(n) for n in parts), F.lit(0))
    return scored.withColumn("total_score", total).withColumn("risk_grade", hazard.grade(F.col("total_score")))


def station_coverage(points: DataFrame, stations: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` nearest stations of every point and the minutes a vehicle needs."""
    near = knn_join(points, stations, k)
    return near.select("id", F.col("target_id").alias("station_id"), "rank", "distance_m",
                       hazard.response_minutes(F.col("distance_m")).alias("est_response_min"))


# Words that mark a residential or a commercial use.
RESIDENTIAL = ("주택", "아파트", "다세대", "단독")
COMMERCIAL = ("상업", "업무", "판매", "근린")


def impact(reached: DataFrame, buildings: DataFrame, risk: DataFrame, residential: tuple[str, ...] = RESIDENTIAL,
           commercial: tuple[str, ...] = COMMERCIAL, max_nodes: int | None = None) -> DataFrame:
    """Per scenario: affected area, counts by risk grade and use, steps, time to 100 buildings."""
    words = lambda ws: F.when(F.col("usage_type").rlike("|".join(ws)), 1)
    b = distinct_on(buildings, ["pnu"], [F.col("gid")]).select(F.col("pnu").alias("id"), "building_area", "usage_type", F.lit(1).alias("_known"))
    r = distinct_on(risk, ["pnu"], [F.col("gid")]).select(F.col("pnu").alias("id"), "risk_grade")
    joined = reached.join(b, "id", "left").join(r, "id", "left")
    grade = lambda g: F.count(F.when((F.col("risk_grade") == g) & F.col("_known").isNotNull(), 1))
    stats = joined.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("total_buildings"), F.coalesce(F.sum("building_area"), F.lit(0.0)).alias("total_area_m2"),
        grade("HIGH").alias("high_risk_count"), grade("MEDIUM").alias("medium_risk_count"),
        F.count(words(residential)).alias("residential_count"), F.count(words(commercial)).alias("commercial_count"),
        F.max("step").alias("max_step_reached"),
    )
    hundred = timeline(reached).filter(F.col("cumulative_count") >= 100).groupBy("scenario").agg(F.min("time_min").alias("time_to_100_buildings_min"))
    return stats.join(hundred, "scenario", "left").withColumns({
        "simulation_duration_min": F.col("max_step_reached") * TIME_PER_STEP_MIN,
        "halted_due_to_limit": F.lit(False) if max_nodes is None else F.col("total_buildings") >= max_nodes,
    })


def cluster_high_risk(risk_points: DataFrame, eps_m: float = 100.0, min_pts: int = 5, min_score: float = 60.0) -> DataFrame:
    """Cluster points (id, lng, lat, total_score) of at least ``min_score``: adds cluster, is_core."""
    high = risk_points.filter(F.col("total_score") >= min_score)
    return high.join(dbscan(high, geo.eps_degrees(eps_m), min_pts), "id")


def _turn(o, a, b) -> int:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _hull(pdf, scale: float):
    """Convex hull of one part (monotone chain), judged in whole numbers on a grid of 1 / ``scale``."""
    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values(["lng", "lat"])
    grid = np.floor(pdf[["lng", "lat"]].to_numpy(float) * scale + 0.5)
    place = {}
    for spot, own in zip(map(tuple, grid.astype(object)), pdf[["lng", "lat"]].itertuples(index=False, name=None)):
        place.setdefault(tuple(map(int, spot)), own)
    pts = sorted(place)

    def chain(seq):
        out = []
        for p in seq:
            while len(out) >= 2 and _turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    corners = chain(pts) + chain(pts[::-1]) if len(pts) > 2 else pts
    frame = pd.DataFrame([place[c] for c in corners], columns=["lng", "lat"])
    frame.insert(0, "cluster", pdf["cluster"].iloc[0])
    frame["seq"] = range(len(frame))
    return frame


def convex_hulls(members: DataFrame, batch: int = 20_000, fan: int = 8, digits: int = 9) -> DataFrame:
    """cluster, lng, lat, seq: hull corners in counter-clockwise order, from the one farthest west (then south).

    A tree of partial hulls: a cluster is divided into parts of about ``batch`` points, each is thinned to its corners, and ``fan``
    parts at a time are joined and thinned again until one is left, so a task holds ``fan`` partial hulls, never a cluster. Corners are judged
    on a grid of 10^-``digits`` degrees in whole numbers: points on a side are no corners, points of one grid cell are one
    point (the first by lng, lat). Rows without cluster or coordinates take no part; a single point is its own hull, two are
    a side.
    """
    id_type = members.schema["cluster"].dataType.simpleString()
    schema = f"cluster {id_type}, lng double, lat double, seq int"
    pts = members.filter("cluster IS NOT NULL AND lng IS NOT NULL AND lat IS NOT NULL").select("cluster", F.col("lng").cast("double"), F.col("lat").cast("double")).distinct()
    sizes = cut(pts.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / batch).alias("_parts")))
    most = sizes.agg(F.max("_parts")).first()[0] or 0
    thin = lambda df: df.groupBy("cluster", "_part").applyInPandas(lambda pdf: _hull(pdf, float(10 ** digits)), schema)
    open_ = thin(pts.join(sizes, "cluster").withColumn("_part", F.pmod(F.xxhash64("lng", "lat"), F.col("_parts"))).drop("_parts"))
    while most > 1:
        # the corners of parts carry no part number: they are dealt anew, to a number of parts that falls by fan
        most = -(-most // fan)
        sizes = sizes.withColumn("_parts", F.ceil(F.col("_parts") / fan))
        dealt = cut(open_.drop("seq")).join(sizes, "cluster")
        open_ = thin(dealt.withColumn("_part", F.pmod(F.xxhash64("lng", "lat"), F.col("_parts"))).drop("_parts"))
    return open_


def cluster_summary(members: DataFrame, min_pts: int = 5) -> DataFrame:
    """Per cluster: level by mean score, size and mean, clusters of at least ``min_pts`` members."""
    return (
        members.filter("cluster IS NOT NULL").groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("building_count"), F.avg("total_score").alias("avg_risk_score"))
        .filter(F.col("building_count") >= min_pts)
        .withColumn("risk_level", hazard.grade(F.col("avg_risk_score")))
        .withColumn("avg_risk_score", half_up(F.col("avg_risk_score"), 4))
    )


def largest_clusters(summary: DataFrame, limit: int) -> DataFrame:
    return summary.orderBy(F.col("building_count").desc(), F.col("cluster")).limit(limit)


def stations_of(stations: DataFrame, district: str | None = None) -> DataFrame:
    return stations if district is None else stations.filter(F.col("district") == district)


def current_wind(observations: DataFrame, circular: bool = False) -> DataFrame:
    """Mean wind of the newest observation time: direction, speed, count.

    The plain mean of degrees matches the stored view but is wrong across north; ``circular``
    averages on the circle.
    """
    rad = F.radians("wind_direction")
    around = F.pmod(F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad)))) + 360.0, F.lit(360.0))
    direction = around if circular else F.avg("wind_direction")
    per_time = observations.filter(F.col("measured_at").isNotNull()).groupBy("measured_at").agg(
        half_up(direction, 1).alias("wind_direction"), half_up(F.avg("wind_speed"), 1).alias("wind_speed"),
        F.count(F.lit(1)).alias("observations"),
    )
    return per_time.orderBy(F.col("measured_at").desc()).limit(1)
