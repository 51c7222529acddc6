"""Readers and writers, fed with text and files that Spark derives from the supplied tables."""

from __future__ import annotations

import os
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from parcelwatt.functions import geo
from parcelwatt.operators import ml, quality, query as Q
from parcelwatt.session import shared_dir
from parcelwatt.sources import buildings as B, feeds, sinks
from standin_queries.base import BUILDING, CURRENT, READING, R, RESULT, TS, building, query, reading, result, rounded, table
from standin_queries.energy import YEAR, _GRADE
from standin_queries.learning import _events, predictions


def _path(spark, name):
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@query("meter_rows", f"""SELECT {TS("date_trunc('minute', ts)::TIMESTAMP")} AS recorded_at, value, count(*) AS n FROM (SELECT ts, floor(value) * 1000 + 0.5 AS value FROM events WHERE event_type <> 'error') GROUP BY date_trunc('minute', ts), value""")
def meter_rows(spark, sf):
    """Meter text in five time formats with thousands commas; broken rows rejected."""
    e = table(spark, sf, "events").withColumn("t", F.date_trunc("minute", "ts"))
    k = F.col("event_id") % 5
    at = lambda f: F.date_format("t", f)
    text = F.when(k == 0, at("yyyy-MM-dd HH:mm:ss")).when(k == 1, at("yyyy/MM/dd HH:mm")).when(k == 2, at("yyyyMMddHHmm")).when(k == 3, at("yyyy-MM-dd'T'HH:mm:ss")).otherwise(at("yyyyMMdd HH:mm"))
    raw = e.select(F.when(F.col("event_type") == "error", "n/a").otherwise(text).alias("측정시각"), F.format_number(F.floor("value") * 1000 + 0.5, 1).alias("전력량(kWh)"))
    good, _ = feeds.parse_meter_rows(raw, 1, "electricity", "kWh")
    return good.groupBy("recorded_at", "value").agg(F.count(F.lit(1)).alias("n"))


@query("meter_rejects", """SELECT count(*) AS rejected FROM events WHERE event_type = 'error'""")
def meter_rejects(spark, sf):
    e = table(spark, sf, "events")
    raw = e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("when"), F.when(F.col("event_type") == "error", "").otherwise(F.col("value").cast("string")).alias("amount"))
    return feeds.parse_meter_rows(raw, 1, "gas", "m3")[1].agg(F.count(F.lit(1)).alias("rejected"))


@query("weather_lines", f"""SELECT {TS("date_trunc('minute', ts)::TIMESTAMP")} AS measured_at, CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 90.0 WHEN 2 THEN 202.5 ELSE 315.0 END::DOUBLE AS wind_direction, CASE user_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 9 WHEN 4 THEN 13 ELSE 2 END::DOUBLE AS wind_speed
 FROM events WHERE event_type <> 'error'""")
def weather_lines(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id") % 4
    w = F.when(k == 0, "N").when(k == 1, "E").when(k == 2, "SSW").otherwise("NW")
    line = F.concat_ws(" ", F.lit("11B10101"), F.date_format("ts", "yyyyMMddHHmm"), F.date_format("ts", "yyyyMMddHHmm"), F.lit("A 0 108 2 x y"), F.lit("S"), (F.col("user_id") % 6).cast("string"), w, F.lit("end"))
    return feeds.weather_from_lines(e.select(F.when(F.col("event_type") == "error", F.concat(F.lit("# "), line)).otherwise(line).alias("value"))).drop("reg")


@query("weather_items", f"""WITH g AS (SELECT user_id, strftime(ts, '%Y%m%d%H') || '00' AS h, max(value) FILTER (WHERE event_type = 'purchase') AS vec, max(value) FILTER (WHERE event_type = 'click') AS wsd FROM events GROUP BY 1, 2)
 SELECT user_id AS grid_x, vec AS wind_direction, wsd AS wind_speed, h FROM g WHERE vec IS NOT NULL AND wsd IS NOT NULL""")
def weather_items(spark, sf):
    e = table(spark, sf, "events")
    cat = F.when(F.col("event_type") == "purchase", "VEC").when(F.col("event_type") == "click", "WSD").otherwise("T1H")
    items = e.select(F.col("user_id").alias("nx"), F.lit(0).alias("ny"), F.date_format("ts", "yyyyMMdd").alias("fcstDate"), F.concat(F.date_format("ts", "HH"), F.lit("00")).alias("fcstTime"), cat.alias("category"), F.col("value").cast("string").alias("fcstValue"))
    return feeds.weather_from_items(items).select("grid_x", "wind_direction", "wind_speed", F.date_format("measured_at", "yyyyMMddHHmm").alias("h"))


@query("ledger_items", """SELECT '11440' || '10100' || CASE l_linenumber % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' ELSE '1' END || lpad(CAST(l_orderkey % 10000 AS VARCHAR), 4, '0') || '0000' AS pnu, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS enrgy_eff_rate,
 nullif(l_tax * 100, 0) AS epi_score, l_extendedprice AS tot_area FROM lineitem""")
def ledger_items(spark, sf):
    li = table(spark, sf, "lineitem")
    text = lambda c: c.cast("string")
    given = {
        "sigunguCd": F.lit("11440"), "bjdongCd": F.lit(" 10100 "), "platGbCd": text(F.col("l_linenumber") % 4), "bun": text(F.col("l_orderkey") % 10000),
        "engrGrade": F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.col("l_returnflag")), "engrEpi": text(F.col("l_tax") * 100), "totArea": text(F.col("l_extendedprice")),
    }
    items = li.select(*[given.get(f, F.lit(None).cast("string")).alias(f) for f in B._XML_FIELDS])
    return B.ledger_from_items(items, "recap").select("pnu", "enrgy_eff_rate", "epi_score", "tot_area")


@query("footprint_features", f"""WITH {BUILDING} SELECT pnu, {R('cx', 5)} AS cx, {R('cy', 5)} AS cy, {R('(1 + gid % 25) * 3.3::DOUBLE', 1)} AS height FROM building""")
def footprint_features(spark, sf):
    """Square footprints as feature pages, every feature on two overlapping tiles."""
    b = building(spark, sf)
    corner = lambda dx, dy: F.array(F.col("cx") + dx, F.col("cy") + dy)
    h = 0.0005
    ring = F.array(corner(-h, -h), corner(h, -h), corner(h, h), corner(-h, h), corner(-h, -h))
    geometry = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    props = F.create_map(F.lit("bd_mgt_sn"), F.concat("pnu", F.lit("000001")), F.lit("gro_flo_co"), F.col("floors_above").cast("string"))
    page = F.array(F.struct(geometry.alias("geometry"), props.alias("properties")))
    pages = b.select(page.alias("features"))
    out = B.footprints_from_features(pages.unionByName(pages)).filter(geo.is_valid(F.col("rings")))
    return rounded(out.select("pnu", "cx", "cy", "height"), 5, "cx", "cy")


@query("run_names", """SELECT CASE l_linenumber % 2 WHEN 0 THEN 'office' ELSE 'small_office' END AS archetype, CASE WHEN l_returnflag = 'A' THEN 'pre1990' ELSE '2018_plus' END AS vintage, 'jeju' AS city, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2""")
def run_names(spark, sf):
    flag = F.col("l_returnflag")
    vintage = F.when(flag == "A", "v1_pre1990").when(flag == "R", "v5_2018_plus").otherwise("v9_other")
    name = F.concat_ws("_", F.when(F.col("l_linenumber") % 2 == 0, "office").otherwise("small_office"), vintage, F.lit("jeju_tmy"), F.concat(F.lit("p"), F.col("l_orderkey").cast("string")))
    runs = table(spark, sf, "lineitem").select(feeds.parse_run_id(name).alias("r")).filter("r IS NOT NULL")
    return runs.groupBy("r.archetype", "r.vintage", "r.city").agg(F.count(F.lit(1)).alias("n"))


@query("partitioned_readings", f"""WITH {READING} SELECT meter_type, count(*) AS n, {R('sum(value)', 3)} AS total FROM reading WHERE recorded_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1""")
def partitioned_readings(spark, sf):
    path = _path(spark, "readings")
    sinks.write_readings(reading(spark, sf), path)
    back = sinks.read_readings(spark, path, datetime(2024, 1, 5), datetime(2024, 1, 20, 12))
    return rounded(back.groupBy("meter_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 3, "total")


@query("region_replace", f"""WITH {BUILDING} SELECT left(pnu, 5) AS sgg, count(*) AS n, CAST(sum(CASE WHEN left(pnu, 5) < '11010' THEN 2 ELSE 1 END) AS BIGINT) AS version FROM building GROUP BY 1""")
def region_replace(spark, sf):
    """All districts written, then the first ten written again."""
    path = _path(spark, "regions")
    rows = lambda v: building(spark, sf).select("pnu", F.lit(v).alias("version"))
    sinks.replace_region(rows(1), path)
    sinks.replace_region(rows(2).filter(F.substring("pnu", 1, 5) < "11010"), path)
    return spark.read.parquet(path).groupBy(F.col("sgg").cast("string").alias("sgg")).agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("version"))


@query("csv_export", f"""WITH {CURRENT} SELECT pnu, vintage_class, {R('total_energy', 2)} AS total_energy FROM cur WHERE usage_type = '공장'""")
def csv_export(spark, sf):
    from parcelwatt.operators.energy import with_current

    path = _path(spark, "export")
    df = Q.filter_buildings(with_current(building(spark, sf), result(spark, sf)), usages=("공장",))
    sinks.export_csv(df.withColumns({"lng": F.col("cx"), "lat": F.col("cy")}), path)
    back = spark.read.option("header", True).csv(path)
    return back.select("pnu", "vintage_class", F.col("total_energy").cast("double").alias("total_energy"))


@query("snapshot_swap", """SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderstatus <> 'P'""")
def snapshot_swap(spark, sf):
    """A snapshot replaced by a filter of itself."""
    path = _path(spark, "snapshot")
    sinks.write_snapshot(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), path)
    sinks.write_snapshot(spark.read.parquet(path).filter("o_orderstatus <> 'P'"), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("promote_versions", """WITH e AS (SELECT 'm' || (o_custkey % 10) AS model_name, 'v' || (o_custkey // 10) AS version_tag, CASE o_orderstatus WHEN 'O' THEN 'staging' WHEN 'F' THEN 'production' ELSE 'archived' END AS stage, o_totalprice AS mape, o_orderdate AS created_at FROM orders),
 s AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY model_name, version_tag ORDER BY created_at DESC, stage DESC, mape DESC) = 1),
 live AS (SELECT * FROM s WHERE stage = 'production' QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY created_at DESC, version_tag DESC) = 1)
 SELECT model_name, CASE WHEN 150000 < mape * 0.98::DOUBLE THEN 'production' ELSE 'staging' END AS stage FROM live""")
def promote_versions(spark, sf):
    ev = _events(spark, sf)
    new = ev.select("model_name").distinct().select(
        "model_name", F.lit("next").alias("version_tag"), F.lit("").alias("stage"), F.lit(150000.0).alias("mape"), F.lit(0.0).alias("rmse"), F.lit("2030-01-01").cast("timestamp").alias("created_at"), F.lit("").alias("path"))
    live = ml.production(ev).select("model_name")
    out = ml.promote(ev, new.join(live, "model_name", "left_semi"))
    return out.filter("version_tag = 'next'").select("model_name", "stage")


@query("key_checks", f"""WITH {BUILDING} SELECT gid, CASE WHEN total_area IS NULL THEN 'area' WHEN building_name IS NULL THEN 'name' END AS first_reason FROM building WHERE total_area IS NULL OR building_name IS NULL""")
def key_checks(spark, sf):
    rules = {"pnu": quality.pnu_ok(F.col("pnu")), "area": F.col("total_area").isNotNull(), "name": F.col("building_name").isNotNull()}
    _, bad = quality.check(building(spark, sf), rules)
    return bad.select("gid", F.col("reasons")[0].alias("first_reason"))


@query("prediction_store", """SELECT year(l_shipdate) AS year, count(*) AS n, CAST(round(CAST(sum(l_quantity) AS DECIMAL(30,8)), 2) AS DOUBLE) AS total FROM lineitem GROUP BY 1""")
def prediction_store(spark, sf):
    path = _path(spark, "predictions")
    sinks.write_predictions(predictions(spark, sf), path)
    back = spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n"), (F.sum("predicted_eui") / 1000).alias("total"))
    return rounded(back, 2, "total")


@query("audit_run", """SELECT 'load' AS run_type, 'success' AS status, count(*) AS rows_upserted, count(*) FILTER (WHERE o_orderstatus = 'P') AS rows_skipped FROM orders""")
def audit_run(spark, sf):
    """Orders written under an audit record, which counts them on the way."""
    from parcelwatt.operators import audit

    path = _path(spark, "audit")
    orders = table(spark, sf, "orders")
    with audit.record(spark, f"{path}/log", "load", {"sf": "given"}) as run:
        run.watch(orders).write.parquet(f"{path}/orders")
        run.watch(orders.filter("o_orderstatus = 'P'"), "skipped").write.parquet(f"{path}/skipped")
    return spark.read.parquet(f"{path}/log").select("run_type", "status", "rows_upserted", "rows_skipped")


@query("estimate_results", f"""WITH {RESULT}, one AS (SELECT b.pnu, {_GRADE} AS g, r.data_tier, r.simulation_type, r.total_energy FROM building b LEFT JOIN (SELECT * FROM result WHERE is_current) r USING (pnu))
 SELECT pnu, CASE WHEN g IS NOT NULL AND coalesce(data_tier, 4) >= 2 THEN 2 WHEN coalesce(data_tier, 4) = 4 THEN 4 ELSE data_tier END AS data_tier,
 CASE WHEN g IS NOT NULL AND coalesce(data_tier, 4) >= 2 THEN 'energy_grade' WHEN coalesce(data_tier, 4) = 4 THEN 'archetype' ELSE simulation_type END AS simulation_type,
 CASE WHEN g IS NOT NULL AND coalesce(data_tier, 4) >= 2 THEN g WHEN coalesce(data_tier, 4) < 4 THEN total_energy ELSE 0 END AS kept_energy FROM one""")
def estimate_results(spark, sf):
    """Current results after grades and archetype estimates filled every building."""
    from parcelwatt.plans.refresh import estimate_results as run

    current = result(spark, sf).filter("is_current").drop("reference_year", "co2_kg_m2", "primary_energy_kwh_m2")
    out = run(building(spark, sf), current, None, YEAR)
    kept = F.when(F.col("data_tier") == 4, 0.0).otherwise(F.col("total_energy"))
    return out.select("pnu", "data_tier", "simulation_type", kept.alias("kept_energy"))
