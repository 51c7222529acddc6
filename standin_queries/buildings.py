"""Entity resolution, classification, look-ups and statistics of buildings."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwatt import dims
from parcelwatt.functions import classify, geo, pnu
from parcelwatt.functions.energy import eui
from parcelwatt.operators import energy, enrich, quality, query as Q, resolve, stats
from parcelwatt.operators.join import distinct_on, fallback_left, top1_left, top_k
from parcelwatt.operators.upsert import protect
from standin_queries.base import (
    BATCHES, BUILDING, CURRENT, EVEN, FOOTPRINT, LEDGER, RESULT, R, batches, building, footprint, ledger, query, result, rounded, table,
)

_BEST = """best AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY pnu ORDER BY grnd_flr_cnt DESC NULLS LAST, tot_area DESC NULLS LAST, main_purps_nm DESC NULLS LAST, bld_nm DESC NULLS LAST) = 1)"""
_ENERGY = """energy AS (SELECT * FROM ledger WHERE enrgy_eff_rate IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pnu ORDER BY tot_area DESC NULLS LAST, enrgy_eff_rate DESC, epi_score DESC) = 1)"""
_DAY = "coalesce(e.use_apr_day, b.use_apr_day, p.use_apr_day)"
_CLS_YEAR = f"coalesce(try_cast(nullif(left(nullif({_DAY}, ''), 4), '') AS INTEGER), try_cast(nullif(left(nullif(f.approval_date, ''), 4), '') AS INTEGER), 1970)"
_FLOORS = "coalesce(b.grnd_flr_cnt, p.grnd_flr_cnt, f.grnd_flr, 3)"
_AREA = "coalesce(e.tot_area, b.tot_area, p.tot_area, 0)"
_STRUCT = "coalesce(b.strct_nm, p.strct_nm)"


def _year(text):
    y = f"try_cast(left({text}, 4) AS INTEGER)"
    return f"CASE WHEN {y} BETWEEN 1900 AND 2026 THEN {y} END"


@query("enrich_buildings", f"""WITH {FOOTPRINT}, {LEDGER}, {_BEST}, {_ENERGY}
 SELECT f.gid, f.pnu, coalesce(e.bld_nm, b.bld_nm, p.bld_nm, f.bld_nm, '') AS building_name, coalesce(e.main_purps_nm, b.main_purps_nm, p.main_purps_nm, f.usage_type, '미분류') AS usage_type,
 {_STRUCT} AS structure_type, {R(f'least(coalesce(nullif(f.height, 0), nullif(coalesce(b.bld_ht, p.bld_ht), 0), greatest({_FLOORS}, 1) * 3.3::DOUBLE, 10.0), 650.0)', 4)} AS height,
 CAST({_FLOORS} AS BIGINT) AS floors_above, CAST(coalesce(b.ugrnd_flr_cnt, p.ugrnd_flr_cnt, f.ugrnd_flr, 0) AS BIGINT) AS floors_below, {R(_AREA, 4)} AS total_area,
 {R('coalesce(e.bld_area, b.bld_area, p.bld_area, 0)', 4)} AS building_area,
 CAST(CASE WHEN coalesce({_DAY}, '') <> '' THEN {_year(_DAY)} ELSE {_year('f.approval_date')} END AS DOUBLE) AS built_year, e.enrgy_eff_rate AS energy_grade, {R('e.epi_score', 4)} AS epi_score,
 CASE WHEN {_CLS_YEAR} < 1980 THEN 'pre-1980' WHEN {_CLS_YEAR} <= 2000 THEN '1980-2000' WHEN {_CLS_YEAR} <= 2010 THEN '2001-2010' ELSE 'post-2010' END AS vintage_class,
 CASE WHEN {_AREA} < 500 THEN 'small' WHEN {_AREA} < 3000 THEN 'medium' ELSE 'large' END AS size_class,
 CASE WHEN {_STRUCT} LIKE '%철근콘크리트%' THEN 'RC' WHEN {_STRUCT} LIKE '%철골%' THEN 'steel' WHEN {_STRUCT} LIKE '%벽돌%' OR {_STRUCT} LIKE '%목%' THEN 'masonry' ELSE 'RC' END AS structure_class
 FROM footprint f LEFT JOIN energy e ON e.pnu = f.pnu LEFT JOIN best b ON b.pnu = f.pnu LEFT JOIN best p ON p.pnu = left(f.pnu, 15) || '0000' AND b.main_purps_nm IS NULL""")
def enrich_buildings(spark, sf):
    df = enrich.buildings(footprint(spark, sf), ledger(spark, sf))
    df = df.withColumn("built_year", F.col("built_year").cast("double"))
    return rounded(df, 4, "height", "total_area", "building_area", "epi_score")


@query("join_top1", f"""WITH {FOOTPRINT}, {LEDGER}, {_ENERGY} SELECT f.gid, f.pnu, e.enrgy_eff_rate, {R('e.tot_area', 4)} AS tot_area FROM footprint f LEFT JOIN energy e USING (pnu)""")
def join_top1(spark, sf):
    order = [F.col("tot_area").desc_nulls_last(), F.col("enrgy_eff_rate").desc(), F.col("epi_score").desc()]
    right = ledger(spark, sf).select("pnu", "enrgy_eff_rate", "tot_area", "epi_score")
    df = top1_left(footprint(spark, sf).select("gid", "pnu"), right, "pnu", order, F.col("enrgy_eff_rate").isNotNull())
    return rounded(df.drop("epi_score"), 4, "tot_area")


@query("join_fallback", f"""WITH {FOOTPRINT}, {LEDGER}, {_BEST} SELECT f.gid, f.pnu, b.main_purps_nm AS own, p.main_purps_nm AS parent, CAST(p.grnd_flr_cnt AS DOUBLE) AS parent_floors
 FROM footprint f LEFT JOIN best b ON b.pnu = f.pnu LEFT JOIN best p ON p.pnu = left(f.pnu, 15) || '0000' AND b.main_purps_nm IS NULL""")
def join_fallback(spark, sf):
    order = [F.col("grnd_flr_cnt").desc_nulls_last(), F.col("tot_area").desc_nulls_last(), F.col("main_purps_nm").desc_nulls_last(), F.col("bld_nm").desc_nulls_last()]
    best = top_k(ledger(spark, sf), ["pnu"], order)
    df = footprint(spark, sf).select("gid", "pnu").join(best.select("pnu", F.col("main_purps_nm").alias("own")), "pnu", "left")
    parents = best.select("pnu", F.col("main_purps_nm").alias("parent"), F.col("grnd_flr_cnt").cast("double").alias("parent_floors"))
    return fallback_left(df, parents, "pnu", pnu.parent(F.col("pnu")), F.col("own").isNull())


@query("height_expr", f"""WITH {FOOTPRINT} SELECT gid, {R('least(coalesce(nullif(height, 0), greatest(grnd_flr, 1) * 3.3::DOUBLE, 10.0), 650.0)', 4)} AS height FROM footprint""")
def height_expr(spark, sf):
    h = classify.height(F.col("height"), F.lit(None).cast("double"), F.col("grnd_flr"))
    return rounded(footprint(spark, sf).select("gid", h.alias("height")), 4, "height")


@query("built_year", f"""WITH {LEDGER} SELECT pnu, use_apr_day, CAST({_year('use_apr_day')} AS DOUBLE) AS built_year FROM ledger""")
def built_year(spark, sf):
    return ledger(spark, sf).select("pnu", "use_apr_day", classify.built_year(F.col("use_apr_day"), F.lit(None).cast("string")).cast("double").alias("built_year"))


def _orders_year(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.when(k % 17 != 0, 1960 + k % 65).cast("int").alias("y"))


_Y = "CASE WHEN c_custkey % 17 <> 0 THEN 1960 + c_custkey % 65 END"


@query("vintage_class", f"""SELECT c_custkey, CASE WHEN {_Y} IS NULL THEN '1980-2000' WHEN {_Y} < 1980 THEN 'pre-1980' WHEN {_Y} <= 2000 THEN '1980-2000' WHEN {_Y} <= 2010 THEN '2001-2010' ELSE 'post-2010' END AS vintage FROM customer""")
def vintage_class(spark, sf):
    return _orders_year(spark, sf).select("c_custkey", classify.vintage(F.col("y")).alias("vintage"))


@query("vintage5", f"""SELECT c_custkey, CASE WHEN {_Y} IS NULL THEN '2001_2010' WHEN {_Y} < 1990 THEN 'pre1990' WHEN {_Y} < 2001 THEN '1991_2000' WHEN {_Y} < 2011 THEN '2001_2010' WHEN {_Y} < 2018 THEN '2011_2017' ELSE '2018_plus' END AS vintage FROM customer""")
def vintage5(spark, sf):
    return _orders_year(spark, sf).select("c_custkey", classify.vintage5(F.col("y")).alias("vintage"))


@query("size_structure", f"""WITH {LEDGER} SELECT pnu, {R('tot_area', 3)} AS tot_area, CASE WHEN coalesce(tot_area, 0) < 500 THEN 'small' WHEN tot_area < 3000 THEN 'medium' ELSE 'large' END AS size_class,
 CASE WHEN strct_nm LIKE '%철근콘크리트%' THEN 'RC' WHEN strct_nm LIKE '%철골%' THEN 'steel' WHEN strct_nm LIKE '%벽돌%' OR strct_nm LIKE '%목%' THEN 'masonry' ELSE 'RC' END AS structure_class FROM ledger""")
def size_structure(spark, sf):
    df = ledger(spark, sf).select("pnu", "tot_area", classify.size_class(F.col("tot_area")).alias("size_class"), classify.structure_class(F.col("strct_nm")).alias("structure_class"))
    return rounded(df, 3, "tot_area")


_USE_KEYS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in classify.USAGE_KEYS.items())


@query("usage_norm", f"""WITH {FOOTPRINT}, {LEDGER}, u AS (SELECT main_purps_nm AS usage FROM ledger UNION ALL SELECT usage_type FROM footprint)
 SELECT CASE WHEN coalesce(trim(usage), '') = '' THEN 'apartment' ELSE CASE trim(usage) {_USE_KEYS} ELSE lower(trim(usage)) END END AS usage_key, count(*) AS n FROM u GROUP BY 1""")
def usage_norm(spark, sf):
    u = ledger(spark, sf).select(F.col("main_purps_nm").alias("usage")).unionByName(footprint(spark, sf).select(F.col("usage_type").alias("usage")))
    return u.groupBy(classify.usage_key(F.col("usage")).alias("usage_key")).agg(F.count(F.lit(1)).alias("n"))


@query("display_name", f"""WITH {BUILDING} SELECT gid, coalesce(nullif(trim(building_name), ''), CAST(CAST(substr(pnu, 12, 4) AS INTEGER) AS VARCHAR) ||
 CASE WHEN CAST(substr(pnu, 16, 4) AS INTEGER) > 0 THEN '-' || CAST(CAST(substr(pnu, 16, 4) AS INTEGER) AS VARCHAR) ELSE '' END || '번지') AS display_name,
 coalesce(nullif(trim(building_name), ''), nullif(trim(usage_type), '') || ' 건물', '미분류 건물') AS report_name FROM building""")
def display_name(spark, sf):
    b = building(spark, sf)
    return b.select("gid", enrich.display_name(F.col("building_name"), F.col("pnu")).alias("display_name"), enrich.report_name(F.col("building_name"), F.col("usage_type")).alias("report_name"))


@query("eui_expr", f"""WITH {CURRENT} SELECT pnu, data_tier, eui FROM cur""")
def eui_expr(spark, sf):
    df = energy.with_current(building(spark, sf), result(spark, sf))
    return df.select("pnu", "data_tier", eui(F.col("total_energy"), F.col("total_area"), F.col("simulation_type")).alias("eui"))


BBOX = (126.8, 37.45, 127.1, 37.6)
_IN = "cx > 126.8 AND cx < 127.1 AND cy > 37.45 AND cy < 37.6"


@query("filter_multi", f"""WITH {BUILDING} SELECT gid, pnu, usage_type, vintage_class, energy_grade FROM building WHERE energy_grade IN ('1등급', '2', 'A') AND vintage_class IN ('pre-1980', '1980-2000')
 AND usage_type IN ('공동주택', '공장', '업무시설') AND {_IN}""")
def filter_multi(spark, sf):
    b = building(spark, sf)
    return Q.filter_buildings(b, ("1등급", "2", "A"), ("pre-1980", "1980-2000"), ("공동주택", "공장", "업무시설"), BBOX).select("gid", "pnu", "usage_type", "vintage_class", "energy_grade")


@query("list_filtered", f"""WITH {BUILDING} SELECT gid, pnu FROM building WHERE usage_type = '공장' AND vintage_class = '1980-2000' AND left(pnu, 5) = '11003'""")
def list_filtered(spark, sf):
    return Q.list_buildings(building(spark, sf), usage="공장", vintage="1980-2000", sigungu="11003").select("gid", "pnu")


@query("bbox", f"""WITH {BUILDING} SELECT gid, 'intersects' AS mode FROM building WHERE xmin <= 127.1 AND xmax >= 126.8 AND ymin <= 37.6 AND ymax >= 37.45 UNION ALL SELECT gid, 'within' FROM building WHERE {_IN}""")
def bbox(spark, sf):
    b = building(spark, sf)
    part = lambda mode: Q.in_bbox(b, *BBOX, mode=mode).select("gid", F.lit(mode).alias("mode"))
    return part("intersects").unionByName(part("within"))


@query("semi_bbox", f"""WITH {BUILDING}, c AS (SELECT pnu, cx, cy FROM building WHERE {_IN}) SELECT gid, pnu FROM building b WHERE EXISTS (SELECT 1 FROM c WHERE c.pnu = b.pnu) AND vintage_class IN ('post-2010')""")
def semi_bbox(spark, sf):
    b = building(spark, sf)
    return Q.filter_buildings(b, vintages=("post-2010",), bbox=BBOX, centroids=enrich.centroids(b)).select("gid", "pnu")


@query("search_name", """SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_partkey LIMIT 10""")
def search_name(spark, sf):
    return Q.search(table(spark, sf, "part"), "RING", "p_name", 10, [F.col("p_partkey")]).select("p_partkey", "p_name")


_CUR_NUM = R("eui / 365.0", 3)


@query("overlay_zeb", f"""WITH {CURRENT}, one AS (SELECT * FROM cur QUALIFY row_number() OVER (PARTITION BY pnu ORDER BY gid) = 1) SELECT pnu, {R('eui', 1)} AS eui, eui <= 150 AS is_zeb FROM one WHERE total_energy > 0 AND {_IN}""")
def overlay_zeb(spark, sf):
    b = building(spark, sf)
    return Q.overlay(enrich.centroids(b), result(spark, sf), b, "zeb", BBOX, n=None).select("pnu", "eui", "is_zeb")


@query("overlay_hourly", f"""WITH {CURRENT}, one AS (SELECT * FROM cur QUALIFY row_number() OVER (PARTITION BY pnu ORDER BY gid) = 1) SELECT pnu, {_CUR_NUM} AS eui_daily, coalesce(usage_type, '기타') AS usage_type FROM one WHERE total_energy > 0 AND {_IN}""")
def overlay_hourly(spark, sf):
    b = building(spark, sf)
    return Q.overlay(enrich.centroids(b), result(spark, sf), b, "hourly", BBOX, n=None).select("pnu", "eui_daily", "usage_type")


@query("overlay_co2", f"""WITH {CURRENT} SELECT pnu, {R('co2_kg_m2', 1)} AS co2, {R('primary_energy_kwh_m2', 1)} AS pe FROM cur WHERE co2_kg_m2 IS NOT NULL AND {_IN}""")
def overlay_co2(spark, sf):
    b = building(spark, sf)
    return Q.overlay(enrich.centroids(b), result(spark, sf), b, "co2", BBOX, n=None).select("pnu", "co2", "pe")


@query("by_keys", f"""WITH {BUILDING}, k AS (SELECT DISTINCT o_custkey AS gid FROM orders WHERE o_orderstatus = 'P'), keys AS (SELECT pnu FROM building JOIN k USING (gid)) SELECT pnu, {R('cx', 6)} AS lng, {R('cy', 6)} AS lat FROM building WHERE pnu IN (SELECT pnu FROM keys)""")
def by_keys(spark, sf):
    b = building(spark, sf)
    late = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("gid")).distinct()
    return rounded(Q.by_keys(b, b.join(late, "gid").select("pnu")), 6, "lng", "lat")


@query("active_codes", """SELECT DISTINCT right(code, 5) AS bdong_code FROM (SELECT '11' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || lpad(CAST(c_custkey % 40 AS VARCHAR), 3, '0') || '00' AS code, CASE WHEN c_custkey % 6 = 0 THEN '20200101' ELSE '' END AS gone FROM customer)
 WHERE gone = '' AND left(code, 5) = '11003' AND right(code, 5) <> '00000'""")
def active_codes(spark, sf):
    k = F.col("c_custkey")
    codes = table(spark, sf, "customer").select(
        F.concat(F.lit("11"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.lpad((k % 40).cast("string"), 3, "0"), F.lit("00")).alias("code"), F.when(k % 6 == 0, "20200101").otherwise("").alias("abolished"))
    return pnu.active_codes(codes, "11003")


@query("current_energy", f"""WITH {CURRENT} SELECT gid, pnu, total_energy, data_tier, simulation_type FROM cur""")
def current_energy(spark, sf):
    return energy.with_current(building(spark, sf), result(spark, sf)).select("gid", "pnu", "total_energy", "data_tier", "simulation_type")


@query("anti_protected", f"""WITH {BATCHES} SELECT pnu, order_id FROM new WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.pnu = new.pnu AND b.data_tier IN (1, 2))""")
def anti_protected(spark, sf):
    base, new = batches(spark, sf)
    return new.join(base.filter("data_tier IN (1, 2)").select("pnu"), "pnu", "left_anti").select("pnu", "order_id")


@query("district_stats", f"""WITH {CURRENT} SELECT left(pnu, 5) AS sigungu_cd, count(*) AS building_count, {R('avg(eui)', 1)} AS avg_eui, {R('min(eui)', 1)} AS min_eui, {R('max(eui)', 1)} AS max_eui,
 count(*) FILTER (WHERE eui <= 150) AS zeb_count, count(*) FILTER (WHERE eui > 150) AS non_zeb_count, {R('count(*) FILTER (WHERE eui <= 150) * 100.0 / count(*)', 1)} AS zeb_pct,
 {R('avg(cx)', 6)} AS center_lng, {R('avg(cy)', 6)} AS center_lat FROM cur WHERE eui > 0 GROUP BY 1""")
def district_stats(spark, sf):
    return rounded(stats.by_district(building(spark, sf), result(spark, sf)), 6, "center_lng", "center_lat")


@query("stats_bundle", f"""WITH {CURRENT} SELECT 'grade' AS dimension, coalesce(energy_grade, 'unknown') AS value, count(*) AS n, {R('sum(total_energy)', 3)} AS energy_sum, count(total_energy) AS energy_count FROM cur GROUP BY 2
 UNION ALL SELECT 'usage', coalesce(usage_type, 'unknown'), count(*), {R('sum(total_energy)', 3)}, count(total_energy) FROM cur GROUP BY 2""")
def stats_bundle(spark, sf):
    return rounded(stats.bundle_long(building(spark, sf), result(spark, sf)), 3, "energy_sum")


@query("stats_bundle_bbox", f"""WITH {CURRENT} SELECT count(*) AS total_count, {R('avg(total_energy)', 4)} AS avg_energy FROM cur WHERE xmin <= 127.1 AND xmax >= 126.8 AND ymin <= 37.6 AND ymax >= 37.45""")
def stats_bundle_bbox(spark, sf):
    return rounded(stats.bundle(building(spark, sf), result(spark, sf), BBOX).select("total_count", "avg_energy"), 4, "avg_energy")


@query("filter_options", f"""WITH {BUILDING} SELECT 'usage' AS kind, usage_type AS option FROM building WHERE usage_type <> '' GROUP BY 2 UNION ALL SELECT 'vintage', vintage_class FROM building GROUP BY 2
 UNION ALL SELECT 'grade', energy_grade FROM building WHERE energy_grade <> '' GROUP BY 2""")
def filter_options(spark, sf):
    row = stats.filter_options(building(spark, sf))
    part = lambda kind, c: row.select(F.lit(kind).alias("kind"), F.explode(c).alias("option"))
    return part("usage", "usage_types").unionByName(part("vintage", "vintage_classes")).unionByName(part("grade", "energy_grades"))


@query("coverage", f"""WITH {RESULT} SELECT count(r.pnu) AS with_energy, count(*) AS total_buildings, count(*) FILTER (WHERE simulation_type = 'energy_grade') AS from_energy_grade,
 count(*) FILTER (WHERE simulation_type = 'seoul_green_cert') AS from_seoul_green_cert, count(*) FILTER (WHERE simulation_type = 'archetype') AS from_archetype, {R('avg(total_energy)', 1)} AS avg_eui
 FROM building b LEFT JOIN (SELECT * FROM result WHERE is_current) r USING (pnu)""")
def coverage(spark, sf):
    return stats.coverage(building(spark, sf), result(spark, sf).filter("is_current"))


@query("year_coverage", f"""WITH {BUILDING} SELECT left(pnu, 5) AS sigungu_cd, count(*) AS total, count(built_year) AS with_year, {R('count(built_year) * 100.0 / count(*)', 1)} AS year_pct FROM building GROUP BY 1""")
def year_coverage(spark, sf):
    return stats.year_coverage(building(spark, sf))


@query("by_source", f"""WITH {RESULT} SELECT simulation_type, count(*) AS cnt, {R('avg(total_energy)', 1)} AS avg_eui FROM result GROUP BY 1""")
def by_source(spark, sf):
    return stats.by_source(result(spark, sf))


@query("distinct_on", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def distinct(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return distinct_on(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("quality_report", f"""WITH {RESULT}, b AS (SELECT count(*) FILTER (WHERE built_year NOT BETWEEN 1900 AND 2026) AS year_out_of_range, count(*) FILTER (WHERE height >= 650) AS extreme_height,
 count(*) FILTER (WHERE usage_type NOT IN ('공동주택', '공장')) AS unclassified_usage FROM building), e AS (SELECT count(*) FILTER (WHERE co2_kg_m2 IS NULL) AS null_co2, count(*) FILTER (WHERE total_energy < 0) AS negative_eui FROM result WHERE is_current) SELECT * FROM b, e""")
def quality_report(spark, sf):
    return quality.report(building(spark, sf), result(spark, sf), ("공동주택", "공장"))


@query("page", """SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 50 OFFSET 120""")
def page(spark, sf):
    return Q.page(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 50, 120, [F.col("o_custkey"), F.col("o_orderkey")])


@query("sample_hash")
def sample_hash(spark, sf):
    return Q.sample_hash(building(spark, sf), 500).select("gid", "pnu")


@query("retrofit_priority", f"""WITH {CURRENT}, t AS (SELECT *, eui * total_area AS kwh FROM cur WHERE total_area > 0 AND eui > 150 ORDER BY eui * total_area DESC, pnu LIMIT 20)
 SELECT row_number() OVER (ORDER BY kwh DESC, pnu) AS rank, pnu, coalesce(nullif(trim(building_name), ''), usage_type || ' 건물', '미분류 건물') AS building_name, {R('total_area', 0)} AS total_area, {R('eui', 1)} AS eui,
 {R('kwh', 0)} AS total_kwh_yr, {R('eui - 150', 1)} AS zeb_gap FROM t""")
def retrofit_priority(spark, sf):
    return Q.retrofit_priority(building(spark, sf), result(spark, sf)).select("rank", "pnu", "building_name", "total_area", "eui", "total_kwh_yr", "zeb_gap")


@query("compare_pair", f"""WITH {CURRENT}, p AS (SELECT left(pnu, 5) AS d, min(pnu) AS pnu1, max(pnu) AS pnu2 FROM building GROUP BY 1)
 SELECT pnu1, pnu2, {EVEN('a.eui - 150', 1)} AS zeb_gap1, {EVEN('b.eui - 150', 1)} AS zeb_gap2, {EVEN('b.eui - a.eui', 1)} AS diff_eui_kwh_m2, {EVEN('b.co2_kg_m2 - a.co2_kg_m2', 1)} AS diff_co2_kg_m2,
 {EVEN('b.total_area - a.total_area', 1)} AS diff_total_area, {R('b.built_year - a.built_year', 1)} AS diff_built_year FROM p JOIN cur a ON a.pnu = pnu1 JOIN cur b ON b.pnu = pnu2""")
def compare_pair(spark, sf):
    b = building(spark, sf)
    pairs = b.groupBy(F.substring("pnu", 1, 5)).agg(F.min("pnu").alias("pnu1"), F.max("pnu").alias("pnu2"))
    return Q.compare_pair(b, result(spark, sf), pairs)


@query("building_detail", f"""WITH {CURRENT} SELECT pnu, usage_type, vintage_class, eui AS eui_kwh_m2, total_energy, data_tier FROM cur WHERE energy_grade = '7'""")
def building_detail(spark, sf):
    b = building(spark, sf)
    df = Q.detail(b, result(spark, sf), b.filter(F.col("energy_grade") == "7"))
    return df.select("pnu", "usage_type", "vintage_class", "eui_kwh_m2", F.col("energy.total_energy").alias("total_energy"), "data_tier")


# ── keys and addresses ───────────────────────────────────────────────────────

_LP = "CASE WHEN length(CAST(l_orderkey AS VARCHAR)) >= 4 THEN CAST(l_orderkey AS VARCHAR) ELSE lpad(CAST(l_orderkey AS VARCHAR), 4, '0') END"
_GEN = f"'11440' || '10100' || CASE CAST(l_linenumber - 1 AS VARCHAR) WHEN '0' THEN '1' WHEN '1' THEN '2' WHEN '2' THEN '3' ELSE CAST(l_linenumber - 1 AS VARCHAR) END || {_LP} || lpad(CAST(l_linenumber AS VARCHAR), 4, '0')"


@query("pnu_generate", f"""SELECT l_orderkey, l_linenumber, CASE WHEN length({_GEN}) = 19 THEN {_GEN} END AS pnu FROM lineitem""")
def pnu_generate(spark, sf):
    text = lambda c: F.col(c).cast("string")
    key = pnu.generate(F.lit("11440"), F.lit("10100"), (F.col("l_linenumber") - 1).cast("string"), text("l_orderkey"), text("l_linenumber"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key.alias("pnu"))


@query("pnu_parse", f"""WITH {FOOTPRINT} SELECT gid, substr(pnu, 1, 5) AS sigungu_code, substr(pnu, 6, 5) AS bdong_code, substr(pnu, 11, 1) AS land_kind,
 CASE substr(pnu, 11, 1) WHEN '1' THEN '대지' WHEN '2' THEN '산' WHEN '3' THEN '블록' ELSE '알수없음' END AS land_kind_name, substr(pnu, 12, 4) AS bon, substr(pnu, 16, 4) AS ji FROM footprint""")
def pnu_parse(spark, sf):
    return footprint(spark, sf).select("gid", pnu.parse(F.col("pnu")).alias("p")).select("gid", "p.*")


@query("mgt_sn", f"""WITH {FOOTPRINT} SELECT gid, pnu || lpad(CAST(gid AS VARCHAR), 6, '0') AS sn, pnu AS back FROM footprint""")
def mgt_sn(spark, sf):
    df = footprint(spark, sf).withColumn("sn", pnu.mgt_sn(F.col("pnu"), F.col("gid").cast("string")))
    return df.select("gid", "sn", pnu.from_mgt_sn(F.col("sn")).alias("back"))


def addresses(spark, sf):
    """A free address per customer in three spellings."""
    k, text = F.col("c_custkey"), lambda c: c.cast("string")
    gu = F.when(k % 3 == 0, "중구").when(k % 3 == 1, "강남구").otherwise("동대문구")
    lot = F.when(k % 4 == 0, F.concat(text(k % 300), F.lit("번지"))).when(k % 4 == 1, F.concat(text(k % 300), F.lit("-"), text(k % 9), F.lit("번지"))).when(
        k % 4 == 2, F.concat(text(k % 300), F.lit("-"), text(k % 9))).otherwise("일대")
    return table(spark, sf, "customer").select(k.alias("id"), F.concat(F.lit("서울특별시 "), gu, F.lit(" 오곡동 "), lot).alias("address"), F.col("c_name").alias("bld_nm"))


ADDRESSES = """addresses AS (SELECT c_custkey AS id, '서울특별시 ' || CASE c_custkey % 3 WHEN 0 THEN '중구' WHEN 1 THEN '강남구' ELSE '동대문구' END || ' 오곡동 ' ||
 CASE c_custkey % 4 WHEN 0 THEN (c_custkey % 300) || '번지' WHEN 1 THEN (c_custkey % 300) || '-' || (c_custkey % 9) || '번지' WHEN 2 THEN (c_custkey % 300) || '-' || (c_custkey % 9) ELSE '일대' END AS address, c_name AS bld_nm FROM customer)"""


@query("address_parse", f"""WITH {ADDRESSES} SELECT id, CASE WHEN id % 4 < 3 THEN '오곡동' END AS dong, CASE WHEN id % 4 < 3 THEN id % 300 END::DOUBLE AS bon, CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN id % 9 WHEN 2 THEN id % 9 END::DOUBLE AS ji,
 CASE WHEN id % 4 < 3 THEN id % 300 END::DOUBLE AS token_bon FROM addresses""")
def address_parse(spark, sf):
    df = addresses(spark, sf).withColumns({"p": pnu.parse_address(F.col("address")), "t": pnu.parse_lot_tokens(F.col("address"))})
    return df.select("id", "p.dong", *[F.col(c).cast("double").alias(a) for c, a in (("p.bon", "bon"), ("p.ji", "ji"), ("t.bon", "token_bon"))])


@query("sgg_from_text", f"""WITH {ADDRESSES} SELECT id, CASE id % 3 WHEN 0 THEN '11140' WHEN 1 THEN '11680' ELSE '11230' END AS sgg FROM addresses""")
def sgg_from_text(spark, sf):
    return addresses(spark, sf).select("id", pnu.sgg_from_text(F.col("address"), dims.district_pairs("11")).alias("sgg"))


def _named_footprints(spark, sf):
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    gu = F.when(k % 3 == 0, "11140").when(k % 3 == 1, "11680").otherwise("11230")
    return table(spark, sf, "part").select(
        F.concat(gu, F.lit("101001"), F.lpad(text(k % 300), 4, "0"), F.lpad(text(F.floor(k / 300) % 9), 4, "0")).alias("pnu"),
        F.concat(F.lit("Customer#"), F.lpad(text(k * 7), 9, "0")).alias("bld_nm"))


_NAMED = """fp AS (SELECT CASE p_partkey % 3 WHEN 0 THEN '11140' WHEN 1 THEN '11680' ELSE '11230' END || '101001' || lpad(CAST(p_partkey % 300 AS VARCHAR), 4, '0') || lpad(CAST((p_partkey // 300) % 9 AS VARCHAR), 4, '0') AS pnu,
 'Customer#' || lpad(CAST(p_partkey * 7 AS VARCHAR), 9, '0') AS bld_nm FROM part)"""


_TRIGRAMS = "list_distinct(flatten(list_transform(string_split(lower(name), ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("address_to_pnu", f"""WITH {ADDRESSES}, {_NAMED}, a AS (SELECT id, bld_nm, CASE id % 3 WHEN 0 THEN '11140' WHEN 1 THEN '11680' ELSE '11230' END AS sgg, CASE WHEN id % 4 < 3 THEN id % 300 END AS bon, CASE id % 4 WHEN 0 THEN 0 ELSE id % 9 END AS ji FROM addresses),
 lot AS (SELECT id, min(pnu) AS pnu FROM a JOIN fp ON left(pnu, 5) = sgg AND CAST(substr(pnu, 12, 4) AS INTEGER) = bon AND CAST(substr(pnu, 16, 4) AS INTEGER) = ji GROUP BY 1),
 rest AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM lot)), named AS (SELECT left(pnu, 5) AS sgg, bld_nm AS name, min(pnu) AS pnu FROM fp GROUP BY 1, 2),
 l AS MATERIALIZED (SELECT sgg, name, {_TRIGRAMS} AS t FROM (SELECT DISTINCT sgg, bld_nm AS name FROM rest)), r AS MATERIALIZED (SELECT sgg, name, pnu, {_TRIGRAMS} AS t FROM named),
 s AS (SELECT l.sgg, l.name, r.name AS other, r.pnu, length(list_intersect(l.t, r.t)) AS k, length(l.t) AS na, length(r.t) AS nb FROM l JOIN r USING (sgg)),
 best AS (SELECT * FROM s WHERE k / (na + nb - k)::DOUBLE >= 0.3 QUALIFY row_number() OVER (PARTITION BY sgg, name ORDER BY k / (na + nb - k)::DOUBLE DESC, other) = 1)
 SELECT id, pnu, 'lot' AS method FROM lot UNION ALL SELECT id, pnu, CASE WHEN pnu IS NULL THEN 'no match' ELSE 'name' END FROM rest LEFT JOIN best ON best.sgg = rest.sgg AND best.name = rest.bld_nm""")
def address_to_pnu(spark, sf):
    return resolve.address_to_pnu(addresses(spark, sf), _named_footprints(spark, sf))


@query("fuzzy_match", """WITH l AS (SELECT DISTINCT p_brand AS block, p_name AS name FROM part), r AS (SELECT DISTINCT p_brand AS block, lower(p_type) || ' ' || p_name AS name FROM part),
 tri AS (SELECT side, block, name, list_distinct(flatten(list_transform(string_split(lower(name), ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS t
  FROM (SELECT 'l' AS side, * FROM l UNION ALL SELECT 'r', * FROM r)),
 s AS (SELECT a.block, a.name AS name_a, b.name AS name_b, length(list_intersect(a.t, b.t)) AS k, length(a.t) AS na, length(b.t) AS nb FROM tri a JOIN tri b ON a.block = b.block AND a.side = 'l' AND b.side = 'r')
 SELECT block, name_a, name_b, CAST(round(k / (na + nb - k)::DOUBLE, 6) AS DOUBLE) AS similarity FROM s WHERE k / (na + nb - k)::DOUBLE >= 0.3 QUALIFY row_number() OVER (PARTITION BY block, name_a ORDER BY k / (na + nb - k)::DOUBLE DESC, name_b) = 1""")
def fuzzy_match(spark, sf):
    p = table(spark, sf, "part")
    left = p.select(F.col("p_brand").alias("block"), F.col("p_name").alias("name"))
    right = p.select(F.col("p_brand").alias("block"), F.concat(F.lower("p_type"), F.lit(" "), F.col("p_name")).alias("name"))
    return rounded(resolve.best_similar(left, right), 6, "similarity")


_ADDRESS_SQL = f"""WITH {ADDRESSES}, b AS (SELECT pnu, '서울특별시 ' || CASE c_custkey % 3 WHEN 0 THEN '중구' WHEN 1 THEN '강남구' ELSE '동대문구' END || ' 오곡동 ' || (c_custkey % 50) || '-' || (c_custkey % 9) AS a
  FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 19, '0') AS pnu FROM customer)), q AS (SELECT DISTINCT {{q}} AS q FROM addresses),
 m AS (SELECT q, min(pnu) AS pnu FROM q JOIN b ON contains(a, q) GROUP BY 1) SELECT id, pnu FROM addresses JOIN m ON {{q}} = q"""


def _addressed(spark, sf):
    k, text = F.col("c_custkey"), lambda c: c.cast("string")
    gu = F.when(k % 3 == 0, "중구").when(k % 3 == 1, "강남구").otherwise("동대문구")
    b = table(spark, sf, "customer").select(
        F.lpad(text(k), 19, "0").alias("pnu"), F.concat(F.lit("서울특별시 "), gu, F.lit(" 오곡동 "), text(k % 50), F.lit("-"), text(k % 9)).alias("road_addr"), F.lit(None).cast("string").alias("jibun_addr"))
    return b


@query("address_prefix", _ADDRESS_SQL.format(q="left(trim(address), 15)"))
def address_prefix(spark, sf):
    return resolve.by_address(addresses(spark, sf), _addressed(spark, sf), 15)


@query("address_whole", _ADDRESS_SQL.format(q="lower(trim(address))"))
def address_whole(spark, sf):
    """Whole addresses anywhere in the address of a building."""
    return resolve.by_address(addresses(spark, sf), _addressed(spark, sf))


@query("geojson_feature", f"""WITH {BUILDING} SELECT gid, {R('cx', 5)} AS x, {R('cy', 5)} AS y, usage_type FROM building""")
def geojson_feature(spark, sf):
    """Features written as text and read back."""
    b = building(spark, sf).withColumn("feature", geo.to_feature(geo.point_geojson(F.col("cx"), F.col("cy")), ["gid", "usage_type"]))
    at = lambda p: F.get_json_object("feature", p)
    df = b.select(at("$.properties.gid").cast("long").alias("gid"), at("$.geometry.coordinates[0]").cast("double").alias("x"), at("$.geometry.coordinates[1]").cast("double").alias("y"), at("$.properties.usage_type").alias("usage_type"))
    return rounded(df, 5, "x", "y")


@query("upsert_protect", f"""WITH {BATCHES} SELECT pnu, order_id FROM base b WHERE data_tier <> 4 OR NOT EXISTS (SELECT 1 FROM new n WHERE n.pnu = b.pnu) UNION ALL
 SELECT pnu, order_id FROM new n WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.pnu = n.pnu AND b.data_tier <> 4)""")
def protect_tiers(spark, sf):
    base, new = batches(spark, sf)
    return protect(base, new).select("pnu", "order_id")
