"""Lookup tables built from samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwatt.dims import values as V
from parcelwatt.operators import tables as T
from standin_queries.base import R, query, rounded, table
from standin_queries.energy import LOOKUP, SAMPLES, lookup, samples


@query("eui_lookup", f"""WITH {SAMPLES}, first AS (SELECT * FROM samples), v AS (SELECT *, {R('eui', 2)} AS v FROM first WHERE eui > 5 AND eui < 5000)
 SELECT archetype, vintage, city, {R('quantile_cont(v, 0.5)', 1)} AS median, {R('quantile_cont(v, 0.1)', 1)} AS p10, {R('quantile_cont(v, 0.9)', 1)} AS p90, count(*) AS n FROM v GROUP BY 1, 2, 3""")
def eui_lookup(spark, sf):
    return T.build_eui_lookup(samples(spark, sf))


_USES = ("제2종근린생활시설", "업무시설", "교육연구시설", "공동주택", "종교시설", "숙박시설", "창고시설")
_USE = "CASE l_linenumber " + " ".join(f"WHEN {i + 1} THEN '{u}'" for i, u in enumerate(_USES)) + " END"
_ARCHOF = "CASE usage_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.CALIBRATION_ARCHETYPE.items()) + " END"
_V5 = "CASE WHEN by_ < 1990 THEN 'pre1990' WHEN by_ < 2001 THEN '1991_2000' WHEN by_ < 2011 THEN '2001_2010' WHEN by_ < 2018 THEN '2011_2017' ELSE '2018_plus' END"


@query("calibration", f"""WITH {LOOKUP}, t AS (SELECT l_orderkey || '-' || l_linenumber AS pnu, l_extendedprice / 250 AS eui, {_USE} AS usage_type, 1980 + CAST(l_quantity AS INTEGER) % 45 AS by_ FROM lineitem),
 k AS (SELECT *, {_ARCHOF} AS archetype, {_V5} AS vintage FROM t WHERE eui BETWEEN 10 AND 400 QUALIFY row_number() OVER (PARTITION BY pnu ORDER BY eui) = 1),
 s AS (SELECT archetype, vintage, coalesce(max(median) FILTER (WHERE city = 'seoul'), max(median) FILTER (WHERE city = 'busan'), max(median) FILTER (WHERE city = 'daegu')) AS sim FROM lookup GROUP BY 1, 2),
 j AS (SELECT usage_type, max(k.archetype) AS archetype, count(*) AS n_tier1, quantile_cont(eui, 0.5) AS m, quantile_cont(sim, 0.5) AS sm FROM k LEFT JOIN s USING (archetype, vintage) GROUP BY 1)
 SELECT usage_type, coalesce(archetype, 'N/A') AS archetype, n_tier1, {R('m', 1)} AS median_tier1, {R('sm', 1)} AS median_simul, coalesce({R('m / nullif(sm, 0)', 4)}, 1.0) AS correction_factor FROM j""")
def calibration(spark, sf):
    li = table(spark, sf, "lineitem")
    use = F.element_at(F.array(*[F.lit(u) for u in _USES]), F.col("l_linenumber"))
    t = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("pnu"), (F.col("l_extendedprice") / 250).alias("eui"), use.alias("usage_type"), (F.col("l_quantity").cast("int") % 45 + 1980).alias("built_year"))
    return T.calibration(t, lookup(spark, sf)).drop("note")


_AREA = "CASE building " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.SIMULATED_AREA.items()) + " END"
_BLD = ("Hotel", "School", "Retail", "Warehouse", "Apartment", "SmallOffice", "Hospital")


@query("city_base", f"""WITH m AS (SELECT CASE l_linenumber {' '.join(f"WHEN {i + 1} THEN '{b}'" for i, b in enumerate(_BLD))} END AS building, CASE l_suppkey % 2 WHEN 0 THEN 'Seoul' ELSE 'Busan' END AS city, l_extendedprice * 1e7 AS energy_j FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus = 'O'),
 e AS (SELECT building, city, energy_j / 3600000.0 / {_AREA} AS eui FROM m), g AS (SELECT building, city, list_sort(list(eui)) AS v, count(*) AS n, quantile_cont(eui, 0.5) AS med FROM e GROUP BY 1, 2)
 SELECT building, city, {R('med', 1)} AS median, {R('v[greatest(0, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) - 1) + 1]', 1)} AS p10, {R('v[least(n - 1, CAST(floor(n * 0.9::DOUBLE) AS BIGINT)) + 1]', 1)} AS p90, n FROM g""")
def city_base(spark, sf):
    li = table(spark, sf, "lineitem")
    meta = li.select(
        F.element_at(F.array(*[F.lit(b) for b in _BLD]), F.col("l_linenumber")).alias("building"), F.when(F.col("l_suppkey") % 2 == 0, "Seoul").otherwise("Busan").alias("city"),
        F.when(F.col("l_returnflag") == "N", "E1").otherwise("E0").alias("ems"), (F.col("l_linestatus") == "O").alias("valid"), (F.col("l_extendedprice") * 1e7).alias("energy_j"))
    return T.build_city_base(T.simulated_eui(meta))


@query("hourly_annual", f"""WITH h AS (SELECT l_orderkey AS run_id, CASE l_orderkey % 2 WHEN 0 THEN 'office' ELSE 'school' END AS archetype, sum(l_quantity) AS kwh FROM lineitem GROUP BY 1, 2) SELECT run_id, archetype, {R("kwh / CASE archetype WHEN 'office' THEN 4982.0 ELSE 6871.0 END", 8)} AS eui FROM h WHERE kwh > 0""")
def hourly_annual(spark, sf):
    k = F.col("l_orderkey")
    h = table(spark, sf, "lineitem").select(k.alias("run_id"), F.when(k % 2 == 0, "office").otherwise("school").alias("archetype"), F.lit("2001_2010").alias("vintage"), F.lit("seoul").alias("city"), F.col("l_quantity").alias("kwh"))
    return rounded(T.annual_from_hourly(h).select("run_id", "archetype", "eui"), 8, "eui")
