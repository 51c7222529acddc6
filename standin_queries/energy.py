"""Energy estimation, carbon, retrofit and result merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwatt import dims
from parcelwatt.dims import values as V
from parcelwatt.functions import energy as E
from parcelwatt.functions.classify import USAGE_KEYS
from parcelwatt.operators import carbon, energy, retrofit, tables, upsert
from parcelwatt.plans import table_functions
from standin_queries.base import (
    BATCHES, BUILDING, R, RESULT, batches, building, query, result, rounded, table,
)

YEAR = 2026


def _values(name, columns, rows):
    def lit(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)

    return f"{name}({', '.join(columns)}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


_ARCH_ROWS = dims._rows("archetypes.csv")
_ARCH_COLS = list(_ARCH_ROWS[0])
ARCH = _values("arch", ["usage", "vintage", "structure", *_ARCH_COLS[3:]], [[r[c] if i < 3 else float(r[c]) for i, c in enumerate(_ARCH_COLS)] for r in _ARCH_ROWS])
ENDUSE = _values("enduse", ["usage", *V.END_USES], [(k, *map(float, v)) for k, v in V.END_USE_RATIOS.items()])

_KEY = "CASE trim(usage_type) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in USAGE_KEYS.items()) + " ELSE lower(trim(usage_type)) END"
_DEG = f"CASE WHEN built_year IS NULL THEN 2.0 WHEN {YEAR} - built_year <= 10 THEN 1.0 WHEN {YEAR} - built_year <= 20 THEN 1.3 WHEN {YEAR} - built_year <= 30 THEN 1.7 ELSE 2.0 END::DOUBLE"
_VINT = "CASE WHEN built_year IS NULL THEN '1980-2000' WHEN built_year < 1980 THEN 'pre-1980' WHEN built_year <= 2000 THEN '1980-2000' WHEN built_year <= 2010 THEN '2001-2010' ELSE 'post-2010' END"

_PARAMS = {k: f"coalesce(x.{k}, rc.{k}, ap.{k}, {v}::DOUBLE)" for k, v in V.DEFAULT_ARCHETYPE.items()}
MATCHED = f"""{ARCH}, {ENDUSE}, {BUILDING}, keyed AS (SELECT *, {_KEY} AS usage_key, {_VINT} AS mv, {_DEG} AS deg FROM building),
matched AS (SELECT k.gid, k.pnu, k.usage_type, k.usage_key, k.mv, k.deg, k.built_year, k.floors_above, k.structure_class, {', '.join(f'{v} AS {k}' for k, v in _PARAMS.items())}, x.wall_uvalue AS wall_base
 FROM keyed k LEFT JOIN arch x ON x.usage = k.usage_key AND x.vintage = k.mv AND x.structure = k.structure_class
 LEFT JOIN arch rc ON rc.usage = k.usage_key AND rc.vintage = k.mv AND rc.structure = 'RC' LEFT JOIN arch ap ON ap.usage = 'apartment' AND ap.vintage = k.mv AND ap.structure = 'RC')"""


@query("archetype_match", f"""WITH {MATCHED} SELECT gid, usage_key, mv AS match_vintage, {R('wall_uvalue * deg', 4)} AS wall_uvalue, {R('roof_uvalue * deg', 4)} AS roof_uvalue, {R('window_uvalue * deg', 4)} AS window_uvalue,
 wwr, ref_heating, ref_cooling, ref_total FROM matched""")
def archetype_match(spark, sf):
    df = energy.match_archetype(building(spark, sf), YEAR)
    df = df.select("gid", "usage_key", "match_vintage", "wall_uvalue", "roof_uvalue", "window_uvalue", "wwr", "ref_heating", "ref_cooling", "ref_total")
    return rounded(df, 4, "wall_uvalue", "roof_uvalue", "window_uvalue")


_SC = {"heating": "deg_ratio", "cooling": "(1.0 + (deg_ratio - 1.0) * 0.3::DOUBLE)"}
_PART = {u: f"ref_total * coalesce(e.{u}, {d}::DOUBLE)" + (f" * {_SC[u]}" if u in _SC else "") for u, d in zip(V.END_USES, V.DEFAULT_END_USE)}
ESTIMATED = MATCHED + f""",
parts AS (SELECT m.*, {', '.join(f'{p} AS p_{u}' for u, p in _PART.items())} FROM (SELECT *, CASE WHEN wall_base > 0 THEN wall_uvalue * deg / wall_base ELSE 1.0 END AS deg_ratio FROM matched) m LEFT JOIN enduse e ON e.usage = usage_key),
estimated AS (SELECT *, {', '.join(f"{R(f'p_{u}', 2)} AS {u}" for u in V.END_USES)}, {R(' + '.join(f'p_{u}' for u in V.END_USES), 2)} AS total_energy FROM parts)"""


@query("estimate_energy", f"WITH {ESTIMATED} SELECT gid, {', '.join(V.END_USES)}, total_energy FROM estimated")
def estimate_energy(spark, sf):
    return energy.estimate(building(spark, sf), YEAR).select("gid", *V.END_USES, "total_energy")


def lookup(spark, sf):
    """A simulation lookup built from the line items: archetype by line number, vintage by quantity, city by supplier."""
    return tables.build_eui_lookup(samples(spark, sf))


ARCHES = ("apartment_highrise", "apartment_midrise", "office", "school", "small_office", "warehouse", "retail")
VINTS = ("pre1990", "1991_2000", "2001_2010", "2011_2017", "2018_plus")
CITIES = ("seoul", "busan", "daegu")


def samples(spark, sf):
    at = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    return table(spark, sf, "lineitem").select(
        at(ARCHES, (F.col("l_linenumber") - 1) % 7).alias("archetype"), at(VINTS, F.col("l_quantity").cast("int") % 5).alias("vintage"), at(CITIES, F.col("l_suppkey") % 3).alias("city"),
        F.format_string("run_%012d_%d_%d", "l_orderkey", "l_linenumber", "l_partkey").alias("run_id"), (F.col("l_extendedprice") / 100).alias("eui"),
    )


def _at(names, expr):
    return "CASE " + expr + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


SAMPLES = f"""samples AS (SELECT {_at(ARCHES, '(l_linenumber - 1) % 7')} AS archetype, {_at(VINTS, 'CAST(l_quantity AS INTEGER) % 5')} AS vintage, {_at(CITIES, 'l_suppkey % 3')} AS city,
 'run_' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '_' || l_linenumber || '_' || l_partkey AS run_id, l_extendedprice / 100 AS eui FROM lineitem)"""
LOOKUP = SAMPLES + f""",
lookup AS (SELECT archetype, vintage, city, {R('quantile_cont(v, 0.5)', 1)} AS median, {R('quantile_cont(v, 0.1)', 1)} AS p10, {R('quantile_cont(v, 0.9)', 1)} AS p90, count(*) AS n
 FROM (SELECT *, {R('eui', 2)} AS v FROM samples WHERE eui > 5 AND eui < 5000) GROUP BY 1, 2, 3)"""

_V5 = "CASE WHEN built_year IS NULL THEN '2001_2010' WHEN built_year < 1990 THEN 'pre1990' WHEN built_year < 2001 THEN '1991_2000' WHEN built_year < 2011 THEN '2001_2010' WHEN built_year < 2018 THEN '2011_2017' ELSE '2018_plus' END"
_SIMARCH = ("CASE usage_key WHEN 'apartment' THEN CASE WHEN floors_above <= 5 THEN 'apartment_midrise' ELSE 'apartment_highrise' END "
            + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.SIMULATED_ARCHETYPE.items() if k != "apartment") + " ELSE 'small_office' END")
_CF = "CASE usage_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.CORRECTION_FACTORS.items()) + " ELSE 1.0 END::DOUBLE"


@query("estimate_calibrated", f"""WITH {ESTIMATED}, {LOOKUP}, j AS (SELECT e.*, {R(f'l.median * {_CF}', 1)} AS eui FROM (SELECT *, {_V5} AS v5, {_SIMARCH} AS sa FROM estimated) e LEFT JOIN lookup l ON l.archetype = sa AND l.vintage = v5 AND l.city = 'seoul')
 SELECT gid, coalesce(eui, j.total_energy) AS total_energy, CASE WHEN eui IS NULL THEN j.heating ELSE {R('eui * coalesce(u.heating, 0.35)', 2)} END AS heating,
 CASE WHEN eui IS NULL THEN j.lighting ELSE {R('eui * coalesce(u.lighting, 0.16)', 2)} END AS lighting, CASE WHEN eui IS NULL THEN 'archetype_fallback' ELSE 'korean_bb_calibrated' END AS simulation_type FROM j LEFT JOIN enduse u ON u.usage = usage_key""")
def estimate_calibrated(spark, sf):
    df = energy.estimate_calibrated(building(spark, sf), lookup(spark, sf), YEAR)
    return df.select("gid", "total_energy", "heating", "lighting", "simulation_type")


_MED = dims._rows("city_medians.csv")
_MEDIANS = _values("medians", ["building", "city", "median"], [(r["building"], c, float(v)) for r in _MED for c, v in r.items() if c != "building"])
_SIM = _values("simb", ["archetype", "building"], list(V.ARCHETYPE_BUILDING.items()))


@query("city_ratio", f"""WITH {_MEDIANS}, {_SIM}, {BUILDING}, ratio AS (SELECT archetype, m.city, {R('m.median / s.median', 4)} AS ratio FROM simb JOIN medians m USING (building) JOIN medians s ON s.building = m.building AND s.city = 'seoul'),
 b AS (SELECT gid, CASE gid % 4 WHEN 0 THEN 'daejeon' WHEN 1 THEN 'seoul' WHEN 2 THEN 'jeju' ELSE 'incheon' END AS city, CASE usage_type WHEN '업무시설' THEN 'office' WHEN '공장' THEN 'warehouse' ELSE 'school' END AS archetype FROM building)
 SELECT gid, archetype, city, ratio FROM b JOIN ratio USING (archetype, city)""")
def city_ratio(spark, sf):
    g = F.col("gid") % 4
    b = building(spark, sf).select(
        "gid", F.when(g == 0, "daejeon").when(g == 1, "seoul").when(g == 2, "jeju").otherwise("incheon").alias("city"),
        F.when(F.col("usage_type") == "업무시설", "office").when(F.col("usage_type") == "공장", "warehouse").otherwise("school").alias("archetype"))
    return b.join(F.broadcast(energy.city_ratio(spark)), ["archetype", "city"]).select("gid", "archetype", "city", "ratio")


_GRADE = "CASE trim(energy_grade) " + " ".join(f"WHEN '{g}' THEN {V.GRADE_EUI[c]}" for g, c in [*((g, g) for g in V.GRADE_EUI), *V.GRADE_ALIASES.items()]) + " END::DOUBLE"


@query("grade_eui", f"""WITH {BUILDING} SELECT gid, energy_grade, {_GRADE} AS eui FROM building""")
def grade_eui(spark, sf):
    return building(spark, sf).select("gid", "energy_grade", E.grade_eui(F.col("energy_grade")).alias("eui"))


def _word(i):
    d = V.DEFAULT_END_USE[i]
    return "CASE " + " ".join(f"WHEN usage_type LIKE '%{w}%' THEN {s[i]}" for w, s in V.END_USE_BY_WORD) + f" ELSE {d} END::DOUBLE"


@query("from_grade", f"""WITH {BUILDING}, g AS (SELECT pnu, {_GRADE} AS eui, usage_type FROM building) SELECT pnu, eui AS total_energy, {', '.join(f"{R(f'eui * {_word(i)}', 2)} AS {u}" for i, u in enumerate(V.END_USES))} FROM g WHERE eui IS NOT NULL""")
def from_grade(spark, sf):
    return energy.from_grade(building(spark, sf)).select("pnu", "total_energy", *V.END_USES)


@query("degradation", f"""WITH {BUILDING} SELECT gid, {R(f'0.47::DOUBLE * {_DEG}', 4)} AS uvalue FROM building""")
def degradation(spark, sf):
    return rounded(building(spark, sf).select("gid", (F.lit(0.47) * E.degradation(F.col("built_year"), YEAR)).alias("uvalue")), 4, "uvalue")


_MIX = _values("mix", ["usage_type", "e", "g", "d"], [(k, *map(float, v)) for k, v in V.FUEL_MIX.items()])
_C, _P = V.CO2_FACTORS, V.PRIMARY_FACTORS


def _sum(f, names):
    return " + ".join(f"{n} * {x}::DOUBLE" for n, x in zip(names, f))


@query("carbon", f"""WITH {RESULT}, {_MIX}, j AS (SELECT r.pnu, r.data_tier, r.simulation_type = 'tier_c_metered' AS metered, nullif(b.total_area, 0) AS area, total_energy * coalesce(m.e, 0.65) AS e2, total_energy * coalesce(m.g, 0.35) AS g2, total_energy * coalesce(m.d, 0) AS d2,
  greatest(coalesce(elec_kwh, 0), 0) AS e1, greatest(coalesce(gas_kwh, 0), 0) AS g1, greatest(coalesce(dh_kwh, 0), 0) AS d1 FROM result r JOIN building b USING (pnu) LEFT JOIN mix m ON m.usage_type = b.usage_type WHERE r.is_current AND total_energy > 0)
 SELECT pnu, data_tier, CASE WHEN metered THEN {R(_sum(_C, ('e1', 'g1', 'd1')), 1)} ELSE {R(f"({_sum(_C, ('e2', 'g2', 'd2'))}) * area", 1)} END AS co2_kg_yr,
 CASE WHEN metered THEN {R(f"({_sum(_C, ('e1', 'g1', 'd1'))}) / area", 2)} ELSE {R(_sum(_C, ('e2', 'g2', 'd2')), 2)} END AS co2_kg_m2,
 CASE WHEN metered THEN {R(_sum(_P, ('e1', 'g1', 'd1')), 1)} ELSE {R(f"({_sum(_P, ('e2', 'g2', 'd2'))}) * area", 1)} END AS primary_energy_kwh_yr,
 CASE WHEN metered THEN {R(f"({_sum(_P, ('e1', 'g1', 'd1'))}) / area", 1)} ELSE {R(_sum(_P, ('e2', 'g2', 'd2')), 1)} END AS primary_energy_kwh_m2 FROM j""")
def carbon_apply(spark, sf):
    df = carbon.apply(result(spark, sf).filter("is_current"), building(spark, sf))
    return df.select("pnu", "data_tier", *carbon.COLUMNS)


@query("sql_carbon_update", f"""WITH {RESULT}, {_MIX}, j AS (SELECT r.pnu, r.simulation_type, r.reference_year, total_energy, r.simulation_type = 'tier_c_metered' AS metered, nullif(b.total_area, 0) AS area, total_energy * coalesce(m.e, 0.65) AS e2, total_energy * coalesce(m.g, 0.35) AS g2, total_energy * coalesce(m.d, 0) AS d2,
  greatest(coalesce(elec_kwh, 0), 0) AS e1, greatest(coalesce(gas_kwh, 0), 0) AS g1, greatest(coalesce(dh_kwh, 0), 0) AS d1 FROM result r JOIN building b USING (pnu) LEFT JOIN mix m ON m.usage_type = b.usage_type WHERE r.is_current AND r.reference_year = 1998 AND total_energy > 0)
 SELECT pnu, simulation_type, CAST(reference_year AS BIGINT) AS reference_year, total_energy, CASE WHEN metered THEN {R(_sum(_C, ('e1', 'g1', 'd1')), 1)} ELSE {R(f"({_sum(_C, ('e2', 'g2', 'd2'))}) * area", 1)} END AS co2_kg_yr,
 CASE WHEN metered THEN {R(f"({_sum(_C, ('e1', 'g1', 'd1'))}) / area", 2)} ELSE {R(_sum(_C, ('e2', 'g2', 'd2')), 2)} END AS co2_kg_m2,
 CASE WHEN metered THEN {R(_sum(_P, ('e1', 'g1', 'd1')), 1)} ELSE {R(f"({_sum(_P, ('e2', 'g2', 'd2'))}) * area", 1)} END AS primary_energy_kwh_yr,
 CASE WHEN metered THEN {R(f"({_sum(_P, ('e1', 'g1', 'd1'))}) / area", 1)} ELSE {R(_sum(_P, ('e2', 'g2', 'd2')), 1)} END AS primary_energy_kwh_m2 FROM j""")
def sql_carbon_update(spark, sf):
    """The table function called from SQL text for the results of one year."""
    name = table_functions.register_carbon_update(spark, result(spark, sf), building(spark, sf), "carbon_of_year")
    return spark.sql(f"SELECT * FROM {name}(1998)")


@query("carbon_totals", f"""WITH {BUILDING}, {_MIX} SELECT gid, {R(_sum(_C, [f'total_area * 120 * coalesce({c}, {d})' for c, d in (('e', 0.65), ('g', 0.35), ('d', 0.0))]), 1)} AS co2_kg_yr,
 {R('(' + _sum(_P, [f'total_area * 120 * coalesce({c}, {d})' for c, d in (('e', 0.65), ('g', 0.35), ('d', 0.0))]) + ') / total_area', 1)} AS primary_energy_kwh_m2 FROM building LEFT JOIN mix USING (usage_type) WHERE total_area > 0""")
def carbon_totals(spark, sf):
    none = F.lit(None).cast("double")
    b = building(spark, sf).filter("total_area > 0").select("gid", "usage_type", (F.col("total_area") * 120).alias("total_energy_kwh"), F.col("total_area").alias("area_m2"), none.alias("elec_kwh"), none.alias("gas_kwh"), none.alias("dh_kwh"))
    return carbon.of_totals(b).select("gid", "co2_kg_yr", "primary_energy_kwh_m2")


def retrofit_input(spark, sf):
    return building(spark, sf).select(
        "pnu", (F.abs("epi_score") + 50).alias("eui_kwh_m2"), (F.abs("epi_score") / 4).alias("co2_kg_m2"), F.col("total_area").alias("total_area_m2"), "vintage_class", "usage_type")


def _saving(table_):
    return "CASE vintage_class " + " ".join(f"WHEN '{v}' THEN {x}" for v, x in zip(V.VINTAGES, table_)) + f" ELSE {table_[-1]} END::DOUBLE"


_H, _CO, _L = V.RETROFIT_SHARES
_PRICE = "CASE usage_type " + " ".join(f"WHEN '{k}' THEN {s}" for k, s in V.PRICE_ELEC_SHARE.items()) + f" ELSE {V.DEFAULT_PRICE_ELEC_SHARE} END::DOUBLE"
_CTE = f"""r0 AS (SELECT pnu, abs(epi_score) + 50 AS eui, abs(epi_score) / 4 AS co2, total_area AS area, vintage_class, usage_type, {_PRICE} * 120 + (1 - {_PRICE}) * 80 AS price, abs(epi_score) + 50 AS rem, 0::DOUBLE AS total FROM building)"""
for _i, (_id, _label, _cost, _heat, _cool, _light) in enumerate(V.RETROFIT, 1):
    _s = f"eui * {_L} * {_saving(_light)}" if _light else f"rem * ({_H}::DOUBLE * {_saving(_heat)} + {_CO}::DOUBLE * {_saving(_cool)})"
    _CTE += f", r{_i} AS (SELECT * REPLACE (greatest(rem - ({_s}), 0) AS rem, total + ({_s}) AS total), {_s} AS s_{_id} FROM r{_i - 1})"
_N = len(V.RETROFIT)
_COST = sum(m[2] for m in V.RETROFIT)


@query("retrofit_project", f"""WITH {BUILDING}, {_CTE}, t AS (SELECT *, CASE WHEN area <> 0 THEN CAST(trunc({_COST} * area) AS BIGINT) ELSE 0 END AS cost, CASE WHEN area <> 0 THEN CAST(trunc(total * area * price) AS BIGINT) ELSE 0 END AS saved FROM r{_N})
 SELECT pnu, {R('greatest(eui - total, 0)', 1)} AS eui_after, {R('total', 2)} AS eui_saving_kwh_m2, {R('total / eui', 4)} AS saving_pct, {R('co2 * (greatest(eui - total, 0) / eui)', 2)} AS co2_after_kg_m2,
 cost AS cost_total_krw, saved AS annual_saving_krw, CASE WHEN saved > 0 THEN {R('cost / saved::DOUBLE', 1)} END AS payback_years, {', '.join(f"{R('s_' + m[0], 2)} AS {m[0]}" for m in V.RETROFIT)} FROM t""")
def retrofit_project(spark, sf):
    df = retrofit.project(retrofit_input(spark, sf))
    one = lambda mid: F.filter("measures", lambda m: m["id"] == mid)[0]["eui_saving_kwh_m2"].alias(mid)
    return df.select("pnu", "eui_after", "eui_saving_kwh_m2", "saving_pct", "co2_after_kg_m2", "cost_total_krw", "annual_saving_krw", "payback_years", *[one(m[0]) for m in V.RETROFIT])


@query("annualise_monthly", f"""WITH m AS (SELECT o_custkey AS pnu, strftime(o_orderdate, '%m') AS ym, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS kwh FROM orders), g AS (SELECT pnu, ym, sum(kwh) AS kwh FROM m GROUP BY 1, 2 HAVING sum(kwh) > 0)
 SELECT pnu, count(*) AS months, {R('sum(kwh) * 12 / count(*)', 2)} AS annual_kwh FROM g GROUP BY 1 HAVING max(ym) = (SELECT max(ym) FROM m)""")
def annualise_monthly(spark, sf):
    o = table(spark, sf, "orders")
    m = o.select(F.col("o_custkey").alias("pnu"), F.date_format("o_orderdate", "MM").alias("ym"), F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice")).alias("kwh"))
    return rounded(energy.annualise_monthly(m).select("pnu", "months", "annual_kwh"), 2, "annual_kwh")


@query("primary_to_final", f"""WITH {BUILDING} SELECT gid, {R('abs(epi_score) * CASE ' + _KEY + ' ' + ' '.join(f"WHEN '{k}' THEN {v}" for k, v in V.PRIMARY_TO_FINAL.items()) + ' ELSE 0.5 END', 4)} AS eui FROM building""")
def primary_to_final(spark, sf):
    from parcelwatt.functions.classify import usage_key

    b = building(spark, sf)
    return rounded(b.select("gid", E.primary_to_final(F.abs("epi_score"), usage_key(F.col("usage_type"))).alias("eui")), 4, "eui")


@query("upsert_tier", f"""WITH {BATCHES} SELECT pnu, order_id, total_energy, data_tier FROM (SELECT *, 0 AS isnew FROM base UNION ALL SELECT *, 1 FROM new) QUALIFY row_number() OVER (PARTITION BY pnu ORDER BY data_tier, isnew DESC) = 1""")
def upsert_tier(spark, sf):
    base, new = batches(spark, sf)
    return upsert.by_tier(base, new).select("pnu", "order_id", "total_energy", "data_tier")


@query("upsert_year", f"""WITH {BATCHES}, j AS (SELECT coalesce(b.pnu, n.pnu) AS pnu, b.order_id AS oid, n.order_id AS nid, CASE WHEN b.pnu IS NULL THEN 'inserted' WHEN n.pnu IS NOT NULL AND (b.data_tier > n.data_tier OR (b.data_tier = n.data_tier AND b.reference_year < n.reference_year)) THEN 'updated' ELSE 'kept' END AS action
 FROM base b FULL JOIN new n ON b.pnu = n.pnu) SELECT pnu, CASE WHEN action = 'kept' THEN oid ELSE nid END AS order_id, action FROM j""")
def upsert_year(spark, sf):
    base, new = batches(spark, sf)
    return upsert.by_tier_and_year(base, new).select("pnu", "order_id", "action")


@query("fill_from_predictions", f"""WITH {BATCHES} SELECT pnu, {R('avg(o_totalprice)', 1)} AS total_energy, 3 AS data_tier, 'xgboost_tier_b' AS simulation_type FROM (SELECT o_custkey AS pnu, o_totalprice FROM orders) o
 WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.pnu = o.pnu AND b.data_tier < 4) GROUP BY 1""")
def fill_from_predictions(spark, sf):
    base, _ = batches(spark, sf)
    pred = table(spark, sf, "orders").select(F.col("o_custkey").alias("pnu"), F.col("o_totalprice").alias("predicted_eui"))
    return upsert.fill_from_predictions(base.withColumn("is_current", F.col("data_tier") < 4), pred).drop("is_current")


@query("backfill_actuals", f"""WITH {BATCHES}, p AS (SELECT o_custkey AS pnu, o_orderkey, o_totalprice AS predicted_eui FROM orders) SELECT p.pnu, o_orderkey, {R('b.total_energy', 2)} AS actual_eui, {R('abs(predicted_eui - b.total_energy)', 2)} AS error_abs,
 {R('abs(predicted_eui - b.total_energy) / b.total_energy * 100', 4)} AS error_pct FROM p LEFT JOIN base b ON b.pnu = p.pnu AND b.data_tier = 1""")
def backfill_actuals(spark, sf):
    base, _ = batches(spark, sf)
    none = F.lit(None).cast("double")
    p = table(spark, sf, "orders").select(F.col("o_custkey").alias("pnu"), "o_orderkey", F.col("o_totalprice").alias("predicted_eui"), none.alias("actual_eui"), none.alias("error_abs"), none.alias("error_pct"))
    df = upsert.backfill_actuals(p, base.withColumn("is_current", F.lit(True))).select("pnu", "o_orderkey", "actual_eui", "error_abs", "error_pct")
    return rounded(rounded(df, 2, "actual_eui", "error_abs"), 4, "error_pct")
