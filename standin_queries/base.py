"""Registration and the stand-in tables, once as DataFrames and once as SQL common table expressions."""

from __future__ import annotations

from functools import wraps
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from parcelwatt.functions.rounding import half_up

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    """Plain result types: long integers, text dates and times."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return tidy(fn(spark, sf))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: half_up(F.col(c), digits) for c in columns})


def R(expr: str, digits: int) -> str:
    """SQL half-up rounding through a decimal."""
    return f"CAST(round(CAST({expr} AS DECIMAL(30,8)), {digits}) AS DOUBLE)"


def EVEN(expr: str, digits: int) -> str:
    """SQL banker's rounding through a decimal."""
    d, f = f"CAST({expr} AS DECIMAL(30,8))", 10**digits
    return f"CAST(CASE WHEN abs({d} * {f} - trunc({d} * {f})) = 0.5 THEN round({d} * {f} / 2) * 2.0 / {f} ELSE round({d}, {digits}) END AS DOUBLE)"


def TS(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def D(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


# ── meters ───────────────────────────────────────────────────────────────────

METER_OF = {"purchase": "electricity", "click": "gas", "view": "heat", "signup": "water"}


def reading_columns(df: DataFrame) -> DataFrame:
    meter = F.lit("other")
    for event, name in METER_OF.items():
        meter = F.when(F.col("event_type") == event, name).otherwise(meter)
    return df.select(F.col("user_id").alias("ts_id"), meter.alias("meter_type"), F.col("ts").alias("recorded_at"), "value")


def reading(spark, sf) -> DataFrame:
    return reading_columns(table(spark, sf, "events"))


READING = """reading AS (SELECT user_id AS ts_id, CASE event_type WHEN 'purchase' THEN 'electricity' WHEN 'click' THEN 'gas'
 WHEN 'view' THEN 'heat' WHEN 'signup' THEN 'water' ELSE 'other' END AS meter_type, ts AS recorded_at, value FROM events)"""


def monitored(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ts_id"), F.lpad(F.col("c_custkey").cast("string"), 19, "0").alias("pnu"), F.col("c_name").alias("alias"),
        F.col("c_mktsegment").alias("usage_type"), F.nullif(F.abs("c_acctbal"), F.lit(0.0)).alias("total_area"),
    )


MONITORED = """monitored AS (SELECT c_custkey AS ts_id, lpad(CAST(c_custkey AS VARCHAR), 19, '0') AS pnu, c_name AS alias,
 c_mktsegment AS usage_type, nullif(abs(c_acctbal), 0) AS total_area FROM customer)"""


def daily(spark, sf) -> DataFrame:
    """Long daily series: one per order priority and status."""
    o = table(spark, sf, "orders")
    meter = F.when(F.col("o_orderstatus") == "O", "electricity").when(F.col("o_orderstatus") == "F", "gas").otherwise("heat")
    return o.groupBy(F.col("o_orderpriority").alias("ts_id"), meter.alias("meter_type"), F.col("o_orderdate").cast("date").alias("day")).agg(
        F.sum("o_totalprice").alias("total_kwh"), F.count(F.lit(1)).cast("int").alias("ok_count"),
        F.greatest(F.lit(4) - F.count(F.lit(1)), F.lit(0)).cast("int").alias("missing_count"),
        F.least(F.count(F.lit(1)) * 25.0, F.lit(100.0)).alias("coverage_pct"),
    )


DAILY = """daily AS (SELECT o_orderpriority AS ts_id, CASE o_orderstatus WHEN 'O' THEN 'electricity' WHEN 'F' THEN 'gas' ELSE 'heat' END AS meter_type,
 CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS total_kwh, count(*) AS ok_count, greatest(4 - count(*), 0) AS missing_count,
 CAST(least(count(*) * 25.0, 100.0) AS DOUBLE) AS coverage_pct FROM orders GROUP BY 1, 2, 3)"""


def points_of_meters(spark, sf) -> DataFrame:
    """Meter points of the daily series with an area per priority."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("ts_id")).agg(
        F.lpad(F.min("o_custkey").cast("string"), 19, "0").alias("pnu"), (F.max("o_totalprice") / 10).alias("total_area")
    )


METER_POINTS = """meter_points AS (SELECT o_orderpriority AS ts_id, lpad(CAST(min(o_custkey) AS VARCHAR), 19, '0') AS pnu,
 max(o_totalprice) / 10 AS total_area FROM orders GROUP BY 1)"""


def series(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("ts_id"), F.col("o_orderdate").cast("date").alias("day")).agg(
        F.sum("o_totalprice").alias("y")
    )


SERIES = """series AS (SELECT o_orderpriority AS ts_id, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2)"""

FILLED = SERIES + """,
bounds AS (SELECT ts_id, min(day) AS a, max(day) AS b FROM series GROUP BY 1),
dense AS (SELECT c.ts_id, c.day, s.y FROM (SELECT ts_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM bounds) c
 LEFT JOIN series s USING (ts_id, day)),
marked AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN day END IGNORE NULLS) OVER p AS pd, last_value(y IGNORE NULLS) OVER p AS py,
 first_value(CASE WHEN y IS NOT NULL THEN day END IGNORE NULLS) OVER n AS nd, first_value(y IGNORE NULLS) OVER n AS ny FROM dense
 WINDOW p AS (PARTITION BY ts_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 n AS (PARTITION BY ts_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT ts_id, day, coalesce(y, py + (ny - py) * least(date_diff('day', pd, day), 7) / nullif(date_diff('day', pd, nd), 0), py, ny, 0) AS y FROM marked)"""

# ── footprints and register ──────────────────────────────────────────────────


def footprint(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    return table(spark, sf, "part").select(
        k.alias("gid"), F.concat(F.lpad(text(F.floor(k / 10)), 15, "0"), F.lpad(text(k % 10), 4, "0")).alias("pnu"), F.col("p_name").alias("bld_nm"),
        F.col("p_type").alias("usage_type"), F.col("p_size").alias("grnd_flr"), F.lit(None).cast("int").alias("ugrnd_flr"),
        F.when(F.col("p_size") % 3 == 0, 0.0).when(F.col("p_size") % 3 == 2, F.col("p_size") * 3.0).alias("height"),
        F.when(k % 5 == 0, "").otherwise(F.concat(text(F.col("p_size") + 1950), F.lit("0101"))).alias("approval_date"),
    )


FOOTPRINT = """footprint AS (SELECT p_partkey AS gid, lpad(CAST(p_partkey // 10 AS VARCHAR), 15, '0') || lpad(CAST(p_partkey % 10 AS VARCHAR), 4, '0') AS pnu,
 p_name AS bld_nm, p_type AS usage_type, p_size AS grnd_flr, CAST(NULL AS INTEGER) AS ugrnd_flr,
 CASE p_size % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 2 THEN p_size * 3.0::DOUBLE END AS height,
 CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_size + 1950 AS VARCHAR) || '0101' END AS approval_date FROM part)"""


def ledger(spark, sf) -> DataFrame:
    k, text = F.col("l_partkey"), lambda c: c.cast("string")
    line = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lpad(text(F.floor(k / 10)), 15, "0"), F.lpad(text(k % 10), 4, "0")).alias("pnu"),
        F.when(line > 2, F.concat(F.lit("B"), text(F.col("l_orderkey")))).alias("bld_nm"),
        F.when(F.col("l_returnflag") == "A", "업무시설").when(F.col("l_returnflag") == "R", "공동주택").alias("main_purps_nm"),
        F.when(line == 1, "철근콘크리트구조").when(line == 2, "일반철골구조").when(line == 3, "벽돌구조").when(line == 4, "목구조").alias("strct_nm"),
        F.col("l_quantity").cast("int").alias("grnd_flr_cnt"), line.alias("ugrnd_flr_cnt"),
        F.when(line == 1, 0.0).otherwise(F.col("l_quantity") * 3.5).alias("bld_ht"), (F.col("l_extendedprice") / 20).alias("tot_area"),
        (F.col("l_extendedprice") / 200).alias("bld_area"),
        F.when(F.col("l_discount") == 0, "").when(F.col("l_tax") == 0, "18500101").otherwise(F.date_format("l_shipdate", "yyyyMMdd")).alias("use_apr_day"),
        F.when(F.col("l_returnflag") == "R", "1등급").when((F.col("l_returnflag") == "A") & (line < 4), "1++").alias("enrgy_eff_rate"),
        (F.col("l_tax") * 100).alias("epi_score"),
    )


LEDGER = """ledger AS (SELECT lpad(CAST(l_partkey // 10 AS VARCHAR), 15, '0') || lpad(CAST(l_partkey % 10 AS VARCHAR), 4, '0') AS pnu,
 CASE WHEN l_linenumber > 2 THEN 'B' || l_orderkey END AS bld_nm, CASE l_returnflag WHEN 'A' THEN '업무시설' WHEN 'R' THEN '공동주택' END AS main_purps_nm,
 CASE l_linenumber WHEN 1 THEN '철근콘크리트구조' WHEN 2 THEN '일반철골구조' WHEN 3 THEN '벽돌구조' WHEN 4 THEN '목구조' END AS strct_nm,
 CAST(l_quantity AS INTEGER) AS grnd_flr_cnt, l_linenumber AS ugrnd_flr_cnt, CASE l_linenumber WHEN 1 THEN 0.0::DOUBLE ELSE l_quantity * 3.5::DOUBLE END AS bld_ht,
 l_extendedprice / 20 AS tot_area, l_extendedprice / 200 AS bld_area,
 CASE WHEN l_discount = 0 THEN '' WHEN l_tax = 0 THEN '18500101' ELSE strftime(l_shipdate, '%Y%m%d') END AS use_apr_day,
 CASE WHEN l_returnflag = 'R' THEN '1등급' WHEN l_returnflag = 'A' AND l_linenumber < 4 THEN '1++' END AS enrgy_eff_rate, l_tax * 100 AS epi_score FROM lineitem)"""

# ── buildings, results ───────────────────────────────────────────────────────

USE_OF = {"HOUSEHOLD": "공동주택", "MACHINERY": "공장", "FURNITURE": "판매시설", "BUILDING": "업무시설", "AUTOMOBILE": "교육연구시설"}
STRUCTURES = ("철근콘크리트구조", "일반철골구조", "벽돌구조", "목구조")
GRADES = ("1+++등급", "1++", "1+등급", "1등급", "2", "3등급", "A", "7")


def _pick(col, values, default=None):
    out = F.lit(default).cast("string")
    for i, v in enumerate(values):
        out = F.when(col == i, v).otherwise(out)
    return out


def building(spark, sf) -> DataFrame:
    k, text = F.col("c_custkey"), lambda c: c.cast("string")
    use = F.lit(None).cast("string")
    for seg, name in USE_OF.items():
        use = F.when(F.col("c_mktsegment") == seg, name).otherwise(use)
    cx, cy = 126.7 + 0.6 * ((k * 7919) % 10007) / 10007, 37.4 + 0.3 * ((k * 104729) % 10007) / 10007
    year = F.when(k % 17 != 0, 1960 + k % 65).cast("int")
    df = table(spark, sf, "customer").select(
        k.alias("gid"),
        F.concat(F.lit("11"), F.lpad(text(F.col("c_nationkey")), 3, "0"), F.lit("101001"), F.lpad(text(k % 10000), 4, "0"), F.lpad(text(F.floor(k / 10000)), 4, "0")).alias("pnu"),
        F.when(k % 7 != 0, F.col("c_name")).alias("building_name"), use.alias("usage_type"),
        _pick(k % 5, STRUCTURES).alias("structure_type"), (1 + k % 25).cast("int").alias("floors_above"), ((1 + k % 25) * 3.3).alias("height"),
        F.nullif(F.abs("c_acctbal"), F.lit(0.0)).alias("total_area"), (F.abs("c_acctbal") / 4).alias("building_area"), year.alias("built_year"),
        _pick(k % 12, GRADES).alias("energy_grade"), (F.col("c_acctbal") / 50).alias("epi_score"), cx.alias("cx"), cy.alias("cy"),
    )
    from parcelwatt.functions import classify

    return df.withColumns({
        "vintage_class": classify.vintage(F.col("built_year"), unknown="pre-1980"), "structure_class": classify.structure_class(F.col("structure_type")),
        "xmin": F.col("cx") - 0.0005, "xmax": F.col("cx") + 0.0005, "ymin": F.col("cy") - 0.0005, "ymax": F.col("cy") + 0.0005,
    })


def _case(expr, mapping, default="NULL"):
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in mapping) + f" ELSE {default} END"


BUILDING = f"""building0 AS (SELECT c_custkey AS gid,
 '11' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || '101001' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || lpad(CAST(c_custkey // 10000 AS VARCHAR), 4, '0') AS pnu,
 CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS building_name, {_case('c_mktsegment', [(f"'{k}'", v) for k, v in USE_OF.items()])} AS usage_type,
 {_case('c_custkey % 5', list(enumerate(STRUCTURES)))} AS structure_type, 1 + c_custkey % 25 AS floors_above, (1 + c_custkey % 25) * 3.3::DOUBLE AS height,
 nullif(abs(c_acctbal), 0) AS total_area, abs(c_acctbal) / 4 AS building_area, CASE WHEN c_custkey % 17 <> 0 THEN 1960 + c_custkey % 65 END AS built_year,
 {_case('c_custkey % 12', list(enumerate(GRADES)))} AS energy_grade, c_acctbal / 50 AS epi_score,
 126.7::DOUBLE + 0.6::DOUBLE * ((c_custkey * 7919) % 10007) / 10007 AS cx, 37.4::DOUBLE + 0.3::DOUBLE * ((c_custkey * 104729) % 10007) / 10007 AS cy FROM customer),
building AS (SELECT *, CASE WHEN built_year IS NULL OR built_year < 1980 THEN 'pre-1980' WHEN built_year <= 2000 THEN '1980-2000' WHEN built_year <= 2010 THEN '2001-2010' ELSE 'post-2010' END AS vintage_class,
 CASE WHEN structure_type LIKE '%철근콘크리트%' THEN 'RC' WHEN structure_type LIKE '%철골%' THEN 'steel' WHEN structure_type LIKE '%벽돌%' OR structure_type LIKE '%목%' THEN 'masonry' ELSE 'RC' END AS structure_class,
 cx - 0.0005::DOUBLE AS xmin, cx + 0.0005::DOUBLE AS xmax, cy - 0.0005::DOUBLE AS ymin, cy + 0.0005::DOUBLE AS ymax FROM building0)"""


def result(spark, sf) -> DataFrame:
    """All results of every building; the newest order is the current one."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders")
    newest = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()))
    tier = F.least(F.lit(4), F.substring("o_orderpriority", 1, 1).cast("int"))
    total = F.when(tier == 1, F.col("o_totalprice")).otherwise(F.col("o_totalprice") / 1000)
    rows = o.select(
        F.col("o_custkey").alias("gid"), half_up(total, 2).alias("total_energy"), tier.alias("data_tier"),
        _pick(tier - 1, ("tier_c_metered", "energy_grade", "xgboost_tier_b", "archetype")).alias("simulation_type"),
        F.year("o_orderdate").alias("reference_year"), (newest == 1).alias("is_current"),
        *[F.when(tier == 1, half_up(F.col("o_totalprice") * s, 2)).alias(n) for n, s in (("elec_kwh", 0.6), ("gas_kwh", 0.3), ("dh_kwh", 0.1))],
        half_up(F.col("o_totalprice") / 5000, 2).alias("co2_kg_m2"), half_up(F.col("o_totalprice") / 900, 1).alias("primary_energy_kwh_m2"),
    )
    return rows.join(building(spark, sf).select("gid", "pnu"), "gid").drop("gid")


RESULT = BUILDING + f""",
result0 AS (SELECT o_custkey AS gid, least(4, CAST(left(o_orderpriority, 1) AS INTEGER)) AS data_tier, o_totalprice, year(o_orderdate) AS reference_year,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_current FROM orders),
result AS (SELECT b.pnu, {R('CASE WHEN data_tier = 1 THEN o_totalprice ELSE o_totalprice / 1000 END', 2)} AS total_energy, data_tier,
 CASE data_tier WHEN 1 THEN 'tier_c_metered' WHEN 2 THEN 'energy_grade' WHEN 3 THEN 'xgboost_tier_b' ELSE 'archetype' END AS simulation_type, reference_year, is_current,
 CASE WHEN data_tier = 1 THEN {R('o_totalprice * 0.6::DOUBLE', 2)} END AS elec_kwh, CASE WHEN data_tier = 1 THEN {R('o_totalprice * 0.3::DOUBLE', 2)} END AS gas_kwh,
 CASE WHEN data_tier = 1 THEN {R('o_totalprice * 0.1::DOUBLE', 2)} END AS dh_kwh, {R('o_totalprice / 5000', 2)} AS co2_kg_m2, {R('o_totalprice / 900', 1)} AS primary_energy_kwh_m2
 FROM result0 JOIN building b USING (gid))"""

# Buildings with their current result and EUI.
CURRENT = RESULT + f""",
cur AS (SELECT b.*, r.total_energy, r.data_tier, r.simulation_type, r.co2_kg_m2, r.primary_energy_kwh_m2,
 CASE WHEN r.simulation_type = 'tier_c_metered' THEN {R('r.total_energy / nullif(b.total_area, 0)', 1)} ELSE r.total_energy END AS eui
 FROM building b LEFT JOIN (SELECT * FROM result WHERE is_current) r USING (pnu))"""


def batches(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Result rows keyed by customer: even orders as the stored table, odd ones as the batch."""
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("pnu"), F.col("o_totalprice").alias("total_energy"), F.least(F.lit(4), F.substring("o_orderpriority", 1, 1).cast("int")).alias("data_tier"),
        F.year("o_orderdate").alias("reference_year"), F.col("o_orderkey").alias("order_id"),
    )
    from parcelwatt.operators.join import distinct_on

    one = lambda df: distinct_on(df, ["pnu"], [F.col("order_id")])
    return one(o.filter(F.col("order_id") % 2 == 0)), one(o.filter(F.col("order_id") % 2 == 1))


BATCHES = """batch0 AS (SELECT o_custkey AS pnu, o_totalprice AS total_energy, least(4, CAST(left(o_orderpriority, 1) AS INTEGER)) AS data_tier, year(o_orderdate) AS reference_year, o_orderkey AS order_id FROM orders),
base AS (SELECT * FROM batch0 WHERE order_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY pnu ORDER BY order_id) = 1),
new AS (SELECT * FROM batch0 WHERE order_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY pnu ORDER BY order_id) = 1)"""

# ── points ───────────────────────────────────────────────────────────────────


def points(spark, sf) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), (126.9 + 0.05 * e[0].cast("double")).alias("lng"), (37.5 + 0.05 * e[1].cast("double")).alias("lat"), "label",
    )


POINTS = """points AS (SELECT vec_id AS id, 126.9::DOUBLE + 0.05::DOUBLE * embedding[1]::DOUBLE AS lng, 37.5::DOUBLE + 0.05::DOUBLE * embedding[2]::DOUBLE AS lat, label FROM embeddings)"""

EARTH = "6371008.8"


def HAVERSINE(a: str, b: str) -> str:
    return (f"(2 * {EARTH} * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) "
            f"* pow(sin(radians({b}.lng - {a}.lng) / 2), 2)))))")


def stations(spark, sf) -> DataFrame:
    """Mean point of every label, as target points."""
    return points(spark, sf).groupBy(F.col("label").cast("long").alias("id")).agg(half_up(F.avg("lng"), 6).alias("lng"), half_up(F.avg("lat"), 6).alias("lat"))


STATIONS = POINTS + f", stations AS (SELECT CAST(label AS BIGINT) AS id, {R('avg(lng)', 6)} AS lng, {R('avg(lat)', 6)} AS lat FROM points GROUP BY 1)"

RADIUS = 100.0

PAIRS = POINTS + f""",
pairs AS (SELECT a.id AS id_a, b.id AS id_b, {HAVERSINE('a', 'b')} AS distance_m FROM points a JOIN points b ON a.id < b.id AND abs(a.lat - b.lat) < 0.002 WHERE {HAVERSINE('a', 'b')} <= {RADIUS})"""

CLASS = "CASE label % 3 WHEN 0 THEN 'RC' WHEN 1 THEN 'steel' ELSE 'masonry' END"


def attrs(spark, sf) -> DataFrame:
    return points(spark, sf).select("id", _pick(F.col("label") % 3, ("RC", "steel", "masonry")).alias("structure_class"))


EDGES = PAIRS + f""",
attrs AS (SELECT id, {CLASS} AS structure_class FROM points),
edges AS (SELECT source_pnu, target_pnu, distance_m, greatest(0, (1.0 - distance_m / {RADIUS}) * CASE a.structure_class WHEN 'masonry' THEN 1.4 WHEN 'steel' THEN 1.0 ELSE 0.8 END) AS spread_weight
 FROM (SELECT id_a AS source_pnu, id_b AS target_pnu, distance_m FROM pairs UNION ALL SELECT id_b, id_a, distance_m FROM pairs) p JOIN attrs a ON a.id = p.source_pnu)"""


def edges(spark, sf) -> DataFrame:
    from parcelwatt.operators.graph import build_adjacency

    return build_adjacency(points(spark, sf).select("id", "lng", "lat"), attrs(spark, sf), RADIUS)
