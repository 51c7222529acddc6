"""Meter time series."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from parcelwatt.functions.energy import to_kwh, total_kwh
from parcelwatt.operators import fire, query as Q, quality, timeseries as ts, upsert
from parcelwatt.plans import table_functions
from standin_queries.base import (
    D, DAILY, FILLED, METER_POINTS, MONITORED, READING, SERIES, R, TS, daily, monitored, points_of_meters, query, reading, rounded, series, table,
)

# Scores exactly at the limit of 2 are left out: the last bit of a mean differs between engines.
Z = 2.000001

# The readings end on this day; the daily series ends with the orders.
AS_OF = datetime(2024, 1, 31)
DAILY_AS_OF = date(2001, 8, 2)

ANOMALY = f"""scored AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS n FROM reading
 WINDOW w AS (PARTITION BY ts_id, meter_type ORDER BY recorded_at RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 1 SECOND PRECEDING)),
anomaly AS (SELECT ts_id, meter_type, recorded_at AS detected_at, m AS window_mean, s AS window_std, value AS offending_value, abs(value - m) / s AS z_score
 FROM scored WHERE n >= 2 AND s > 0 AND abs(value - m) / s > 2.000001)"""


@query("anomaly_z24", f"""WITH {READING}, {ANOMALY} SELECT ts_id, meter_type, {TS('detected_at')} AS detected_at, {R('window_mean', 4)} AS window_mean,
 {R('window_std', 4)} AS window_std, offending_value, {R('z_score', 3)} AS z_score FROM anomaly""")
def anomaly_z24(spark, sf):
    found = ts.anomalies(reading(spark, sf), min_count=2, z=Z)
    return rounded(rounded(found, 4, "window_mean", "window_std"), 3, "z_score")


def _resample(step, name):
    sql = f"""WITH {READING} SELECT ts_id, meter_type, {TS(f"CAST(date_trunc('{step}', recorded_at) AS TIMESTAMP)")} AS ts, {R('sum(value)', 4)} AS value
 FROM reading WHERE recorded_at BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-28 12:00:00' GROUP BY 1, 2, 3"""

    @query(f"resample_{name}", sql)
    def run(spark, sf):
        df = ts.resample(reading(spark, sf), name, datetime(2024, 1, 3), datetime(2024, 1, 28, 12))
        return df.select("ts_id", "meter_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")

    return run


resample_hourly, resample_daily, resample_weekly = (_resample(s, n) for s, n in (("hour", "hourly"), ("day", "daily"), ("week", "weekly")))


@query("resample_raw", f"""WITH {READING} SELECT ts_id, meter_type, {TS('recorded_at')} AS ts, value FROM reading WHERE recorded_at >= TIMESTAMP '2024-01-20 00:00:00'""")
def resample_raw(spark, sf):
    return ts.resample(reading(spark, sf), "raw", start=datetime(2024, 1, 20)).drop("unit")


@query("daily_by_meter", f"""WITH {READING} SELECT ts_id, meter_type, {D('CAST(recorded_at AS DATE)')} AS day, {R('sum(value)', 2)} AS value
 FROM reading WHERE recorded_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1, 2, CAST(recorded_at AS DATE)""")
def daily_by_meter(spark, sf):
    nested = ts.daily_by_meter(reading(spark, sf), AS_OF)
    flat = nested.select("ts_id", F.explode("daily").alias("meter_type", "days")).select("ts_id", "meter_type", F.explode("days").alias("d"))
    return flat.select("ts_id", "meter_type", F.col("d.day").alias("day"), F.col("d.value").alias("value"))


@query("eui_365", f"""WITH {READING}, {MONITORED} SELECT m.ts_id, m.alias, {R("sum(r.value) FILTER (WHERE r.meter_type IN ('electricity','gas')) / any_value(m.total_area)", 1)} AS eui_kwh_m2_1yr,
 {TS('min(r.recorded_at)')} AS data_start, {TS('max(r.recorded_at)')} AS data_end, count(DISTINCT r.meter_type) AS meter_count
 FROM monitored m LEFT JOIN reading r ON m.ts_id = r.ts_id AND r.recorded_at >= TIMESTAMP '2024-01-31' - INTERVAL 365 DAYS GROUP BY 1, 2""")
def eui_365(spark, sf):
    return ts.eui_summary(monitored(spark, sf), reading(spark, sf), AS_OF).select("ts_id", "alias", "eui_kwh_m2_1yr", "data_start", "data_end", "meter_count")


@query("left_on_condition", f"""WITH {READING}, {MONITORED} SELECT m.ts_id, count(r.value) AS n, {R('sum(r.value)', 4)} AS total
 FROM monitored m LEFT JOIN reading r ON m.ts_id = r.ts_id AND r.recorded_at >= TIMESTAMP '2024-01-24' GROUP BY 1""")
def left_on_condition(spark, sf):
    recent = ts.recent(reading(spark, sf), AS_OF, 7).groupBy("ts_id").agg(F.count("value").alias("n"), F.sum("value").alias("total"))
    df = monitored(spark, sf).select("ts_id").join(recent, "ts_id", "left")
    return rounded(df.withColumn("n", F.coalesce("n", F.lit(0))), 4, "total")


@query("compare_ids", f"""WITH {READING}, {MONITORED}, s AS (SELECT ts_id, sum(value) AS kwh FROM reading WHERE meter_type IN ('electricity','gas')
 AND recorded_at >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAYS AND recorded_at <= TIMESTAMP '2024-01-31' GROUP BY 1)
 SELECT m.ts_id, CASE WHEN kwh IS NOT NULL THEN alias END AS alias, {R('nullif(kwh / total_area, 0)', 2)} AS value, 'kWh/m²' AS unit FROM monitored m LEFT JOIN s USING (ts_id)""")
def compare_ids(spark, sf):
    m = monitored(spark, sf)
    return ts.compare(m, reading(spark, sf), m, quality.period_days("14d"), "eui", AS_OF).select("ts_id", "alias", "value", "unit")


@query("daily_rollup", f"""WITH {READING} SELECT ts_id, meter_type, {D('CAST(recorded_at AS DATE)')} AS day, {R('sum(value)', 4)} AS total_kwh, count(value) AS ok_count,
 greatest(24 - count(value), 0) AS missing_count, {R('least(count(value) / 24.0::DOUBLE, 1.0) * 100', 2)} AS coverage_pct FROM reading GROUP BY 1, 2, CAST(recorded_at AS DATE)""")
def daily_rollup(spark, sf):
    return rounded(ts.daily_rollup(reading(spark, sf), expected=24), 4, "total_kwh")


@query("annual_metered", f"""WITH {DAILY}, {METER_POINTS} SELECT pnu, ts_id, {R("sum(CASE WHEN meter_type='electricity' THEN total_kwh ELSE 0 END)", 2)} AS elec_kwh,
 {R("sum(CASE WHEN meter_type='gas' THEN total_kwh ELSE 0 END)", 2)} AS gas_kwh, {R("sum(CASE WHEN meter_type='heat' THEN total_kwh ELSE 0 END)", 2)} AS dh_kwh,
 {R("sum(CASE WHEN meter_type<>'water' THEN total_kwh ELSE 0 END)", 2)} AS total_kwh, count(DISTINCT meter_type) AS meter_count, {R('avg(coverage_pct)', 4)} AS avg_coverage
 FROM daily JOIN meter_points USING (ts_id) WHERE year(day) = 1998 AND coverage_pct >= 50 GROUP BY 1, 2 HAVING sum(CASE WHEN meter_type<>'water' THEN total_kwh ELSE 0 END) > 0""")
def annual_metered(spark, sf):
    from parcelwatt.operators.energy import annual_metered as run

    df = run(daily(spark, sf), points_of_meters(spark, sf), 1998).select("pnu", "ts_id", "elec_kwh", "gas_kwh", "dh_kwh", "total_kwh", "meter_count", "avg_coverage")
    return rounded(rounded(df, 2, "elec_kwh", "gas_kwh", "dh_kwh", "total_kwh"), 4, "avg_coverage")


@query("sql_annual_metered", f"""WITH {DAILY}, {METER_POINTS} SELECT CAST(year(day) AS BIGINT) AS year, pnu, ts_id, {R("sum(CASE WHEN meter_type='electricity' THEN total_kwh ELSE 0 END)", 2)} AS elec_kwh,
 {R("sum(CASE WHEN meter_type='gas' THEN total_kwh ELSE 0 END)", 2)} AS gas_kwh, {R("sum(CASE WHEN meter_type='heat' THEN total_kwh ELSE 0 END)", 2)} AS dh_kwh,
 {R("sum(CASE WHEN meter_type<>'water' THEN total_kwh ELSE 0 END)", 2)} AS total_kwh, count(DISTINCT meter_type) AS meter_count, {R('avg(coverage_pct)', 4)} AS avg_coverage
 FROM daily JOIN meter_points USING (ts_id) WHERE coverage_pct >= 50 GROUP BY 1, 2, 3 HAVING sum(CASE WHEN meter_type<>'water' THEN total_kwh ELSE 0 END) > 0""")
def sql_annual_metered(spark, sf):
    """The table function called from SQL text, once for each year of the daily series."""
    every = daily(spark, sf)
    every.select(F.year("day").alias("year")).distinct().createOrReplaceTempView("metered_years")
    name = table_functions.register_annual_metered(spark, every, points_of_meters(spark, sf), "annual_metered_totals")
    df = spark.sql(f"SELECT y.year, t.* FROM metered_years y, LATERAL {name}(y.year, 50D) t")
    return rounded(rounded(df, 2, "elec_kwh", "gas_kwh", "dh_kwh", "total_kwh"), 4, "avg_coverage")


_IN30, _IN90, _YTD = "day >= DATE '2001-07-03'", "day >= DATE '2001-05-04'", "day >= DATE '2001-01-01'"


@query("ts_summary", f"""WITH {DAILY}, {METER_POINTS}, g AS (SELECT ts_id, meter_type, count(*) FILTER (WHERE {_IN30}) AS days_with_data_30d, sum(total_kwh) FILTER (WHERE {_IN30}) AS k30,
 {R(f'avg(total_kwh) FILTER (WHERE {_IN30})', 2)} AS avg_daily_kwh_30d, {R(f'max(total_kwh) FILTER (WHERE {_IN30})', 2)} AS peak_daily_kwh_30d,
 {R(f'avg(coverage_pct) FILTER (WHERE {_IN30})', 1)} AS avg_coverage_pct_30d, CAST(sum(missing_count) FILTER (WHERE {_IN30}) AS BIGINT) AS total_missing_intervals_30d,
 {R(f'sum(total_kwh) FILTER (WHERE {_YTD})', 2)} AS total_kwh_ytd, count(*) FILTER (WHERE {_YTD}) AS days_with_data_ytd,
 coalesce({R(f'sum(missing_count) FILTER (WHERE {_IN90}) * 100.0 / nullif(sum(ok_count + missing_count) FILTER (WHERE {_IN90}), 0)', 2)}, 0) AS anomaly_pct_90d, max(day) AS latest FROM daily GROUP BY 1, 2)
 SELECT ts_id, meter_type, days_with_data_30d, {R('k30', 2)} AS total_kwh_30d, avg_daily_kwh_30d, peak_daily_kwh_30d, avg_coverage_pct_30d, total_missing_intervals_30d, total_kwh_ytd,
 days_with_data_ytd, anomaly_pct_90d, {D('latest')} AS latest_day, {R('k30 / total_area', 3)} AS eui_kwh_m2_30d, date_diff('day', latest, DATE '2001-08-02') AS days_since_latest
 FROM g JOIN meter_points USING (ts_id) WHERE days_with_data_30d > 0""")
def ts_summary(spark, sf):
    return ts.summary(daily(spark, sf), points_of_meters(spark, sf), DAILY_AS_OF).drop("pnu", "total_area", "total_suspect_intervals_30d")


@query("daily_wide", f"""WITH {DAILY} SELECT ts_id, {D('day')} AS day, {R("sum(CASE WHEN meter_type='electricity' THEN total_kwh ELSE 0 END)", 2)} AS elec_kwh,
 {R("sum(CASE WHEN meter_type='gas' THEN total_kwh ELSE 0 END)", 2)} AS gas_kwh, {R('sum(total_kwh)', 2)} AS total_kwh, {R('avg(coverage_pct)', 4)} AS coverage
 FROM daily WHERE day >= DATE '2000-08-02' GROUP BY ts_id, daily.day""")
def daily_wide(spark, sf):
    df = ts.daily_wide(daily(spark, sf), DAILY_AS_OF)
    return rounded(rounded(df, 2, "elec_kwh", "gas_kwh", "total_kwh"), 4, "coverage")


@query("eligible", f"""WITH {DAILY}, {METER_POINTS} SELECT ts_id, pnu, count(DISTINCT day) AS valid_days FROM daily JOIN meter_points USING (ts_id) WHERE coverage_pct >= 50 GROUP BY 1, 2 HAVING count(DISTINCT day) >= 100""")
def eligible(spark, sf):
    return ts.eligible(daily(spark, sf), points_of_meters(spark, sf), min_days=100).select("ts_id", "pnu", "valid_days")


@query("sufficient_history", f"""WITH {SERIES} SELECT ts_id, date_diff('day', min(day), max(day)) AS span_days, count(*) FILTER (WHERE y > 0) AS valid_days FROM series GROUP BY 1
 HAVING date_diff('day', min(day), max(day)) >= 365 AND count(*) FILTER (WHERE y > 0) >= 365 * 0.7""")
def sufficient_history(spark, sf):
    return ts.sufficient_history(series(spark, sf))


@query("align_pivot", f"""WITH {SERIES} SELECT {D('day')} AS day, {R('max(y) FILTER (WHERE ts_id = $$1-URGENT$$)', 2)} AS urgent, {R('max(y) FILTER (WHERE ts_id = $$5-LOW$$)', 2)} AS low
 FROM series WHERE ts_id IN ('1-URGENT', '5-LOW') GROUP BY series.day""")
def align_pivot(spark, sf):
    wide = ts.align(series(spark, sf), ["1-URGENT", "5-LOW"], value="y").withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})
    return rounded(wide, 2, "urgent", "low")


@query("filter_monitored", f"""WITH {READING}, {MONITORED}, t AS (SELECT ts_id, list(DISTINCT meter_type) AS meters FROM reading GROUP BY 1)
 SELECT ts_id, alias, usage_type FROM monitored JOIN t USING (ts_id) WHERE list_contains(meters, 'gas') AND (lower(alias) LIKE '%house%' OR lower(usage_type) LIKE '%house%')""")
def filter_monitored(spark, sf):
    types = reading(spark, sf).groupBy("ts_id").agg(F.collect_set("meter_type").alias("meter_types"))
    return Q.filter_monitored(monitored(spark, sf).join(types, "ts_id"), "gas", "House").select("ts_id", "alias", "usage_type")


@query("insert_ignore", f"""WITH {READING}, target AS (SELECT * FROM reading WHERE recorded_at < TIMESTAMP '2024-01-20'),
 batch AS (SELECT ts_id, meter_type, date_trunc('hour', recorded_at) AS recorded_at, value FROM reading),
 have AS (SELECT DISTINCT ts_id, meter_type, date_trunc('hour', recorded_at) AS recorded_at FROM target)
 SELECT ts_id, meter_type, {TS('CAST(recorded_at AS TIMESTAMP)')} AS recorded_at, min(value) AS value FROM batch b WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.ts_id = b.ts_id AND h.meter_type = b.meter_type AND h.recorded_at = b.recorded_at)
 GROUP BY ts_id, meter_type, b.recorded_at""")
def insert_ignore(spark, sf):
    hour = lambda df: df.withColumn("recorded_at", F.date_trunc("hour", "recorded_at").cast("timestamp_ntz"))
    r = reading(spark, sf)
    target = hour(r.filter(F.col("recorded_at") < F.lit(datetime(2024, 1, 20))))
    return upsert.insert_ignore(target, hour(r), ["ts_id", "meter_type", "recorded_at"], [F.col("value")])


@query("latest_k", f"""WITH {READING} SELECT ts_id, meter_type, {TS('recorded_at')} AS recorded_at, value FROM reading QUALIFY row_number() OVER (PARTITION BY ts_id, meter_type ORDER BY recorded_at DESC) <= 3""")
def latest_k(spark, sf):
    return Q.latest_k(reading(spark, sf), ["ts_id", "meter_type"], "recorded_at", 3)


@query("latest_anomalies", f"""WITH {READING}, {ANOMALY} SELECT ts_id, meter_type, {TS('detected_at')} AS detected_at, {R('z_score', 2)} AS z_score FROM anomaly
 WHERE detected_at >= TIMESTAMP '2024-01-24' ORDER BY anomaly.detected_at DESC, ts_id, meter_type LIMIT 200""")
def latest_anomalies(spark, sf):
    found = ts.anomalies(reading(spark, sf), min_count=2, z=Z)
    top = Q.newest(found, "detected_at", 200, F.lit(AS_OF - timedelta(days=7)), [F.col("ts_id"), F.col("meter_type")])
    return rounded(top.select("ts_id", "meter_type", "detected_at", "z_score"), 2, "z_score")


@query("fill_daily", f"""WITH {FILLED} SELECT ts_id, {D('day')} AS day, {R('y', 3)} AS y FROM filled""")
def fill_daily(spark, sf):
    return rounded(ts.fill_daily(series(spark, sf)), 3, "y")


_W = "(PARTITION BY ts_id ORDER BY day"
_LAG_SQL = ", ".join(f"{R(f'lag(y, {n}) OVER {_W})', 3)} AS lag_{n}d" for n in (1, 2, 3, 7, 14, 30))


@query("lag_features", f"WITH {FILLED} SELECT ts_id, {D('filled.day')} AS day, {_LAG_SQL.replace('ORDER BY day', 'ORDER BY filled.day')} FROM filled")
def lag_features(spark, sf):
    df = ts.lag_features(ts.fill_daily(series(spark, sf))).drop("y")
    return rounded(df, 3, *[c for c in df.columns if c.startswith("lag_")])


def _roll(fn, w, digits=2):
    frame = f"OVER (PARTITION BY ts_id ORDER BY filled.day ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"{R(f'CASE WHEN count(y) {frame} = {w} THEN {fn}(y) {frame} END', digits)}"


_ROLL_SQL = ", ".join(f"{_roll('avg', w)} AS roll_mean_{w}d, {_roll('stddev_samp', w)} AS roll_std_{w}d" for w in (7, 14, 30))
_F7 = "OVER (PARTITION BY ts_id ORDER BY filled.day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
_DEV = R(f"lag(y, 1) OVER (PARTITION BY ts_id ORDER BY filled.day) - CASE WHEN count(y) {_F7} = 7 THEN avg(y) {_F7} END", 2)


@query("rolling_features", f"WITH {FILLED} SELECT ts_id, {D('filled.day')} AS day, {_ROLL_SQL}, {_DEV} AS dev_from_7d_avg FROM filled")
def rolling_features(spark, sf):
    df = ts.rolling_features(ts.fill_daily(series(spark, sf))).drop("y")
    return rounded(df, 2, *[c for c in df.columns if c.startswith(("roll_", "dev_"))])


@query("calendar", f"""WITH {SERIES} SELECT ts_id, {D('series.day')} AS day, isodow(series.day) - 1 AS day_of_week, dayofyear(series.day) AS day_of_year, month(series.day) AS month,
 CASE WHEN isodow(series.day) >= 6 THEN 1 ELSE 0 END AS is_weekend, 0 AS is_holiday, CASE WHEN isodow(series.day) < 6 THEN 1 ELSE 0 END AS is_work_day FROM series""")
def calendar(spark, sf):
    return ts.calendar(series(spark, sf)).drop("y")


from parcelwatt.dims.values import MONTHLY_WEATHER  # noqa: E402

_WEATHER = "weather(m, hdd, cdd, temp) AS (VALUES " + ", ".join(f"({m}, {v[0]}::DOUBLE, {v[1]}::DOUBLE, {v[3]}::DOUBLE)" for m, v in MONTHLY_WEATHER.items()) + ")"


@query("weather_features", f"""WITH {SERIES}, {_WEATHER} SELECT ts_id, {D('series.day')} AS day, {R('hdd / 30', 6)} AS "HDD18", {R('cdd / 30', 6)} AS "CDD24", temp AS avg_temp FROM series JOIN weather ON month(series.day) = m""")
def weather_features(spark, sf):
    return rounded(ts.weather_features(series(spark, sf)).drop("y"), 6, "HDD18", "CDD24")


@query("training_frame", f"""WITH {FILLED}, f AS (SELECT ts_id, day, y, lag(y, 30) OVER (PARTITION BY ts_id ORDER BY filled.day) AS lag_30d, row_number() OVER (PARTITION BY ts_id ORDER BY filled.day) AS rn FROM filled)
 SELECT ts_id, {D('f.day')} AS day, {R('y', 3)} AS y, {R('lag_30d', 3)} AS lag_30d FROM f WHERE rn > 30""")
def training_frame(spark, sf):
    return rounded(ts.training_frame(series(spark, sf)).select("ts_id", "day", "y", "lag_30d"), 3, "y", "lag_30d")


@query("forecast")
def forecast(spark, sf):
    return ts.forecast(series(spark, sf), 7)


@query("retrain_all")
def retrain_all(spark, sf):
    return ts.retrain_all(daily(spark, sf), points_of_meters(spark, sf), min_days=100, min_coverage=25.0)


@query("total_kwh", f"""SELECT l_orderkey, l_linenumber, {R('''coalesce(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END, CASE WHEN l_returnflag = 'A' OR l_linestatus = 'O'
 THEN coalesce(CASE WHEN l_returnflag = 'A' THEN l_quantity END, 0) + coalesce(CASE WHEN l_linestatus = 'O' THEN l_tax END, 0) END)''', 4)} AS y FROM lineitem""")
def total(spark, sf):
    li = table(spark, sf, "lineitem")
    a, o = F.col("l_returnflag") == "A", F.col("l_linestatus") == "O"
    y = total_kwh(F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice")), F.when(a, F.col("l_quantity")), F.when(o, F.col("l_tax")))
    return rounded(li.select("l_orderkey", "l_linenumber", y.alias("y")), 4, "y")


@query("to_kwh", f"""SELECT event_id, {R('''value * CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 10.55 WHEN 'view' THEN 1163.0 WHEN 'signup' THEN 0.27778 END''', 4)} AS kwh FROM events""")
def kwh(spark, sf):
    unit = F.when(F.col("event_type") == "purchase", "kWh").when(F.col("event_type") == "click", "Nm3").when(F.col("event_type") == "view", "Gcal").when(F.col("event_type") == "signup", "MJ")
    return rounded(table(spark, sf, "events").select("event_id", to_kwh(F.col("value"), unit).alias("kwh")), 4, "kwh")


@query("wind_current", f"""WITH w AS (SELECT date_trunc('day', ts) AS measured_at, value % 360 AS wind_direction, value / 20 AS wind_speed FROM events)
 SELECT {TS('CAST(measured_at AS TIMESTAMP)')} AS measured_at, {R('avg(wind_direction)', 1)} AS wind_direction, {R('avg(wind_speed)', 1)} AS wind_speed, count(*) AS observations
 FROM w WHERE w.measured_at = (SELECT max(measured_at) FROM w) GROUP BY w.measured_at""")
def wind_current(spark, sf):
    w = table(spark, sf, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("measured_at"), (F.col("value") % 360).alias("wind_direction"), (F.col("value") / 20).alias("wind_speed"))
    return fire.current_wind(w)


@query("quality_rejects", f"""WITH {READING}, t AS (SELECT ts_id, {TS('recorded_at')} AS recorded_at, meter_type, value,
 concat_ws(',', CASE WHEN meter_type NOT IN ('electricity','gas','heat','water') THEN 'meter' END, CASE WHEN NOT value > 0.1 THEN 'value' END) AS reasons FROM reading)
 SELECT * FROM t WHERE reasons <> ''""")
def quality_rejects(spark, sf):
    rules = {"meter": quality.meter_ok(F.col("meter_type")), "value": F.col("value") > 0.1}
    _, bad = quality.check(reading(spark, sf), rules)
    return bad.withColumn("reasons", F.concat_ws(",", "reasons"))
