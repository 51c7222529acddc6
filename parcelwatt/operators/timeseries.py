"""Meter time series: resampling, comparison, anomalies, rollups, daily features."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from typing import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelwatt import dims
from parcelwatt.dims import values as V
from parcelwatt.functions.energy import total_kwh
from parcelwatt.functions.rounding import half_up
from parcelwatt.operators.join import top_k

SERIES = ["ts_id", "meter_type"]


def resample(df: DataFrame, resolution: str, start=None, end=None) -> DataFrame:
    """Sum readings per hour, day or (Monday) week; ``raw`` passes through. Both ends are inclusive."""
    if start is not None:
        df = df.filter(F.col("recorded_at") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("recorded_at") <= F.lit(end))
    unit = F.col("unit") if "unit" in df.columns else F.lit(None).cast("string")
    if resolution == "raw":
        return df.select(*SERIES, F.col("recorded_at").alias("ts"), "value", unit.alias("unit"))
    step = {"hourly": "hour", "daily": "day", "weekly": "week"}[resolution]
    return df.groupBy(*SERIES, F.date_trunc(step, "recorded_at").alias("ts")).agg(
        half_up(F.sum("value"), 4).alias("value"), F.max(unit).alias("unit")
    )


def anomalies(df: DataFrame, window: timedelta = timedelta(hours=24), min_count: int = 6, z: float = 2.0,
              chunk: timedelta = timedelta(days=1)) -> DataFrame:
    """Readings more than ``z`` population deviations from the mean of the ``window`` before them.

    The window ends one second before the reading and needs ``min_count`` readings. A series is cut
    into ``chunk``-long pieces, each carrying the ``window`` of readings before it as context, so a
    single series holding most of the data still spreads over many tasks.
    """
    if chunk < window:
        raise ValueError("chunk must not be shorter than window")
    span, piece = int(window.total_seconds()), int(chunk.total_seconds())
    micros = F.unix_micros(F.col("recorded_at").cast("timestamp"))
    second = 1_000_000
    first = F.floor(micros / (piece * second)).cast("long")
    last = F.floor((micros + span * second) / (piece * second)).cast("long")
    pieces = (
        df.select(*SERIES, "recorded_at", "value", micros.alias("_us"), F.explode(F.sequence(first, last)).alias("_piece"))
        .withColumn("_own", F.floor(F.col("_us") / (piece * second)) == F.col("_piece"))
    )
    before = Window.partitionBy(*SERIES, "_piece").orderBy("_us").rangeBetween(-span * second, -second)
    scored = pieces.withColumns({
        "window_mean": F.avg("value").over(before),
        "window_std": F.stddev_pop("value").over(before),
        "_n": F.count(F.lit(1)).over(before),
    })
    score = F.when(F.col("window_std") > 0, F.abs(F.col("value") - F.col("window_mean")) / F.nullif(F.col("window_std"), F.lit(0.0)))
    return (
        scored.filter(F.col("_own") & (F.col("_n") >= min_count))
        .withColumn("z_score", F.coalesce(score, F.lit(0.0)))
        .filter(F.col("z_score") > z)
        .select(*SERIES, F.col("recorded_at").alias("detected_at"), "window_mean", "window_std",
                F.col("value").alias("offending_value"), "z_score")
    )


def recent(df: DataFrame, as_of: datetime, days: int, when: str = "recorded_at") -> DataFrame:
    return df.filter(F.col(when) >= F.lit(as_of - timedelta(days=days)))


def daily_by_meter_long(df: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """ts_id, meter_type, day, value: daily totals of the last ``days``."""
    unit = F.col("unit") if "unit" in df.columns else F.lit(None).cast("string")
    return recent(df, as_of, days).groupBy(*SERIES, F.to_date("recorded_at").alias("day")).agg(
        half_up(F.sum("value"), 2).alias("value"), F.max(unit).alias("unit")
    )


def daily_by_meter(df: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """The same nested per meter point: map of meter -> day-ordered array (at most ``days`` + 1 long)."""
    long = daily_by_meter_long(df, as_of, days)
    per_meter = long.groupBy(*SERIES).agg(F.sort_array(F.collect_list(F.struct("day", "value", "unit"))).alias("days"))
    return per_meter.groupBy("ts_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("meter_type", "days")))).alias("daily"))


def eui_summary(monitored: DataFrame, readings: DataFrame, as_of: datetime, days: int = 365) -> DataFrame:
    """Every meter point with its electricity+gas EUI over ``days``, data range and meter count."""
    agg = recent(readings, as_of, days).groupBy("ts_id").agg(
        F.sum(F.when(F.col("meter_type").isin("electricity", "gas"), F.col("value"))).alias("_kwh"),
        F.min("recorded_at").alias("data_start"), F.max("recorded_at").alias("data_end"),
        F.countDistinct("meter_type").alias("meter_count"),
    )
    return monitored.join(agg, "ts_id", "left").select(
        *monitored.columns,
        half_up(F.col("_kwh") / F.nullif(F.col("total_area"), F.lit(0.0)), 1).alias("eui_kwh_m2_1yr"),
        "data_start", "data_end", F.coalesce("meter_count", F.lit(0)).alias("meter_count"),
    )


def compare(monitored: DataFrame, readings: DataFrame, ids: DataFrame, days: int, metric: str, as_of: datetime) -> DataFrame:
    """``eui`` or one meter's total over the period for the requested points; no data gives null."""
    if metric not in ("eui", "electricity", "gas", "heat", "water"):
        raise ValueError(f"unknown metric {metric!r}")
    meters = ("electricity", "gas") if metric == "eui" else (metric,)
    wanted = ids.select("ts_id").distinct()
    period = recent(readings, as_of, days).filter((F.col("recorded_at") <= F.lit(as_of)) & F.col("meter_type").isin(*meters))
    sums = period.join(wanted, "ts_id", "left_semi").groupBy("ts_id").agg(F.sum("value").alias("_kwh"))
    df = wanted.join(monitored.select("ts_id", "alias", "pnu", "total_area"), "ts_id", "left").join(sums, "ts_id", "left")
    found = F.col("_kwh").isNotNull()
    value = F.col("_kwh") / F.nullif(F.col("total_area"), F.lit(0.0)) if metric == "eui" else F.col("_kwh")
    return df.select(
        "ts_id", F.when(found, F.col("alias")).alias("alias"), F.when(found, F.col("pnu")).alias("pnu"),
        half_up(F.nullif(value, F.lit(0.0)), 2).alias("value"), F.lit("kWh/m²" if metric == "eui" else "kWh").alias("unit"),
    )


def daily_rollup(df: DataFrame, expected: int = 96) -> DataFrame:
    """Day totals with valid / missing counts and coverage in percent of ``expected`` readings a day."""
    ok = F.count("value")
    return df.groupBy(*SERIES, F.to_date("recorded_at").alias("day")).agg(
        F.sum("value").alias("total_kwh"), ok.cast("int").alias("ok_count"),
        F.greatest(F.lit(expected) - ok, F.lit(0)).cast("int").alias("missing_count"),
        half_up(F.least(ok / F.lit(float(expected)), F.lit(1.0)) * 100, 2).alias("coverage_pct"),
    )


def summary(daily: DataFrame, monitored: DataFrame, as_of: date) -> DataFrame:
    """Dashboard figures per point and meter: 30-day, year-to-date, 90-day anomaly share, freshness.

    ``daily`` needs total_kwh, ok_count, missing_count, coverage_pct and optionally suspect_count.
    One conditional aggregation; only pairs with data in the last 30 days appear.
    """
    suspect = F.col("suspect_count") if "suspect_count" in daily.columns else F.lit(0)
    day, valid = F.col("day"), F.col("total_kwh").isNotNull()
    in30 = (day >= F.lit(as_of - timedelta(days=30))) & valid
    in90 = day >= F.lit(as_of - timedelta(days=90))
    ytd = (day >= F.lit(date(as_of.year, 1, 1))) & valid
    s = lambda cond, col: F.sum(F.when(cond, col))
    bad, every = suspect + F.col("missing_count"), F.col("ok_count") + suspect + F.col("missing_count")
    agg = daily.groupBy(*SERIES).agg(
        F.count(F.when(in30, 1)).alias("days_with_data_30d"),
        half_up(s(in30, F.col("total_kwh")), 2).alias("total_kwh_30d"),
        half_up(F.avg(F.when(in30, F.col("total_kwh"))), 2).alias("avg_daily_kwh_30d"),
        half_up(F.max(F.when(in30, F.col("total_kwh"))), 2).alias("peak_daily_kwh_30d"),
        half_up(F.avg(F.when(in30, F.col("coverage_pct"))), 1).alias("avg_coverage_pct_30d"),
        s(in30, F.col("missing_count")).alias("total_missing_intervals_30d"),
        s(in30, F.lit(0) + suspect).alias("total_suspect_intervals_30d"),
        half_up(s(ytd, F.col("total_kwh")), 2).alias("total_kwh_ytd"),
        F.count(F.when(ytd, 1)).alias("days_with_data_ytd"),
        F.coalesce(half_up(s(in90, bad) * 100.0 / F.nullif(s(in90, every), F.lit(0)), 2), F.lit(0.0)).alias("anomaly_pct_90d"),
        F.max(F.when(valid, day)).alias("latest_day"),
        s(in30, F.col("total_kwh")).alias("_kwh30"),
    ).filter(F.col("days_with_data_30d") > 0)
    area = F.nullif(F.greatest(F.col("total_area"), F.lit(0.0)), F.lit(0.0))
    return (
        monitored.join(agg, "ts_id")
        .withColumns({
            "eui_kwh_m2_30d": half_up(F.col("_kwh30") / area, 3),
            "days_since_latest": F.datediff(F.lit(as_of), F.col("latest_day")),
        })
        .drop("_kwh30")
    )


def daily_wide(daily: DataFrame, as_of: date | None = None, days: int = 365) -> DataFrame:
    """Electricity, gas, total and mean coverage per point and day of the last ``days``."""
    if as_of is not None:
        daily = daily.filter(F.col("day") >= F.lit(as_of - timedelta(days=days)))
    of = lambda m: F.sum(F.when(F.col("meter_type") == m, F.col("total_kwh")).otherwise(0.0))
    return daily.groupBy("ts_id", "day").agg(
        of("electricity").alias("elec_kwh"), of("gas").alias("gas_kwh"),
        F.sum("total_kwh").alias("total_kwh"), F.avg("coverage_pct").alias("coverage"),
    )


def eligible(daily: DataFrame, monitored: DataFrame, min_days: int = 180, min_coverage: float = 50.0) -> DataFrame:
    """Meter points with at least ``min_days`` distinct days at or above ``min_coverage`` percent."""
    days = daily.filter(F.col("coverage_pct") >= min_coverage).groupBy("ts_id").agg(F.countDistinct("day").alias("valid_days"))
    return monitored.join(days.filter(F.col("valid_days") >= min_days), "ts_id")


def sufficient_history(daily: DataFrame, min_days: int = 365) -> DataFrame:
    """ts_id of series spanning ``min_days`` with consumption on at least 70 % of them."""
    per = daily.groupBy("ts_id").agg(
        F.datediff(F.max("day"), F.min("day")).alias("span_days"), F.count(F.when(F.col("y") > 0, 1)).alias("valid_days")
    )
    return per.filter((F.col("span_days") >= min_days) & (F.col("valid_days") >= min_days * 0.7))


def align(df: DataFrame, ids: list, key: str = "ts_id", when: str = "day", value: str = "value") -> DataFrame:
    """One row per day, one column per requested series."""
    return df.filter(F.col(key).isin(*ids)).groupBy(when).pivot(key, ids).agg(F.first(value))


# ── daily features ───────────────────────────────────────────────────────────

def consumption(df: DataFrame) -> DataFrame:
    """ts_id, day, y: the day's total, from its parts where no total was recorded."""
    return df.select("ts_id", "day", total_kwh(F.col("total_kwh"), F.col("elec_kwh"), F.col("gas_kwh")).alias("y"))


def fill_daily(df: DataFrame, limit: int = 7) -> DataFrame:
    """Dense daily series (ts_id, day, y) without nulls.

    Inside a gap the first ``limit`` days are interpolated linearly and the last interpolated value
    is carried over the rest; leading gaps take the first known value, empty series become 0.
    """
    bounds = df.groupBy("ts_id").agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    calendar = bounds.select("ts_id", F.explode(F.sequence("_a", "_b")).alias("day"))
    dense = calendar.join(df.select("ts_id", "day", "y"), ["ts_id", "day"], "left")
    known = F.when(F.col("y").isNotNull(), F.struct("day", "y"))
    back = Window.partitionBy("ts_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("ts_id").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = dense.withColumns({"_p": F.last(known, True).over(back), "_n": F.last(known, True).over(ahead)})
    since = F.datediff("day", F.col("_p.day"))
    steps = F.least(since, F.lit(limit))
    gap = F.nullif(F.datediff(F.col("_n.day"), F.col("_p.day")), F.lit(0))
    line = F.col("_p.y") + (F.col("_n.y") - F.col("_p.y")) * steps / gap
    return marked.select("ts_id", "day", F.coalesce("y", line, F.col("_p.y"), F.col("_n.y"), F.lit(0.0)).alias("y"))


def lag_features(df: DataFrame, lags: tuple[int, ...] = V.LAGS) -> DataFrame:
    """Add ``lag_<n>d`` on a gap-free daily series."""
    by_day = Window.partitionBy("ts_id").orderBy("day")
    return df.withColumns({f"lag_{n}d": F.lag("y", n).over(by_day) for n in lags})


def rolling_features(df: DataFrame, windows: tuple[int, ...] = V.ROLLING) -> DataFrame:
    """Add mean and sample deviation of the preceding full windows, and yesterday's gap to the shortest."""
    by_day = Window.partitionBy("ts_id").orderBy("day")
    columns: dict[str, Column] = {}
    for w in windows:
        frame = by_day.rowsBetween(-w, -1)
        full = F.count("y").over(frame) == w
        columns[f"roll_mean_{w}d"] = F.when(full, F.avg("y").over(frame))
        columns[f"roll_std_{w}d"] = F.when(full, F.stddev_samp("y").over(frame))
    out = df.withColumns(columns)
    return out.withColumn(f"dev_from_{windows[0]}d_avg", F.lag("y", 1).over(by_day) - F.col(f"roll_mean_{windows[0]}d"))


def calendar(df: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Day of week (Monday 0), day of year, month, weekend, holiday and workday flags.

    ``holidays`` (column ``day``) defaults to the shipped list; one row per day of the calendar.
    """
    if holidays is None:
        holidays = F.broadcast(dims.holidays(df.sparkSession))
    weekend = F.weekday("day") >= 5
    marked = df.join(holidays.select("day", F.lit(1).alias("is_holiday")).distinct(), "day", "left")
    return marked.withColumns({
        "day_of_week": F.weekday("day"), "day_of_year": F.dayofyear("day"), "month": F.month("day"),
        "is_weekend": weekend.cast("int"), "is_holiday": F.coalesce("is_holiday", F.lit(0)),
        "is_work_day": (~weekend & F.col("is_holiday").isNull()).cast("int"),
    })


def weather_features(df: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """Daily HDD18 / CDD24 / mean temperature: observed by day, else typical values of the month."""
    if weather is not None:
        return df.join(weather.select("day", "HDD18", "CDD24", "avg_temp"), "day", "left")
    typical = dims.monthly_weather(df.sparkSession).select(
        F.col("month").alias("_m"), (F.col("hdd18") / 30).alias("HDD18"), (F.col("cdd24") / 30).alias("CDD24"), "avg_temp"
    )
    return df.join(F.broadcast(typical), F.month("day") == F.col("_m"), "left").drop("_m")


FEATURE_COLUMNS = (
    "day_of_week", "day_of_year", "month", "is_weekend", "is_holiday", "is_work_day", "dev_from_7d_avg",
    "HDD18", "CDD24", "avg_temp", *[f"lag_{n}d" for n in V.LAGS],
    *[f"roll_{s}_{w}d" for w in V.ROLLING for s in ("mean", "std")],
)


def training_frame(df: DataFrame, weather: DataFrame | None = None, min_rows: int = 30) -> DataFrame:
    """Feature rows (complete ones only) of every series that has at least ``min_rows`` of them."""
    filled = fill_daily(df)
    feats = weather_features(calendar(rolling_features(lag_features(filled))), weather)
    full = feats.dropna(subset=[*FEATURE_COLUMNS, "y"])
    counts = full.groupBy("ts_id").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= min_rows)
    return full.join(counts.select("ts_id"), "ts_id", "left_semi")


# ── forecast ─────────────────────────────────────────────────────────────────

FORECAST_SCHEMA = (
    "ts_id {id}, day date, y_pred double, y_lower double, y_upper double, val_rmse double, residual_p90 double, rows int, reason string"
)


def _ridge(x, y):
    """Default model: ridge regression on standardised features."""
    import numpy as np

    mean, std = x.mean(axis=0), x.std(axis=0)
    std = np.where(std > 0, std, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / std])
    penalty = np.eye(z.shape[1])
    penalty[0, 0] = 0.0
    beta = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    return lambda rows: np.column_stack([np.ones(len(rows)), (rows - mean) / std]) @ beta


LEAST_ROWS = 30


def _forecast_one(pdf, horizon: int, fit: Callable, typical: dict, holidays: set):
    """One series: fit on its feature rows, then predict day by day feeding predictions back; too short a series gives one row that says so."""
    import numpy as np
    import pandas as pd

    columns = ["ts_id", "day", "y_pred", "y_lower", "y_upper", "val_rmse", "residual_p90", "rows", "reason"]
    pdf = pdf.sort_values("day")
    train = pdf.dropna(subset=[*FEATURE_COLUMNS, "y"])
    if len(train) < LEAST_ROWS:
        return pd.DataFrame([(pdf["ts_id"].iloc[0], *[None] * 6, len(train), f"fewer than {LEAST_ROWS} feature rows")], columns=columns)
    x, y = train[list(FEATURE_COLUMNS)].to_numpy(float), train["y"].to_numpy(float)
    predict = fit(x, y)
    residual = np.abs(y - np.clip(predict(x), 0.0, None))
    rmse, p90 = float(np.sqrt(np.mean(residual**2))), float(np.percentile(residual, 90))
    history, last, out = list(pdf["y"].to_numpy(float)), pd.Timestamp(pdf["day"].iloc[-1]), []
    for step in range(1, horizon + 1):
        day = last + pd.Timedelta(days=step)
        weekend, holiday = day.dayofweek >= 5, day.date().isoformat() in holidays
        hdd, cdd, _, temp = typical[day.month]
        row = {
            "day_of_week": day.dayofweek, "day_of_year": day.dayofyear, "month": day.month, "is_weekend": weekend,
            "is_holiday": holiday, "is_work_day": not weekend and not holiday,
            "HDD18": hdd / 30, "CDD24": cdd / 30, "avg_temp": temp,
            **{f"lag_{n}d": history[-n] for n in V.LAGS},
        }
        for w in V.ROLLING:
            row[f"roll_mean_{w}d"], row[f"roll_std_{w}d"] = np.mean(history[-w:]), np.std(history[-w:], ddof=1)
        row["dev_from_7d_avg"] = row["lag_1d"] - row["roll_mean_7d"]
        value = max(0.0, float(predict(np.array([[float(row[c]) for c in FEATURE_COLUMNS]]))[0]))
        history.append(value)
        out.append((pdf["ts_id"].iloc[0], day.date(), value, max(0.0, value - p90), value + p90, rmse, p90, len(train), None))
    return pd.DataFrame(out, columns=columns)


def forecast(df: DataFrame, horizon: int = 7, fit: Callable | None = None) -> DataFrame:
    """Recursive daily forecast of every series with a P90 residual band, never below 0; a series with too few feature rows has one row
    without a day, and the reason.

    A group is one meter point's daily series, so its size is bounded by days, not by readings.
    ``fit(x, y)`` returns a predict function; the default is a ridge regression.
    """
    filled = fill_daily(df)
    feats = weather_features(calendar(rolling_features(lag_features(filled))))
    model, typical, holidays = fit or _ridge, dict(V.MONTHLY_WEATHER), set(V.HOLIDAYS)
    schema = FORECAST_SCHEMA.format(id=df.schema["ts_id"].dataType.simpleString())
    return feats.select("ts_id", "day", "y", *FEATURE_COLUMNS).groupBy("ts_id").applyInPandas(
        lambda pdf: _forecast_one(pdf, horizon, model, typical, holidays), schema
    )


def forecast_eui(forecasts: DataFrame, monitored: DataFrame) -> DataFrame:
    """Forecast kWh per m2 of floor area (areas below 1 m2 count as 1)."""
    area = F.greatest(F.coalesce("total_area", F.lit(1.0)), F.lit(1.0))
    joined = forecasts.join(monitored.select("ts_id", "total_area"), "ts_id", "left")
    return joined.withColumns({f"eui_{k}": F.col(f"y_{k}") / area for k in ("pred", "lower", "upper")}).drop("total_area")


def retrain_all(daily: DataFrame, monitored: DataFrame, horizon: int = 7, min_days: int = 180,
                min_coverage: float = 50.0, fit: Callable | None = None) -> DataFrame:
    """Fit and forecast every eligible meter point in one job; returns its EUI forecast rows."""
    ready = eligible(daily, monitored, min_days, min_coverage)
    series = daily_wide(daily).select("ts_id", "day", F.col("total_kwh").alias("y"))
    return forecast_eui(forecast(series.join(ready.select("ts_id"), "ts_id", "left_semi"), horizon, fit), monitored)


def newest_readings(df: DataFrame) -> DataFrame:
    """Latest reading of every series."""
    return top_k(df, SERIES, [F.col("recorded_at").desc(), F.col("value").desc()])
