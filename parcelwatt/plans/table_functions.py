"""Table functions for SQL users, over DataFrames that the caller names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelwatt.operators import carbon

_FUELS = (("electricity", "elec_kwh"), ("gas", "gas_kwh"), ("heat", "dh_kwh"))


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def register_annual_metered(spark: SparkSession, daily: DataFrame, monitored: DataFrame, name: str = "annual_metered") -> str:
    """Create the temporary table function ``name(of_year INT, least_coverage DOUBLE)``: annual metered totals per parcel and meter point.

    ``daily`` (ts_id, meter_type, day, total_kwh, coverage_pct), ``monitored`` (ts_id, pnu). A day of unknown coverage counts, one without a
    total does not; points without a parcel or a positive total (water apart) have no row. The body is part of the caller's plan, so the year and the
    columns reach the scan of ``daily``. It reads the two frames through temporary views ``name_daily`` and ``name_points``.
    """
    daily.createOrReplaceTempView(f"{name}_daily")
    monitored.createOrReplaceTempView(f"{name}_points")
    fuels = ", ".join(f"sum(CASE WHEN meter_type = '{kind}' THEN total_kwh ELSE 0D END) AS {column}" for kind, column in _FUELS)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(of_year INT, least_coverage DOUBLE DEFAULT 50D)
        RETURNS TABLE (pnu {_type(monitored, 'pnu')}, ts_id {_type(daily, 'ts_id')}, elec_kwh DOUBLE, gas_kwh DOUBLE, dh_kwh DOUBLE,
                       total_kwh DOUBLE, meter_count BIGINT, avg_coverage DOUBLE)
        RETURN SELECT p.pnu, t.ts_id, t.elec_kwh, t.gas_kwh, t.dh_kwh, t.total, t.meter_count, t.avg_coverage
          FROM (SELECT ts_id, {fuels}, sum(CASE WHEN meter_type <> 'water' THEN total_kwh ELSE 0D END) AS total,
                       count(DISTINCT meter_type) AS meter_count, avg(coverage_pct) AS avg_coverage
                  FROM {name}_daily
                 WHERE year(day) = {name}.of_year AND day >= make_date({name}.of_year, 1, 1) AND day < make_date({name}.of_year + 1, 1, 1)
                   AND total_kwh IS NOT NULL AND (coverage_pct IS NULL OR coverage_pct >= {name}.least_coverage)
                 GROUP BY ts_id) t
          JOIN {name}_points p ON p.ts_id = t.ts_id
         WHERE t.total > 0 AND p.pnu IS NOT NULL""")
    return name


def register_carbon_update(spark: SparkSession, results: DataFrame, buildings: DataFrame, name: str = "carbon_update") -> str:
    """Create the temporary table function ``name(of_year INT)``: current result rows of a year with their four carbon and energy measures.

    ``of_year`` null: all years. Rows without a known building or a positive total keep null measures. The measures are those of
    ``operators.carbon.apply``, seen through the temporary view ``name_rows``, so year and columns are pruned before they are computed.
    """
    carbon.apply(results, buildings).createOrReplaceTempView(f"{name}_rows")
    measures = ", ".join(f"{c} DOUBLE" for c in carbon.COLUMNS)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(of_year INT DEFAULT NULL)
        RETURNS TABLE (pnu {_type(results, 'pnu')}, simulation_type STRING, reference_year INT, total_energy DOUBLE, {measures})
        RETURN SELECT pnu, simulation_type, CAST(reference_year AS INT), total_energy, {', '.join(carbon.COLUMNS)}
          FROM {name}_rows
         WHERE is_current AND ({name}.of_year IS NULL OR reference_year = {name}.of_year)""")
    return name
