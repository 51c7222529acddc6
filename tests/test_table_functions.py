"""Table functions called from SQL text give what the operators give."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from parcelwatt.operators import carbon, energy
from parcelwatt.plans import table_functions as tf


def test_annual_metered_in_sql(spark):
    rows = [("a", "electricity", date(2025, 1, 1), 10.0, 90.0), ("a", "gas", date(2025, 12, 31), 5.0, None), ("a", "heat", date(2025, 6, 1), 7.0, 10.0),
            ("a", "electricity", date(2024, 12, 31), 99.0, 90.0), ("a", "water", date(2025, 2, 1), 3.0, 60.0), ("b", "water", date(2025, 2, 1), 3.0, 60.0),
            ("c", "gas", date(2025, 2, 1), 4.0, 60.0), ("d", "gas", date(2025, 2, 1), None, 60.0), ("e", "gas", date(2026, 1, 1), 1.0, 60.0)]
    daily = spark.createDataFrame(rows, "ts_id string, meter_type string, day date, total_kwh double, coverage_pct double")
    points = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4"), ("e", "5")], "ts_id string, pnu string")
    tf.register_annual_metered(spark, daily, points)
    columns = ["pnu", "ts_id", "elec_kwh", "gas_kwh", "dh_kwh", "total_kwh", "meter_count", "avg_coverage"]
    for year, least in ((2025, 50.0), (2025, 5.0), (2026, 50.0), (1990, 50.0)):
        got = spark.sql(f"SELECT {', '.join(columns)} FROM annual_metered({year}, {least}D)").collect()
        assert sorted(got) == sorted(energy.annual_metered(daily, points, year, least).select(columns).collect())
    row = spark.sql("SELECT * FROM annual_metered(2025)").first()
    assert (row.ts_id, row.elec_kwh, row.gas_kwh, row.dh_kwh, row.total_kwh, row.meter_count) == ("a", 10.0, 5.0, 0.0, 15.0, 3)
    # called once for each row of another table
    years = spark.sql("SELECT y.year, t.ts_id FROM VALUES (2024), (2025), (2026) AS y(year), LATERAL annual_metered(y.year) t ORDER BY 1")
    assert [tuple(r) for r in years.collect()] == [(2024, "a"), (2025, "a"), (2026, "e")]


def test_carbon_update_in_sql(spark):
    results = spark.createDataFrame(
        [("1", "archetype", 2024, True, 100.0, None, None, None), ("1", "archetype", 2023, True, 90.0, None, None, None), ("2", "tier_c_metered", 2024, True, 50.0, 30.0, 20.0, 0.0),
         ("3", "archetype", 2024, True, 80.0, None, None, None), ("1", "archetype", 2024, False, 10.0, None, None, None), ("2", "archetype", None, True, 70.0, None, None, None)],
        "pnu string, simulation_type string, reference_year int, is_current boolean, total_energy double, elec_kwh double, gas_kwh double, dh_kwh double")
    buildings = spark.createDataFrame([(1, "1", "업무시설", 200.0), (2, "2", "공동주택", 0.0)], "gid long, pnu string, usage_type string, total_area double")
    tf.register_carbon_update(spark, results, buildings)
    columns = ["pnu", "simulation_type", "total_energy", *carbon.COLUMNS]
    key = lambda r: tuple((v is not None, v) for v in r)
    whole = carbon.apply(results, buildings).where("is_current")
    for call, kept in (("carbon_update(2024)", F.col("reference_year") == 2024), ("carbon_update()", F.lit(True))):
        got = spark.sql(f"SELECT {', '.join(columns)} FROM {call}").collect()
        assert sorted(got, key=key) == sorted(whole.where(kept).select(columns).collect(), key=key) and got
    assert spark.sql("SELECT count(*) FROM carbon_update(1990)").first()[0] == 0
