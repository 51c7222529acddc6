"""Schemas of the tables the operators exchange (DDL text)."""

RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"

FOOTPRINT = (
    "gid BIGINT, pnu STRING, bld_mgt_sn STRING, bld_nm STRING, dong_nm STRING, usage_type STRING, grnd_flr INT, "
    f"ugrnd_flr INT, height DOUBLE, approval_date STRING, rings ARRAY<{RING}>, cx DOUBLE, cy DOUBLE, "
    "xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE"
)
LEDGER = (
    "pnu STRING, bld_mgt_sn STRING, bld_nm STRING, dong_nm STRING, main_purps_cd STRING, main_purps_nm STRING, "
    "strct_cd STRING, strct_nm STRING, grnd_flr_cnt INT, ugrnd_flr_cnt INT, bld_ht DOUBLE, tot_area DOUBLE, "
    "bld_area DOUBLE, use_apr_day STRING, enrgy_eff_rate STRING, epi_score DOUBLE"
)
ENERGY_RESULT = (
    "pnu STRING, heating DOUBLE, cooling DOUBLE, hot_water DOUBLE, lighting DOUBLE, ventilation DOUBLE, "
    "total_energy DOUBLE, simulation_type STRING, data_tier INT, reference_year INT, is_current BOOLEAN, "
    "source_metadata STRUCT<elec_kwh: DOUBLE, gas_kwh: DOUBLE, dh_kwh: DOUBLE, meter_count: BIGINT, "
    "avg_coverage: DOUBLE, reference_year: INT>, co2_kg_yr DOUBLE, co2_kg_m2 DOUBLE, "
    "primary_energy_kwh_yr DOUBLE, primary_energy_kwh_m2 DOUBLE"
)
MONITORED = (
    "ts_id BIGINT, pnu STRING, alias STRING, meter_types ARRAY<STRING>, total_area DOUBLE, usage_type STRING, "
    "built_year INT, data_source STRING"
)
READING = "ts_id BIGINT, meter_type STRING, recorded_at TIMESTAMP_NTZ, value DOUBLE, unit STRING"
READING_DAILY = (
    "ts_id BIGINT, meter_type STRING, day DATE, total_kwh DOUBLE, ok_count INT, missing_count INT, coverage_pct DOUBLE"
)
ANOMALY = (
    "ts_id BIGINT, meter_type STRING, detected_at TIMESTAMP_NTZ, window_mean DOUBLE, window_std DOUBLE, "
    "offending_value DOUBLE, z_score DOUBLE"
)
EDGE = "source_pnu STRING, target_pnu STRING, distance_m DOUBLE, spread_weight DOUBLE"
WEATHER = (
    "grid_x INT, grid_y INT, lng DOUBLE, lat DOUBLE, wind_direction DOUBLE, wind_speed DOUBLE, measured_at TIMESTAMP"
)
SHELTER = "name STRING, category STRING, capacity INT, address STRING, lng DOUBLE, lat DOUBLE, source STRING"
PREDICTION = (
    "pnu STRING, model_version_id BIGINT, predicted_at TIMESTAMP, temporal_scale STRING, horizon_days INT, "
    "target_variable STRING, predicted_eui DOUBLE, confidence_low DOUBLE, confidence_high DOUBLE, "
    "features_used STRING, actual_eui DOUBLE, error_abs DOUBLE, error_pct DOUBLE"
)
