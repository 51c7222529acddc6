"""Domain functions for SQL users, as native expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from parcelwatt.functions.geo import EARTH_RADIUS_M

_FUNCTIONS = {
    "pnu_generate(sgg STRING, bdong STRING, kind STRING, bon STRING, ji STRING) RETURNS STRING": """
        CASE WHEN length(concat(trim(sgg), trim(bdong), CASE trim(kind) WHEN '0' THEN '1' WHEN '1' THEN '2' WHEN '2' THEN '3' ELSE trim(kind) END,
                  CASE WHEN length(trim(bon)) >= 4 THEN trim(bon) ELSE lpad(trim(bon), 4, '0') END,
                  CASE WHEN length(trim(ji)) >= 4 THEN trim(ji) ELSE lpad(trim(ji), 4, '0') END)) = 19
             THEN concat(trim(sgg), trim(bdong), CASE trim(kind) WHEN '0' THEN '1' WHEN '1' THEN '2' WHEN '2' THEN '3' ELSE trim(kind) END,
                  CASE WHEN length(trim(bon)) >= 4 THEN trim(bon) ELSE lpad(trim(bon), 4, '0') END,
                  CASE WHEN length(trim(ji)) >= 4 THEN trim(ji) ELSE lpad(trim(ji), 4, '0') END) END""",
    "pnu_district(pnu STRING) RETURNS STRING": "substring(pnu, 1, 5)",
    "pnu_parent(pnu STRING) RETURNS STRING": "concat(substring(pnu, 1, 15), '0000')",
    "pnu_mgt_sn(pnu STRING, seq STRING) RETURNS STRING": """
        CASE WHEN length(trim(pnu)) = 19 AND length(trim(seq)) <= 6 THEN concat(trim(pnu), lpad(trim(seq), 6, '0')) END""",
    "bearing_deg(lng1 DOUBLE, lat1 DOUBLE, lng2 DOUBLE, lat2 DOUBLE) RETURNS DOUBLE": """
        pmod(degrees(atan2(sin(radians(lng2 - lng1)) * cos(radians(lat2)),
             cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lng2 - lng1)))) + 360, 360)""",
    "wind_factor(direction DOUBLE, wind_from DOUBLE, speed DOUBLE) RETURNS DOUBLE": """
        greatest(0D, 1 + (speed / 20) * cos(radians(direction - (wind_from + 180))))""",
    "haversine_m(lng1 DOUBLE, lat1 DOUBLE, lng2 DOUBLE, lat2 DOUBLE) RETURNS DOUBLE": f"""
        2 * {EARTH_RADIUS_M}D * asin(sqrt(CASE WHEN lng1 + lat1 + lng2 + lat2 IS NOT NULL THEN least(1D, power(sin(radians(lat2 - lat1) / 2), 2)
             + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lng2 - lng1) / 2), 2)) END))""",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions of the session; returns their names."""
    for signature, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in _FUNCTIONS]
