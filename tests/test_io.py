import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from parcelwatt import dims
from parcelwatt.operators import audit, energy
from parcelwatt.plans.refresh import estimate_results, refresh
from parcelwatt.sources import buildings as B, feeds, sinks


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_feature_pages(spark, tmp_path):
    square = lambda x: {"type": "Polygon", "coordinates": [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]]}
    feature = lambda x, sn, floors: {"type": "Feature", "geometry": square(x), "properties": {"bd_mgt_sn": sn, "buld_nm": "n", "gro_flo_co": floors}}
    (tmp_path / "p").mkdir()
    write(tmp_path / "p" / "1.json", json.dumps({"type": "FeatureCollection", "features": [feature(0, "1" * 25, "5"), feature(3, "short", "x")]}))
    write(tmp_path / "p" / "2.json", json.dumps({"type": "FeatureCollection", "features": [feature(0, "1" * 25, "5")]}))
    out = B.footprints_from_features(B.read_feature_pages(spark, str(tmp_path / "p"))).orderBy("cx").collect()
    assert [(r["pnu"], r["grnd_flr"], r["height"], r["cx"]) for r in out] == [("1" * 19, 5, 16.5, 0.5), (None, None, None, 3.5)]
    assert B.valid_footprints(spark.createDataFrame([([[{"x": 0.0, "y": 0.0}]],)], "rings array<array<struct<x:double,y:double>>>")).count() == 0


def test_footprint_aliases(spark, tmp_path):
    spark.createDataFrame([("a", "11110", "x"), ("a", "11110", "y"), ("b", "22222", "z")], "PNU string, SGG_CD string, `건물명` string").write.parquet(str(tmp_path / "f"))
    df = B.read_footprints(spark, str(tmp_path / "f"), "11110")
    assert set(df.columns) == {"pnu", "sigungu_cd", "bld_name"} and df.count() == 1


XML = """<r><items><item><sigunguCd>11440</sigunguCd><bjdongCd>10100</bjdongCd><platGbCd>0</platGbCd><bun>0123</bun><ji>0004</ji><bldNm> a </bldNm><mainPurpsCdNm>업무시설</mainPurpsCdNm>
<totArea>100.5</totArea><archArea></archArea><useAprDay>20010101</useAprDay><engrGrade> </engrGrade><engrEpi>0</engrEpi><grndFlrCnt>7</grndFlrCnt><heit>0</heit><strctCdNm>RC</strctCdNm></item></items></r>"""


def test_ledger_xml(spark, tmp_path):
    path = write(tmp_path / "a.xml", XML)
    both = B.union_ledgers(B.read_ledger_xml(spark, path, "recap"), B.read_ledger_xml(spark, path, "title")).collect()
    recap, title = both
    assert recap["pnu"] == title["pnu"] == "1144010100101230004"
    assert (recap["bld_nm"], recap["tot_area"], recap["bld_area"], recap["enrgy_eff_rate"], recap["epi_score"], recap["grnd_flr_cnt"]) == ("a", 100.5, None, None, None, None)
    assert (title["grnd_flr_cnt"], title["bld_ht"], title["strct_nm"], title["use_apr_day"]) == (7, None, "RC", "20010101")


def test_ledger_csv_layouts(spark, tmp_path):
    coded = write(tmp_path / "c.csv", "시군구코드,법정동코드,대지구분코드,번,지,건물명,연면적(㎡),지상층수\n41190,11500,1,12,3,가,\"1,234.5\",4\n41190,0,1,12,3,나,1,1\n", "cp949")
    got = B.read_ledger_csv(spark, coded).collect()
    assert [(r["pnu"], r["bld_nm"], r["tot_area"], r["grnd_flr_cnt"]) for r in got] == [("4119011500100120003", "가", 1234.5, 4)]
    free = write(tmp_path / "f.csv", "﻿대지위치,시군구,법정동,주용도,연면적(제곱미터)\n경기도 부천시 원미구 중동 100,a,b,업무시설,10\n경기도 부천시 원미구 없는동 1,a,b,x,1\n")
    codes = spark.createDataFrame([("중동", "11500")], "dong string, bdong_code string")
    got = B.read_ledger_csv(spark, free, sigungu="41190", dong_codes=codes).collect()
    assert [(r["pnu"], r["main_purps_nm"], r["tot_area"]) for r in got] == [("4119011500101000000", "업무시설", 10.0)]


def test_meter_csv(spark, tmp_path):
    lines = ["측정시각,비고,전력량(kWh)", "2025-01-01 00:15:00,,1", "2025-01-01T00:30:00,,2", "2025/01/01 00:45,,3", "202501010100,,4", "2025-01-01 01:15,,5", "20250101 01:30,,\"1,234.5\"", "bad,,1", "2025-01-01 02:00,,", "2025-01-01 02:00,,x"]
    for encoding in ("utf-8-sig", "euc-kr"):
        good, bad = feeds.read_meter_csv(spark, write(tmp_path / f"{encoding}.csv", "\n".join(lines), encoding), 7, "electricity")
        rows = good.orderBy("recorded_at").collect()
        assert [r["value"] for r in rows] == [1.0, 2.0, 3.0, 4.0, 5.0, 1234.5] and rows[0]["recorded_at"] == dt.datetime(2025, 1, 1, 0, 15) and rows[0]["ts_id"] == 7
        assert bad.count() == 3
    good, bad = feeds.read_meter_csv(spark, write(tmp_path / "u.csv", "when,amount\n2025-01-01 00:00:00,5\n"), 1, "gas", "m3")
    assert good.first()["unit"] == "m3" and bad.count() == 0


def test_weather_and_shelters(spark, tmp_path):
    text = "# head\n11B10101 202501010500 202501010600 A 0 108 2 x y NW 2 N 5\n11B10101 1 2 3\n11B10102 202501010500 202501010600 A 0 108 2 x y ?? 9 ?? 5\n"
    got = feeds.read_weather_text(spark, write(tmp_path / "w.txt", text, "euc-kr")).collect()
    assert [(r["reg"], r["wind_direction"], r["wind_speed"]) for r in got] == [("11B10101", 0.0, 5.0)]
    item = lambda c, v, x=60: {"category": c, "fcstDate": "20250101", "fcstTime": "0600", "fcstValue": v, "nx": x, "ny": 127}
    page = {"response": {"body": {"items": {"item": [item("VEC", "350"), item("WSD", "2.5"), item("T1H", "1"), item("VEC", "9", 61)]}}}}
    rows = feeds.read_weather_json(spark, write(tmp_path / "w.json", json.dumps(page))).collect()
    assert [(r["grid_x"], r["wind_direction"], r["wind_speed"], r["measured_at"]) for r in rows] == [(60, 350.0, 2.5, dt.datetime(2025, 1, 1, 6))]
    shelter = lambda x, cap: {"FCLT_NM": "s", "XCRD": cap, "REFINE_WGS84_LOGT": x, "REFINE_WGS84_LAT": "37.5"}
    page = {"TBSHLTRRSVTBSH": {"row": [shelter("127.0", "30"), shelter("127.0", "many"), shelter("140", "1"), shelter("", "1")]}}
    assert [r["capacity"] for r in feeds.read_shelters(spark, write(tmp_path / "s.json", json.dumps(page)), (126.5, 37.3, 127.5, 37.8)).collect()] == [30, None]
    assert feeds.read_shelters(spark, str(tmp_path / "s.json")).count() == 4
    assert dims.shelters(spark).count() == 35 and dims.stations(spark).count() == 25


def test_energy_feeds(spark, tmp_path):
    lines = [{"pnu": "a", "useYm": m, "useQty": q} for m, q in (("202401", "10"), ("202402", "20"), ("202403", "30"))] + [{"pnu": "a", "useYm": "202403", "gasUseQnt": "30"}, {"pnu": "b", "useYm": "202401", "elecUseQnt": "99"}]
    monthly = feeds.read_monthly(spark, write(tmp_path / "m.json", "\n".join(map(json.dumps, lines))))
    assert [(r["pnu"], r["months"], r["annual_kwh"]) for r in energy.annualise_monthly(monthly).collect()] == [("a", 3, 360.0)]
    b = spark.createDataFrame([(1, "a", "업무시설", 100.0)], "gid int, pnu string, usage_type string, total_area double")
    row = energy.from_monthly(b, monthly).first()
    assert (row["total_energy"], row["heating"], row["data_tier"]) == (3.6, 1.08, 1)
    cert = {"response": {"body": {"items": {"item": [{"RGN_SCT_NAME": "서울", "LOC_ADDR": "x 1", "W_1ST_ENERGY_REQUIRE6": "120.5", "BLD_NM": "n", "GRD_NAME": "1"}, {"RGN_SCT_NAME": "부산", "LOC_ADDR": "x", "W_1ST_ENERGY_REQUIRE6": "1"}, {"RGN_SCT_NAME": "서울", "LOC_ADDR": "", "W_1ST_ENERGY_REQUIRE6": "1"}]}}}}
    got = feeds.read_certificates(spark, write(tmp_path / "c.json", json.dumps(cert)), "서울")
    assert [(r["address"], r["eui"]) for r in got.collect()] == [("x 1", 120.5)]
    assert energy.from_certificates(got.withColumns({"pnu": F.lit("p"), "usage_type": F.lit("업무시설")})).first()["heating"] == 36.15
    sim = "\n".join(json.dumps(x) for x in ({"ems": "E0", "building": "Hotel", "city": "Seoul", "validation": {"valid": True, "energy_j": 3.6e6 * 11345}}, {"ems": "E0", "building": "Hotel", "city": "Seoul"}))
    meta = feeds.read_sim_metadata(spark, write(tmp_path / "sim.jsonl", sim))
    from parcelwatt.operators.tables import simulated_eui

    assert [r["eui"] for r in simulated_eui(meta).collect()] == [1.0]
    run = "apartment_highrise_v1_pre1990_seoul_tmy_p0042"
    spark.createDataFrame([(run, 1, 2.0), ("odd", 1, 1.0)], "run_id string, hour int, kwh double").write.parquet(str(tmp_path / "h"))
    row = feeds.read_hourly_runs(spark, str(tmp_path / "h")).collect()
    assert [(r["archetype"], r["vintage"], r["city"]) for r in row] == [("apartment_highrise", "pre1990", "seoul")]


def test_partitioned_sinks(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame([(1, dt.datetime(2024, 12, 31, 23)), (2, dt.datetime(2025, 1, 1)), (3, dt.datetime(2025, 2, 1))], "ts_id int, recorded_at timestamp_ntz")
    sinks.write_readings(df, path)
    got = sinks.read_readings(spark, path, dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 31))
    assert [r["ts_id"] for r in got.collect()] == [2]
    assert "PartitionFilters: [isnotnull(year" in got._jdf.queryExecution().toString()
    region = str(tmp_path / "g")
    rows = lambda *v: spark.createDataFrame(list(v), "pnu string, v int")
    sinks.replace_region(rows(("11110" + "0" * 14, 1), ("11140" + "0" * 14, 1)), region)
    sinks.replace_region(rows(("11110" + "0" * 14, 2)), region)
    assert sorted((r["sgg"], r["v"]) for r in spark.read.parquet(region).collect()) == [(11110, 2), (11140, 1)]


def test_snapshot_can_read_itself(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.write_snapshot(spark.range(3), path)
    sinks.write_snapshot(spark.read.parquet(path).filter("id > 0"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2] and not os.path.exists(path + ".next") and not os.path.exists(path + ".old")


def test_snapshot_survives_a_broken_swap(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.write_snapshot(spark.range(3), path)
    os.rename(path, path + ".old")  # where a run that died between the two moves leaves it
    sinks.write_snapshot(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not os.path.exists(path + ".old")


def test_encoding_is_decided_on_the_whole_file(spark, tmp_path):
    lines = ["a,b"] * 1500 + ["가,나"]
    assert B.detect_encoding(spark, write(tmp_path / "k.csv", "\n".join(lines), "euc-kr")) == "MS949"
    (tmp_path / "x.csv").write_bytes(b"a,b\n\xff\xff\xff,1\n")
    with pytest.raises(ValueError):
        B.detect_encoding(spark, str(tmp_path / "x.csv"))


def test_exports(spark, tmp_path):
    row = {c: None for c in sinks.EXPORT_COLUMNS} | {"pnu": "p", "total_area": 1.5}
    types = {"built_year": "int", "floors_above": "int"} | {c: "double" for c in ("total_area", "height", "total_energy", "co2_kg_m2", "lng", "lat")}
    df = spark.createDataFrame([row], ", ".join(f"{c} {types.get(c, 'string')}" for c in sinks.EXPORT_COLUMNS)).coalesce(1)
    sinks.export_csv(df, str(tmp_path / "e"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "e")).collect()]
    assert lines == [",".join(sinks.EXPORT_COLUMNS), "p,,,,,1.5,,,,,,,,"]
    sinks.export_geojson_lines(df.withColumns({"lng": F.lit(127.0), "lat": F.lit(37.5)}), str(tmp_path / "j"), ["pnu", "built_year"])
    feature = json.loads(spark.read.text(str(tmp_path / "j")).first()["value"])
    assert feature == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [127.0, 37.5]}, "properties": {"pnu": "p", "built_year": None}}


def test_audit_rows(spark, tmp_path):
    path = str(tmp_path / "audit")
    with audit.record(spark, path, "load", {"n": 3}) as run:
        run.watch(spark.range(5)).write.parquet(str(tmp_path / "t"))
    try:
        with audit.record(spark, path, "load"):
            raise ValueError("no data")
    except ValueError:
        pass
    rows = {r["status"]: r for r in spark.read.parquet(path).collect()}
    assert rows["success"]["rows_upserted"] == 5 and rows["success"]["params"] == '{"n": 3}' and rows["failed"]["error_message"] == "no data"


def test_audit_does_not_wait_for_an_unwritten_frame(spark, tmp_path):
    path = str(tmp_path / "audit")
    with audit.record(spark, path, "idle", wait=1.0) as run:
        run.watch(spark.range(5))
    row = spark.read.parquet(path).first()
    assert row["status"] == "success" and row["rows_upserted"] is None


def test_refresh_and_estimates(spark, tmp_path):
    paths = {k: str(tmp_path / k) for k in ("footprints", "ledger", "buildings", "centroids", "risk")}
    fp = [(1, "1" * 19, "n", "업무시설", 5, 0, None, "20050101", 127.0, 37.5), (2, "2" * 19, "m", "공동주택", 3, 0, None, "", 127.1, 37.6)]
    spark.createDataFrame(fp, "gid long, pnu string, bld_nm string, usage_type string, grnd_flr int, ugrnd_flr int, height double, approval_date string, cx double, cy double").write.parquet(paths["footprints"])
    led = [("1" * 19, "r", "업무시설", "철근콘크리트", 7, 1, 0.0, 1000.0, 100.0, "20050101", "1등급", 1.0)]
    spark.createDataFrame(led, "pnu string, bld_nm string, main_purps_nm string, strct_nm string, grnd_flr_cnt int, ugrnd_flr_cnt int, bld_ht double, tot_area double, bld_area double, use_apr_day string, enrgy_eff_rate string, epi_score double").write.parquet(paths["ledger"])
    refresh(spark, paths)
    assert spark.read.parquet(paths["risk"]).count() == 2 and spark.read.parquet(paths["centroids"]).count() == 2
    b = spark.read.parquet(paths["buildings"])
    current = spark.createDataFrame([], "pnu string, total_energy double, heating double, cooling double, hot_water double, lighting double, ventilation double, simulation_type string, data_tier int, is_current boolean")
    out = {r["pnu"]: r for r in estimate_results(b, current, None, 2026).collect()}
    assert (out["1" * 19]["data_tier"], out["1" * 19]["total_energy"]) == (2, 135.0) and out["2" * 19]["data_tier"] == 4
    assert all(r["co2_kg_m2"] > 0 for r in out.values()) and out["2" * 19]["co2_kg_yr"] is None
