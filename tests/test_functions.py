from pyspark.sql import functions as F

from parcelwatt import dims
from parcelwatt.functions import classify, energy, geo, hazard, pnu
from parcelwatt.operators import carbon, energy as en, retrofit


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict(recursive=True)


def lit(*values):
    return [F.lit(v) for v in values]


def test_parcel_key(spark):
    got = one(
        spark, a=pnu.generate(*lit("11440", "10100", "0", "123", "4")), b=pnu.generate(*lit("11440", "10100", "1", "12345", "4")),
        mapped=pnu.generate(*lit("11440", "10100", "9", "1", "0"), default_kind="1"), raw=pnu.generate(*lit("11440", "10100", "2", "1", "0"), map_kind=False),
        p=pnu.parse(F.lit("1144010100101230004")), short=pnu.parse(F.lit("123")), sn=pnu.mgt_sn(F.lit("1144010100101230004"), F.lit("1")),
        bad=pnu.mgt_sn(F.lit("1144010100101230004"), F.lit("1234567")), back=pnu.from_mgt_sn(F.lit("1144010100101230004000001")),
    )
    assert got["a"] == "1144010100101230004" and got["b"] is None
    assert got["mapped"] == "1144010100100010000" and got["raw"][10] == "2"
    assert got["p"] == {"sigungu_code": "11440", "bdong_code": "10100", "land_kind": "1", "land_kind_name": "대지", "bon": "0123", "ji": "0004"}
    assert got["short"] is None and got["bad"] is None
    assert got["sn"] == "1144010100101230004000001" and got["back"] == "1144010100101230004"


def test_addresses(spark):
    got = one(
        spark, a=pnu.parse_address(F.lit("강서구 오곡동 1-6번지")), b=pnu.parse_address(F.lit("강서구 오곡동 12번지")), none=pnu.parse_address(F.lit("어딘가")),
        t1=pnu.parse_lot_tokens(F.lit("경기도 부천시 소사구 계수동 67-5")), t2=pnu.parse_lot_tokens(F.lit("경기도 부천시 원미구 중동 100")),
        t3=pnu.parse_lot_tokens(F.lit("경기도 부천시 오정구 대장동 산 1-2")), t4=pnu.parse_lot_tokens(F.lit("경기도 부천시 소사구 계수동 67-5번지")), t5=pnu.parse_lot_tokens(F.lit("하나")),
        g=pnu.sgg_from_text(F.lit("서울특별시 동대문구 x"), dims.district_pairs("11")), h=pnu.sgg_from_text(F.lit("서울 중구 x"), dims.district_pairs("11")),
    )
    assert (got["a"]["dong"], got["a"]["bon"], got["a"]["ji"]) == ("오곡동", 1, 6)
    assert (got["b"]["bon"], got["b"]["ji"]) == (12, 0) and got["none"] is None
    lots = [(got[k]["dong"], got[k]["bon"], got[k]["ji"], got[k]["mountain"]) for k in ("t1", "t2", "t3", "t4")]
    assert lots == [("계수동", 67, 5, False), ("중동", 100, 0, False), ("대장동", 1, 2, True), ("계수동", 67, 5, False)]
    assert got["t5"] is None and (got["g"], got["h"]) == ("11230", "11140")


def test_classes(spark):
    null = F.lit(None)
    got = one(
        spark, h1=classify.height(F.lit(25.0), null.cast("double"), F.lit(3)), h2=classify.height(F.lit(0.0), F.lit(0.0), F.lit(5)), h3=classify.height(null.cast("double"), null.cast("double"), null.cast("int")),
        h4=classify.height(F.lit(900.0), null.cast("double"), F.lit(1)), y1=classify.built_year(F.lit("18500101"), F.lit("20100101")), y2=classify.built_year(F.lit(""), F.lit("20100101")),
        y3=classify.built_year(F.lit("abcd"), F.lit("2010")), v=classify.vintage(null.cast("int")), v2=classify.vintage(F.lit(2000)), v5=classify.vintage5(null.cast("int")), v6=classify.vintage5(F.lit(2018)),
        s=classify.structure_class(null.cast("string")), s2=classify.structure_class(F.lit("일반목구조")), s3=classify.structure_class(F.lit("철골철근콘크리트")), u=classify.usage_key(F.lit(" 업무시설 ")),
        u2=classify.usage_key(F.lit("  ")), u3=classify.usage_key(F.lit("Office X")), z=classify.size_class(null.cast("double")), z2=classify.size_class(F.lit(3000.0)),
    )
    assert (got["h1"], got["h2"], got["h3"], got["h4"]) == (25.0, 16.5, 10.0, 650.0) or abs(got["h2"] - 16.5) < 1e-9
    assert (got["y1"], got["y2"], got["y3"]) == (None, 2010, None)
    assert (got["v"], got["v2"], got["v5"], got["v6"]) == ("1980-2000", "1980-2000", "2001_2010", "2018_plus")
    assert (got["s"], got["s2"], got["s3"]) == ("RC", "masonry", "RC")
    assert (got["u"], got["u2"], got["u3"], got["z"], got["z2"]) == ("office", "apartment", "office x", "small", "large")


def test_degradation_and_grades(spark):
    got = one(
        spark, a=energy.degradation(F.lit(2020), 2026), b=energy.degradation(F.lit(2010), 2026), c=energy.degradation(F.lit(2000), 2026), d=energy.degradation(F.lit(1990), 2026),
        e=energy.degradation(F.lit(None).cast("int"), 2026), g=energy.grade_eui(F.lit(" 1++등급 ")), g2=energy.grade_eui(F.lit("A")), g3=energy.grade_eui(F.lit("등급외")), c1=energy.city_of(F.lit("43112")), c2=energy.city_of(F.lit("99999")),
        m=energy.eui(F.lit(1000.0), F.lit(0.0), F.lit("tier_c_metered")), m2=energy.eui(F.lit(1000.0), F.lit(8.0), F.lit("tier_c_metered")), m3=energy.eui(F.lit(120.0), F.lit(8.0), F.lit("archetype")),
        k=energy.total_kwh(*[F.lit(None).cast("double")] * 3), k2=energy.total_kwh(F.lit(0.0), F.lit(5.0), F.lit(5.0)), k3=energy.total_kwh(F.lit(None).cast("double"), F.lit(5.0), F.lit(None).cast("double")),
    )
    assert [got[k] for k in "abcde"] == [1.0, 1.3, 1.7, 2.0, 2.0]
    assert (got["g"], got["g2"], got["g3"], got["c1"], got["c2"]) == (75.0, 45.0, None, "cheongju", "seoul")
    assert (got["m"], got["m2"], got["m3"]) == (None, 125.0, 120.0) and (got["k"], got["k2"], got["k3"]) == (None, 0.0, 5.0)


def test_carbon_totals(spark):
    cols = "id int, total_energy_kwh double, area_m2 double, usage_type string, elec_kwh double, gas_kwh double, dh_kwh double"
    data = [(1, 500000.0, 3000.0, "office", None, None, None), (2, 100000.0, None, "office", None, None, None), (3, 0.0, 1000.0, None, None, None, None),
            (4, 100000.0, 1000.0, "x", -5000.0, 60000.0, None), (5, -1.0, None, None, None, None, None), (6, 1000.0, 10.0, None, 600.0, None, None)]
    out = {r["id"]: r for r in carbon.of_totals(spark.createDataFrame(data, cols)).collect()}
    assert (out[1]["co2_kg_m2"], out[1]["primary_energy_kwh_m2"]) == (70.53, 403.3)
    assert out[1]["co2_kg_yr"] == 211600.0
    assert out[2]["co2_kg_m2"] is None and out[2]["co2_kg_yr"] > 0
    assert (out[3]["co2_kg_yr"], out[3]["co2_kg_m2"], out[5]["co2_kg_m2"]) == (0.0, 0.0, None)
    assert out[4]["co2_kg_yr"] == 12216.0
    assert out[6]["co2_kg_yr"] == round(1000 * (0.65 * 0.4781 + 0.35 * 0.2036), 1)


def test_fuel_mix_sums_to_one(spark):
    assert all(abs(r[0] - 1) < 1e-9 for r in dims.fuel_mix(spark).selectExpr("elec + gas + district_heat").collect())
    assert all(abs(r[0] - 1) < 1e-9 for r in dims.end_use_ratios(spark).selectExpr("heating + cooling + hot_water + lighting + ventilation").collect())


def _simulate(eui, co2, area, vintage, usage, ids):
    """Row-wise statement of the retrofit rule, for comparison."""
    from parcelwatt.dims import values as V

    known = {m[0]: m for m in V.RETROFIT}
    at = lambda t: dict(zip(V.VINTAGES, t)).get(vintage, t[-1])
    rest, total, cost = eui, 0.0, 0
    for i in ids:
        _, _, c, h, k, lt = known[i]
        s = eui * 0.15 * at(lt) if lt else rest * (0.45 * at(h) + 0.20 * at(k))
        rest, total, cost = max(rest - s, 0), total + s, cost + c
    e = V.PRICE_ELEC_SHARE.get(usage, 0.65)
    return round(eui - total, 1), round(total, 2), int(cost * area) if area else 0, int(total * (area or 0) * (e * 120 + (1 - e) * 80))


def test_retrofit(spark):
    cols = "pnu string, eui_kwh_m2 double, co2_kg_m2 double, total_area_m2 double, vintage_class string, usage_type string"
    data = [("a", 150.0, 45.0, 3000.0, "1980-2000", "업무시설"), ("b", 150.0, None, None, None, None), ("c", 0.0, 1.0, 1.0, None, None), ("d", 150.0, 45.0, 3000.0, "pre-1980", "업무시설")]
    df = spark.createDataFrame(data, cols)
    out = {r["pnu"]: r for r in retrofit.project(df).collect()}
    assert set(out) == {"a", "b", "d"}
    ids = [m["id"] for m in out["a"]["measures"]]
    assert ids == ["window", "wall_insulation", "roof_insulation", "led_lighting", "hvac_upgrade"]
    want = _simulate(150.0, 45.0, 3000.0, "1980-2000", "업무시설", ids)
    assert (out["a"]["eui_after"], out["a"]["eui_saving_kwh_m2"], out["a"]["cost_total_krw"], out["a"]["annual_saving_krw"]) == want
    assert out["b"]["cost_total_krw"] == 0 and out["b"]["payback_years"] is None and out["b"]["co2_after_kg_m2"] is None
    assert out["d"]["eui_saving_kwh_m2"] > out["a"]["eui_saving_kwh_m2"]
    assert abs(sum(m["eui_saving_kwh_m2"] for m in out["a"]["measures"]) - out["a"]["eui_saving_kwh_m2"]) < 0.05
    few = retrofit.project(df, ["led_lighting", "unknown"]).filter("pnu = 'a'").first()
    assert [m["id"] for m in few["measures"]] == ["led_lighting"]
    assert retrofit.project(df, []).filter("pnu = 'a'").first()["eui_after"] == 150.0


def test_archetype_match_and_fallback(spark):
    cols = "gid int, usage_type string, built_year int, structure_class string"
    data = [(1, "공동주택", 2015, "RC"), (2, "업무시설", 2010, "steel"), (3, "알수없음", 1995, "RC"), (4, "판매시설", 1970, "steel"), (5, None, None, None)]
    df = spark.createDataFrame(data, cols)
    out = {r["gid"]: r for r in en.match_archetype(df, 2026).collect()}
    assert out[1]["ref_total"] == 90.0 and abs(out[1]["wall_uvalue"] - 0.27 * 1.3) < 1e-9
    assert out[2]["ref_total"] == 138.0
    assert out[3]["ref_total"] == 150.0 and out[3]["wall_base"] is None
    assert out[4]["ref_total"] == 220.0
    assert out[5]["usage_key"] == "apartment" and abs(out[5]["wall_uvalue"] - 0.76 * 2) < 1e-9
    strict = {r["gid"]: r for r in en.match_archetype(df, 2026, strict_compat=True).collect()}
    assert strict[2]["ref_total"] == 140.0


def test_city_ratio(spark):
    got = {(r["archetype"], r["city"]): r["ratio"] for r in en.city_ratio(spark).collect()}
    assert got[("apartment_highrise", "daejeon")] == 1.0101 and got[("office", "seoul")] == 1.0 and ("unknown", "seoul") not in got


def test_wind_and_scores(spark):
    got = one(
        spark, calm=hazard.wind_factor(F.lit(90.0), F.lit(0.0), F.lit(0.0)), along=hazard.wind_factor(F.lit(180.0), F.lit(0.0), F.lit(10.0)), against=hazard.wind_factor(F.lit(0.0), F.lit(0.0), F.lit(10.0)),
        strong=hazard.wind_factor(F.lit(0.0), F.lit(0.0), F.lit(40.0)), n=hazard.compass_degrees(F.lit("N"), F.lit("SW")), w=hazard.compass_degrees(F.lit("??"), F.lit("sw")), old=hazard.age_score(F.lit(1985), F.lit(12)),
        h=hazard.height_score(F.lit(None).cast("int")), h2=hazard.height_score(F.lit(20)), u=hazard.usage_score(F.lit(None).cast("string")), s=hazard.structure_score(F.lit(None).cast("string")),
        b=geo.bearing(F.lit(127.0), F.lit(37.5), F.lit(127.1), F.lit(37.5)),
    )
    assert got["calm"] == 1.0 and abs(got["along"] - 1.5) < 1e-9 and abs(got["against"] - 0.5) < 1e-9 and got["strong"] == 0.0
    assert (got["n"], got["w"]) == (0.0, 225.0) and (got["old"], got["h"], got["h2"], got["u"], got["s"]) == (25, 0, 10, 10, 15)
    assert 89 < got["b"] < 90


def test_polygons(spark):
    square = '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]],[[0.5,0.5],[1,0.5],[1,1],[0.5,1],[0.5,0.5]]]}'
    multi = '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[9,5],[9,9],[5,9],[5,5]]]]}'
    df = spark.createDataFrame([(square, multi)], "s string, m string").select(geo.from_geojson(F.col("s"))[0].alias("s"), geo.from_geojson(F.col("m")).alias("m"))
    got = df.select(
        geo.ring_area(F.col("s")[0]).alias("area"), geo.centroid(F.col("s")).alias("c"), geo.bbox(F.col("s")).alias("b"), geo.is_valid(F.col("s")).alias("ok"),
        geo.contains(F.col("s"), F.lit(0.75), F.lit(0.75)).alias("hole"), geo.contains(F.col("s"), F.lit(1.5), F.lit(1.5)).alias("inside"), geo.contains(F.col("s"), F.lit(3.0), F.lit(1.0)).alias("out"),
        geo.bbox(geo.largest_part(F.col("m"))).alias("big"), geo.is_valid(F.array(F.slice(F.col("s")[0], 1, 3))).alias("open"),
    ).first()
    assert got["area"] == 4.0 and got["ok"] and not got["open"] and (got["hole"], got["inside"], got["out"]) == (False, True, False)
    assert abs(got["c"]["x"] - (4 * 1 - 0.25 * 0.75) / 3.75) < 1e-9 and (got["b"]["xmin"], got["b"]["ymax"]) == (0.0, 2.0) and got["big"]["xmin"] == 5.0


def test_sql_functions(spark):
    from parcelwatt.functions.registry import register_functions

    assert "pnu_generate" in register_functions(spark)
    row = spark.sql("SELECT pnu_generate('11440','10100','0','123','4') a, pnu_generate('11440','10100','0','12345','4') b, pnu_mgt_sn('1144010100101230004','1') c, wind_factor(180, 0, 10) w").first()
    assert (row.a, row.b, row.c) == ("1144010100101230004", None, "1144010100101230004000001") and abs(row.w - 1.5) < 1e-9
