import datetime as dt

from pyspark.sql import functions as F

from parcelwatt import schemas
from parcelwatt.operators import carbon, energy, enrich, join, quality, resolve, stats, upsert


def test_enrich_priority_ties_and_parent(spark):
    fp = "gid long, pnu string, bld_nm string, usage_type string, grnd_flr int, ugrnd_flr int, height double, approval_date string"
    a, b, parent = "1111010100100010001", "1111010100100020003", "1111010100100020000"
    footprints = spark.createDataFrame([(1, a, "own", "창고시설", 2, 0, 0.0, "20050101"), (2, b, None, None, None, None, None, ""), (3, None, None, None, 1, None, 5.0, None), (4, a, None, None, 9, None, None, None)], fp)
    rows = [
        (a, "graded", "업무시설", None, None, None, None, 100.0, 50.0, "18500101", "1등급", 7.0), (a, "tall", "공동주택", "일반철골구조", 12, 2, 0.0, 900.0, 80.0, "19990101", None, None),
        (a, "nofloors", "공장", "목구조", None, None, 50.0, 5000.0, 80.0, "20990101", None, None), (parent, "parent", "판매시설", "벽돌구조", 3, 1, 11.0, 700.0, 70.0, "", None, None),
    ]
    ledger = spark.createDataFrame(rows, "pnu string, bld_nm string, main_purps_nm string, strct_nm string, grnd_flr_cnt int, ugrnd_flr_cnt int, bld_ht double, tot_area double, bld_area double, use_apr_day string, enrgy_eff_rate string, epi_score double")
    out = {r["gid"]: r for r in enrich.buildings(footprints, ledger).collect()}
    assert len(out) == 4
    one = out[1]
    assert (one["building_name"], one["usage_type"], one["structure_class"], one["floors_above"]) == ("graded", "업무시설", "steel", 12)
    assert abs(one["height"] - 12 * 3.3) < 1e-9 and one["built_year"] is None and one["vintage_class"] == "pre-1980" and one["total_area"] == 100.0
    two = out[2]
    assert (two["usage_type"], two["structure_class"], two["height"], two["built_year"], two["vintage_class"]) == ("판매시설", "masonry", 11.0, None, "pre-1980")
    three = out[3]
    assert (three["usage_type"], three["height"], three["floors_above"], three["size_class"]) == ("미분류", 5.0, 1, "small")
    assert out[4]["building_name"] == "graded"


BASE = "pnu string, total_energy double, data_tier int, reference_year int"


def test_tier_upserts(spark, rows):
    base = spark.createDataFrame([("a", 1.0, 4, 2020), ("b", 1.0, 1, 2020), ("c", 1.0, 2, 2020), ("d", 1.0, 2, None), ("e", 1.0, 2, 2022)], BASE)
    new = spark.createDataFrame([("a", 2.0, 2, 2021), ("b", 2.0, 4, 2025), ("c", 2.0, 2, 2020), ("d", 2.0, 2, 2001), ("e", 2.0, 2, 2021), ("f", 2.0, 3, 2020)], BASE)
    assert rows(upsert.by_tier(base, new), "pnu", "total_energy") == [("a", 2.0), ("b", 1.0), ("c", 2.0), ("d", 2.0), ("e", 2.0), ("f", 2.0)]
    got = rows(upsert.by_tier_and_year(base, new), "pnu", "total_energy", "action")
    assert got == [("a", 2.0, "updated"), ("b", 1.0, "kept"), ("c", 1.0, "kept"), ("d", 2.0, "updated"), ("e", 1.0, "kept"), ("f", 2.0, "inserted")]
    assert rows(upsert.by_tier_and_year(base, new, strict=False), "pnu", "action")[2] == ("c", "updated")
    assert rows(upsert.protect(base, new), "pnu", "total_energy") == [("a", 2.0), ("b", 1.0), ("c", 1.0), ("d", 1.0), ("e", 1.0), ("f", 2.0)]
    empty = base.limit(0)
    assert rows(upsert.by_tier(empty, new), "pnu") == rows(new, "pnu")


def test_insert_ignore_and_prefer_new(spark, rows):
    target = spark.createDataFrame([(1, "x", 1.0)], "k int, m string, v double")
    batch = spark.createDataFrame([(1, "x", 9.0), (2, "x", 5.0), (2, "x", 4.0)], "k int, m string, v double")
    assert rows(upsert.insert_ignore(target, batch, ["k", "m"], [F.col("v")])) == [(2, "x", 4.0)]
    assert rows(upsert.prefer_new(target, batch, ["k", "m"], [F.col("v")])) == [(1, "x", 9.0), (2, "x", 4.0)]


def test_backfill_and_fill(spark, rows):
    p = spark.createDataFrame([("a", 100.0, None, None, None), ("b", 50.0, 40.0, 10.0, 25.0), ("c", 1.0, None, None, None)], "pnu string, predicted_eui double, actual_eui double, error_abs double, error_pct double")
    r = spark.createDataFrame([("a", 80.0, 1, True), ("b", 1.0, 1, True), ("c", 5.0, 2, True)], "pnu string, total_energy double, data_tier int, is_current boolean")
    assert rows(upsert.backfill_actuals(p, r)) == [("a", 100.0, 80.0, 20.0, 25.0), ("b", 50.0, 40.0, 10.0, 25.0), ("c", 1.0, None, None, None)]
    assert rows(upsert.fill_from_predictions(r.filter("pnu <> 'a'"), p), "pnu", "total_energy", "data_tier") == [("a", 100.0, 3)]


def test_metered_pipeline_parts(spark, rows):
    day = dt.date(2025, 3, 1)
    daily = spark.createDataFrame([(1, "electricity", day, 10.0, 90.0), (1, "gas", day, 5.0, None), (1, "water", day, 99.0, 90.0), (1, "heat", day, 7.0, 10.0), (2, "water", day, 5.0, 99.0)], "ts_id long, meter_type string, day date, total_kwh double, coverage_pct double")
    mon = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, None)], "ts_id long, pnu string")
    annual = energy.annual_metered(daily, mon, 2025)
    assert rows(annual, "pnu", "elec_kwh", "gas_kwh", "dh_kwh", "total_kwh", "meter_count") == [("p1", 10.0, 5.0, 0.0, 15.0, 3)]
    results = energy.metered_results(annual, 2025)
    b = spark.createDataFrame([(1, "p1", "업무시설", 0.0)], "gid int, pnu string, usage_type string, total_area double")
    got = carbon.apply(results, b).first()
    assert got["co2_kg_yr"] == round(10 * 0.4781 + 5 * 0.2036, 1) and got["co2_kg_m2"] is None


def test_quality_and_bundle(spark):
    df = spark.createDataFrame([("1" * 19, "gas", 1), ("x", "steam", 9)], "pnu string, meter string, tier int")
    rules = {"pnu": quality.pnu_ok(F.col("pnu")), "meter": quality.meter_ok(F.col("meter")), "tier": quality.tier_ok(F.col("tier"))}
    ok, bad = quality.check(df, rules)
    assert ok.count() == 1 and bad.first()["reasons"] == ["pnu", "meter", "tier"]
    assert quality.period_days(" 30D ") == 30
    for text in ("30", "0d", "366d"):
        try:
            quality.period_days(text)
            raise AssertionError(text)
        except ValueError:
            pass
    b = spark.createDataFrame([(1, "p1", None, "a"), (2, "p2", "1", "a")], "gid int, pnu string, energy_grade string, usage_type string").withColumns({"cx": F.lit(1.0), "cy": F.lit(1.0), "total_area": F.lit(1.0)})
    r = spark.createDataFrame([("p1", 10.0, 4, True, "archetype")], "pnu string, total_energy double, data_tier int, is_current boolean, simulation_type string")
    row = stats.bundle(b, r).first()
    assert row["total_count"] == 2 and row["avg_energy"] == 10.0 and row["grade_distribution"] == {"1": 1, "unknown": 1} and row["usage_distribution"] == {"a": 2}
    assert stats.by_district(b, r).first()["zeb_pct"] == 100.0


def test_top_k_survives_a_hot_key(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    top = join.top_k(df, ["k"], [F.col("v").desc()], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(r["v"] for r in top.filter("k = 0").collect()) == [19995, 19998]


def test_resolution(spark, rows):
    fp = spark.createDataFrame([("1114010100101230004", "서울타워 빌딩"), ("1114010100101230000", "남산 상가"), ("1168010100100010000", "강남 파이낸스 센터"), ("4119510100100070000", None)], "pnu string, bld_nm string")
    certs = spark.createDataFrame([(1, "서울특별시 중구 을지동 123-4", "x"), (2, "서울특별시 강남구 테헤란로 152", "강남파이낸스 센터"), (3, "부산광역시 해운대구 우동 1-1", "서울타워"), (4, "서울특별시 중구 을지동 123번지", None), (5, "서울특별시 중구 을지동 9", "qq"), (6, "경기도 부천시 중동 7번지", None)], "id int, address string, bld_nm string")
    assert rows(resolve.address_to_pnu(certs, fp)) == [(1, "1114010100101230004", "lot"), (2, "1168010100100010000", "name"), (3, None, "no district"), (4, "1114010100101230000", "lot"), (5, None, "no match"), (6, "4119510100100070000", "lot")]


def test_whole_addresses_are_found_anywhere_in_a_text(spark, rows):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice("abc 가1-") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    asked = [t[a:a + n] for t in texts[:60] for a, n in ((2, 1), (1, 2), (3, 3), (0, 4), (2, 9), (0, 40))] + ["zzz", "abcz", "", "가1-가1-가"]
    buildings = spark.createDataFrame([(f"{i:019d}", t, None if i % 3 else t.upper()) for i, t in enumerate(texts)] + [("9", None, None)], "pnu string, road_addr string, jibun_addr string")
    certs = spark.createDataFrame([(i, q) for i, q in enumerate(asked)] + [(-1, None)], "id int, address string")
    for length in (None, 4):
        want = []
        for i, q in enumerate(asked):
            q = q.strip(" ")[:length].lower()
            hit = [f"{j:019d}" for j, t in enumerate(texts) if q and q in t.lower()]
            want += [(i, min(hit))] if hit else []
        assert sorted(rows(resolve.by_address(certs, buildings, length))) == sorted(want)
    assert resolve.by_address(certs.limit(0), buildings).count() == 0 and resolve.by_address(certs, buildings.limit(0)).count() == 0


def test_schemas_parse(spark):
    for name in ("FOOTPRINT", "LEDGER", "ENERGY_RESULT", "MONITORED", "READING", "READING_DAILY", "ANOMALY", "EDGE", "WEATHER", "SHELTER", "PREDICTION"):
        assert len(spark.createDataFrame([], getattr(schemas, name)).columns) > 3


def test_similar_names_match_brute_force_with_hot_trigrams(spark, monkeypatch):
    import random
    import re

    from parcelwatt.operators import spatial

    monkeypatch.setattr(spatial, "HOT", 3)
    rnd = random.Random(4)
    words = ["tower", "towers", "plaza", "park", "hill", "house", "apt", "apartment", "seoul", "garden"]
    name = lambda: " ".join(rnd.sample(words, rnd.randint(1, 3))) + rnd.choice(["", " 1", " 22"])
    left, right = [("x", name()) for _ in range(60)], [("x", name()) for _ in range(60)]

    def tri(text):
        return {("  " + w + " ")[i:i + 3] for w in re.split(r"[^a-z0-9]+", text.lower()) if w for i in range(len(w) + 1)}

    jac = lambda a, b: len(tri(a) & tri(b)) / len(tri(a) | tri(b))
    want = {(a, b) for _, a in left for _, b in right if jac(a, b) >= 0.3}
    frame = lambda rows_: spark.createDataFrame(rows_, "block string, name string")
    got = {(r["name_a"], r["name_b"]) for r in resolve.similar_names(frame(left), frame(right)).collect()}
    assert got == want and want
    best = {r["name_a"]: (r["name_b"], round(r["similarity"], 9)) for r in resolve.best_similar(frame(left), frame(right)).collect()}
    ranked = {a: min((-jac(a, b), b) for _, b in right) for _, a in left}
    assert best == {a: (b, round(-j, 9)) for a, (j, b) in ranked.items() if -j >= 0.3}


def test_names_with_a_common_word_leave_early(spark, monkeypatch):
    """All names share a word, so all pairs pass the threshold; the best is found without making them."""
    words = ["Customer#%09d" % (i * 7) for i in range(1, 120)] + ["ab", "Customer", "abc Customer of a very long name with many words"]
    asked = ["Customer#%09d" % i for i in range(1, 60)] + ["ac", "Custom", "zzz"]
    left = spark.createDataFrame([("x", n) for n in asked], "block string, name string")
    right = spark.createDataFrame([("x", n) for n in words], "block string, name string")
    seen = []
    plain = resolve.similar_names
    monkeypatch.setattr(resolve, "similar_names", lambda l, r, t: seen.append(l.count()) or plain(l, r, t))
    got = {r.name_a: (r.name_b, r.similarity) for r in resolve.best_similar(left, right).collect()}

    def grams(n):
        return {("  " + w + " ")[i:i + 3] for w in n.lower().replace("#", " ").split() for i in range(len(w) + 1)}

    for n in asked:
        all_ = [(-len(grams(n) & grams(o)) / len(grams(n) | grams(o)), o) for o in words]
        s, o = min(all_)
        assert got.get(n) == ((o, -s) if -s >= 0.3 else None)
    assert seen[0] <= 10


def test_names_are_split_into_trigrams_once(spark, monkeypatch):
    """Two blocks with names in common and characters of four bytes: each side is split once, the best name is that of the own block, and nothing is asked of the plain search once all names have left."""
    split, late = [], []
    plain = resolve.trigrams
    monkeypatch.setattr(resolve, "trigrams", lambda c: split.append(1) or plain(c))
    monkeypatch.setattr(resolve, "similar_names", lambda *a: late.append(a))
    words = [("x", "Customer#%09d" % (i * 7)) for i in range(1, 60)] + [("y", "Customer#%09d" % (i * 7 + 1)) for i in range(1, 60)] + [("y", "가나다라마바사아자𠀀𠀁")]
    asked = [("x", "Customer#%09d" % i) for i in range(101, 140)] + [("y", "가나다라마바사아자𠀀𠀂"), ("y", "Customer#%09d" % 120)]
    frame = lambda rows_: spark.createDataFrame(rows_, "block string, name string")
    got = {(r.block, r.name_a): (r.name_b, r.similarity) for r in resolve.best_similar(frame(asked), frame(words)).collect()}

    def grams(n):
        return {("  " + w + " ")[i:i + 3] for w in n.lower().replace("#", " ").split() for i in range(len(w) + 1)}

    for block, n in asked:
        s, o = min((-len(grams(n) & grams(o)) / len(grams(n) | grams(o)), o) for b, o in words if b == block)
        assert got[block, n] == (o, -s)
    assert len(split) == 2 and not late
