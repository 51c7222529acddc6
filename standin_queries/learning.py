"""Features, training sets, splits, models and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwatt.dims import values as V
from parcelwatt.operators import ml
from standin_queries.base import BATCHES, BUILDING, R, RESULT, batches, building, query, result, rounded, table
from standin_queries.energy import MATCHED, YEAR


def predictions(spark, sf):
    li = table(spark, sf, "lineitem")
    df = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("pnu"), F.col("l_linenumber").cast("long").alias("model_version_id"), F.lit("annual").alias("temporal_scale"), F.lit("eui").alias("target_variable"),
        "l_returnflag", "l_linestatus", (F.col("l_quantity") * 1000).alias("predicted_eui"), F.col("l_extendedprice").alias("actual_eui"), F.col("l_shipdate").alias("predicted_at"))
    return ml.errors(df)


PRED = """pred0 AS (SELECT l_orderkey || '-' || l_linenumber AS pnu, l_linenumber AS model_version_id, l_returnflag, l_linestatus, l_quantity * 1000 AS p, l_extendedprice AS a, l_shipdate AS at_ FROM lineitem),
pred AS (SELECT *, abs(p - a) AS ea, abs(p - a) / nullif(a, 0) * 100 AS ep FROM pred0)"""


def _registry(spark, sf):
    """Registry and versions: one model per line status, one version per line number."""
    v = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.max("l_shipdate").alias("created_at"))
    versions = v.select(F.col("l_linenumber").cast("long").alias("id"), (F.col("l_linenumber") % 2).cast("long").alias("model_id"), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("version_tag"), "created_at")
    registry = versions.select(F.col("model_id").alias("id")).distinct().select("id", F.concat(F.lit("model_"), F.col("id").cast("string")).alias("model_name"), F.lit("xgboost").alias("model_type"), F.lit("production").alias("stage"))
    return registry, versions


@query("accuracy", f"""WITH {PRED} SELECT model_version_id, 'v' || model_version_id AS version_tag, 'model_' || (model_version_id % 2) AS model_name, count(*) AS prediction_count, {R('sqrt(avg(ea * ea))', 3)} AS rmse, {R('avg(ep)', 2)} AS mape,
 {R('1 - avg(ea * ea) / nullif(var_samp(a), 0)', 4)} AS r_squared, {R('avg(p)', 1)} AS avg_predicted, {R('avg(a)', 1)} AS avg_actual, {R('max(ea)', 1)} AS max_error_abs FROM pred WHERE a >= 5 GROUP BY model_version_id""")
def accuracy(spark, sf):
    registry, versions = _registry(spark, sf)
    df = ml.accuracy(predictions(spark, sf), versions, registry)
    return df.select("model_version_id", "version_tag", "model_name", "prediction_count", "rmse", "mape", "r_squared", "avg_predicted", "avg_actual", "max_error_abs")


@query("star_accuracy", f"""WITH {PRED} SELECT 'model_' || (model_version_id % 2) AS model_name, l_returnflag, count(*) AS n, {R('avg(ep)', 1)} AS mape FROM pred GROUP BY 1, 2""")
def star_accuracy(spark, sf):
    registry, versions = _registry(spark, sf)
    v = versions.join(registry.select(F.col("id").alias("model_id"), "model_name"), "model_id").select(F.col("id").alias("model_version_id"), "model_name")
    return ml.accuracy_by_segment(predictions(spark, sf).join(v, "model_version_id"), ["model_name", "l_returnflag"]).drop("rmse")


@query("latest_version", """WITH v AS (SELECT l_linenumber AS id, l_linenumber % 2 AS model_id, max(l_shipdate) AS created_at FROM lineitem GROUP BY 1, 2) SELECT 'model_' || model_id AS model_name, 'v' || id AS version_tag FROM v QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY created_at DESC, id DESC) = 1""")
def latest_version(spark, sf):
    return ml.latest_versions(*_registry(spark, sf)).select("model_name", "version_tag")


@query("accuracy_segment", f"""WITH {PRED} SELECT l_returnflag, l_linestatus, count(*) AS n, {R('avg(ep)', 1)} AS mape, {R('sqrt(avg(ea * ea))', 1)} AS rmse FROM pred GROUP BY 1, 2""")
def accuracy_segment(spark, sf):
    return ml.accuracy_by_segment(predictions(spark, sf), ["l_returnflag", "l_linestatus"])


@query("regression_metrics", f"""WITH {PRED} SELECT count(*) AS n, {R('sqrt(sum((a - p) * (a - p)) / count(*))', 3)} AS rmse, {R('avg(abs(a - p))', 3)} AS mae, {R('avg(abs(a - p) / greatest(a, 1)) * 100', 3)} AS mape, {R('1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*))', 6)} AS r2 FROM pred""")
def regression_metrics(spark, sf):
    return rounded(rounded(ml.regression_metrics(predictions(spark, sf)), 3, "rmse", "mae", "mape"), 6, "r2")


@query("prediction_history", f"""WITH {PRED} SELECT 'k' || model_version_id || l_returnflag AS pnu, strftime(at_, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY model_version_id, l_returnflag ORDER BY at_ DESC) AS rn FROM pred) WHERE rn <= 90 GROUP BY 1, 2""")
def prediction_history(spark, sf):
    p = predictions(spark, sf).withColumn("pnu", F.concat(F.lit("k"), F.col("model_version_id").cast("string"), F.col("l_returnflag")))
    return ml.history(p, p, 90).groupBy("pnu", F.date_format("predicted_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


_DEF = {"u": " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.USAGE_CODES.items()), "v": " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.VINTAGE_CODES.items()), "s": " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.STRUCTURE_CODES.items())}
# Unknown years are matched as 1990 by the features.
_FEAT = MATCHED.replace("keyed AS (SELECT *,", "keyed AS (SELECT * REPLACE (coalesce(built_year, 1990) AS built_year), built_year AS y0,").replace("SELECT k.gid,", "SELECT k.gid, k.y0, k.total_area,")
_HDD, _CDD, _SOL, _TMP = V.ANNUAL_WEATHER


@query("ml_features", f"""WITH {_FEAT}, f AS (SELECT *, wall_uvalue * deg AS w, window_uvalue * deg AS wi, CASE usage_key {_DEF['u']} ELSE 0 END::DOUBLE AS ue, ln(1 + greatest(coalesce(nullif(total_area, 0), 500), 1)) AS al FROM matched)
 SELECT gid, {R('w', 4)} AS wall_uvalue, {R('wi', 4)} AS window_uvalue, CASE mv {_DEF['v']} ELSE 1 END::DOUBLE AS vintage_class_enc, ue AS usage_type_enc, CASE structure_class {_DEF['s']} ELSE 0 END::DOUBLE AS structure_type_enc,
 {R('al', 6)} AS total_area_log, greatest(floors_above, 1)::DOUBLE AS floors, least(greatest(coalesce({YEAR} - y0, 40), 0), 120)::DOUBLE AS built_year_age, {R(f'w * {_HDD}', 3)} AS "wall_uvalue_x_HDD18", {R(f'wi * {_CDD}', 3)} AS "window_uvalue_x_CDD24",
 {R('al * (ue + 1)', 6)} AS area_x_usage, {R(f'{_SOL}', 6)} AS solar_rad_avg FROM f""")
def ml_features(spark, sf):
    df = ml.features(building(spark, sf), YEAR)
    df = df.select("gid", "wall_uvalue", "window_uvalue", "vintage_class_enc", "usage_type_enc", "structure_type_enc", "total_area_log", "floors", "built_year_age", "wall_uvalue_x_HDD18", "window_uvalue_x_CDD24", "area_x_usage", "solar_rad_avg")
    return rounded(rounded(rounded(df, 4, "wall_uvalue", "window_uvalue"), 3, "wall_uvalue_x_HDD18", "window_uvalue_x_CDD24"), 6, "total_area_log", "area_x_usage", "solar_rad_avg")


_TRAIN = RESULT + f""", tr AS (SELECT b.pnu, b.usage_type, b.vintage_class, r.data_tier, CASE WHEN r.simulation_type = 'tier_c_metered' THEN {R('r.total_energy / b.total_area', 1)} ELSE r.total_energy END AS eui FROM building b JOIN result r USING (pnu)
 WHERE r.is_current AND r.data_tier IN (1, 2) AND b.total_area > 0),
train AS (SELECT * FROM tr WHERE eui BETWEEN 10 AND 2000)"""


@query("training_rows", f"WITH {_TRAIN} SELECT pnu, data_tier, eui FROM train")
def training_rows(spark, sf):
    return ml.training_rows(building(spark, sf), result(spark, sf)).select("pnu", "data_tier", "eui")


def _set(spark, sf):
    base, new = batches(spark, sf)
    vint = F.col("reference_year") % 4
    named = lambda df: df.select("pnu", (F.col("total_energy") / 1000).alias("eui"), F.when(vint == 0, "pre-1980").when(vint == 1, "1980-2000").when(vint == 2, "2001-2010").otherwise("post-2010").alias("vintage_class"))
    return ml.training_set(named(base.filter("data_tier = 1")), named(new))


_SET = BATCHES + """, s AS (SELECT pnu, total_energy / 1000 AS eui, reference_year % 4 AS v, 1 AS source_tier, 5.0::DOUBLE AS weight FROM base WHERE data_tier = 1
 UNION ALL SELECT pnu, total_energy / 1000, reference_year % 4, 2, 1.0 FROM new n WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.pnu = n.pnu AND b.data_tier = 1)),
named AS (SELECT *, CASE v WHEN 0 THEN 'pre-1980' WHEN 1 THEN '1980-2000' WHEN 2 THEN '2001-2010' ELSE 'post-2010' END AS vintage_class FROM s)"""


@query("training_set", f"WITH {_SET} SELECT pnu, vintage_class, source_tier, weight, {R('eui', 4)} AS eui FROM named")
def training_set(spark, sf):
    return rounded(_set(spark, sf), 4, "eui")


@query("split_exact", f"""WITH {_SET} SELECT vintage_class, count(*) FILTER (WHERE source_tier = 1) AS tier1_train, CAST(round(0.2 * count(*) FILTER (WHERE source_tier = 2)) AS BIGINT) AS validation, count(*) AS n FROM named GROUP BY 1""")
def split_exact(spark, sf):
    marked = ml.split(_set(spark, sf))
    return marked.groupBy("vintage_class").agg(
        F.count(F.when((F.col("source_tier") == 1) & ~F.col("is_validation"), 1)).alias("tier1_train"), F.count(F.when(F.col("is_validation"), 1)).alias("validation"), F.count(F.lit(1)).alias("n"))


@query("folds", f"""WITH {_SET}, c AS (SELECT vintage_class, count(*) AS n FROM named WHERE source_tier = 2 GROUP BY 1) SELECT vintage_class, f AS fold, n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS rows FROM c, range(5) t(f)""")
def folds(spark, sf):
    return ml.folds(_set(spark, sf)).filter("fold IS NOT NULL").groupBy("vintage_class", "fold").agg(F.count(F.lit(1)).alias("rows"))


def _feature_rows(spark, sf):
    current = result(spark, sf).filter("is_current").select("pnu", (F.col("primary_energy_kwh_m2") / 2).alias("eui"))
    return ml.features(building(spark, sf).drop("epi_score"), YEAR).join(current, "pnu").withColumn("weight", F.lit(1.0))


@query("gbt_fit")
def gbt_fit(spark, sf):
    """Fit on every building and score it again."""
    rows = _feature_rows(spark, sf)
    model = ml.fit(rows, _small())
    return ml.regression_metrics(model.transform(ml.assemble(rows)), "eui", "prediction")


def _small():
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol="features", labelCol="eui", weightCol="weight", maxIter=5, maxDepth=3, seed=42)


@query("importance")
def importance(spark, sf):
    return ml.importance(ml.fit(_feature_rows(spark, sf), _small()), spark)


@query("batch_predict")
def batch_predict(spark, sf):
    rows = _feature_rows(spark, sf)
    model = ml.fit(rows, _small())
    scored = model.transform(ml.assemble(rows)).select("usage_key", "eui", F.col("prediction").alias("predicted_eui"))
    df = ml.predict(model, building(spark, sf), ml.residual_bands(scored), YEAR)
    return df.select("gid", "pnu", "predicted_eui", "confidence_low", "confidence_high")


_FE = f"""f AS (SELECT l_orderkey, l_linenumber, (l_linenumber - 1) % 4 + 1 AS t, l_quantity * 10 AS p, l_extendedprice / 500 AS eui, l_tax * 1000 AS epi, CASE l_returnflag WHEN 'A' THEN 'office' WHEN 'R' THEN 'apartment' ELSE 'other' END AS k FROM lineitem),
g AS (SELECT *, p * 0.3::DOUBLE + epi * CASE k WHEN 'office' THEN 0.45 WHEN 'apartment' THEN 0.62 ELSE 0.5 END::DOUBLE * 0.7::DOUBLE AS bl FROM f)"""


@query("final_estimate", f"""WITH {_FE} SELECT l_orderkey, l_linenumber, {R('CASE WHEN t = 1 AND eui > 0 THEN eui WHEN t = 2 AND epi > 0 THEN bl ELSE p END', 4)} AS final_eui, {R('CASE WHEN t = 1 AND eui > 0 THEN eui * 0.9::DOUBLE WHEN t = 2 AND epi > 0 THEN p * 0.8::DOUBLE * (bl / p) ELSE p * 0.8::DOUBLE END', 4)} AS final_low,
 {R('CASE WHEN t = 1 AND eui > 0 THEN eui * 1.1::DOUBLE WHEN t = 2 AND epi > 0 THEN p * 1.2::DOUBLE * (bl / p) ELSE p * 1.2::DOUBLE END', 4)} AS final_high, least(t, 3) AS data_tier_used FROM g""")
def final_estimate(spark, sf):
    p = F.col("l_quantity") * 10
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", ((F.col("l_linenumber") - 1) % 4 + 1).alias("data_tier"), p.alias("predicted_eui"), (p * 0.8).alias("confidence_low"), (p * 1.2).alias("confidence_high"),
        (F.col("l_extendedprice") / 500).alias("eui"), (F.col("l_tax") * 1000).alias("epi_score"), F.when(F.col("l_returnflag") == "A", "office").when(F.col("l_returnflag") == "R", "apartment").otherwise("other").alias("usage_key"))
    out = ml.final_estimate(df).select("l_orderkey", "l_linenumber", "final_eui", "final_low", "final_high", "data_tier_used")
    return rounded(out, 4, "final_eui", "final_low", "final_high")


@query("registry_state", """WITH e AS (SELECT 'm' || (o_custkey % 10) AS model_name, 'v' || (o_custkey // 10) AS version_tag, CASE o_orderstatus WHEN 'O' THEN 'staging' WHEN 'F' THEN 'production' ELSE 'archived' END AS stage, o_totalprice AS mape, o_orderdate AS created_at FROM orders)
 SELECT model_name, version_tag, stage FROM e QUALIFY row_number() OVER (PARTITION BY model_name, version_tag ORDER BY created_at DESC, stage DESC) = 1""")
def registry_state(spark, sf):
    return ml.registry_state(_events(spark, sf)).select("model_name", "version_tag", "stage")


def _events(spark, sf):
    k = F.col("o_custkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("m"), (k % 10).cast("string")).alias("model_name"), F.concat(F.lit("v"), F.floor(k / 10).cast("string")).alias("version_tag"),
        F.when(F.col("o_orderstatus") == "O", "staging").when(F.col("o_orderstatus") == "F", "production").otherwise("archived").alias("stage"), F.col("o_totalprice").alias("mape"), F.lit(0.0).alias("rmse"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.lit("").alias("path"))


@query("registry_production", """WITH e AS (SELECT 'm' || (o_custkey % 10) AS model_name, 'v' || (o_custkey // 10) AS version_tag, CASE o_orderstatus WHEN 'O' THEN 'staging' WHEN 'F' THEN 'production' ELSE 'archived' END AS stage, o_orderdate AS created_at FROM orders),
 s AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY model_name, version_tag ORDER BY created_at DESC, stage DESC) = 1) SELECT model_name, version_tag FROM s WHERE stage = 'production' QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY created_at DESC, version_tag DESC) = 1""")
def registry_production(spark, sf):
    return ml.production(_events(spark, sf)).select("model_name", "version_tag")
