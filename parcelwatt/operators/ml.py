"""Learning data jobs: features, weighted training sets, splits, prediction, accuracy, registry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelwatt import dims
from parcelwatt.dims import values as V
from parcelwatt.functions.classify import literal_map
from parcelwatt.functions.energy import eui, primary_to_final
from parcelwatt.functions.rounding import half_up
from parcelwatt.operators.energy import match_archetype
from parcelwatt.operators.join import distinct_on, top_k
from parcelwatt.operators.quantile import exact_quantiles


def features(buildings: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """The model features of every building, in fixed order, after its own columns.

    Optional columns ``HDD18_annual``, ``CDD24_annual``, ``solar_rad_avg``, ``avg_temp_annual``
    override the typical year.
    """
    have = set(buildings.columns)
    weather = dict(zip(("HDD18_annual", "CDD24_annual", "solar_rad_avg", "avg_temp_annual"), V.ANNUAL_WEATHER))
    df = buildings.withColumns({
        "structure_class": F.coalesce("structure_class", F.lit("RC")),
        **{k: F.coalesce(F.col(k) if k in have else F.lit(None).cast("double"), F.lit(v)) for k, v in weather.items()},
    })
    known_year = F.coalesce(F.col("built_year"), F.lit(1990))
    df = match_archetype(df.withColumn("_year", F.col("built_year")).withColumn("built_year", known_year), as_of_year)
    code = lambda table, col, default: F.coalesce(literal_map(table)[F.col(col)], F.lit(default)).cast("double")
    age = F.coalesce(F.lit(as_of_year) - F.nullif(F.col("_year"), F.lit(0)), F.lit(40))
    area = F.coalesce(F.nullif(F.col("total_area"), F.lit(0.0)), F.lit(500.0))
    floors = F.coalesce(F.nullif(F.col("floors_above"), F.lit(0)), F.lit(5))
    df = df.withColumns({
        "vintage_class_enc": code(V.VINTAGE_CODES, "match_vintage", 1),
        "usage_type_enc": code(V.USAGE_CODES, "usage_key", 0),
        "structure_type_enc": code(V.STRUCTURE_CODES, "match_structure", 0),
        "total_area_log": F.log1p(F.greatest(area, F.lit(1.0))),
        "floors": F.greatest(floors, F.lit(1)).cast("double"),
        "built_year_age": F.least(F.greatest(age, F.lit(0)), F.lit(120)).cast("double"),
        "wall_uvalue_x_HDD18": F.col("wall_uvalue") * F.col("HDD18_annual"),
        "window_uvalue_x_CDD24": F.col("window_uvalue") * F.col("CDD24_annual"),
    })
    df = df.withColumn("area_x_usage", F.col("total_area_log") * (F.col("usage_type_enc") + 1))
    own = [c for c in buildings.columns if c not in V.FEATURES and c not in ("built_year", "structure_class")]
    return df.select(*own, F.col("_year").alias("built_year"), "structure_class", "usage_key", *V.FEATURES)


def training_rows(buildings: DataFrame, results: DataFrame) -> DataFrame:
    """Tier 1 and 2 rows with a plausible EUI (10..2000) and a floor area; one building per parcel."""
    one = distinct_on(buildings.filter(F.col("total_area") > 0), ["pnu"], [F.col("gid")])
    current = results.filter("is_current AND data_tier IN (1, 2)").select("pnu", "total_energy", "data_tier", "simulation_type")
    value = eui(F.col("total_energy"), F.col("total_area"), F.col("simulation_type"))
    return one.join(current, "pnu").withColumn("eui", value).filter(F.col("eui").between(10, 2000)).drop("total_energy", "simulation_type")


def training_set(tier1: DataFrame, tier2: DataFrame, tier1_weight: float = 5.0, tier2_weight: float = 1.0,
                 convert: bool = False, usage: str = "usage_key") -> DataFrame:
    """Weighted union; a parcel measured in tier 1 leaves tier 2.

    ``convert`` treats the tier-2 value ``primary_energy`` as primary energy and turns it into EUI.
    """
    second = tier2.join(tier1.select("pnu").distinct(), "pnu", "left_anti")
    if convert:
        second = second.withColumn("eui", primary_to_final(F.col("primary_energy"), F.col(usage)))
    tag = lambda df, tier, weight: df.withColumns({"source_tier": F.lit(tier), "weight": F.lit(weight)})
    return tag(tier1, 1, tier1_weight).unionByName(tag(second, 2, tier2_weight), allowMissingColumns=True)


def synthetic_rows(spark, n: int, noise: float = 0.10, seed: int = 42, weight: float = 0.1) -> DataFrame:
    """Archetype rows with a noisy target, spread evenly over the archetypes (statistical, seeded)."""
    table = dims.archetypes(spark).withColumn("_k", F.row_number().over(Window.orderBy("usage", "vintage", "structure")) - 1)
    count = len(dims._rows("archetypes.csv"))
    years = literal_map({"pre-1980": 1965, "1980-2000": 1990, "2001-2010": 2005, "post-2010": 2015})
    ids = spark.range(n).withColumn("_k", (F.col("id") % count).cast("int"))
    df = ids.join(F.broadcast(table), "_k")
    target = primary_to_final(F.col("ref_total"), F.col("usage")) + F.randn(seed) * F.col("ref_total") * noise
    return df.select(
        F.format_string("SYN_%06d", "id").alias("pnu"), F.col("usage").alias("usage_type"),
        F.col("structure").alias("structure_class"), years[F.col("vintage")].alias("built_year"),
        (F.rand(seed + 1) * 9800 + 200).alias("total_area"), (F.floor(F.rand(seed + 2) * 18) + 2).cast("int").alias("floors_above"),
        F.greatest(F.lit(20.0), target).alias("eui"), F.lit(4).alias("source_tier"), F.lit(weight).alias("weight"),
    )


def _ordinal(df: DataFrame, strata: list[str], key: str, seed: int, bins: int = 256) -> DataFrame:
    """Add ``_rank`` (1-based by keyed hash) and ``_size`` per stratum.

    Ranks are counted bin by bin over the hash range, so a stratum holding most rows is ordered by
    many tasks.
    """
    h = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_bin", F.shiftrightunsigned(F.col("_h"), 64 - int(math.log2(bins))))
    per_bin = h.groupBy(*strata, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    by_bin = Window.partitionBy(*strata).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bin.withColumns({
        "_before": F.coalesce(F.sum("_n").over(by_bin), F.lit(0)), "_size": F.sum("_n").over(Window.partitionBy(*strata)),
    }).drop("_n")
    inside = Window.partitionBy(*strata, "_bin").orderBy("_h", F.col(key))
    return h.join(offsets, [*strata, "_bin"]).withColumn("_rank", F.row_number().over(inside) + F.col("_before")).drop("_h", "_bin", "_before")


def split(df: DataFrame, strata: str = "vintage_class", ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_validation``: exactly round(ratio x size) rows of every stratum, never tier 1."""
    fixed = df.filter(F.col("source_tier") == 1).withColumn("is_validation", F.lit(False))
    ranked = _ordinal(df.filter(F.col("source_tier") != 1), [strata], "pnu", seed)
    open_rows = ranked.withColumn("is_validation", F.col("_rank") <= F.round(F.col("_size") * ratio)).drop("_rank", "_size")
    return fixed.unionByName(open_rows)


def folds(df: DataFrame, n: int = 5, strata: str = "vintage_class", seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..n-1, balanced inside every stratum; tier 1 gets null (it trains every fold)."""
    fixed = df.filter(F.col("source_tier") == 1).withColumn("fold", F.lit(None).cast("int"))
    ranked = _ordinal(df.filter(F.col("source_tier") != 1), [strata], "pnu", seed)
    return fixed.unionByName(ranked.withColumn("fold", ((F.col("_rank") - 1) % n).cast("int")).drop("_rank", "_size"))


def assemble(df: DataFrame, columns: tuple[str, ...] = V.FEATURES) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep").transform(df)


def fit(train: DataFrame, estimator=None, label: str = "eui", weight: str = "weight"):
    """Fit a weighted regressor (gradient-boosted trees by default) on feature rows."""
    from pyspark.ml.regression import GBTRegressor

    est = estimator or GBTRegressor(featuresCol="features", labelCol=label, weightCol=weight, maxIter=60, maxDepth=5, stepSize=0.1, seed=42)
    return est.fit(assemble(train))


def importance(model, spark) -> DataFrame:
    """feature, importance (sums to 1)."""
    raw = [float(x) for x in model.featureImportances.toArray()]
    total = sum(raw) or 1.0
    return dims.local_table(spark, ["feature", "importance"], [(f, x / total) for f, x in zip(V.FEATURES, raw)])


def cross_validate(df: DataFrame, n: int = 5, strata: str = "vintage_class", estimator=None) -> DataFrame:
    """fold, rmse, mape, r2 of ``n`` folds (each holds out one share of the non-tier-1 rows)."""
    marked = folds(df, n, strata)
    out = None
    for i in range(n):
        held = F.coalesce(F.col("fold") == i, F.lit(False))
        model = fit(marked.filter(~held), estimator)
        scored = model.transform(assemble(marked.filter(held))).select("eui", F.greatest("prediction", F.lit(10.0)).alias("pred"))
        row = regression_metrics(scored, "eui", "pred").withColumn("fold", F.lit(i))
        out = row if out is None else out.unionByName(row)
    return out


def predict(model, buildings: DataFrame, residuals: DataFrame | None = None, as_of_year: int = 2026) -> DataFrame:
    """Predict every building: mean (>= 10), ordered interval, feature snapshot.

    ``residuals`` (usage_key, lower, upper: offsets to the mean, see ``residual_bands``) gives the
    interval; uses without one fall back to +-20 %.
    """
    feats = features(buildings, as_of_year)
    scored = model.transform(assemble(feats)).withColumn("predicted_eui", F.greatest("prediction", F.lit(10.0)))
    mean = F.col("predicted_eui")
    if residuals is not None:
        scored = scored.join(residuals.select("usage_key", F.col("lower").alias("_lo"), F.col("upper").alias("_hi")), "usage_key", "left")
    else:
        scored = scored.withColumns({"_lo": F.lit(None).cast("double"), "_hi": F.lit(None).cast("double")})
    return scored.select(
        *[c for c in buildings.columns if c not in V.FEATURES], "usage_key", "predicted_eui",
        F.least(F.greatest(mean + F.coalesce("_lo", mean * -0.2), F.lit(5.0)), mean).alias("confidence_low"),
        F.greatest(mean + F.coalesce("_hi", mean * 0.2), mean).alias("confidence_high"),
        F.to_json(F.struct(*V.FEATURES)).alias("features_used"),
    )


def residual_bands(scored: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """usage_key -> quantiles of (actual - predicted), for intervals around the mean."""
    rest = scored.withColumn("_res", F.col("eui") - F.col("predicted_eui"))
    return exact_quantiles(rest, ["usage_key"], "_res", {"lower": low, "upper": high}).drop("n")


def final_estimate(df: DataFrame) -> DataFrame:
    """Tier-aware estimate: measured +-10 %, certified 70 % / model 30 %, else the model.

    Needs data_tier, eui, epi_score (certified primary energy), usage_key, predicted_eui,
    confidence_low, confidence_high. Adds final_eui, final_low, final_high, data_tier_used.
    """
    tier = F.coalesce(F.col("data_tier"), F.lit(4))
    mean = F.col("predicted_eui")
    measured = F.coalesce((tier == 1) & (F.col("eui") > 0), F.lit(False))
    certified = F.coalesce((tier == 2) & (F.col("epi_score") > 0), F.lit(False))
    blended = mean * 0.3 + primary_to_final(F.col("epi_score"), F.col("usage_key")) * 0.7
    ratio = F.when(mean > 0, blended / F.nullif(mean, F.lit(0.0))).otherwise(1.0)
    pick = lambda m, c, p: F.when(measured, m).when(certified, c).otherwise(p)
    return df.withColumns({
        "final_eui": pick(F.col("eui"), blended, mean),
        "final_low": pick(F.col("eui") * 0.9, F.col("confidence_low") * ratio, F.col("confidence_low")),
        "final_high": pick(F.col("eui") * 1.1, F.col("confidence_high") * ratio, F.col("confidence_high")),
        "data_tier_used": F.when(measured, 1).otherwise(F.least(tier, F.lit(3))),
    })


# ── accuracy ─────────────────────────────────────────────────────────────────

def errors(df: DataFrame, actual: str = "actual_eui", predicted: str = "predicted_eui") -> DataFrame:
    gap = F.abs(F.col(predicted) - F.col(actual))
    return df.withColumns({"error_abs": gap, "error_pct": gap / F.nullif(F.col(actual), F.lit(0.0)) * 100})


def accuracy(predictions: DataFrame, versions: DataFrame, registry: DataFrame, min_actual: float = 5.0) -> DataFrame:
    """Accuracy mart per model version, scale and target, over rows with an actual of at least 5."""
    mse, var = F.avg(F.col("error_abs") * F.col("error_abs")), F.var_samp("actual_eui")
    agg = predictions.filter(F.col("actual_eui") >= min_actual).groupBy("model_version_id", "temporal_scale", "target_variable").agg(
        F.count(F.lit(1)).alias("prediction_count"), F.count("actual_eui").alias("evaluated_count"),
        half_up(F.sqrt(mse), 3).alias("rmse"), half_up(F.avg("error_pct"), 2).alias("mape"),
        half_up(1.0 - mse / F.nullif(var, F.lit(0.0)), 4).alias("r_squared"),
        half_up(F.avg("predicted_eui"), 1).alias("avg_predicted"), half_up(F.avg("actual_eui"), 1).alias("avg_actual"),
        half_up(F.max("error_abs"), 1).alias("max_error_abs"),
        F.min("predicted_at").alias("first_prediction_at"), F.max("predicted_at").alias("last_prediction_at"),
    )
    named = versions.select(F.col("id").alias("model_version_id"), "model_id", "version_tag").join(
        registry.select(F.col("id").alias("model_id"), "model_name", "model_type", "stage"), "model_id"
    )
    return agg.join(named.drop("model_id"), "model_version_id")


def accuracy_by_segment(predictions: DataFrame, segments: list[str]) -> DataFrame:
    """n, MAPE and RMSE per segment over evaluated rows."""
    return predictions.filter("actual_eui IS NOT NULL").groupBy(*segments).agg(
        F.count(F.lit(1)).alias("n"), half_up(F.avg("error_pct"), 1).alias("mape"),
        half_up(F.sqrt(F.avg(F.col("error_abs") * F.col("error_abs"))), 1).alias("rmse"),
    )


def regression_metrics(df: DataFrame, actual: str = "actual_eui", predicted: str = "predicted_eui") -> DataFrame:
    """One row: n, rmse, mae, mape (actuals clipped to 1), r2."""
    y, p = F.col(actual), F.col(predicted)
    sse = F.sum((y - p) * (y - p))
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(sse / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"),
        (F.avg(F.abs(y - p) / F.greatest(y, F.lit(1.0))) * 100).alias("mape"),
        (1.0 - sse / F.nullif(F.var_pop(y) * F.count(F.lit(1)), F.lit(0.0))).alias("r2"),
    )


def history(predictions: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` predictions of every requested parcel."""
    wanted = predictions.join(keys.select("pnu").distinct(), "pnu", "left_semi")
    return top_k(wanted, ["pnu"], [F.col("predicted_at").desc(), F.col("model_version_id").desc()], limit)


# ── registry: an append-only event log and its latest state ──────────────────

REGISTRY_SCHEMA = (
    "model_name string, version_tag string, stage string, mape double, rmse double, created_at timestamp, path string"
)


def registry_state(events: DataFrame) -> DataFrame:
    """Current stage of every (model_name, version_tag): its newest event."""
    return top_k(events, ["model_name", "version_tag"], [F.col("created_at").desc(), F.col("stage").desc()])


def production(events: DataFrame) -> DataFrame:
    """The newest production version of every model."""
    live = registry_state(events).filter(F.col("stage") == "production")
    return top_k(live, ["model_name"], [F.col("created_at").desc(), F.col("version_tag").desc()])


def latest_versions(registry: DataFrame, versions: DataFrame) -> DataFrame:
    """Every registered model with its newest version (null columns when it has none)."""
    newest = top_k(versions, ["model_id"], [F.col("created_at").desc_nulls_last(), F.col("id").desc()])
    renamed = newest.select("model_id", F.col("id").alias("version_id"), "version_tag", "created_at")
    return registry.join(renamed, registry["id"] == renamed["model_id"], "left").drop("model_id")


def promote(events: DataFrame, candidate: DataFrame, gain: float = 0.98) -> DataFrame:
    """Events to append for new ``candidate`` versions (registry schema, stage ignored).

    A candidate becomes production when no version is live or its MAPE is below ``gain`` times the
    live one's, which is then archived; otherwise it is recorded as staging.
    """
    live = production(events)
    one = live.select("model_name", F.col("mape").alias("_live"), F.struct(*[c for c in live.columns if c != "model_name"]).alias("_old"))
    judged = candidate.join(one, "model_name", "left").withColumn(
        "_wins", F.col("_live").isNull() | F.coalesce(F.col("mape") < F.col("_live") * gain, F.lit(False))
    )
    new = judged.withColumn("stage", F.when(F.col("_wins"), "production").otherwise("staging")).select(*events.columns)
    at = judged.filter("_wins AND _old IS NOT NULL").select(
        "model_name", *[F.col(f"_old.{c}").alias(c) for c in events.columns if c not in ("model_name", "stage", "created_at")],
        F.lit("archived").alias("stage"), F.col("created_at"),
    )
    return new.unionByName(at.select(*events.columns))


def within(col: Column, low: float, high: float) -> Column:
    return F.coalesce(col.between(low, high), F.lit(False))
