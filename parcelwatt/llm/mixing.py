"""Mixing of sources to target weights by entropy balancing.

Each source gets a share of a word budget in proportion to its weight, at most ``most`` times its own size; what lies above
is reshared by weight until no source is above its limit. A document's rate is the expected number of its copies. Rates
solve a convex problem for each source: minimise the sum over documents of a_d (r log r - r + 1), with rates up to
``most`` and the rate-weighted words equal to the target, where a_d = size_d + mean size of the source. The solution is an
exponential tilt, r_d = min(most, exp(lambda x_d)) with x_d = size_d / a_d between 0 and 1, so short documents keep rates near
1 and long ones carry more of the change. The dual has one unknown per source; Newton steps for all sources run together as
aggregates over (source, size) counts, each step kept inside a bracket.

Rates become copies: the whole part, and one more where a hash of the row is below the fraction. A shift of that
threshold per source, found by aggregates of ever finer steps, brings the words taken to within about one document of the target.
Everything is DataFrame work; a source of any share is spread over tasks, because only (source, size) or (source, step) counts meet.

Defined results: null text has size 0 and is not taken; documents of a null source form a source of their own, the last; a
source without words has target 0; repeated rows with equal id and text are taken alike; rows with a null id take part; an
empty table gives no rows. ``mix`` returns one row per input row, ``mixed`` the input rows times their copies with all columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from parcelwatt.llm.common import WORD, counted_broadcast, cut, free_name

LEVELS = (12, 10, 10)  # bits by which the threshold is refined


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from (source, source_size); weights repeat over the sources by code point, null last."""
    everything = Window.partitionBy(F.lit(0))
    place = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    limits = sizes.withColumn("w", weight).withColumn("limit", most * F.col("source_size"))
    # sources reach their limits in order of limit / weight; c is the level per unit of weight if exactly those before are at theirs
    by_level = everything.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    rest = share * F.sum("source_size").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    leveled = limits.withColumn("c", rest / F.sum("w").over(after))
    level = F.max(F.when(F.col("c") * F.col("w") <= F.col("limit"), F.col("c"))).over(everything)
    free = leveled.withColumn("level", level)
    return free.select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("w"), "limit")).alias("target"))


def _balance(counts: DataFrame, goals: DataFrame, most: float, rounds: int = 60, close: float = 1e-9) -> DataFrame:
    """source, lam: the tilt of each source. ``counts`` (source, size, n), ``goals`` (source, source_size, target, mean).

    Newton steps run until every source meets its target to ``close`` of its size; a step that leaves the bracket of
    signs is replaced by its middle, so ``rounds`` halvings always suffice.
    """
    state = cut(goals.select("source", "source_size", "target", "mean", F.lit(0.0).alias("lam"), F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"), F.lit(False).alias("done")))
    x = F.col("size") / (F.col("size") + F.col("mean"))
    for _ in range(rounds):
        rate = F.exp(F.col("lam") * x)
        words = F.col("n") * F.col("size")
        sums = counts.join(counted_broadcast(state.where("NOT done").select(F.col("source").alias("s"), "lam", "mean")), F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(
            F.sum(words * F.least(rate, F.lit(most))).alias("got"), F.sum(F.when(rate < most, words * x * rate)).alias("slope")).withColumnRenamed("s", "k")
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.col("slope")
        # a side that is still open grows by doubling
        middle = F.when(F.col("hi") == math.inf, F.greatest(2 * F.col("lo"), F.lit(1.0))).when(F.col("lo") == -math.inf, F.least(2 * F.col("hi"), F.lit(-1.0))).otherwise((F.col("lo") + F.col("hi")) / 2)
        usable = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - F.col("lam")) < 8)
        fine = F.col("done") | (F.abs(gap) <= close * F.col("source_size"))
        moved = (
            state.join(counted_broadcast(sums), F.col("source").eqNullSafe(F.col("k")), "left").withColumn("fine", F.coalesce(fine, F.lit(True)))
            .withColumns({"lo": F.coalesce(lo, "lo"), "hi": F.coalesce(hi, "hi")}).withColumn("next", F.when(usable, newton).otherwise(middle)))
        state = cut(moved.select("source", "source_size", "target", "mean", F.when(F.col("fine"), F.col("lam")).otherwise(F.col("next")).alias("lam"), "lo", "hi", F.col("fine").alias("done")))
        if state.where("NOT done").isEmpty():
            break
    return state.select("source", "lam")


def _threshold(rated: DataFrame, goals: DataFrame) -> DataFrame:
    """source, bound: rows with ``step`` below ``bound`` get one more copy. ``rated`` (source, size, base, step), goals (source, target)."""
    bits = sum(LEVELS)
    base = rated.groupBy("source").agg(F.sum(F.col("base") * F.col("size")).alias("sure")).withColumnRenamed("source", "k")
    state = cut(goals.join(counted_broadcast(base), F.col("source").eqNullSafe(F.col("k")), "left").select(
        "source", (F.col("target") - F.coalesce("sure", F.lit(0))).alias("need"), F.lit(0).cast("long").alias("prefix")))
    done = 0
    for level in LEVELS:
        shift = bits - done - level
        inside = rated.where("step IS NOT NULL").join(counted_broadcast(state.selectExpr("source AS k", "prefix", "need")), F.col("source").eqNullSafe(F.col("k"))).where(
            F.shiftright("step", bits - done) == F.col("prefix"))
        parts = inside.groupBy("k", "need", F.shiftright("step", shift).alias("part")).agg(F.sum("size").alias("words"))
        running = parts.withColumn("upto", F.sum("words").over(Window.partitionBy("k").orderBy("part")))
        # the part in which the need is met; a need beyond all parts leaves the bound behind the last one
        met = running.where(F.col("upto") - F.col("words") <= F.col("need")).groupBy("k").agg(
            F.max(F.struct("part", (F.col("upto") - F.col("words")).alias("under"))).alias("top"))
        state = cut(state.join(counted_broadcast(met), F.col("source").eqNullSafe(F.col("k")), "left").select(
            "source", (F.col("need") - F.coalesce("top.under", F.lit(0))).alias("need"),
            F.coalesce("top.part", F.shiftleft("prefix", level)).alias("prefix")))
        done += level
    last = rated.join(counted_broadcast(state.selectExpr("source AS k", "prefix")), F.col("source").eqNullSafe(F.col("k"))).where("step = prefix").groupBy("k").agg(F.sum("size").alias("words"))
    return state.join(counted_broadcast(last), F.col("source").eqNullSafe(F.col("k")), "left").select(
        "source", (F.col("prefix") + F.when(F.col("need") * 2 >= F.col("words"), 1).otherwise(0)).alias("bound"))


def _copies(docs: DataFrame, weights, share, most) -> tuple[DataFrame, DataFrame]:
    """(rows with source, size, step, base; per source: source_size, target, bound), so that copies = base + (step < bound)."""
    sizes = docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("h"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    slim = cut(sizes)
    counts = cut(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = cut(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows")))
    aims = cut(targets(totals.select("source", "source_size"), weights, share, most))
    goals = aims.join(totals.select(F.col("source").alias("k"), (F.col("source_size") / F.col("rows")).alias("mean")), F.col("source").eqNullSafe(F.col("k"))).drop("k")
    # at either end no tilt is wanted: nothing, or everything at the limit
    inner = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12))
    tilts = _balance(counts, goals.where(inner), most)
    rates = cut(goals.join(tilts.withColumnRenamed("source", "k"), F.col("source").eqNullSafe(F.col("k")), "left").drop("k"))
    rated = _rated(slim, rates, most)
    bounds = _threshold(rated.select("source", "size", "base", "step").where("size > 0"), rates.where("lam IS NOT NULL"))
    plan = cut(rates.join(bounds.withColumnRenamed("source", "k"), F.col("source").eqNullSafe(F.col("k")), "left").drop("k"))
    return slim, plan


def _rated(slim: DataFrame, rates: DataFrame, most: float) -> DataFrame:
    """``slim`` with base copies and the step at which one more copy comes (null: never)."""
    plan = rates.select(F.col("source").alias("k"), *[c for c in rates.columns if c != "source"])
    joined = slim.join(counted_broadcast(plan), F.col("source").eqNullSafe(F.col("k")), "left").drop("k")
    rate = F.when(F.col("lam").isNotNull(), F.least(F.exp(F.col("lam") * F.col("size") / (F.col("size") + F.col("mean"))), F.lit(most))).otherwise(
        F.when(F.col("target") > 0, F.lit(most)).otherwise(F.lit(0.0)))
    base = F.floor("rate").cast("long")
    unit = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    step = F.floor((unit - (F.col("rate") - base) + 1) / 2 * F.lit(float(1 << sum(LEVELS)))).cast("long")
    return joined.withColumn("rate", rate).withColumn("base", base).withColumn("step", F.when(F.col("lam").isNotNull() & (base < most), step)).drop("rate")


def _taken():
    return F.when(F.col("size") > 0, F.col("base") + F.when(F.col("step") < F.col("bound"), 1).otherwise(0)).otherwise(0)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (copies x size) for every row of ``docs`` (doc_id, text, source)."""
    slim, plan = _copies(docs, weights, share, most)
    return _rated(slim, plan, most).withColumn("copies", _taken().cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all columns of ``docs``."""
    _, plan = _copies(docs, weights, share, most)
    whole = free_name(docs, "_row")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(whole), "source", F.xxhash64("doc_id", "text").alias("h"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    counted = _rated(rows, plan, most).withColumn("copies", _taken().cast("int")).where("copies > 0")
    return counted.select(whole, F.explode(F.sequence(F.lit(1), "copies"))).select(f"{whole}.*")
