"""Exact grouped order statistics without gathering a group in one task.

Values are collapsed to (group, value, count). A fixed, order-keeping function of the value cuts
every group into narrow buckets; bucket counts tell which bucket holds each wanted rank, and only
the values of those few buckets are ranked, one task per (group, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Buckets per power of two; the width of a bucket is the value over this number.
STEPS = 4096
_OFFSET = 1100


def bucket(value: Column, steps: int = STEPS) -> Column:
    """Integer that never decreases with ``value``: a piecewise linear logarithm, mirrored below 0."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    level = F.floor(steps * (exponent + size / F.pow(F.lit(2.0), exponent) + (_OFFSET - 1))).cast("long")
    return F.when(value > 0, level).when(value < 0, -level).otherwise(F.lit(0).cast("long"))


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column],
                     weight: str | None = None) -> DataFrame:
    """Exact values at given 1-based ranks.

    ``ranks`` maps an output name to a rank expression over the column ``n`` (group size). Null and
    NaN values are ignored. ``weight`` repeats a value that many times. Returns ``keys``, ``n`` and
    one column per rank.
    """
    v = F.col(value).cast("double")
    known = df.filter(v.isNotNull() & ~F.isnan(v))
    weights = F.sum(weight) if weight else F.count(F.lit(1))
    counted = known.groupBy(*keys, v.alias("_v")).agg(weights.cast("long").alias("_c")).withColumn("_b", bucket(F.col("_v")))
    sizes = counted.groupBy(*keys, "_b").agg(F.sum("_c").alias("_size"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumns({"_upto": F.sum("_size").over(upto), "n": F.sum("_size").over(group)})
    wants = F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks.items()])
    inside = lambda w: (w["rank"] > F.col("_upto") - F.col("_size")) & (w["rank"] <= F.col("_upto"))
    targets = sizes.withColumn("_wants", F.filter(wants, inside)).filter(F.size("_wants") > 0)
    targets = targets.select(*keys, "_b", "n", (F.col("_upto") - F.col("_size")).alias("_before"), "_wants")
    ranked = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = counted.join(targets, [*keys, "_b"]).withColumn("_hi", F.col("_before") + F.sum("_c").over(ranked))
    here = lambda w: (w["rank"] <= F.col("_hi")) & (w["rank"] > F.col("_hi") - F.col("_c"))
    hits = hits.withColumn("_hit", F.explode(F.filter("_wants", here)))
    return hits.groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("_hit.name") == name, F.col("_v"))).alias(name) for name in ranks]
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
                    weight: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles (numpy's default), exact for groups of any size."""
    position = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in quantiles.items()}
    ranks: dict[str, Column] = {}
    for name, p in position.items():
        ranks[f"_lo_{name}"], ranks[f"_hi_{name}"] = F.floor(p) + 1, F.ceil(p) + 1
    stats = order_statistics(df, keys, value, ranks, weight)
    between = lambda name, p: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (p - F.floor(p))
    return stats.select(*keys, "n", *[between(name, p).alias(name) for name, p in position.items()])
