"""Top-1 / top-k per key, fallback and distinct-on joins.

``row_number() <= k`` filters run a per-task group limit before the shuffle, so one hot key ships
at most ``k`` rows per task instead of its whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every key in ``order`` (give a total order for repeatable results).

    The limit before the shuffle applies up to ``spark.sql.optimizer.windowGroupLimitThreshold``.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast when its counted ``rows`` are few, else unchanged."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


TASK_ROWS = 1_000_000


def dealt(df: DataFrame, rows: int, keys: list[str], per_task: int = TASK_ROWS) -> DataFrame:
    """``df`` of counted ``rows`` dealt by ``keys`` to as many tasks as keep each at about ``per_task`` rows; unchanged when one would do."""
    return df.repartition(-(-rows // per_task), *keys) if rows > per_task else df


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_k(df, keys, order, 1)


def top1_left(left: DataFrame, right: DataFrame, on: str, order: list[Column], where: Column | None = None) -> DataFrame:
    """Left join with the single best matching right row; never multiplies left rows."""
    candidates = right.filter(where) if where is not None else right
    return left.join(top_k(candidates.filter(F.col(on).isNotNull()), [on], order), on, "left")


def fallback_left(left: DataFrame, right: DataFrame, on: str, fallback_key: Column, when: Column) -> DataFrame:
    """Second left join on a derived key, only for rows where ``when`` holds.

    ``right`` must be unique on ``on``. Rows that do not take part get a private key that matches
    nothing, so they stay spread over the cluster instead of meeting in one null partition.
    """
    idle = F.concat(F.lit("~"), F.coalesce(F.col(on), F.xxhash64(*left.columns).cast("string")))
    key = F.when(when, F.coalesce(fallback_key, idle)).otherwise(idle)
    other = right.withColumnRenamed(on, "_fallback")
    return left.withColumn("_fallback", key).join(other, "_fallback", "left").drop("_fallback")
