"""A total order over rows without one global task: sorted partitions, and what stands before each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import stage

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def place_sorted(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``_part`` and ``_at``: their sorted partition and place in it.

    The sorted partitions are written once, so that every pass sees the same rows. Rows that are equal in ``order``
    are told apart by a hash of the whole row, so that they too can be spread over partitions.
    """
    tied = df.withColumn("_tie", F.xxhash64(*df.columns))
    spot = F.monotonically_increasing_id().alias("_spot")
    ordered = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    return stage(ordered.select(*df.columns, spot), "ordered").select(
        *df.columns, F.shiftright("_spot", _ROW_BITS).alias("_part"),
        F.col("_spot").bitwiseAND((1 << _ROW_BITS) - 1).alias("_at"),
    )


def with_start(placed: DataFrame, value: Column, out: str = "_start") -> DataFrame:
    """Adds the total of ``value`` over all earlier partitions: one row per partition, so few enough for a single
    window task and for a broadcast."""
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias(out))
    return placed.join(F.broadcast(starts), "_part")


def running_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """The rows with the sum of ``value`` up to and including each of them. ``order`` leaves no two rows equal."""
    placed = with_start(place_sorted(df, order), F.col(value))
    inside = F.sum(value).over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("_inside", inside).select(*df.columns, (F.col("_start") + F.col("_inside")).alias(out))
