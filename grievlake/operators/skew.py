"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key of at least so many rows is hot: what one task should hold. There are at most total / HOT_FLOOR of them.
HOT_FLOOR = 200_000
# Rows of a hot key that one salt should hold.
ROWS_PER_SALT = 100_000


def hot_keys(counts: DataFrame, keys: list[str], weight: str, floor: int = HOT_FLOOR) -> DataFrame:
    """Keys of at least ``floor`` rows with their number of salts. ``counts`` has one row per key and its row
    count in ``weight``. The limit is absolute, so a hot key is split whatever its share of the table."""
    salts = F.ceil(F.col(weight) / F.lit(ROWS_PER_SALT)).cast("int")
    return counts.filter(F.col(weight) >= floor).select(*keys, salts.alias("_salts"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    counts: DataFrame | None = None,
    weight: str = "_rows",
    floor: int = HOT_FLOOR,
    spread_by: list[str] | None = None,
) -> DataFrame:
    """Equi-join (inner or left) that spreads each hot key of the left side over several tasks.

    Hot keys are known from ``counts`` or counted on the left side (partial aggregation keeps that
    shuffle to one row per key and task). There are at most (rows / floor) of them, so they are broadcast: Spark
    judges them by the size of the whole table of counts and would deal out both sides by key once more to find
    them. The rows of the right side with a hot key are repeated once per salt, all others stay
    single. ``spread_by`` names short columns that
    tell rows of one key apart (all columns by default), so that wide ones need not be read for it.
    """
    if how not in ("left", "inner"):
        raise ValueError("salted_join keeps left rows: use 'left' or 'inner'")
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias(weight))
    hot = F.broadcast(hot_keys(counts, keys, weight, floor).withColumnsRenamed({k: f"_hot_{k}" for k in keys}))
    is_hot = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    salts = F.coalesce("_salts", F.lit(1))
    row_hash = F.xxhash64(*(spread_by or left.columns))
    spread = F.when(salts > 1, F.pmod(row_hash, salts)).otherwise(0).cast("int")
    salted = left.join(hot, is_hot, "left").select(*left.columns, spread.alias("_salt"))
    copies = F.explode(F.sequence(F.lit(0), salts - 1))
    repeated = right.join(hot, is_hot, "left").select(*right.columns, copies.alias("_salt"))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
