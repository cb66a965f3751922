"""Complaints per contractor within the last 48 hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stage
from .ordering import running_sum

HOUR = 3_600_000_000  # microseconds
_NO_TIME = -(1 << 63)


def complaints_48h(
    df: DataFrame, key: str = "contractor_name", ts: str = "timestamp", hours: int = 48, out: str = "complaints_48h"
) -> DataFrame:
    """Adds, per row, the number of rows of the same key in the ``hours`` up to and including its time.

    One window per key would put a busy contractor into one task, and one per hour a busy hour. Here rows are first
    counted per key and time. Every time enters its key's count and, just after the ``hours``, leaves it again; the
    count is the running sum over these steps in the order of (key, time), kept in range partitions that may split a
    key and an hour anywhere. Since a key's steps add up to nothing, keys need no sums of their own.

    A time that is null or cannot be read has no place among the others: such a row counts the rows of its
    key that have no time either, itself included, as a window over null times does.
    """
    own = df.withColumns({
        # rows without a key are one group of their own
        "_key": F.coalesce(F.col(key).cast("string"), F.lit("")), "_keyless": F.col(key).isNull(),
        "_time": F.coalesce(F.unix_micros(F.col(ts).try_cast("timestamp")), F.lit(_NO_TIME)),
    })
    keys = ["_key", "_keyless"]
    counts = stage(own.groupBy(*keys, "_time").agg(F.count(F.lit(1)).alias("_rows")), "counts")
    timed = counts.filter(F.col("_time") != _NO_TIME)
    enters = timed.select(*keys, "_time", F.lit(0).alias("_leaves"), F.col("_rows").alias("_change"))
    # a step out at the same time as a step in comes after it: the border still counts
    leaves = timed.select(*keys, F.col("_time") + hours * HOUR, F.lit(1), -F.col("_rows"))
    running = running_sum(enters.union(leaves), [*keys, "_time", "_leaves"], "_change", "_count").filter("_leaves = 0")
    timeless = counts.filter(F.col("_time") == _NO_TIME).select(*keys, "_time", F.col("_rows").alias("_count"))
    found = running.select(*keys, "_time", "_count").union(timeless)
    return own.join(found, [*keys, "_time"]).select(*df.columns, F.col("_count").alias(out))
