"""Transcribed files to call records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.text import base_name, iso_timestamp
from ..schemas import CALLS
from .ordering import place_sorted, with_start


def dense_ids(df: DataFrame, order: list[str], out: str, offset: int = 0) -> DataFrame:
    """Consecutive numbers from ``offset + 1`` in the given order, computed without one global task: the count of
    earlier partitions is added to the position inside a sorted one."""
    numbered = with_start(place_sorted(df, order), F.lit(1))
    return numbered.select((F.col("_start") + F.col("_at") + 1 + offset).alias(out), *df.columns)


def assign_call_ids(df: DataFrame, offset: int = 0, order: list[str] | None = None) -> DataFrame:
    """``call_id`` in path order and the file name ``call_<id>.json`` (at least three digits)."""
    return dense_ids(df, order or ["path"], "call_id", offset).withColumn(
        "file_name", F.format_string("call_%03d.json", "call_id")
    )


def with_transcript(df: DataFrame, text: str = "text") -> DataFrame:
    """Files that gave a transcript."""
    return df.filter(F.length(text) > 0)


def call_records(transcripts: DataFrame, offset: int = 0) -> DataFrame:
    """Call rows from ``path`` and ``text``: sentinel pincode, current time, stable stand-in duration."""
    numbered = assign_call_ids(with_transcript(transcripts), offset)
    return numbered.select(
        F.col("call_id").cast("long").alias("call_id"),
        F.lit(fixed.SENTINEL_PINCODE).alias("pincode"),
        F.col("text").alias("hindi_audio_text"),
        iso_timestamp(F.current_timestamp()).alias("timestamp"),
        (30 + F.pmod(F.xxhash64("path"), F.lit(151))).cast("long").alias("call_duration_seconds"),
        base_name("path").alias("audio_source"),
    ).select(*CALLS.fieldNames())


def run_scoped_ids(df: DataFrame, prefix: str, order: list[str], out: str = "call_id") -> DataFrame:
    """Ids such as ``DYNAMIC-3``, numbered in the given order."""
    return dense_ids(df, order, "_number").withColumn(
        out, F.concat(F.lit(prefix), F.col("_number").cast("string"))
    ).drop("_number")


def web_id():
    """``WEB-<epoch seconds>`` for a portal request."""
    return F.concat(F.lit("WEB-"), F.unix_timestamp().cast("string"))
