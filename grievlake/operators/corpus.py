"""Sections and schemes to one table of retrievable chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.text import any_column_contains, longer_than
from ..schemas import CHUNKS, SECTIONS
from ..sources.readers import rows_table


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in ``order``.

    The rank limit is applied before the shuffle too, so copies of one key leave at most one row per task.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def seed_sections(spark: SparkSession) -> DataFrame:
    rows = [
        (fixed.SECTION_PREFIX + number, number, title, content, fixed.SECTION_SOURCE)
        for number, title, content in fixed.SEED_SECTIONS
    ]
    return rows_table(spark, rows, SECTIONS)


def fill_gaps(parsed: DataFrame, seed: DataFrame, key: str = "section_id", tie: str = "content") -> DataFrame:
    """Parsed rows, plus seed rows for keys that were not parsed; one row per key."""
    both = parsed.withColumn("_priority", F.lit(0)).unionByName(
        seed.withColumn("_priority", F.lit(1)), allowMissingColumns=True
    )
    return keep_first(both, [key], ["_priority", tie]).drop("_priority")


def dedup_sections(sections: DataFrame) -> DataFrame:
    return keep_first(sections, ["section_id"], ["content", "title"])


def labour_schemes(schemes: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Schemes that mention a labour keyword in any text column."""
    return any_column_contains(schemes, fixed.LABOUR_KEYWORDS if keywords is None else keywords)


def section_chunks(sections: DataFrame) -> DataFrame:
    text = F.concat(F.lit("BNS Section "), "section_num", F.lit(" - "), "title", F.lit(": "), "content")
    return sections.select(
        F.col("section_id").alias("chunk_id"), text.alias("content"), F.lit(fixed.SECTION_SOURCE).alias("source")
    )


def scheme_chunks(schemes: DataFrame, null_as_empty: bool = False) -> DataFrame:
    """One text per scheme. A scheme with an empty field has no text unless ``null_as_empty``."""
    def part(name: str) -> Column:
        value = F.col(name).cast("string")
        return F.coalesce(value, F.lit("")) if null_as_empty else value

    text = F.concat(
        F.lit("Scheme: "), part("scheme_name"),
        F.lit(". Eligibility: "), part("eligibility"),
        F.lit(". Benefits: "), part("benefits"),
        F.lit(". Apply at: "), part("application"),
    )
    return schemes.select(
        F.col("scheme_name").alias("chunk_id"), text.alias("content"), F.lit(fixed.SCHEME_SOURCE).alias("source")
    )


def build_chunks(
    sections: DataFrame, schemes: DataFrame, min_length: int = fixed.MIN_CHUNK, null_as_empty: bool = False
) -> DataFrame:
    """Chunk table: union, one row per chunk_id, then texts over the minimum length.

    A key present in both sources keeps its section. Rows without text lose to rows with text last, since
    the length rule runs after the choice.
    """
    both = section_chunks(sections).unionByName(scheme_chunks(schemes, null_as_empty))
    chosen = keep_first(both, ["chunk_id"], ["source", F.asc_nulls_last("content")])
    return chosen.filter(longer_than("content", min_length)).select(*CHUNKS.fieldNames())
