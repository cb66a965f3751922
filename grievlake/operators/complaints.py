"""Calls to structured complaints: translation memory, entity extraction, pincode, silver table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fixed
from ..functions.replies import coerce_entities, first_readable, parse_entities
from ..functions.shape import conform
from ..functions.text import as_column, fill_template, strip
from ..schemas import SILVER

# fixed values: words that decide issue, violence and counts; the first issue that matches wins
ISSUE_PATTERNS = [
    (r"\b(assault\w*|beaten|hit|slapped|struck)\b", "PHYSICAL_ASSAULT"),
    (r"\b(fired|terminat\w*|dismiss\w*|without notice)\b", "WRONGFUL_TERMINATION"),
    (r"\b(unsafe|safety|helmet|accident)\b", "UNSAFE_CONDITIONS"),
    (r"\b(wages?|salary|money|paid|payment)\b", "WAGE_THEFT"),
]
VIOLENCE_PATTERN = r"\b(threat\w*|beat\w*|hit|assault\w*|kill\w*)\b"
# every text that matches a pattern holds one of these as it is: a plain search spares most texts the pattern
WORD_STEMS = {
    "PHYSICAL_ASSAULT": ("assault", "beaten", "hit", "slapped", "struck"),
    "WRONGFUL_TERMINATION": ("fired", "terminat", "dismiss", "without notice"),
    "UNSAFE_CONDITIONS": ("unsafe", "safety", "helmet", "accident"),
    "WAGE_THEFT": ("wage", "salary", "money", "paid", "payment"),
}
VIOLENCE_STEMS = ("threat", "beat", "hit", "assault", "kill")
COUNT_PATTERN = r"(\d+)\s+(?:workers?|labou?rers?|mazdoors?)"
CONTRACTOR_PATTERN = r"(?i:contractor|supervisor)\s+([A-Z][a-z]+)"
SITE_PATTERN = r"\bat\s+(?:the\s+)?([A-Z]\w+(?:\s+\w+){0,2})\s+site\b"
PINCODE_PATTERN = r"\b([1-9]\d{5})\b"
_UNICODE = "(?U)"  # word borders respect letters of every script


def to_raw(bronze: DataFrame) -> DataFrame:
    return bronze.select(
        F.col("call_id").cast("string").alias("call_id"), "pincode", F.col("hindi_audio_text").alias("raw_text")
    )


def with_translation(df: DataFrame, memory: DataFrame | None = None, text: str = "raw_text") -> DataFrame:
    """``english_text``: the stored translation of the trimmed text, else the trimmed text itself.

    ``memory`` has source_text (unique, trimmed) and translated_text. Texts are matched on a 128-bit
    digest. Both sides are plain shuffles of a table, so adaptive execution splits the partition of a
    text that very many calls share.
    """
    trimmed = df.withColumn("_text", strip(text))
    if memory is None:
        return trimmed.withColumnRenamed("_text", "english_text")
    digest = F.md5(F.col("_text"))
    stored = memory.select(F.md5("source_text").alias("_digest"), "translated_text")
    joined = trimmed.withColumn("_digest", digest).join(stored, "_digest", "left")
    return joined.select(*df.columns, F.coalesce("translated_text", "_text").alias("english_text"))


def untranslated(df: DataFrame, memory: DataFrame, text: str = "raw_text") -> DataFrame:
    """Distinct trimmed texts the memory does not hold yet: the work list for a translation client."""
    wanted = df.select(strip(text).alias("source_text")).filter("source_text != ''").withColumn("_digest", F.md5("source_text"))
    known = memory.select(F.md5("source_text").alias("_digest"))
    # matched on digests as in with_translation; a text many calls share leaves one row per task
    return wanted.groupBy("_digest").agg(F.first("source_text").alias("source_text")).join(
        known, "_digest", "left_anti").select("source_text")


def _matches(text: Column, pattern: str, stems: tuple[str, ...]) -> Column:
    holds = reduce(lambda a, b: a | b, [F.contains(text, F.lit(stem)) for stem in stems])
    return F.when(holds, text.rlike(_UNICODE + pattern)).otherwise(False)


def issue_of(text: Column) -> Column:
    found = [F.when(_matches(text, pattern, WORD_STEMS[issue]), F.lit(issue)) for pattern, issue in ISSUE_PATTERNS]
    return F.coalesce(*found, F.lit(fixed.OTHER_ISSUE))


def entities_of(text: Column | str) -> Column:
    """Entity struct by word rules on an English text."""
    text = as_column(text)
    lower = F.lower(text)

    def named(pattern: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, _UNICODE + pattern, 1), F.lit("")), F.lit(fixed.UNKNOWN))

    count = F.regexp_extract(lower, _UNICODE + COUNT_PATTERN, 1).try_cast("int")
    return F.struct(
        named(CONTRACTOR_PATTERN).alias("contractor_name"),
        named(SITE_PATTERN).alias("work_site"),
        issue_of(lower).alias("issue_type"),
        _matches(lower, VIOLENCE_PATTERN, VIOLENCE_STEMS).alias("violence_threatened"),
        F.coalesce(count, F.lit(0)).alias("worker_count_mentioned"),
    )


def extract_entities(df: DataFrame, text: str = "english_text") -> DataFrame:
    return df.withColumn("_entities", entities_of(text)).select(*df.columns, "_entities.*")


def with_pincode(df: DataFrame, text: str = "english_text") -> DataFrame:
    """A missing or sentinel pincode is replaced by the first one in the text, if there is any."""
    stated = F.nullif(F.regexp_extract(F.col(text), _UNICODE + PINCODE_PATTERN, 1), F.lit(""))
    missing = F.col("pincode").isNull() | (F.col("pincode") == fixed.SENTINEL_PINCODE)
    return df.withColumn("pincode", F.when(missing, F.coalesce(stated, "pincode")).otherwise(F.col("pincode")))


def enrich_with(
    df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType | str
) -> DataFrame:
    """Run any batch client (a translation or chat service, an encoder) over the rows, in parallel."""
    return df.mapInPandas(fn, schema)


def entity_requests(df: DataFrame) -> DataFrame:
    """Request table for a chat client: call_id and prompt."""
    return df.select("call_id", fill_template(fixed.ENTITY_PROMPT).alias("prompt"))


def read_replies(replies: DataFrame, order: str | None = None) -> DataFrame:
    """call_id, raw, parsed of the reply that counts for each call: see ``replies.first_readable``."""
    return first_readable(replies, parse_entities, order)


def failed_replies(read: DataFrame) -> DataFrame:
    """call_id and raw of the read replies (``read_replies``) that nothing could be read from: their calls get defaults."""
    return read.filter(F.col("parsed").isNull()).select("call_id", "raw")


def build_silver(
    bronze: DataFrame,
    memory: DataFrame | None = None,
    replies: DataFrame | None = None,
    find_pincode: bool = False,
    order: str | None = None,
) -> DataFrame:
    """Bronze calls to the silver schema in one plan.

    Entities come from word rules, or from ``replies(call_id, raw)`` of a chat client, read here or already
    (``read_replies``); a call without a reply that can be read gets the default entities.
    """
    english = with_translation(to_raw(bronze), memory)
    if find_pincode:
        english = with_pincode(english)
    if replies is None:
        found = extract_entities(english)
    else:
        read = replies if "parsed" in replies.columns else read_replies(replies, order)
        joined = english.join(read.select("call_id", "parsed"), "call_id", "left")
        typed = joined.withColumn("_entities", coerce_entities(F.col("parsed")))
        found = typed.select(*english.columns, "_entities.*")
    return conform(found, SILVER)
