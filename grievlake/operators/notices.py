"""Notices to contractors and numbered advice for workers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.text import fill_template, strip
from ..sources.sinks import notice_key
from .corpus import keep_first


def notice_target(radar: DataFrame, contractor: str | None = None) -> DataFrame:
    """One row per contractor (or for one contractor): the place with most complaints, then by pincode."""
    chosen = radar if contractor is None else radar.filter(F.col("contractor_name") == contractor)
    return keep_first(chosen, ["contractor_name"], [F.desc("total_complaints"), "pincode"])


def notice_candidates(radar: DataFrame, at_least: int = 5) -> DataFrame:
    return radar.filter(F.col("total_complaints") >= at_least)


def needs_translation(actions: DataFrame) -> DataFrame:
    """Actions whose advice goes to a translation client first."""
    return actions.filter(F.col("urgency") == "HIGH")


def show_cause_notice(rows: DataFrame, long: bool = False) -> DataFrame:
    """Adds the notice text and its file key."""
    return rows.withColumns({
        "notice": fill_template(fixed.LONG_NOTICE if long else fixed.SHORT_NOTICE),
        "file_key": notice_key(),
    })


def notice_requests(rows: DataFrame) -> DataFrame:
    """Request table for a chat client that drafts the notice."""
    return rows.select("contractor_name", "pincode", fill_template(fixed.NOTICE_PROMPT).alias("prompt"))


def translation_requests(advice: DataFrame, language: str | None = None) -> DataFrame:
    """Request table for translating ``english_text``; without a language the plain Hindi wording is used."""
    if language is None:
        return advice.select("call_id", fill_template(fixed.HINDI_PROMPT).alias("prompt"))
    named = advice.withColumn("language", F.lit(language))
    return named.select("call_id", fill_template(fixed.TRANSLATION_PROMPT).alias("prompt"))


def advice_text(df: DataFrame) -> DataFrame:
    """``english_text``: the steps of the action, one per line."""
    return df.withColumn("english_text", F.array_join(F.col("action")["action_steps"], "\n"))


def advice_steps(df: DataFrame, text: str = "english_text") -> DataFrame:
    """call_id, step_no, step: non-blank lines with their two-digit line number."""
    lines = df.select("call_id", F.posexplode(F.split(text, "\n")).alias("_at", "_line"))
    steps = lines.select("call_id", F.format_string("%02d", F.col("_at") + 1).alias("step_no"), strip("_line").alias("step"))
    return steps.filter("step != ''")
