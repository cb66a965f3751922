"""Threat, severity, urgency and display rules as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from .text import as_column, fill_template, lookup


def threat_label(complaints: Column | str, workers: Column | str, hi=(3, 10), mid=(2, 5)) -> Column:
    """HIGH / MEDIUM / LOW by complaint or worker count; a null count never lifts the class."""
    complaints, workers = as_column(complaints), as_column(workers)
    label: Column | None = None
    for (calls, heads), name in ((hi, "HIGH"), (mid, "MEDIUM")):
        reached = (complaints >= calls) | (workers >= heads)
        label = F.when(reached, name) if label is None else label.when(reached, name)
    return label.otherwise("LOW")


def classify_threat(df: DataFrame, hi=(3, 10), mid=(2, 5)) -> DataFrame:
    return df.withColumn("threat_label", threat_label("total_complaints", "total_workers_affected", hi, mid))


def severity(df: DataFrame) -> DataFrame:
    weight = lookup("threat_label", fixed.THREAT_SCORE)
    return df.withColumn("severity_score", F.col("total_complaints") * weight)


def escalate(df: DataFrame) -> DataFrame:
    """Three-valued: unknown violence on a group that is not HIGH stays unknown."""
    return df.withColumn("escalate_immediately", F.col("violence_flagged") | (F.col("threat_label") == "HIGH"))


def high_priority(df: DataFrame) -> DataFrame:
    return df.filter(F.col("escalate_immediately") | (F.col("threat_label") == "HIGH"))


def score_to_urgency(score: Column | str) -> Column:
    score = as_column(score)
    steps = [F.when(score >= floor, F.lit(name)) for floor, name in fixed.URGENCY_STEPS]
    return F.coalesce(*steps, F.lit(fixed.URGENCY_FLOOR))


def style_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "color": lookup("urgency", fixed.URGENCY_COLOR, fixed.DEFAULT_COLOR),
        "badge": lookup("urgency", fixed.URGENCY_BADGE, fixed.DEFAULT_BADGE),
    })


def marker_radius(measure: Column | str, factor: float) -> Column:
    return F.greatest(F.lit(8.0), as_column(measure).cast("double") * F.lit(float(factor)))


def marker_tooltip() -> Column:
    return fill_template("{contractor_name} — {total_complaints} complaints")


def with_mime(df: DataFrame, path: str = "path") -> DataFrame:
    ext = F.lower(F.substring_index(F.col(path), ".", -1))
    return df.withColumn("mime", lookup(ext, fixed.AUDIO_MIME, fixed.DEFAULT_MIME))
