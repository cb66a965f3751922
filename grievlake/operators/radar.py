"""Dashboard tables: radar view, KPIs, filters, markers and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.scores import high_priority, marker_radius, marker_tooltip, score_to_urgency, style_columns
from ..functions.shape import ensure_columns, rename_if_present
from ..functions.text import fill_template, lookup
from .hotspots import KEYS, scores_with_primary_issue


def primary_issue(silver: DataFrame) -> DataFrame:
    """Most frequent issue per hotspot; equal counts go to the alphabetically first."""
    counts = silver.groupBy(*KEYS, "issue_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*KEYS).agg(
        F.min_by("issue_type", F.struct(-F.col("n"), F.col("issue_type"))).alias("primary_issue")
    )


def with_coordinates(df: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """lat / lon by pincode, with a fixed default. ``places(pincode, lat, lon)`` overrides the fixed rows."""
    if places is None:
        spot = lookup(F.col("pincode").cast("string"), fixed.PINCODE_COORDINATES, fixed.DEFAULT_COORDINATES)
        return df.withColumn("_spot", spot).withColumns(
            {"lat": F.col("_spot")[0], "lon": F.col("_spot")[1]}
        ).drop("_spot")
    lat, lon = fixed.DEFAULT_COORDINATES
    keyed = places.select(F.col("pincode").cast("string").alias("pincode"), "lat", "lon")
    joined = df.withColumn("pincode", F.col("pincode").cast("string")).join(keyed, ["pincode"], "left")
    return joined.withColumns({
        "lat": F.coalesce("lat", F.lit(lat)),
        "lon": F.coalesce("lon", F.lit(lon)),
    })


def build_radar(silver: DataFrame, gold: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Gold plus one primary issue, coordinates and urgency. Both join sides hold one row per hotspot."""
    return _radar_of(gold.join(primary_issue(silver), KEYS, "left"), places)


def radar_from_silver(silver: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """The same from complaints alone: scores and primary issue come from one aggregate, without a join."""
    return _radar_of(scores_with_primary_issue(silver), places)


def _radar_of(joined: DataFrame, places: DataFrame | None) -> DataFrame:
    return with_coordinates(with_urgency(joined.select(
        "contractor_name", "pincode", "total_complaints",
        F.col("severity_score").cast("double").alias("severity_score"), "primary_issue",
    )), places)


def normalise_radar(df: DataFrame) -> DataFrame:
    """Accept tables with older column names or without coordinates."""
    renamed = rename_if_present(df, fixed.RADAR_RENAMES)
    if "lat" in renamed.columns:
        return ensure_columns(renamed, {"lon": fixed.DEFAULT_COORDINATES[1]})
    return with_coordinates(renamed)


def with_urgency(df: DataFrame) -> DataFrame:
    return df.withColumn("urgency", score_to_urgency("severity_score"))


def radar_kpis(radar: DataFrame) -> DataFrame:
    return radar.agg(
        F.sum("total_complaints").alias("total_complaints"),
        F.count_if(F.col("urgency") == "CRITICAL").alias("critical_zones"),
        F.count_distinct("contractor_name").alias("unique_contractors"),
        F.count_distinct("pincode").alias("affected_pincodes"),
    )


def radar_filter(radar: DataFrame, urgencies: list[str], issues: list[str]) -> DataFrame:
    """Rows in both lists; an empty list selects nothing."""
    return radar.filter(F.col("urgency").isin(urgencies) & F.col("primary_issue").isin(issues))


def filter_values(radar: DataFrame, column: str) -> DataFrame:
    return radar.select(column).distinct()


def marker_table(radar: DataFrame, size_by: str = "total_complaints") -> DataFrame:
    """Map markers: place, radii, colour, tooltip and popup text."""
    factor = 3 if size_by == "total_complaints" else 5
    styled = style_columns(radar).withColumn("radius", marker_radius(size_by, factor))
    popup = fill_template(
        "{contractor_name}\nPincode: {pincode}\nComplaints: {total_complaints}\n"
        "Issue: {primary_issue}\nSeverity: {severity_score:.1f}\nStatus: {urgency}"
    )
    return styled.select(
        "contractor_name", "pincode", "lat", "lon", "radius",
        (F.col("radius") + 6).alias("glow_radius"), "color",
        marker_tooltip().alias("tooltip"), popup.alias("popup"),
    )


def radar_ranked(radar: DataFrame) -> DataFrame:
    """Styled hotspots, most complaints first."""
    shown = style_columns(radar).select(
        "contractor_name", "pincode", "total_complaints", "severity_score", "primary_issue", "urgency",
        "color", "badge",
    )
    return shown.orderBy(F.desc("total_complaints"), "pincode", "contractor_name")


def first_escalations(gold: DataFrame, size: int = 5) -> DataFrame:
    """The ``size`` most severe hotspots that need action."""
    return high_priority(gold).orderBy(F.desc("severity_score"), "pincode", "contractor_name").limit(size)
