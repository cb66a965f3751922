"""Registered queries: hotspots and radar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import high_priority
from ..operators import hotspots, radar
from .registry import query
from .tables import COMPLAINTS_SQL, GOLD_SQL, complaints, table

_GOLD = f"WITH {COMPLAINTS_SQL}, {GOLD_SQL}"

_RADAR = f"""{_GOLD}, issue_counts AS (
  SELECT pincode, contractor_name, issue_type, count(*) AS n FROM complaints GROUP BY ALL
), issues AS (
  SELECT pincode, contractor_name, issue_type AS primary_issue FROM issue_counts
  QUALIFY row_number() OVER (PARTITION BY pincode, contractor_name ORDER BY n DESC, issue_type) = 1
), radar AS (
  SELECT contractor_name, pincode, total_complaints, severity_score::DOUBLE AS severity_score, primary_issue,
         CASE WHEN severity_score >= 8 THEN 'CRITICAL' WHEN severity_score >= 5 THEN 'HIGH'
              WHEN severity_score >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS urgency,
         CASE pincode WHEN '400053' THEN 19.0760 WHEN '411001' THEN 18.5204 WHEN '110001' THEN 28.6139
              WHEN '600001' THEN 13.0827 WHEN '500001' THEN 17.3850 WHEN '380001' THEN 23.0225
              ELSE 20.5937 END::DOUBLE AS lat,
         CASE pincode WHEN '400053' THEN 72.8777 WHEN '411001' THEN 73.8567 WHEN '110001' THEN 77.2090
              WHEN '600001' THEN 80.2707 WHEN '500001' THEN 78.4867 WHEN '380001' THEN 72.5714
              ELSE 78.9629 END::DOUBLE AS lon
  FROM gold JOIN issues USING (pincode, contractor_name)
), styled AS (
  SELECT *, CASE urgency WHEN 'CRITICAL' THEN '#e74c3c' WHEN 'HIGH' THEN '#e8622a' WHEN 'MEDIUM' THEN '#f39c12'
                         WHEN 'LOW' THEN '#2ecc71' ELSE '#f39c12' END AS color,
         CASE urgency WHEN 'CRITICAL' THEN 'badge-red' WHEN 'HIGH' THEN 'badge-orange'
                      WHEN 'MEDIUM' THEN 'badge-yellow' WHEN 'LOW' THEN 'badge-green'
                      ELSE 'badge-yellow' END AS badge
  FROM radar
)"""


def flat_gold(gold: DataFrame) -> DataFrame:
    """Gold with its two sets as comma-joined text, for comparison."""
    return gold.withColumns({
        "issue_types_reported": F.array_join("issue_types_reported", ","),
        "work_sites": F.array_join("work_sites", ","),
    })


def gold_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotspots.build_gold(complaints(spark, sf_dir))


def radar_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radar.radar_from_silver(complaints(spark, sf_dir))


@query("gold_heatmap", f"""{_GOLD}
SELECT pincode, contractor_name, total_complaints, array_to_string(issue_types_reported, ',') AS issue_types_reported,
       violence_flagged, total_workers_affected, array_to_string(work_sites, ',') AS work_sites, threat_label,
       severity_score, escalate_immediately
FROM gold""")
def gold_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_gold(gold_of(spark, sf_dir))


@query("threat_summary", f"""{_GOLD}
SELECT threat_label, count(*) AS hotspots, sum(total_complaints)::BIGINT AS complaints,
       sum(severity_score)::BIGINT AS severity, count_if(escalate_immediately) AS escalated
FROM gold GROUP BY threat_label""")
def threat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_of(spark, sf_dir).groupBy("threat_label").agg(
        F.count(F.lit(1)).alias("hotspots"),
        F.sum("total_complaints").alias("complaints"),
        F.sum("severity_score").alias("severity"),
        F.count_if("escalate_immediately").alias("escalated"),
    )


@query("high_priority_hotspots", f"""{_GOLD}
SELECT pincode, contractor_name, threat_label, severity_score, escalate_immediately
FROM gold WHERE escalate_immediately OR threat_label = 'HIGH'""")
def high_priority_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return high_priority(gold_of(spark, sf_dir)).select(
        "pincode", "contractor_name", "threat_label", "severity_score", "escalate_immediately"
    )


@query("first_escalations", f"""{_GOLD}
SELECT pincode, contractor_name, severity_score FROM gold WHERE escalate_immediately OR threat_label = 'HIGH'
ORDER BY severity_score DESC, pincode, contractor_name LIMIT 5""")
def first_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radar.first_escalations(gold_of(spark, sf_dir)).select("pincode", "contractor_name", "severity_score")


@query("radar_view", f"""{_RADAR}
SELECT contractor_name, pincode, total_complaints, severity_score, primary_issue, urgency, lat, lon FROM radar""")
def radar_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radar_of(spark, sf_dir)


@query("radar_kpis", f"""{_RADAR}
SELECT sum(total_complaints)::BIGINT AS total_complaints, count_if(urgency = 'CRITICAL') AS critical_zones,
       count(DISTINCT contractor_name) AS unique_contractors, count(DISTINCT pincode) AS affected_pincodes
FROM radar""")
def radar_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radar.radar_kpis(radar.with_urgency(gold_of(spark, sf_dir)))


@query("radar_filtered", f"""{_RADAR}
SELECT contractor_name, pincode, total_complaints, severity_score, primary_issue, urgency FROM radar
WHERE urgency IN ('CRITICAL', 'HIGH') AND primary_issue IN ('WAGE_THEFT', 'PHYSICAL_ASSAULT')""")
def radar_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = radar.radar_filter(radar_of(spark, sf_dir), ["CRITICAL", "HIGH"], ["WAGE_THEFT", "PHYSICAL_ASSAULT"])
    return chosen.drop("lat", "lon")


_MARKERS = """
SELECT contractor_name, pincode, lat, lon, greatest(8.0, {measure} * {factor})::DOUBLE AS radius,
       (greatest(8.0, {measure} * {factor}) + 6)::DOUBLE AS glow_radius, color,
       contractor_name || ' — ' || total_complaints || ' complaints' AS tooltip,
       contractor_name || chr(10) || 'Pincode: ' || pincode || chr(10) || 'Complaints: ' || total_complaints || chr(10)
         || 'Issue: ' || primary_issue || chr(10) || 'Severity: ' || printf('%.1f', severity_score) || chr(10)
         || 'Status: ' || urgency AS popup
FROM styled"""


@query("radar_markers", _RADAR + _MARKERS.format(measure="total_complaints", factor=3))
def radar_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radar.marker_table(radar_of(spark, sf_dir))


@query("radar_markers_by_severity", _RADAR + _MARKERS.format(measure="severity_score", factor=5))
def radar_markers_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radar.marker_table(radar_of(spark, sf_dir), "severity_score")


@query("radar_ranked", f"""{_RADAR}
SELECT contractor_name, pincode, total_complaints, severity_score, primary_issue, urgency, color, badge FROM styled
ORDER BY total_complaints DESC, pincode, contractor_name""")
def radar_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radar.radar_ranked(radar_of(spark, sf_dir))


@query("filter_values", f"""WITH {COMPLAINTS_SQL}
SELECT DISTINCT contractor_name FROM complaints""")
def filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radar.filter_values(complaints(spark, sf_dir), "contractor_name")


@query("coordinates_lookup", """
SELECT c_custkey AS custkey, c_nationkey::VARCHAR AS pincode,
       coalesce(n_nationkey * 1.5, 20.5937)::DOUBLE AS lat, coalesce(n_nationkey * 2.5, 78.9629)::DOUBLE AS lon
FROM customer LEFT JOIN (SELECT CASE WHEN n_nationkey >= 3 THEN n_nationkey END AS n_nationkey FROM nation)
     ON c_nationkey = n_nationkey""")
def coordinates_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every nation is there; the first ones have no coordinates, so their customers take the default
    known = F.when(F.col("n_nationkey") >= 3, F.col("n_nationkey"))
    places = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("pincode"), (known * 1.5).alias("lat"), (known * 2.5).alias("lon"),
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("pincode")
    )
    return radar.with_coordinates(customers, places).select("custkey", "pincode", "lat", "lon")
