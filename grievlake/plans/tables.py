"""The given star-schema tables seen as complaint, call, page and chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# issue code of a line's two flags
ISSUE_OF_FLAGS = {
    "RF": "WAGE_THEFT", "RO": "PHYSICAL_ASSAULT", "AF": "WRONGFUL_TERMINATION", "AO": "UNSAFE_CONDITIONS",
}


def issue_code() -> Column:
    flags = F.concat("l_returnflag", "l_linestatus")
    code = F.lit(None).cast("string")
    for key, issue in ISSUE_OF_FLAGS.items():
        code = F.when(flags == key, issue).otherwise(code)
    return F.coalesce(code, F.lit("OTHER"))


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver-shaped complaints: every line item with its order (place) and supplier (contractor)."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    joined = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
    )
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("call_id"),
        F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("pincode"),
        F.col("s_name").alias("contractor_name"),
        F.concat(F.lit("SITE_"), F.col("l_partkey") % 50).alias("work_site"),
        issue_code().alias("issue_type"),
        (F.col("l_discount") >= 0.09).alias("violence_threatened"),
        F.col("l_linenumber").cast("int").alias("worker_count_mentioned"),
    )


COMPLAINTS_SQL = """complaints AS (
  SELECT concat(l_orderkey, '-', l_linenumber) AS call_id,
         CASE WHEN length(o_custkey::VARCHAR) >= 6 THEN left(o_custkey::VARCHAR, 6)
              ELSE lpad(o_custkey::VARCHAR, 6, '0') END AS pincode,
         s_name AS contractor_name,
         concat('SITE_', l_partkey % 50) AS work_site,
         CASE l_returnflag || l_linestatus
              WHEN 'RF' THEN 'WAGE_THEFT' WHEN 'RO' THEN 'PHYSICAL_ASSAULT'
              WHEN 'AF' THEN 'WRONGFUL_TERMINATION' WHEN 'AO' THEN 'UNSAFE_CONDITIONS'
              ELSE 'OTHER' END AS issue_type,
         l_discount >= 0.09 AS violence_threatened,
         l_linenumber::INTEGER AS worker_count_mentioned
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
)"""

GOLD_SQL = """grouped AS (
  SELECT pincode, contractor_name, count(call_id) AS total_complaints,
         list_sort(list(DISTINCT issue_type)) AS issue_types_reported,
         bool_or(violence_threatened) AS violence_flagged,
         sum(worker_count_mentioned)::BIGINT AS total_workers_affected,
         list_sort(list(DISTINCT work_site)) AS work_sites
  FROM complaints GROUP BY pincode, contractor_name
), labelled AS (
  SELECT *, CASE WHEN total_complaints >= 3 OR total_workers_affected >= 10 THEN 'HIGH'
                 WHEN total_complaints >= 2 OR total_workers_affected >= 5 THEN 'MEDIUM'
                 ELSE 'LOW' END AS threat_label
  FROM grouped
), gold AS (
  SELECT *, total_complaints * CASE threat_label WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS severity_score,
         (threat_label = 'HIGH' OR violence_flagged) AS escalate_immediately
  FROM labelled
)"""
