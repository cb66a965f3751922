"""Row counts per table and layer."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import is_path, read_table


def count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("table_name"), "rows", F.lit("OK").alias("status")
    )


_ABSENT = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND")


def _uncounted(spark: SparkSession, name: str, status: str = "MISSING") -> DataFrame:
    return spark.range(1).select(
        F.lit(name).alias("table_name"), F.lit(None).cast("long").alias("rows"), F.lit(status).alias("status")
    )


def audit_tables(spark: SparkSession, names: list[str]) -> DataFrame:
    """table_name, rows, status, all_good. Counting reads no column; absent tables are
    reported as MISSING, others that cannot be read as UNREADABLE."""
    parts = []
    for name in names:
        label = name.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet") if is_path(name) else name.rsplit(".", 1)[-1]
        try:
            if not is_path(name) and not spark.catalog.tableExists(name):
                parts.append(_uncounted(spark, label))
                continue
            parts.append(count_rows(read_table(spark, name), label))
        except AnalysisException as error:
            parts.append(_uncounted(spark, label, "MISSING" if error.getCondition() in _ABSENT else "UNREADABLE"))
    counts = reduce(DataFrame.unionByName, parts)
    bad = counts.agg(F.count_if(F.col("status") != "OK").alias("n")).scalar()
    return counts.withColumn("all_good", bad == 0)
