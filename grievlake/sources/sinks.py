"""Writers. A target with a slash is a Parquet folder, any other name a catalog table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..schemas import CALLS, VECTORS
from .readers import is_path, read_table
from .text_files import write_text_files


def _write(df: DataFrame, target: str, mode: str) -> None:
    writer = df.write.mode(mode).format("parquet")
    if is_path(target):
        writer.save(target)
    else:
        writer.saveAsTable(target)


def overwrite(df: DataFrame, target: str) -> None:
    _write(df, target, "overwrite")


def append(df: DataFrame, target: str) -> None:
    _write(df, target, "append")


def current_schema(spark: SparkSession, target: str) -> T.StructType | None:
    if not is_path(target):
        return spark.table(target).schema if spark.catalog.tableExists(target) else None
    try:
        return read_table(spark, target).schema
    except AnalysisException:
        return None


def overwrite_merge_schema(df: DataFrame, target: str) -> None:
    """Overwrite the rows but keep columns the stored table already had (as nulls)."""
    stored = current_schema(df.sparkSession, target)
    if stored is not None:
        extra = [f for f in stored.fields if f.name not in df.columns]
        df = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in extra})
    overwrite(df, target)


def ensure_table(spark: SparkSession, name: str, schema: T.StructType) -> None:
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


def reset(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def start_append(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Start to append everything new to the table; the query ends by itself."""
    writer = (
        stream.writeStream.format("parquet").outputMode("append")
        .trigger(availableNow=True).option("checkpointLocation", checkpoint)
    )
    return writer.start(target) if is_path(target) else writer.toTable(target)


def ingest_bronze(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append everything new to the table, then stop. The checkpoint makes reruns exactly-once."""
    query = start_append(stream, target, checkpoint)
    query.awaitTermination()
    return query


def write_calls(calls: DataFrame, folder: str, lines: bool = False) -> None:
    """Call records as JSON: one file per record, or large line-delimited files for bulk export."""
    writer = calls.select(*CALLS.fieldNames()).write
    if not lines:
        writer = writer.option("maxRecordsPerFile", 1)
    writer.json(folder)


def write_vectors(vectors: DataFrame, target: str) -> None:
    overwrite(vectors.select(*VECTORS.fieldNames()), target)


def notice_key(name: str = "contractor_name"):
    """File key ``notice_<name>`` with blanks as underscores."""
    return F.concat(F.lit("notice_"), F.replace(F.col(name), F.lit(" "), F.lit("_")))


def notice_files(notices: DataFrame, text: str = "notice") -> tuple[DataFrame, DataFrame]:
    """(file_name, value of the notices that have a file of their own; contractor_name, file_key of the others).

    Names that differ only by blanks and underscores claim the same file, and so do several notices of one contractor;
    a missing name or one with a slash has none.
    """
    keyed = notices.select("contractor_name", notice_key().alias("file_key"), F.col(text).alias("value"))
    named = F.coalesce(~F.contains("file_key", F.lit("/")), F.lit(False))
    # the files come from one pass over the notices: of a key that is claimed once, the only text is the largest, too
    claims = keyed.groupBy("file_key").agg(F.count(F.lit(1)).alias("_claims"), F.max("value").alias("value"))
    files = claims.filter(named & (F.col("_claims") == 1)).select(F.concat("file_key", F.lit(".txt")).alias("file_name"), "value")
    counts = claims.select(F.col("file_key").alias("_claimed"), "_claims")
    joined = keyed.join(counts, F.col("file_key").eqNullSafe(F.col("_claimed")))
    return files, joined.filter(~named | (F.col("_claims") > 1)).select("contractor_name", "file_key")


def write_notices(notices: DataFrame, folder: str, text: str = "notice") -> DataFrame:
    """One text file ``notice_<name>.txt`` per contractor. Returns those without a file of their own."""
    files, others = notice_files(notices, text)
    write_text_files(files, folder)
    return others


def preview(df: DataFrame, size: int = 5) -> None:
    """Print the schema and the first rows."""
    df.printSchema()
    df.show(size, truncate=False)
