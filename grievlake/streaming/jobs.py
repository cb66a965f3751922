"""Continuous parts of the pipeline: call ingest, silver append, gold refresh, windowed counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.complaints import build_silver
from ..operators.hotspots import KEYS, PART_KEYS, hotspot_parts, hotspots_of_parts, merge_parts, score_hotspots
from ..schemas import GOLD
from ..sources.readers import stream_calls_and_rejects
from ..sources.sinks import start_append
from ..sources.storage import stage

DASHBOARD_INTERVAL = "60 seconds"
GOLD_BUCKETS = 32  # pieces of gold that are rewritten on their own
SLICE_ROWS = 100_000  # parts that one slice of a bucket should hold
_PARTS = T.StructType(
    [T.StructField(c, T.StringType()) for c in PART_KEYS]
    + [T.StructField(c, T.LongType()) for c in ("_calls", "_rows", "_workers")] + [T.StructField("_violence", T.IntegerType())]
)
_VERSION = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("run", T.StringType())])


def ingest_calls(
    spark: SparkSession, folder: str, target: str, checkpoint: str, lines: bool = False, pattern: str = "*.json",
    files_per_trigger: int | None = 10_000, rejects: str | None = None,
) -> StreamingQuery:
    """Take up every call file not seen before, append its rows, and stop. A large folder is taken up in
    batches of ``files_per_trigger`` files, each committed on its own.

    What cannot be read goes to ``rejects`` (by default ``<target>_rejects``) with its path and text, by a second query
    with a checkpoint of its own that runs beside the first: each of them is exactly-once.
    """
    calls, unread = stream_calls_and_rejects(spark, folder, lines, pattern, files_per_trigger)
    other = start_append(unread, rejects or target.rstrip("/") + "_rejects", checkpoint.rstrip("/") + "_rejects")
    query = start_append(calls, target, checkpoint)
    for started in (query, other):
        started.awaitTermination()
    return query


def stream_table(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder as a stream, in batches of so many files if a number is given."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def silver_stream(bronze: DataFrame) -> DataFrame:
    """Entity extraction by word rules needs no state, so the batch plan serves streams too."""
    return build_silver(bronze)


def _start(writer, once: bool, interval: str) -> StreamingQuery:
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    query = writer.trigger(**trigger).start()
    if once:
        query.awaitTermination()
    return query


def _children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system; none if it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The batches that have written a whole version list."""
    named = [n for n in _children(spark, f"{folder}/versions") if n.startswith("batch-")]
    whole = [n for n in named if "_SUCCESS" in _children(spark, f"{folder}/versions/{n}")]
    return sorted(int(n.removeprefix("batch-")) for n in whole)


def _version(spark: SparkSession, folder: str, batch: int) -> dict[int, str]:
    """The run that wrote each bucket as this version has it; at most one row per bucket."""
    rows = spark.read.schema(_VERSION).parquet(f"{folder}/versions/batch-{batch}").collect()
    return {r["bucket"]: r["run"] for r in rows}


def _read_buckets(spark: SparkSession, folder: str, kind: str, schema: T.StructType, runs: dict[int, str]) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{kind}/{run}/bucket={b}" for b, run in sorted(runs.items())])


def _deal(parts: DataFrame, slices: int, buckets: int) -> DataFrame:
    """Parts dealt by bucket and, within it, by slices of whole hotspots, so that a task's share does not grow with the
    bucket. Neither the sums nor the hotspots of the dealt rows need another shuffle."""
    sliced = parts.withColumn("_slice", F.pmod(F.hash(*KEYS), F.lit(slices)))
    dealt_by = ("bucket", "_slice")
    return sliced.repartition(*dealt_by) if slices == 1 else sliced.repartition(slices * buckets, *dealt_by)


def refresh_gold(
    silver: DataFrame, folder: str, checkpoint: str, once: bool = False, interval: str = DASHBOARD_INTERVAL,
    buckets: int = GOLD_BUCKETS,
) -> StreamingQuery:
    """Keep gold current: only new complaints are read, and only the hotspots' buckets that they touch are rewritten.

    A bucket holds the hotspots of one hash value: their parts (one row per hotspot, issue and site) and their gold.
    A batch reduces its complaints to parts, adds those that the touched buckets hold already, writes parts and gold of
    these buckets into a run of its own, and at last the list that names the run of every bucket. Other buckets keep
    their files. Readers follow the newest whole list, so they never see a half-written version; a batch that is
    repeated after its list was written does nothing, and one repeated before writes a new run.
    """
    def write_version(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _versions(spark, folder)
        if number in known:
            return
        runs = _version(spark, folder, known[-1]) if known else {}
        bucket = F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int").alias("bucket")
        new = stage(hotspot_parts(batch).select("*", bucket), "parts")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most one row per bucket
        run = f"run-{uuid.uuid4().hex}"
        if touched:
            held = _read_buckets(spark, folder, "parts", _PARTS, {b: runs[b] for b in touched if b in runs})
            both = new.unionByName(held.select("*", bucket))
            slices = -(-both.count() // (SLICE_ROWS * len(touched)))  # the files know their numbers of rows
            merged = merge_parts(_deal(both, slices, len(touched)), ("bucket", "_slice")).drop("_slice")
            merged.write.partitionBy("bucket").parquet(f"{folder}/parts/{run}")
            now = _read_buckets(spark, folder, "parts", _PARTS, dict.fromkeys(touched, run)).select("*", bucket)
            gold = score_hotspots(hotspots_of_parts(_deal(now, slices, len(touched)), ("bucket", "_slice")))
            gold.write.partitionBy("bucket").parquet(f"{folder}/gold/{run}")
        rows = sorted({**runs, **dict.fromkeys(touched, run)}.items())
        listed = spark.createDataFrame(rows, _VERSION).coalesce(1)
        listed.write.mode("overwrite").parquet(f"{folder}/versions/batch-{number}")

    writer = silver.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write_version)
    return _start(writer, once, interval)


def read_current_gold(spark: SparkSession, folder: str) -> DataFrame:
    """The newest complete version."""
    known = _versions(spark, folder)
    return _read_buckets(spark, folder, "gold", GOLD, _version(spark, folder, known[-1]) if known else {})


def drop_versions(spark: SparkSession, folder: str, keep: int = 10) -> int:
    """Delete all versions but the newest ``keep`` and the runs that only they name; call it when no reader needs older
    ones and no refresh is writing. Returns how many versions went."""
    known = _versions(spark, folder)
    kept, old = (known[-keep:], known[:-keep]) if keep else ([], known)
    needed = {run for batch in kept for run in _version(spark, folder, batch).values()}
    gone = [f"versions/batch-{batch}" for batch in old]
    gone += [f"{kind}/{run}" for kind in ("parts", "gold") for run in _children(spark, f"{folder}/{kind}") if run not in needed]
    files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for name in gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
    return len(old)


def counts_48h_stream(
    calls: DataFrame, key: str = "contractor_name", ts: str = "timestamp",
    window: str = "48 hours", slide: str = "24 hours", delay: str = "1 hour",
) -> DataFrame:
    """Complaints per contractor and 48-hour window, sliding daily; late rows count up to ``delay``.

    A time that cannot be read belongs to no window.
    """
    timed = calls.withColumn("_at", F.col(ts).try_cast("timestamp")).withWatermark("_at", delay)
    return timed.groupBy(F.window("_at", window, slide).alias("w"), key).agg(
        F.count(F.lit(1)).alias("complaints")
    ).select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "complaints")


def write_counts(
    counts: DataFrame, folder: str, checkpoint: str, once: bool = False, interval: str = DASHBOARD_INTERVAL
) -> StreamingQuery:
    """Append closed windows to a Parquet folder."""
    writer = (
        counts.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", folder)
    )
    return _start(writer, once, interval)
