"""Registered queries: call records, recency, streams, readers and writers, audit."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import with_mime
from ..functions import shape
from ..functions.shape import conform, ensure_columns, rename_if_present
from ..functions.text import base_name, extension, or_default
from ..operators import audit, notices, radar
from ..operators.calls import assign_call_ids, call_records, run_scoped_ids
from ..operators.recency import complaints_48h
from ..schemas import CALLS, CHUNKS, SCHEMES, SILVER
from ..sources import readers, sinks, text_files
from ..sources.storage import new_folder, stage
from ..streaming import jobs
from .hotspot_queries import flat_gold, radar_of
from .legal_queries import _TARGET_SQL
from .registry import ORACLES, QUERIES, query
from .tables import COMPLAINTS_SQL, complaints, table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


# --- call records -----------------------------------------------------------------------------------

@query("call_manifest", r"""
SELECT page_id, url AS path, lower(split_part(url, '.', -1)) AS ext, 'audio/wav' AS mime, split_part(url, '/', -1) AS name
FROM pages""")
def call_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    typed = with_mime(files.withColumn("ext", extension("path")))
    return typed.withColumn("name", base_name("path"))


@query("mime_types", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'audio/mpeg' WHEN '2-HIGH' THEN 'audio/mp4'
  WHEN '3-MEDIUM' THEN 'audio/ogg' ELSE 'audio/wav' END AS mime
FROM orders""")
def mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.when(F.col("o_orderpriority") == "1-URGENT", ".MP3").when(F.col("o_orderpriority") == "2-HIGH", ".m4a") \
        .when(F.col("o_orderpriority") == "3-MEDIUM", ".v2.ogg").otherwise(".mp4")
    files = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("/calls/call "), "o_orderkey", ext).alias("path")
    )
    return with_mime(files).select("o_orderkey", "mime")


@query("assign_call_ids", """
SELECT row_number() OVER (ORDER BY url, page_id) + 1000 AS call_id, url AS path, page_id,
       'call_' || (row_number() OVER (ORDER BY url, page_id) + 1000) || '.json' AS file_name
FROM pages""")
def call_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), "page_id")
    return assign_call_ids(files, offset=1000, order=["path", "page_id"])


@query("call_ids_from_one", """
SELECT n AS call_id, 'call_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END || '.json' AS file_name, s_suppkey
FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_name DESC, s_suppkey) AS n FROM supplier)""")
def call_ids_from_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of fewer than three digits are padded in file names."""
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/calls/"), "s_name").alias("path"), "s_suppkey")
    ranked = files.withColumn("path", F.translate("path", "0123456789", "9876543210"))
    return assign_call_ids(ranked, order=["path", "s_suppkey"]).select("call_id", "file_name", "s_suppkey")


@query("call_records", """
SELECT row_number() OVER (ORDER BY conv_id, turn) AS call_id, '000000' AS pincode, md5(text) AS text_digest,
       true AS duration_in_range, conv_id || '-' || turn || '.wav' AS audio_source
FROM (SELECT *, lpad(conv_id::VARCHAR, 9, '0') || lpad(turn::VARCHAR, 3, '0') FROM conversations)
WHERE length(text) > 0""")
def calls_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcripts = table(spark, sf_dir, "conversations").select(
        F.format_string("/audio/%09d/%03d/%d-%d.wav", "conv_id", "turn", "conv_id", "turn").alias("path"), "text"
    )
    return call_records(transcripts).select(
        "call_id", "pincode", F.md5("hindi_audio_text").alias("text_digest"),
        F.col("call_duration_seconds").between(30, 180).alias("duration_in_range"), "audio_source",
    )


@query("run_scoped_ids", """
SELECT 'DYNAMIC-' || row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS call_id, s_suppkey FROM supplier""")
def scoped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select((-F.col("s_acctbal")).alias("lowest_first"), "s_suppkey")
    return run_scoped_ids(rows, "DYNAMIC-", ["lowest_first", "s_suppkey"]).select("call_id", "s_suppkey")


# --- shape ------------------------------------------------------------------------------------------

@query("rename_defaults", """
SELECT c_custkey AS custkey, c_name AS contractor_name, c_acctbal AS severity_score, 'Unknown Issue' AS primary_issue,
       1 AS total_complaints, coalesce(nullif(CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END, ''), '000000')
         AS pincode
FROM customer""")
def rename_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_name").alias("contractor"), F.col("c_acctbal").alias("score"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("pincode"),
    )
    renamed = rename_if_present(rows, {"contractor": "contractor_name", "score": "severity_score", "issue": "primary_issue"})
    whole = ensure_columns(renamed, {"primary_issue": "Unknown Issue", "total_complaints": 1, "pincode": "none"})
    return whole.withColumn("pincode", or_default("pincode", "000000"))


@query("radar_normalised", """
SELECT c_name AS contractor_name, c_custkey AS total_complaints, c_acctbal AS severity_score,
       c_mktsegment AS primary_issue, CASE WHEN c_nationkey = 4 THEN '400053' ELSE '1' END AS pincode,
       CASE WHEN c_nationkey = 4 THEN 19.0760 ELSE 20.5937 END::DOUBLE AS lat,
       CASE WHEN c_nationkey = 4 THEN 72.8777 ELSE 78.9629 END::DOUBLE AS lon
FROM customer""")
def radar_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("contractor"), F.col("c_custkey").alias("complaint_count"),
        F.col("c_acctbal").alias("score"), F.col("c_mktsegment").alias("issue"),
        F.when(F.col("c_nationkey") == 4, 400053).otherwise(1).alias("pincode"),
    )
    return radar.normalise_radar(rows).withColumn("pincode", F.col("pincode").cast("string"))


@query("conform_silver", f"""WITH {COMPLAINTS_SQL}
SELECT call_id, pincode, contractor_name, CASE WHEN worker_count_mentioned = 3 THEN NULL ELSE worker_count_mentioned END
  AS worker_count_mentioned, violence_threatened FROM complaints""")
def conform_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers = F.col("worker_count_mentioned")
    rows = complaints(spark, sf_dir).withColumns({
        "worker_count_mentioned": F.when(workers == 3, "many").otherwise(workers.cast("string")),
        "violence_threatened": F.col("violence_threatened").cast("string"),
        "raw_text": F.lit("x"), "english_text": F.lit("x"),
    })
    kept = ["call_id", "pincode", "contractor_name", "worker_count_mentioned", "violence_threatened"]
    return conform(rows, SILVER).select(*kept)


# --- recency ----------------------------------------------------------------------------------------

@query("complaints_48h", """
SELECT event_id, user_id, count(*) OVER (
  PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 48 HOURS PRECEDING AND CURRENT ROW) AS complaints_48h
FROM events""")
def recent_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return complaints_48h(rows, key="user_id", ts="ts").select("event_id", "user_id", "complaints_48h")


@query("complaints_48h_by_type", """
SELECT event_id, event_type, count(*) OVER (
  PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 48 HOURS PRECEDING AND CURRENT ROW) AS complaints_48h
FROM events""")
def recent_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few keys with very many rows each."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return complaints_48h(rows, key="event_type", ts="ts").select("event_id", "event_type", "complaints_48h")


# --- streams ----------------------------------------------------------------------------------------

_BRONZE_SQL = """
SELECT event_id AS call_id, lpad(user_id::VARCHAR, 6, '0') AS pincode, event_type AS hindi_audio_text,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, user_id AS call_duration_seconds,
       'call ' || event_id || '.wav' AS audio_source
FROM events"""
_CALLS_PER_FILE = 500


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as call records."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"),
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("pincode"),
        F.col("event_type").alias("hindi_audio_text"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("user_id").alias("call_duration_seconds"),
        F.concat(F.lit("call "), "event_id", F.lit(".wav")).alias("audio_source"),
    )


def _call_arrays(calls: DataFrame) -> DataFrame:
    """file, value: pretty-printed JSON arrays of at most ``_CALLS_PER_FILE`` records (ids are unique)."""
    row = F.struct(*CALLS.fieldNames())
    grouped = calls.groupBy(F.floor(F.col("call_id") / _CALLS_PER_FILE).alias("file")).agg(F.collect_list(row).alias("rows"))
    return grouped.select("file", F.to_json("rows", {"pretty": "true"}).alias("value"))


def _write_call_arrays(calls: DataFrame, folder: str) -> None:
    _call_arrays(calls).select("value").write.option("maxRecordsPerFile", 1).text(folder)


@query("bronze_ingest", _BRONZE_SQL)
def bronze_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pretty-printed files, taken up by two runs: the second finds nothing new."""
    base = new_folder(spark, "bronze")
    _write_call_arrays(event_calls(spark, sf_dir), f"{base}/in")
    for _ in range(2):
        jobs.ingest_calls(spark, f"{base}/in", f"{base}/bronze", f"{base}/checkpoint", pattern="*.txt")
    return spark.read.schema(CALLS).parquet(f"{base}/bronze")


@query("bronze_rejects", f"""
SELECT 'call' AS kind, event_id::VARCHAR AS what, true AS named FROM events WHERE (event_id // {_CALLS_PER_FILE}) % 3 <> 1
UNION ALL SELECT DISTINCT 'reject', '{{{{"call_id": ' || (event_id // {_CALLS_PER_FILE}) || ', cut off', true FROM events
WHERE (event_id // {_CALLS_PER_FILE}) % 3 = 1""".replace("{{", "{"))
def bronze_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third file is cut off; it is set aside with its path and text, once, although two runs look for files."""
    base = new_folder(spark, "bronze")
    texts = _call_arrays(event_calls(spark, sf_dir))
    cut = F.concat(F.lit('{"call_id": '), F.col("file").cast("string"), F.lit(", cut off"))
    broken = texts.select(F.when(F.col("file") % 3 == 1, cut).otherwise(F.col("value")).alias("value"))
    broken.write.option("maxRecordsPerFile", 1).text(f"{base}/in")
    for _ in range(2):
        jobs.ingest_calls(spark, f"{base}/in", f"{base}/bronze", f"{base}/checkpoint", pattern="*.txt")
    taken = readers.read_table(spark, f"{base}/bronze").select(
        F.lit("call").alias("kind"), F.col("call_id").cast("string").alias("what"), F.lit(True).alias("named")
    )
    rejects = readers.read_table(spark, f"{base}/bronze_rejects").select(
        F.lit("reject").alias("kind"), F.rtrim("text", F.lit("\n")).alias("what"), F.contains("path", F.lit("/in/")).alias("named")
    )
    return taken.unionByName(rejects)


@query("bronze_ingest_lines", _BRONZE_SQL)
def bronze_ingest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-delimited bulk export, read as a stream."""
    base = new_folder(spark, "bronze")
    sinks.write_calls(event_calls(spark, sf_dir), f"{base}/in", lines=True)
    jobs.ingest_calls(spark, f"{base}/in", f"{base}/bronze", f"{base}/checkpoint", lines=True)
    return spark.read.schema(CALLS).parquet(f"{base}/bronze")


@query("calls_read", _BRONZE_SQL)
def calls_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "calls")
    _write_call_arrays(event_calls(spark, sf_dir), folder)
    return readers.read_calls(spark, folder, pattern="*.txt")


@query("complaints_48h_stream", """WITH windows AS (
  SELECT user_id, date_trunc('day', ts) - to_days(shift) AS window_start FROM events, (VALUES (0), (1)) s(shift)
), counted AS (
  SELECT user_id, window_start, window_start + INTERVAL 48 HOURS AS window_end, count(*) AS complaints
  FROM windows GROUP BY ALL
)
SELECT user_id, strftime(window_start, '%Y-%m-%d') AS window_start, strftime(window_end, '%Y-%m-%d') AS window_end, complaints
FROM counted WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def complaints_48h_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows of the event stream."""
    base = new_folder(spark, "windows")
    events = stage(table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "events")
    stream = jobs.stream_table(spark, events.inputFiles()[0].rsplit("/", 1)[0], events.schema)
    counts = jobs.counts_48h_stream(stream, key="user_id", ts="ts")
    jobs.write_counts(counts, f"{base}/counts", f"{base}/checkpoint", once=True)
    day = "yyyy-MM-dd"
    return spark.read.schema(counts.schema).parquet(f"{base}/counts").select(
        "user_id", F.date_format("window_start", day).alias("window_start"),
        F.date_format("window_end", day).alias("window_end"), "complaints",
    )


@query("gold_refresh", ORACLES["gold_heatmap"])
def gold_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complaints arrive as a stream, in three batches; the refreshed table equals the batch result."""
    base = new_folder(spark, "gold")
    silver = conform(ensure_columns(complaints(spark, sf_dir), {"raw_text": "", "english_text": ""}), SILVER)
    parts = max(3, spark.sparkContext.defaultParallelism)
    silver.repartition(parts).write.parquet(f"{base}/silver")
    stream = jobs.stream_table(spark, f"{base}/silver", SILVER, files_per_trigger=-(-parts // 3))
    jobs.refresh_gold(stream, f"{base}/gold", f"{base}/checkpoint", once=True)
    return flat_gold(jobs.read_current_gold(spark, f"{base}/gold"))


# --- readers, writers, audit ------------------------------------------------------------------------

@query("csv_roundtrip", """
SELECT p_partkey, p_name AS scheme_name, p_brand || ', "quoted"' AS eligibility, p_type AS benefits, p_size FROM part""")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "csv")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("scheme_name"), F.concat("p_brand", F.lit(', "quoted"')).alias("eligibility"),
        F.col("p_type").alias("benefits"), "p_size",
    )
    rows.write.option("header", True).option("escape", '"').csv(folder)
    return readers.read_schemes(spark, folder)


@query("sinks_roundtrip", """
SELECT p_partkey, p_name, NULL::VARCHAR AS note FROM part UNION ALL SELECT p_partkey, p_brand, NULL FROM part""")
def sinks_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwrite with an extra column, overwrite without it (the column stays), then append."""
    folder = new_folder(spark, "sinks")
    parts = table(spark, sf_dir, "part")
    sinks.overwrite(parts.select("p_partkey", "p_name", F.lit("old").alias("note")), folder)
    sinks.overwrite_merge_schema(parts.select("p_partkey", "p_name"), folder)
    sinks.append(parts.select("p_partkey", F.col("p_brand").alias("p_name"), F.lit(None).cast("string").alias("note")), folder)
    return readers.read_table(spark, folder)


@query("vectors_roundtrip", """
SELECT vec_id::VARCHAR AS chunk_id, 'v' || label AS content, 'BNS_2023' AS source, round(list_sum(embedding), 3) AS total
FROM embeddings""")
def vectors_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "vectors")
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("v"), "label").alias("content"),
        F.lit("BNS_2023").alias("source"), "embedding",
    )
    sinks.write_vectors(vectors, folder)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return readers.read_vectors(spark, folder).select(*CHUNKS.fieldNames(), F.round(total, 3).alias("total"))


@query("notices_roundtrip", f"""{_TARGET_SQL}
SELECT 'notice_' || replace(contractor_name, ' ', '_') || '.txt' AS file_name, 'SHOW CAUSE NOTICE' AS first_line,
       'To: Contractor ' || contractor_name || ', Pincode ' || pincode AS second_line
FROM target""")
def notices_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exported text file per contractor, read back whole."""
    folder = new_folder(spark, "notices")
    sinks.write_notices(notices.show_cause_notice(notices.notice_target(radar_of(spark, sf_dir))), folder)
    files = text_files.read_text_files(spark, folder, "notice_*.txt")
    line = lambda n: F.get(F.split("value", "\n"), F.lit(n))
    return files.select("file_name", line(0).alias("first_line"), line(1).alias("second_line"))


@query("notices_without_file", f"""{_TARGET_SQL}
SELECT twice AS contractor_name, 'notice_' || replace(twice, ' ', '_') AS file_key
FROM (SELECT unnest([contractor_name || ' Sons', contractor_name || '_Sons']) AS twice FROM target)""")
def notices_without_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contractors whose names differ only by a blank and an underscore claim the same file: they are reported."""
    rows = notices.show_cause_notice(notices.notice_target(radar_of(spark, sf_dir))).select("contractor_name", "notice")
    names = F.array(*[F.concat("contractor_name", F.lit(end)) for end in ("", " Sons", "_Sons")])
    return sinks.notice_files(rows.select(F.explode(names).alias("contractor_name"), "notice"))[1]


@query("catalog_tables", """
SELECT p_name AS scheme_name, p_brand AS eligibility, p_type AS benefits, NULL::VARCHAR AS application, 'stored' AS origin FROM part
UNION ALL SELECT p_name, p_brand, p_type, NULL::VARCHAR, 'appended' FROM part WHERE p_size > 25
UNION ALL SELECT 'Pension', 'workers over sixty', 'monthly pay', 'office', 'fallback'
UNION ALL SELECT 'Pension', 'workers over sixty', 'monthly pay', 'office', 'fallback'""")
def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the session's catalog: empty, given rows stand in for it; it is created, appended to twice, read, and
    dropped, after which the given rows stand in for it again."""
    name, given = "grievlake_" + uuid.uuid4().hex, [("Pension", "workers over sixty", "monthly pay", "office")]
    parts = table(spark, sf_dir, "part")
    schemes = parts.select(
        F.col("p_name").alias("scheme_name"), F.col("p_brand").alias("eligibility"), F.col("p_type").alias("benefits"),
        F.lit(None).cast("string").alias("application"), F.lit("stored").alias("origin"), "p_size",
    )
    schema = T.StructType([*SCHEMES.fields, T.StructField("origin", T.StringType())])
    sinks.ensure_table(spark, name, schema)
    sinks.ensure_table(spark, name, schema)
    fallback = [(*row, "fallback") for row in given]
    before = readers.table_or_default(spark, name, fallback, schema)
    sinks.append(schemes.drop("p_size"), name)
    sinks.append(schemes.filter("p_size > 25").drop("p_size").withColumn("origin", F.lit("appended")), name)
    kept = stage(readers.table_or_default(spark, name, fallback, schema), "schemes")
    sinks.reset(spark, name)
    return before.unionByName(kept).unionByName(readers.table_or_default(spark, name, fallback, schema))


@query("table_audit", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows, 'OK' AS status, false AS all_good FROM {t}" for t in TABLES
) + " UNION ALL SELECT 'absent', NULL, 'MISSING', false")
def table_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_tables(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES] + [f"{sf_dir}/absent.parquet"])


@query("table_audit_all_good", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows, 'OK' AS status, true AS all_good FROM {t}" for t in TABLES
))
def table_audit_all_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_tables(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES])


@query("vectors_as_json", """
SELECT vec_id, json_object('chunk_id', vec_id::VARCHAR, 'content', 'v' || label)::VARCHAR AS row_json FROM embeddings""")
def vectors_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON text without the vector."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.struct(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("v"), "label").alias("content"), "embedding").alias("r"))
    return rows.select("vec_id", shape.json_without("r", ["embedding"]).alias("row_json"))


@query("layer_counts", f"""WITH {COMPLAINTS_SQL}
SELECT 'silver' AS table_name, count(*) AS rows, 'OK' AS status FROM complaints
UNION ALL SELECT 'gold', count(*), 'OK' FROM (SELECT DISTINCT pincode, contractor_name FROM complaints)""")
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = audit.count_rows(complaints(spark, sf_dir), "silver")
    gold = audit.count_rows(QUERIES["gold_heatmap"](spark, sf_dir), "gold")
    return reduce(DataFrame.unionByName, [silver, gold])

