"""Registered queries: texts to sparse vectors to nearest chunks, and complaints to prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..operators import corpus, legal, retrieval
from ..operators.vectors import BUCKETS, MIX, UNIT
from ..sources.storage import stage
from .hotspot_queries import _GOLD
from .legal_queries import LABEL_SQL, stored_labels
from .registry import query
from .tables import ISSUE_OF_FLAGS, complaints, table

#: Standard CRC-32 of a word's bytes, multiplied, and the upper part of 32 bits taken.
_BUCKET = f"""(xor(list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(range(0, strlen(word)), lambda i: ('0x' || substr(hex(word), (2 * i + 1)::INTEGER, 2))::UBIGINT)),
  lambda crc, b: list_reduce([xor(crc, b), 0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[],
    lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) * {MIX}::UBIGINT
  % 4294967296 * {BUCKETS}) >> 32"""

#: From ``chunks`` (chunk_id, content) and ``asked`` (query_id, query_text) to ``hits``.
HITS_SQL = rf"""words AS (
  SELECT 'chunk' AS side, chunk_id::VARCHAR AS id, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS word FROM chunks
  UNION ALL
  SELECT 'query', query_id::VARCHAR, unnest(regexp_extract_all(lower(query_text), '[\p{{L}}\p{{M}}\p{{N}}_]+')) FROM asked
), vocabulary AS MATERIALIZED (
  SELECT word, {_BUCKET} AS bucket FROM (SELECT DISTINCT word FROM words)
), frequency AS (
  SELECT side, id, bucket, count(*) AS tf FROM words JOIN vocabulary USING (word) GROUP BY side, id, bucket
), held AS (
  SELECT bucket, count(*) AS df FROM frequency WHERE side = 'chunk' GROUP BY bucket
), weighted AS (
  SELECT side, id, bucket, tf * ln(((SELECT count(content) FROM chunks) + 1) / (coalesce(df, 0) + 1)) AS w
  FROM frequency LEFT JOIN held USING (bucket)
), whole AS MATERIALIZED (
  SELECT * FROM (SELECT side, id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) * {UNIT})::BIGINT AS w FROM weighted WHERE w > 0)
  WHERE w > 0
), products AS (
  SELECT q.id AS query_id, c.id AS chunk_id, sum(q.w * c.w) AS product
  FROM whole q JOIN whole c USING (bucket) WHERE q.side = 'query' AND c.side = 'chunk' GROUP BY q.id, c.id
), every AS (
  SELECT q.id AS query_id, c.id AS chunk_id, coalesce(product, 0) AS product
  FROM (SELECT DISTINCT id FROM whole WHERE side = 'query') q, (SELECT DISTINCT id FROM whole WHERE side = 'chunk') c
       LEFT JOIN products p ON p.query_id = q.id AND p.chunk_id = c.id
), hits AS (
  SELECT query_id, chunk_id, 2 - 2 * (product / {float(UNIT) ** 2}) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY product DESC, chunk_id) AS rank
  FROM every QUALIFY rank <= 3
)"""


@query("text_retrieval", f"""WITH chunks AS (SELECT doc_id AS chunk_id, text AS content, source FROM documents),
asked AS (SELECT item_id AS query_id, text AS query_text FROM benchmark), {HITS_SQL}
SELECT query_id::BIGINT AS query_id, chunk_id, source, round(score, 6) AS score, rank::INTEGER AS rank
FROM hits JOIN (SELECT chunk_id::VARCHAR AS chunk_id, source FROM chunks) USING (chunk_id)""")
def text_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage asks for its nearest documents in the fitted vector space."""
    chunks = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), "source"
    )
    model, vectors = retrieval.embed_chunks(chunks)
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    hits = retrieval.search(model, stage(vectors, "vectors"), texts, 3)
    return hits.select(
        "query_id", "chunk_id", "source", F.round("score", 6).alias("score"), "rank"
    )


_ISSUES = [*ISSUE_OF_FLAGS.values(), "OTHER"]
_THREATS = fixed.THREAT_LEVELS


def welfare_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as schemes for workers with a certain complaint."""
    words = F.array(*[F.lit(i.lower().replace("_", " ")) for i in _ISSUES])
    threats = F.array(*[F.lit(t.lower()) for t in _THREATS])
    issue = F.get(words, (F.col("p_partkey") % len(_ISSUES)).cast("int"))
    threat = F.get(threats, (F.col("p_size") % len(_THREATS)).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.concat("p_name", F.lit(" #"), "p_partkey").alias("scheme_name"),
        F.concat(F.lit("any worker after "), issue, F.lit(" under "), threat, F.lit(" threat")).alias("eligibility"),
        F.col("p_type").alias("benefits"), F.col("p_brand").alias("application"),
    )


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SEEDS_SQL = ", ".join(
    f"('BNS_{n}', {_text(f'BNS Section {n} - {title}: {content}')})" for n, title, content in fixed.SEED_SECTIONS
)
_CHUNKS_SQL = f"""chunks AS (
  SELECT * FROM (VALUES {_SEEDS_SQL}) seed(chunk_id, content)
  UNION ALL
  SELECT p_name || ' #' || p_partkey,
         'Scheme: ' || p_name || ' #' || p_partkey || '. Eligibility: any worker after '
         || [{", ".join(_text(i.lower().replace("_", " ")) for i in _ISSUES)}][p_partkey % {len(_ISSUES)} + 1] || ' under '
         || [{", ".join(_text(t.lower()) for t in _THREATS)}][p_size % {len(_THREATS)} + 1] || ' threat. Benefits: ' || p_type
         || '. Apply at: ' || p_brand
  FROM part
)"""
_URGENT_SQL = f"""{_GOLD}, urgent AS (
  SELECT call_id, issue_type, threat_label AS threat_level
  FROM complaints JOIN gold USING (pincode, contractor_name) WHERE escalate_immediately OR threat_label = 'HIGH'
), asked AS (
  SELECT issue_type, threat_level, md5(query_text) AS query_id, query_text FROM (
    SELECT DISTINCT issue_type, threat_level, {LABEL_SQL} || ' worker rights India ' || threat_level || ' threat' AS query_text
    FROM urgent)
)"""


@query("complaint_prompts", f"""{_URGENT_SQL}, {_CHUNKS_SQL}, {HITS_SQL}, contexts AS (
  SELECT query_id, string_agg('- ' || chunk_id || ': ' || content[:300], chr(10) ORDER BY rank) AS context,
         string_agg(chunk_id, ', ' ORDER BY rank) AS retrieved_chunks
  FROM hits JOIN chunks USING (chunk_id) GROUP BY query_id
)
SELECT call_id, retrieved_chunks,
  md5('You are a legal aid expert for Indian unorganised labour law.' || chr(10) || chr(10)
  || 'A worker has reported:' || chr(10) || '- Issue: ' || issue_type || chr(10) || '- Threat Level: ' || threat_level || chr(10)
  || chr(10) || 'Relevant laws:' || chr(10) || context || chr(10) || chr(10)
  || 'Respond ONLY in this exact JSON format, nothing else:' || chr(10) || '{{' || chr(10)
  || '  "bns_sections_cited": ["Section X", "Section Y"],' || chr(10)
  || '  "action_steps": ["Step 1: ...", "Step 2: ...", "Step 3: ..."],' || chr(10)
  || '  "government_portal": "portal name or URL",' || chr(10) || '  "urgency": "HIGH or MEDIUM or LOW"' || chr(10)
  || '}}') AS prompt_digest
FROM urgent JOIN asked USING (issue_type, threat_level) JOIN contexts USING (query_id)""")
def complaint_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every urgent complaint with the prompt that its question's nearest sections and schemes make."""
    silver = complaints(spark, sf_dir)
    rows = legal.high_priority_complaints(silver, stored_labels(silver)).withColumnRenamed("threat_label", "threat_level")
    urgent = stage(rows.select("call_id", *retrieval.ASKED_BY), "urgent")
    chunks = stage(corpus.build_chunks(corpus.seed_sections(spark), welfare_schemes(spark, sf_dir)), "chunks")
    model, vectors = retrieval.embed_chunks(chunks)
    contexts = legal.contexts_for(urgent, model, stage(vectors, "vectors"))
    prompts = legal.action_requests(retrieval.questions(urgent), contexts.drop(*retrieval.ASKED_BY))
    # one prompt per issue and threat level: Spark broadcasts so few, or splits the partitions of busy ones
    asked = urgent.join(prompts, retrieval.ASKED_BY)
    return asked.select(
        "call_id", F.array_join("retrieved_chunks", ", ").alias("retrieved_chunks"), F.md5("prompt").alias("prompt_digest")
    )
