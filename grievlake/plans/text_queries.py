"""Registered queries: replies, extraction, translation memory, corpus, sections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.replies import parse_fenced_json, with_entities
from ..functions.shape import split_rejects
from ..functions.text import any_column_contains, fill_template, strip
from ..operators import complaints as calls
from ..operators import corpus, sections
from ..operators.hotspots import build_gold
from ..sources.readers import clean_pages
from .hotspot_queries import flat_gold
from .registry import query
from .tables import COMPLAINTS_SQL, GOLD_SQL, complaints, table

# white space as the library trims it, for DuckDB
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE}+|{SPACE}+$', '', 'g')"


# --- replies ------------------------------------------------------------------------------------

_PLAIN = (
    '{{"contractor_name":"{contractor_name}","work_site":"{work_site}","issue_type":"{issue_type}",'
    '"violence_threatened":%s,"worker_count_mentioned":{worker_count_mentioned}}}'
)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply per complaint, in seven shapes by worker count: clean, fenced, with thinking, with Python
    literals, cut off, incomplete with a wrong type, and with left-over text."""
    rows = complaints(spark, sf_dir)
    clean = fill_template(_PLAIN % "{violence_threatened}")
    python = F.regexp_replace(fill_template(_PLAIN % "{flag}"), '"work_site":"[^"]*"', '"work_site": None')
    shape = F.col("worker_count_mentioned")
    raw: Column = (
        F.when(shape == 1, clean)
        .when(shape == 2, F.concat(F.lit("Here it is:\n```json\n"), clean, F.lit("\n```")))
        .when(shape == 3, F.concat(F.lit("<think>maybe {a} or {b}</think> Answer: "), clean))
        .when(shape == 4, python)
        .when(shape == 5, F.regexp_replace(clean, r"\}$", ""))
        .when(shape == 6, fill_template('{{"contractor_name":"{contractor_name}","worker_count_mentioned":"many"}}'))
        .otherwise(F.concat(clean, F.lit(" as asked }")))
    )
    flagged = rows.withColumn("flag", F.when(F.col("violence_threatened"), "True").otherwise("False"))
    return flagged.select("call_id", raw.alias("raw"))


def _expected(repaired: str) -> str:
    full = "(1, 2, 3)"
    kept = f"worker_count_mentioned IN {full}" + (" OR worker_count_mentioned = 4" if repaired else "")
    return f"""WITH {COMPLAINTS_SQL}
SELECT call_id,
       CASE WHEN {kept} OR worker_count_mentioned = 6 THEN contractor_name ELSE 'UNKNOWN' END AS contractor_name,
       CASE WHEN worker_count_mentioned IN {full} THEN work_site ELSE 'UNKNOWN' END AS work_site,
       CASE WHEN {kept} THEN issue_type ELSE 'OTHER' END AS issue_type,
       CASE WHEN {kept} THEN violence_threatened ELSE false END AS violence_threatened,
       CASE WHEN {kept} THEN worker_count_mentioned ELSE 0 END AS worker_count_mentioned,
       CASE WHEN {kept} OR worker_count_mentioned = 6 THEN 'ok' ELSE 'default' END AS parse_status
FROM complaints"""


@query("reply_full", _expected("yes"))
def reply_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_entities(replies(spark, sf_dir)).drop("raw")


@query("reply_brace", _expected(""))
def reply_brace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_entities(replies(spark, sf_dir), repair=False).drop("raw")


@query("reply_rejects", f"""WITH {COMPLAINTS_SQL}
SELECT CASE WHEN worker_count_mentioned IN (5, 7) THEN 'rejected' ELSE 'good' END AS verdict, count(*) AS replies
FROM complaints GROUP BY 1""")
def reply_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = with_entities(replies(spark, sf_dir))
    good, rejected = split_rejects(parsed, F.col("parse_status") == "ok")
    both = good.select(F.lit("good").alias("verdict")).unionByName(rejected.select(F.lit("rejected").alias("verdict")))
    return both.groupBy("verdict").agg(F.count(F.lit(1)).alias("replies"))


@query("failed_replies", f"""WITH {COMPLAINTS_SQL}
SELECT call_id, md5(min('{{"contractor_name":"' || contractor_name || '","work_site":"' || work_site || '","issue_type":"'
  || issue_type || '","violence_threatened":' || violence_threatened || ',"worker_count_mentioned":7}} as asked }}')) AS raw_digest
FROM complaints WHERE worker_count_mentioned = 7 GROUP BY call_id""")
def failed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that were cut off were asked for again; those with left-over text are the ones that failed."""
    once = F.array("raw")
    twice = F.when(F.endswith("raw", F.lit("}")), once).otherwise(F.array("raw", F.concat("raw", F.lit("}"))))
    given = replies(spark, sf_dir).select("call_id", F.explode(twice).alias("raw"))
    failed = calls.failed_replies(calls.read_replies(given))
    return failed.select("call_id", F.md5("raw").alias("raw_digest"))


@query("reply_fenced", """
SELECT o_orderkey AS call_id,
       CASE o_orderstatus WHEN 'P' THEN NULL ELSE 'Section ' || o_custkey || ', Section 316' END AS sections,
       CASE o_orderstatus WHEN 'P' THEN NULL ELSE 'Step 1: file | Step 2: wait' END AS steps,
       CASE o_orderstatus WHEN 'P' THEN NULL ELSE 'portal ' || o_orderpriority END AS portal,
       CASE o_orderstatus WHEN 'P' THEN NULL ELSE 'HIGH' END AS urgency
FROM orders""")
def reply_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = fill_template(
        '{{"bns_sections_cited":["Section {o_custkey}","Section 316"],"action_steps":["Step 1: file","Step 2: wait"],'
        '"government_portal":"portal {o_orderpriority}","urgency":"HIGH"}}'
    )
    status = F.col("o_orderstatus")
    raw = (
        F.when(status == "F", F.concat(F.lit("Sure.\n```json\n"), body, F.lit("\n```\nAnything else?")))
        .when(status == "P", F.concat(F.lit("I cannot answer: "), body))
        .otherwise(F.concat(F.lit(" \n"), body, F.lit("\n")))
    )
    parsed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), parse_fenced_json(raw).alias("p"))
    return parsed.select(
        "call_id",
        F.array_join("p.bns_sections_cited", ", ").alias("sections"),
        F.array_join("p.action_steps", " | ").alias("steps"),
        F.col("p.government_portal").alias("portal"),
        F.col("p.urgency").alias("urgency"),
    )


# --- complaint texts ----------------------------------------------------------------------------

_DIGITS = ("0123456789", "abcdefghij")
_DEED = {
    "PHYSICAL_ASSAULT": " slapped ", "WRONGFUL_TERMINATION": " fired ", "UNSAFE_CONDITIONS": " gave no helmet to ",
    "WAGE_THEFT": " has not given wages to ", "OTHER": " insulted ",
}


def call_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze-shaped calls: every complaint told as an English sentence, with stray white space around it."""
    rows = complaints(spark, sf_dir)
    number = F.regexp_replace("contractor_name", r"\D", "")
    name = F.concat(F.lit("K"), F.translate(number, *_DIGITS))
    site = F.concat(F.lit("S"), F.translate(F.substring_index("work_site", "_", -1), *_DIGITS), F.lit(" yard"))
    deed = F.lit(_DEED["OTHER"])
    for issue, words in _DEED.items():
        deed = F.when(F.col("issue_type") == issue, words).otherwise(deed)
    text = F.concat(
        F.lit("  Contractor "), name, deed, F.col("worker_count_mentioned").cast("string"), F.lit(" workers at the "),
        site, F.lit(" site."), F.when(F.col("violence_threatened"), " He made a threat.").otherwise(""), F.lit("\n"),
    )
    return rows.select("call_id", "pincode", text.alias("hindi_audio_text"))


_CALL_SQL = f"""{COMPLAINTS_SQL}, told AS (
  SELECT call_id, pincode, 'K' || translate(regexp_replace(contractor_name, '\\D', '', 'g'), '0123456789', 'abcdefghij')
           AS contractor_name,
         'S' || translate(split_part(work_site, '_', 2), '0123456789', 'abcdefghij') || ' yard' AS work_site,
         issue_type, violence_threatened, worker_count_mentioned
  FROM complaints
)"""


_ENGLISH_SQL = """CASE issue_type WHEN 'PHYSICAL_ASSAULT' THEN 'Contractor ' || contractor_name || ' slapped '
            WHEN 'WRONGFUL_TERMINATION' THEN 'Contractor ' || contractor_name || ' fired '
            WHEN 'UNSAFE_CONDITIONS' THEN 'Contractor ' || contractor_name || ' gave no helmet to '
            WHEN 'WAGE_THEFT' THEN 'Contractor ' || contractor_name || ' has not given wages to '
            ELSE 'Contractor ' || contractor_name || ' insulted ' END
         || worker_count_mentioned || ' workers at the ' || work_site || ' site.'
         || CASE WHEN violence_threatened THEN ' He made a threat.' ELSE '' END"""


@query("extract_entities", f"WITH {_CALL_SQL} SELECT * FROM told")
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = call_texts(spark, sf_dir).withColumnRenamed("hindi_audio_text", "english_text")
    return calls.extract_entities(texts).drop("english_text")


@query("silver_from_calls", f"""WITH {_CALL_SQL}
SELECT call_id, pincode, contractor_name, work_site, issue_type, violence_threatened, worker_count_mentioned,
       {_ENGLISH_SQL} AS english_text
FROM told""")
def silver_from_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.build_silver(call_texts(spark, sf_dir)).drop("raw_text")


@query("silver_from_replies", """
SELECT o_orderkey::VARCHAR AS call_id, lpad(o_custkey::VARCHAR, 6, '0') AS pincode,
       CASE WHEN o_orderstatus = 'P' THEN 'UNKNOWN' ELSE 'Contractor ' || o_custkey END AS contractor_name,
       'UNKNOWN' AS work_site,
       CASE WHEN o_orderstatus = 'P' THEN 'OTHER' ELSE 'WAGE_THEFT' END AS issue_type,
       o_orderstatus = 'F' AS violence_threatened,
       CASE WHEN o_orderstatus = 'P' THEN 0 ELSE (o_custkey % 9)::INTEGER END AS worker_count_mentioned
FROM orders""")
def silver_from_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls. Every one got a refusal first; all but those in status P a good answer on the second try."""
    orders = table(spark, sf_dir, "orders")
    bronze = orders.select(
        F.col("o_orderkey").alias("call_id"),
        F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("pincode"),
        F.col("o_orderpriority").alias("hindi_audio_text"),
    )
    body = fill_template(
        '```json\n{{"contractor_name":"Contractor {o_custkey}","issue_type":"WAGE_THEFT","violence_threatened":{flag},'
        '"worker_count_mentioned":{heads}}}\n```'
    )
    replied = orders.filter("o_orderstatus <> 'P'").withColumns({
        "flag": F.when(F.col("o_orderstatus") == "F", "True").otherwise("False"), "heads": F.col("o_custkey") % 9,
    }).select(F.col("o_orderkey").cast("string").alias("call_id"), body.alias("raw"))
    refused = orders.select(F.col("o_orderkey").cast("string").alias("call_id"), F.lit("I cannot answer that.").alias("raw"))
    return calls.build_silver(bronze, replies=replied.unionByName(refused)).drop("raw_text", "english_text")


@query("gold_from_calls", f"""WITH {_CALL_SQL.replace('complaints AS', 'lines AS').replace('FROM complaints', 'FROM lines')
                                    .replace('told AS', 'complaints AS')}, {GOLD_SQL}
SELECT pincode, contractor_name, total_complaints, array_to_string(issue_types_reported, ',') AS issue_types_reported,
       violence_flagged, total_workers_affected, array_to_string(work_sites, ',') AS work_sites, threat_label,
       severity_score, escalate_immediately
FROM gold""")
def gold_from_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_gold(build_gold(calls.build_silver(call_texts(spark, sf_dir))))


# words between characters that are neither letters, digits nor underscores, for DuckDB
def _word(alternatives: str) -> str:
    edge = r"[^\pL\pN\pM_]"
    return f"(?:^|{edge})(?:{alternatives})(?:$|{edge})"


@query("extract_entities_documents", f"""
SELECT doc_id,
       CASE WHEN regexp_matches(lower(text), '{_word(r"assault[\pL\pN\pM_]*|beaten|hit|slapped|struck")}') THEN 'PHYSICAL_ASSAULT'
            WHEN regexp_matches(lower(text), '{_word(r"fired|terminat[\pL\pN\pM_]*|dismiss[\pL\pN\pM_]*|without notice")}')
            THEN 'WRONGFUL_TERMINATION'
            WHEN regexp_matches(lower(text), '{_word("unsafe|safety|helmet|accident")}') THEN 'UNSAFE_CONDITIONS'
            WHEN regexp_matches(lower(text), '{_word("wages?|salary|money|paid|payment")}') THEN 'WAGE_THEFT'
            ELSE 'OTHER' END AS issue_type,
       regexp_matches(lower(text), '{_word(r"threat[\pL\pN\pM_]*|beat[\pL\pN\pM_]*|hit|assault[\pL\pN\pM_]*|kill[\pL\pN\pM_]*")}')
         AS violence_threatened
FROM documents""")
def extract_entities_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("english_text"))
    return calls.extract_entities(texts).select("doc_id", "issue_type", "violence_threatened")


@query("pincode_from_text", """
SELECT o_orderkey AS call_id,
       CASE WHEN o_orderstatus = 'F' AND o_custkey <> 0 THEN lpad(o_custkey::VARCHAR, 6, '0')
            WHEN o_orderstatus IN ('F', 'O') THEN (100000 + o_custkey)::VARCHAR ELSE '000000' END AS pincode
FROM orders""")
def pincode_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    stated = F.concat(F.lit("I live near "), F.col("o_custkey") + 100000, F.lit(" and order 7 came late."))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("call_id"),
        F.when(status == "F", F.lpad(F.col("o_custkey").cast("string"), 6, "0")).otherwise("000000").alias("pincode"),
        F.when(status == "P", "no place named").otherwise(stated).alias("english_text"),
    )
    return calls.with_pincode(rows).drop("english_text")


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").filter("lang <> 'en'")
    return texts.groupBy(strip("text").alias("source_text")).agg(
        F.concat(F.lit("from "), F.min("lang")).alias("translated_text")
    )


_MEMORY_SQL = f"""memory AS (
  SELECT {strip_sql('text')} AS source_text, 'from ' || min(lang) AS translated_text
  FROM documents WHERE lang <> 'en' GROUP BY 1
)"""


@query("translation_memory", f"""WITH {_MEMORY_SQL}
SELECT doc_id, md5(coalesce(translated_text, {strip_sql('text')})) AS english_digest
FROM documents LEFT JOIN memory ON source_text = {strip_sql('text')}""")
def translation_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text"))
    translated = calls.with_translation(rows, _memory(spark, sf_dir))
    return translated.select("doc_id", F.md5("english_text").alias("english_digest"))


@query("translation_worklist", f"""WITH {_MEMORY_SQL}
SELECT DISTINCT md5({strip_sql('text')}) AS text_digest FROM documents
WHERE {strip_sql('text')} <> '' AND {strip_sql('text')} NOT IN (SELECT source_text FROM memory)""")
def translation_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("text").alias("raw_text"))
    return calls.untranslated(rows, _memory(spark, sf_dir)).select(F.md5("source_text").alias("text_digest"))


@query("enrich_batches", f"""
SELECT doc_id, length({strip_sql('text')}) AS n_chars,
       len(regexp_extract_all(text, '[^ ]+')) AS n_words
FROM documents""")
def enrich_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = batch["text"].str.count("[^ ]+")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_chars": batch["text"].str.strip().str.len(), "n_words": words})

    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return calls.enrich_with(rows, measure, "doc_id long, n_chars long, n_words long")


@query("entity_prompts", f"""WITH {_CALL_SQL}
SELECT call_id, md5('Extract entities from this labor complaint and return ONLY a JSON object.' || chr(10) || chr(10)
  || 'Complaint: ' || {_ENGLISH_SQL} || chr(10) || chr(10) || 'Return exactly this structure:' || chr(10)
  || '{{"contractor_name":"name mentioned or UNKNOWN","work_site":"location mentioned or UNKNOWN","issue_type":"one of WAGE_THEFT/PHYSICAL_ASSAULT/WRONGFUL_TERMINATION/UNSAFE_CONDITIONS/OTHER","violence_threatened":true or false,"worker_count_mentioned":number or 0}}')
  AS prompt_digest
FROM told""")
def entity_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = call_texts(spark, sf_dir).select("call_id", strip("hindi_audio_text").alias("english_text"))
    return calls.entity_requests(texts).select("call_id", F.md5("prompt").alias("prompt_digest"))


# --- corpus -------------------------------------------------------------------------------------

@query("keyword_filter", """
SELECT doc_id FROM documents
WHERE lower(text) LIKE '%heron%' OR lower(lang) LIKE '%heron%' OR lower(source) LIKE '%heron%'
   OR lower(text) LIKE '%ierung%' OR lower(lang) LIKE '%ierung%' OR lower(source) LIKE '%ierung%'
   OR lower(text) LIKE '%src1%' OR lower(lang) LIKE '%src1%' OR lower(source) LIKE '%src1%'""")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return any_column_contains(table(spark, sf_dir, "documents"), ["Heron", "ierung", "src1"]).select("doc_id")


@query("labour_schemes", """
SELECT p_partkey, p_name FROM part
WHERE regexp_matches(lower(p_name) || '|' || lower(p_brand) || '|' || lower(p_type), 'widget|economy|brand#1')""")
def labour_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return corpus.labour_schemes(parts, ["widget", "economy", "brand#1"]).select("p_partkey", "p_name")


_KINDS = [*fixed.LABOUR_KEYWORDS, "sport", "music", "tourism", "harvest", "fishery"]


@query("labour_schemes_of_the_contract", f"""
SELECT p_partkey FROM part
WHERE regexp_matches([{", ".join(f"'{k}'" for k in _KINDS)}][p_partkey % {len(_KINDS)} + 1], '{"|".join(fixed.LABOUR_KEYWORDS)}')""")
def labour_schemes_of_the_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as schemes of fifteen kinds, ten of which the word list of the contract names."""
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    kind = F.get(kinds, (F.col("p_partkey") % len(_KINDS)).cast("int"))
    schemes = table(spark, sf_dir, "part").select(
        "p_partkey", F.lit("Scheme").alias("scheme_name"), F.concat(F.lit("State fund for "), F.initcap(kind)).alias("benefits")
    )
    return corpus.labour_schemes(schemes).select("p_partkey")


def bench_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("BNS_"), "item_id").alias("section_id"),
        F.col("item_id").cast("string").alias("section_num"),
        F.concat(F.lit("Item "), "item_id").alias("title"),
        F.col("text").alias("content"),
        F.lit("BNS_2023").alias("source"),
    )


def part_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat_ws(" ", "p_name", "p_brand").alias("scheme_name"),
        F.nullif(F.col("p_brand"), F.lit("Brand#3")).alias("eligibility"),
        F.col("p_type").alias("benefits"),
        F.when(F.col("p_size") != 7, F.concat(F.lit("Store "), "p_size")).alias("application"),
    )


def _chunks_sql(null_as_empty: bool) -> str:
    def part(expr: str) -> str:
        return f"coalesce({expr}, '')" if null_as_empty else expr

    brand, store = part("nullif(p_brand, 'Brand#3')"), part("CASE WHEN p_size <> 7 THEN 'Store ' || p_size END")
    return f"""WITH both_kinds AS (
  SELECT 'BNS_' || item_id AS chunk_id, 'BNS Section ' || item_id || ' - Item ' || item_id || ': ' || text AS content,
         'BNS_2023' AS source FROM benchmark
  UNION ALL
  SELECT p_name || ' ' || p_brand, 'Scheme: ' || p_name || ' ' || p_brand || '. Eligibility: ' || {brand}
         || '. Benefits: ' || p_type || '. Apply at: ' || {store}, 'GOV_SCHEMES' FROM part
), chosen AS (
  SELECT * FROM both_kinds
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY source, content ASC NULLS LAST) = 1
) SELECT chunk_id, content, source FROM chosen WHERE length(content) > 50"""


@query("chunk_corpus", _chunks_sql(False))
def chunk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.build_chunks(bench_sections(spark, sf_dir), part_schemes(spark, sf_dir))


@query("chunk_corpus_null_as_empty", _chunks_sql(True))
def chunk_corpus_null_as_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.build_chunks(bench_sections(spark, sf_dir), part_schemes(spark, sf_dir), null_as_empty=True)


@query("fill_gaps", """WITH both_kinds AS (
  SELECT p_name AS section_id, p_brand AS content, 0 AS priority FROM part
  UNION ALL SELECT p_type, p_name, 1 FROM part
  UNION ALL SELECT p_name, p_type, 1 FROM part
) SELECT section_id, content FROM both_kinds
QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY priority, content) = 1""")
def fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    parsed = parts.select(F.col("p_name").alias("section_id"), F.col("p_brand").alias("content"))
    seed = parts.select(F.col("p_type").alias("section_id"), F.col("p_name").alias("content")).unionByName(
        parts.select(F.col("p_name").alias("section_id"), F.col("p_type").alias("content"))
    )
    return corpus.fill_gaps(parsed, seed)


_SEED_LENGTHS = ", ".join(f"('BNS_{number}', {len(content)})" for number, _, content in fixed.SEED_SECTIONS)


@query("sections_with_seed", f"""
SELECT 'BNS_' || (item_id + 110) AS section_id, length(text) AS content_length FROM benchmark
UNION ALL
SELECT * FROM (VALUES {_SEED_LENGTHS}) seed(section_id, content_length)
WHERE section_id NOT IN (SELECT 'BNS_' || (item_id + 110) FROM benchmark)""")
def sections_with_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = bench_sections(spark, sf_dir).withColumn(
        "section_id", F.concat(F.lit("BNS_"), F.col("section_num").cast("int") + 110)
    )
    whole = corpus.fill_gaps(parsed, corpus.seed_sections(spark))
    return whole.select("section_id", F.length("content").alias("content_length"))


@query("dedup_sections", """
SELECT p_name AS section_id, p_brand AS content, p_type AS title FROM part
QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_type) = 1""")
def dedup_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("section_id"), F.col("p_brand").alias("content"), F.col("p_type").alias("title")
    )
    return corpus.dedup_sections(rows)


# --- pages and sections -------------------------------------------------------------------------

def volume() -> Column:
    """A document of at most 500 pages: a source's rows, in blocks of ids, so that no document grows with the table."""
    return F.concat_ws("-", "source", F.floor(F.col("doc_id") / 500))


def statute_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per volume, in doc_id order. Every third page opens a section with a numbered header."""
    header = F.concat(
        F.when(F.col("doc_id") % 2 == 0, "Section ").otherwise(""), F.col("doc_id") % 900 + 1,
        F.lit(". Clause about record "), "doc_id", F.lit("\n"),
    )
    opens = F.when(F.col("doc_id") % 3 == 0, header).otherwise("")
    pages = table(spark, sf_dir, "documents").select(
        volume().alias("doc_id"), F.col("doc_id").alias("page_number"), F.concat(opens, "text").alias("raw_text")
    )
    return clean_pages(pages)


_OPENING = """CASE WHEN doc_id % 3 = 0
  THEN CASE WHEN doc_id % 2 = 0 THEN 'Section ' ELSE '' END || (doc_id % 900 + 1) || '. Clause about record ' || doc_id || chr(10)
  ELSE '' END"""


@query("section_split", f"""WITH numbered AS (
  SELECT source || '-' || (doc_id // 500) AS volume, doc_id, {strip_sql(_OPENING + " || text")} AS page_text FROM documents
), whole AS (
  SELECT volume AS doc_id, string_agg(page_text, chr(10) ORDER BY doc_id) AS doc_text
  FROM numbered WHERE page_text <> '' GROUP BY volume
), marked AS (
  SELECT doc_id, regexp_replace(doc_text, '(?:Section\\s+)?(\\d{{1,3}})\\.\\s+([A-Z][^\\n]{{5,80}})\\n',
                                chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'g') AS doc_text
  FROM whole
), pieces AS (
  SELECT doc_id, unnest(string_split(doc_text, chr(1))[2:]) AS piece FROM marked
), sections AS (
  SELECT doc_id, split_part(piece, chr(2), 1) AS section_num,
         {strip_sql("split_part(split_part(piece, chr(2), 2), chr(3), 1)")} AS title,
         regexp_replace(split_part(piece, chr(3), 2), '(?:Section\\s+)?\\d{{1,3}}\\.\\s+[A-Z](?s:.*)', '') AS body
  FROM pieces
)
SELECT doc_id, 'BNS_' || section_num AS section_id, section_num, title,
       replace({strip_sql("body")}, chr(10), ' ') AS content, 'BNS_2023' AS source
FROM sections WHERE length({strip_sql("body")}) > 30""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.split_sections(statute_pages(spark, sf_dir))


@query("assemble_documents", f"""
SELECT source || '-' || (doc_id // 500) AS doc_id, md5(string_agg({strip_sql('text')}, chr(10) ORDER BY documents.doc_id)) AS text_digest
FROM documents WHERE text <> '' GROUP BY source || '-' || (doc_id // 500)""")
def assemble_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = clean_pages(table(spark, sf_dir, "documents").select(
        volume().alias("doc_id"), F.col("doc_id").alias("page_number"), F.col("text").alias("raw_text")
    ))
    return sections.assemble_documents(pages).select("doc_id", F.md5("text").alias("text_digest"))


@query("clean_pages", f"""
SELECT page_id, md5({strip_sql('html')}) AS text_digest FROM pages WHERE html <> ''""")
def pages_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("raw_text"))
    return clean_pages(rows).select("page_id", F.md5("raw_text").alias("text_digest"))
