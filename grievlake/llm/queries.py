"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage
from . import (
    block_naming, conversation_repair, decision_list, decontaminate, jaccard_join, merge_dropout, preference_format,
    secret_crf, subword_classifier, token_splice, vector_codes, warc, wrapper_induction,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Rows of one Arrow batch: texts can be long, so fewer than Spark's usual 10,000.
BATCH_ROWS = "1000"


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = decision_list.learn(docs, table(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return decision_list.judge(docs, rules).select(
        "doc_id", *[F.col(f"_statistics.{c}").alias(c) for c in counts], "base_failed", "kept", "rule"
    )


@query("op4_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Both sides of a window are compared as lists of words.
DECONTAMINATION_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p
        FROM items WHERE len(w) > 0)
), spots AS (
  SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p
        FROM words, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k)
), hits AS (
  SELECT doc_id, p, k, item_id FROM spots JOIN grams USING (k, gram)
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + k)) AS place FROM (SELECT DISTINCT doc_id, p, k FROM hits)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op1_benchmark_decontamination", DECONTAMINATION_SQL)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    n_hit, n_words = F.col("n_hit"), F.col("n_words")
    return hits.withColumn("n_hit", decontaminate.hit_words()).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(n_hit, n_words).alias("contaminated"),
    )


@query("op8_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, path = F.coalesce("text", F.lit("")), public_tokenizers.path("word_bpe_49k.json")
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_splice.token_count(text, path).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > 2048)
    )


@query("op10_sentencepiece_dropout")
def sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return merge_dropout.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


@query("op7_secret_scans")
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = secret_crf.learn(docs)
    spans = F.col("_spans")
    base = F.filter(spans, lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["after"])), ",")
    return docs.select("doc_id", secret_crf.find_secrets(F.col("text"), field).alias("_spans")).select(
        "doc_id", count("assign"), count("access"), count("hex"), count("crf"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"),
    )


@query("op9_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = subword_classifier.held_out(F.col("doc_id"))
    model = subword_classifier.learn(docs, table(spark, sf_dir, "labels").filter(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), subword_classifier.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


WARC_SQL = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM (SELECT *, CASE WHEN strlen(coalesce(html, '')) >= 1000 THEN
                nullif(max(page_id) OVER (PARTITION BY coalesce(html, '')), page_id) END AS refers_to FROM pages)
"""


@query("op2_warc_salvage", WARC_SQL)
def warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = storage.new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.read_archives(spark, folder, with_payload=False).filter("kind = 'record'").select(
        warc.page_id("record_id").alias("page_id"), F.col("length").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        warc.page_id("refers_to").alias("refers_to"),
    )


@query("op3_wrapper_induction")
def html_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = wrapper_induction.main_text(pages, wrapper_induction.induce(pages), ["page_id", "url"])
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


PREFERENCE_SQL = r"""
WITH last AS (
  SELECT conv_id, max(turn) AS turn, max(text ORDER BY turn) AS answer FROM (
    SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS k
    FROM conversations WHERE role = 'assistant') WHERE k = 1 GROUP BY conv_id
), sides AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS a,
         CASE WHEN role = 'assistant' AND turn = l.turn_of THEN coalesce(d.answer, '') ELSE coalesce(text, '') END AS b
  FROM conversations LEFT JOIN (SELECT conv_id, turn AS turn_of FROM last) l USING (conv_id)
       LEFT JOIN (SELECT conv_id + 1 AS conv_id, answer FROM last) d USING (conv_id)
), first_change AS (
  SELECT conv_id, min(turn) FILTER (WHERE a <> b) AS changed FROM sides GROUP BY conv_id
), marked AS (
  SELECT conv_id, turn, changed IS NULL OR turn < changed AS common,
         '<|im_start|>' || role || chr(10) AS head, regexp_replace(a, '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') AS a,
         regexp_replace(b, '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') AS b,
         CASE role WHEN 'assistant' THEN 1 ELSE 0 END AS loss
  FROM sides JOIN first_change USING (conv_id)
)
SELECT conv_id, CAST(count(*) FILTER (WHERE common) AS BIGINT) AS n_common,
  coalesce(string_agg(head || a || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (WHERE common), '') AS prompt,
  coalesce(string_agg(head || a || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (WHERE NOT common), '') AS chosen,
  coalesce(string_agg(head || b || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (WHERE NOT common), '') AS rejected,
  coalesce(string_agg(length(head) || ':0,' || (length(a) + 10) || ':' || loss || ',1:0', ',' ORDER BY turn)
           FILTER (WHERE NOT common), '') AS chosen_mask,
  coalesce(string_agg(length(head) || ':0,' || (length(b) + 10) || ':' || loss || ',1:0', ',' ORDER BY turn)
           FILTER (WHERE NOT common), '') AS rejected_mask,
  CASE WHEN bool_and(common) THEN 'same' ELSE 'ok' END AS status
FROM marked WHERE conv_id IS NOT NULL GROUP BY conv_id
"""


@query("op6_preference_formatting", PREFERENCE_SQL)
def preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pairs = preference_format.format_pairs(turns, preference_format.with_foreign_answer(turns))
    flat = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws(":", r["n"], r["loss"])), ",").alias(c)
    return pairs.select(
        "conv_id", "n_common", "prompt", "chosen", "rejected", flat("chosen_mask"), flat("rejected_mask"), "status"
    )


COPIES_SQL = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), ranked AS (
  SELECT doc_id, body, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM plain WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM ranked
"""


@query("op12_block_naming", COPIES_SQL)
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.mark_copies(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("_row")


def _codebooks_sql(rounds: int) -> str:
    """Codebooks b0 ... b<rounds> and the assignments a0 ... a<rounds> to them, one pair of tables per round.

    Inner products of integers below 2**53 are exact, so the order of distances is that of the integers.
    """
    tables = ["""kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS (
  SELECT vec_id, label, part, v[part * 16 + 1 : part * 16 + 16] AS x FROM kept, range(4) AS p(part)
), b0 AS (
  SELECT part, entry, x AS c FROM pieces
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 256) USING (vec_id)
)"""]
    for r in range(rounds + 1):
        tables.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, label, part, x, entry, d FROM (
    SELECT vec_id, label, part, x, entry,
           list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS d
    FROM pieces JOIN b{r} USING (part))
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1
)""")
        if r < rounds:
            tables.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(n.c, b{r}.c) AS c FROM b{r} LEFT JOIN (
    SELECT part, entry, list(m ORDER BY i) AS c FROM (
      SELECT part, entry, i, floor(sum(x[i]::BIGINT) / count(*)) AS m FROM a{r}, range(1, 17) AS t(i) GROUP BY part, entry, i)
    GROUP BY part, entry) n USING (part, entry)
)""")
    return ",\n".join(tables)


CODES_SQL = f"""
WITH {_codebooks_sql(vector_codes.ROUNDS)}, coded AS (
  SELECT vec_id, label, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM a{vector_codes.ROUNDS} GROUP BY vec_id, label
)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, i))
        FROM (SELECT part, entry, i, c[i] AS x FROM b{vector_codes.ROUNDS}, range(1, 17) AS t(i))) AS codebooks_sha256
FROM coded
"""


@query("op13_vector_codes", CODES_SQL)
def vector_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, codebooks = vector_codes.compress(vectors, keep=("label",))
    errors = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(errors, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(codebooks)).alias("codebooks_sha256")
    )


#: Every place of a conversation carries, per state, the cheapest edits so far; equal costs take the lesser letters.
REPAIR_SQL = r"""
WITH RECURSIVE given AS (
  SELECT *, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::UBIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[],
      lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))) AS crc
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)
), drawn AS (
  SELECT conv_id, turn, role, text, xor(crc, 4294967295::UBIGINT) % 20 AS draw FROM given
), turns AS (
  SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM drawn, range(2) AS c(copy) WHERE draw <> 0 AND (copy = 0 OR draw = 3)
), placed AS (
  SELECT conv_id, turn, role, text, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p
  FROM turns
), faults AS (
  SELECT conv_id, turn, role, text, initial, p,
         CASE WHEN bare = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate'
              WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY p) || initial AS pair
  FROM placed
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
), inserts(st, nxt, edits, price, made) AS (
  VALUES (0, 0, '', 0, []::VARCHAR[]), (0, 2, 'I', 5, ['user:']), (0, 3, 'II', 10, ['user:', 'assistant:']),
         (1, 1, '', 0, []::VARCHAR[]), (1, 2, 'I', 5, ['user:']), (1, 3, 'II', 10, ['user:', 'assistant:']),
         (2, 2, '', 0, []::VARCHAR[]), (2, 3, 'I', 5, ['assistant:']), (3, 3, '', 0, []::VARCHAR[]), (3, 2, 'I', 5, ['user:'])
), edits(st, initial, nxt, edit, price) AS (
  VALUES (0, 's', 1, 'K', 0), (0, 'u', 2, 'K', 0), (1, 'u', 2, 'K', 0), (2, 'a', 3, 'K', 0), (3, 'u', 2, 'K', 0),
         (0, NULL, 2, 'R', 1), (1, NULL, 2, 'R', 1), (2, NULL, 3, 'R', 1), (3, NULL, 2, 'R', 1),
         (0, NULL, 0, 'D', 2), (1, NULL, 1, 'D', 2), (2, NULL, 2, 'D', 2), (3, NULL, 3, 'D', 2)
), paths AS (
  SELECT conv_id, 0::BIGINT AS p, 0 AS st, {'cost': 0::BIGINT, 'audit': '', 'body': []::VARCHAR[]} AS best FROM counts
  UNION ALL
  SELECT conv_id, p, st, min(best) FROM (
    SELECT t.conv_id, t.p + 1 AS p, e.nxt AS st, {
      'cost': t.best.cost + i.price + e.price + CASE WHEN f.fault = 'truncated' AND e.edit <> 'D' THEN 5 ELSE 0 END,
      'audit': t.best.audit || i.edits || e.edit,
      'body': t.best.body || i.made || CASE e.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text]
                                        ELSE [CASE e.nxt WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END} AS best
    FROM paths t JOIN inserts i ON i.st = t.st
    JOIN faults f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.p = t.p + 1
    JOIN edits e ON e.st = i.nxt AND (e.initial IS NULL OR e.initial = f.initial)
                AND (e.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate')))
  GROUP BY conv_id, p, st
), ends AS (
  SELECT t.conv_id, min({'cost': t.best.cost + i.price, 'audit': t.best.audit || i.edits, 'body': t.best.body || i.made}) AS best
  FROM paths t JOIN inserts i ON i.st = t.st AND i.nxt IN (0, 3)
  JOIN counts c ON c.conv_id IS NOT DISTINCT FROM t.conv_id AND c.n = t.p GROUP BY t.conv_id
)
SELECT g.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.body, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
     LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM g.conv_id
"""


@query("op11_conversation_repair", REPAIR_SQL)
def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    summary, repaired = conversation_repair.repair(conversation_repair.damage(turns))
    same = lambda left, right: F.col(left).eqNullSafe(F.col(right))
    digests = conversation_repair.digests(repaired).withColumnRenamed("conv_id", "_hashed")
    every = turns.select(F.col("conv_id").alias("_given")).distinct()
    joined = every.join(summary, same("_given", "conv_id"), "left").join(digests, same("_given", "_hashed"), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        F.col("_given").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
