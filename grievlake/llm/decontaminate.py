"""Benchmark decontamination with DataFrame functions only.

The windows of all benchmark items (13 consecutive words; a shorter item is one window) form a set of hashed
n-grams. It is broadcast while its counted bytes stay under ``broadcast_bytes``; beyond that the same join is
shuffled. Every position of every document probes the set, hits are verified against the words of the window,
and the verified hits give the spans to remove or the documents to drop.

Words are runs of ASCII letters and digits and of everything outside ASCII, A-Z lower-cased. A null or empty
text has no words, so neither hits nor is hit. Repeated document rows are judged one by one, repeated items
count once per item id. Items with a null id can be hit but are not named. Other columns are kept by
``remove``, whatever their names. Very long texts cost work in proportion to their words and hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from ..sources.storage import stage

WINDOW = 13
#: Largest set of windows to broadcast, in bytes of its words.
BROADCAST_BYTES = 64 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased in ASCII only."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(f"[^{SEPARATORS}]+"), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """A row per distinct window: its words ``gram``, their number ``len``, the ids of its items ``items``."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w"))
    length = F.least(F.size("w"), F.lit(width))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - length + 1))
    return (
        words.filter(F.size("w") > 0).select("item", length.alias("len"), "w", starts.alias("p"))
        .select("item", "len", F.slice("w", F.col("p"), F.col("len")).alias("gram"))
        .groupBy("gram", "len").agg(F.collect_set("item").alias("items"))
    )


def find_hits(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", width: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """A row per document: the ``keep`` columns (the id by default), ``n_words``, ``spans`` (struct of the numbers
    of the first word and of the word after the last, merged and in order) and ``items`` (sorted ids)."""
    keep = [id_col] if keep is None else keep
    hits = _hits(docs, items, text_col, item_id_col, item_text_col, width, broadcast_bytes, keep)
    return hits.select(*[F.col("_row")[c].alias(c) for c in keep], "n_words", "spans", "items")


def _hits(
    docs: DataFrame, items: DataFrame, text_col: str, item_id_col: str, item_text_col: str, width: int, broadcast_bytes: int,
    keep: list[str],
) -> DataFrame:
    """The same with the ``keep`` columns as one struct ``_row``, which no column name can clash with."""
    windows = benchmark_windows(items, item_id_col, item_text_col, width)
    # window lengths: at most ``width`` numbers; the bytes decide how the set travels
    facts = windows.agg(
        F.collect_set("len").alias("lengths"),
        F.coalesce(F.sum(F.length(F.concat_ws(" ", "gram")) + F.length(F.concat_ws(" ", "items")) + 64), F.lit(0)).alias("bytes"),
    ).first()
    lengths = sorted(facts["lengths"]) or [width]
    grams = windows.select(
        F.xxhash64("gram").alias("_hash"), F.col("len").alias("_gram_len"), F.col("gram").alias("_gram"),
        F.col("items").alias("_items"),
    )
    fits_broadcast = facts["bytes"] <= broadcast_bytes
    words = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("_row"), F.monotonically_increasing_id().alias("_doc"),
        words_of(F.col(text_col)).alias("_w"),
    )
    if not fits_broadcast:
        words = stage(words, "words")  # read twice below: the numbers of the documents must stay the same
    # position 0 stands for the document itself, so that documents without hits stay
    spots = words.select("_row", "_doc", "_w", F.explode(F.sequence(F.lit(0), F.size("_w"))).alias("_p"))
    if len(lengths) > 1:
        options = F.array(*[F.lit(n) for n in lengths])
        spots = spots.select("*", F.explode(F.when(F.col("_p") == 0, F.array(F.lit(0))).otherwise(options)).alias("_len"))
    else:
        spots = spots.withColumn("_len", F.when(F.col("_p") == 0, 0).otherwise(lengths[0]))
    fits = (F.col("_p") > 0) & (F.col("_p") + F.col("_len") - 1 <= F.size("_w"))
    gram = F.slice("_w", F.greatest("_p", F.lit(1)), F.col("_len"))
    marker = (F.col("_p") == 0)
    probes = spots.filter(fits | marker)
    if fits_broadcast:
        found = probes.withColumn("_probe", F.when(fits, F.xxhash64(gram))).join(
            F.broadcast(grams), (F.col("_probe") == F.col("_hash")) & (F.col("_len") == F.col("_gram_len"))
            & (gram == F.col("_gram")), "left",
        )
    else:
        # only windows of the right hash travel with their words; the documents' own rows go round the join
        candidates = probes.filter(fits).select("_doc", "_p", "_len", F.xxhash64(gram).alias("_probe"), gram.alias("_found"))
        hits = candidates.join(
            grams, (F.col("_probe") == F.col("_hash")) & (F.col("_len") == F.col("_gram_len")) & (F.col("_found") == F.col("_gram")),
        ).select(F.lit(None).cast(words.schema["_row"].dataType).alias("_row"), "_doc", F.lit(None).cast("int").alias("_n"), "_p", "_len", "_items")
        own = words.select("_row", "_doc", F.size("_w").alias("_n"), F.lit(0).alias("_p"), F.lit(0).alias("_len"),
                           F.lit(None).cast("array<string>").alias("_items"))
        return _collect(own.unionByName(hits))
    found = found.filter(marker | F.col("_hash").isNotNull())
    return _collect(found.select(
        F.when(marker, F.col("_row")).alias("_row"), "_doc", F.when(marker, F.size("_w")).alias("_n"), "_p", "_len", "_items",
    ))


def _collect(found: DataFrame) -> DataFrame:
    """Hits of each document, merged into spans. A group is as large as the hits of one text, and the work grows with
    their words: a span starts at a hit word that follows none, and ends behind one that none follows."""
    words = F.when(F.col("_p") > 0, F.sequence(F.col("_p") - 1, F.col("_p") + F.col("_len") - 2))
    hit = F.array_distinct(F.flatten(F.collect_set(words)))

    def spans(hit: Column) -> Column:
        behind = F.transform(hit, lambda x: x + 1)
        return F.zip_with(
            F.array_sort(F.array_except(hit, behind)), F.array_sort(F.array_except(behind, hit)),
            lambda first, after: F.struct(first.alias("first"), after.alias("after")),
        )

    merged = bind(hit, spans)
    return (
        found.groupBy("_doc").agg(
            F.max("_row").alias("_row"), F.max("_n").cast("long").alias("n_words"), merged.alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"),
        )
        .select("_row", "n_words", "spans", "items")
    )


def hit_words(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["after"] - s["first"]))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words is part of benchmark windows."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def remove(
    docs: DataFrame, items: DataFrame, text_col: str = "text", what: str = "documents", item_id_col: str = "item_id",
    item_text_col: str = "text", width: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` without contaminated documents, or (``what="spans"``) with every hit word cut out of the texts.

    A cut takes the words of the span and the separators before each of them; all else stays as it was.
    """
    found = _hits(docs, items, text_col, item_id_col, item_text_col, width, broadcast_bytes, docs.columns)
    if what == "documents":
        return found.filter(~is_contaminated(hit_words(), F.col("n_words"))).select("_row.*")
    if what != "spans":
        raise ValueError("what must be 'documents' or 'spans'")
    text = F.col("_row")[text_col]
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)[{SEPARATORS}]*(?:[^{SEPARATORS}]+|$)"), F.lit(0))
    ends = F.concat(F.transform("spans", lambda s: s["first"]), F.array(F.lit(1 << 30)))
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["after"]))
    # what stands between the spans, each stretch taken once
    kept = lambda p: F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(p, a + 1, b - a), ""))
    cut = F.when(F.size("spans") > 0, F.array_join(bind(pieces, kept), "")).otherwise(text)
    return found.select(*[cut.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
