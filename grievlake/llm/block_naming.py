"""Exact duplicates by naming: equal texts, and only they, end with the same integer.

White space is deleted, the rest of each text is cut into blocks of a fixed number of bytes, and the blocks of all
documents are sorted: the rank of a block among the different ones is its name. Adjacent names of a document are then
paired, the pairs are sorted and named in the same way, and so on until every document has a single name. At each
level two names are equal exactly if what they stand for is, so a document is told by (level, last name) without any
chance of a collision: hashes only deal out the work.

Sorting is spread over buckets of a hash of the key, sized by the number of rows; a name is the bucket's number and
the rank in it. A key that very many rows share (a copied document, a passage at the same place of many) is counted
beforehand, dealt over several buckets, named in each, and its names are made one afterwards by the rows that stand
for them, of which there are at most 2 * HOT_KEYS.

Everything is DataFrame code. Null texts count as empty, and all texts without other characters are equal; ties go to
the smaller id, null ids come last, of rows that do not differ in length and id one stays; an empty table gives an
empty result; other columns are ignored by ``mark_copies`` and kept by ``drop_copies``. Very long texts are cut in one
pass and add levels, not row width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bind
from ..sources.storage import stage

BLOCK_BYTES = 4096
BUCKET_ROWS = 500
#: A key is hot from this many rows on, and from one in HOT_KEYS of all rows: so at most HOT_KEYS of 16 bytes are sent.
HOT_ROWS = 100
HOT_KEYS = 100_000

_WHITE_SPACE = r"[\x20\x09-\x0D]+"
_NAME_BITS = 32  # ranks below, bucket above


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _WHITE_SPACE, "")


def _blocks(text: Column, size: int) -> Column:
    """The bytes of a text in pieces of ``size``; an empty text has one empty piece."""

    def cut(data: Column) -> Column:
        count = F.greatest(F.ceil(F.octet_length(data) / F.lit(size)), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, i * size + 1, F.lit(size)))

    return bind(text.cast("binary"), cut)


def _name(rows: DataFrame, key: list[str], hot_rows: int) -> DataFrame:
    """``rows`` (with ``_row`` and ``pos``) with ``name`` in place of ``key``; written once."""
    others = [c for c in rows.columns if c not in key]
    hashed = rows.withColumn("_hash", F.xxhash64(*key))
    counts = stage(hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")), "block-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    limit, buckets = max(hot_rows, total // HOT_KEYS), max(1, total // BUCKET_ROWS)
    hot = counts.filter(F.col("_n") > limit).select("_hash", F.ceil(F.col("_n") / limit).alias("_shares"))

    share = F.coalesce(F.pmod(F.xxhash64("_row", "pos"), "_shares"), F.lit(0))
    spread = hashed.join(F.broadcast(hot), "_hash", "left").withColumn(
        "_bucket", F.pmod(F.xxhash64("_hash", share), F.lit(buckets))
    )
    sort = W.partitionBy("_bucket").orderBy(*key)
    ranked = spread.withColumn("_rank", F.dense_rank().over(sort))
    leads = F.col("_shares").isNotNull() & (F.coalesce(F.lag("_rank").over(sort), F.lit(0)) != F.col("_rank"))
    named = stage(
        ranked.withColumn("_leads", leads).select(
            *others, (F.shiftleft("_bucket", _NAME_BITS) + F.col("_rank")).alias("name"),
            F.when(F.col("_leads"), F.struct(*key)).alias("_key"),
        ), "block-names",
    )
    # a hot key has a name in each of its buckets: the smallest one holds for all
    lead = named.filter("_key IS NOT NULL").select("name", "_key").distinct()
    one = lead.withColumn("_one", F.min("name").over(W.partitionBy("_key"))).filter("name != _one").select("name", "_one")
    return named.join(F.broadcast(one), "name", "left").select(*others, F.coalesce("_one", "name").alias("name"))


def identities(texts: DataFrame, block_bytes: int = BLOCK_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """_row, level, name and the other columns of ``texts``: equal (level, name) means equal ``data``.

    ``texts`` has ``_row`` (unique, the same in every pass) and ``data`` (a string, not null).
    """
    carried = [c for c in texts.columns if c not in ("_row", "data")]
    pieces = texts.select("_row", *carried, _blocks(F.col("data"), block_bytes).alias("_blocks"))
    blocks = pieces.select("_row", *carried, F.size("_blocks").alias("left"), F.posexplode("_blocks").alias("pos", "block"))
    # what belongs to the document travels with its first block only
    first = [F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in carried]
    names = _name(blocks.select("_row", "pos", "left", *first, "block"), ["block"], hot_rows)
    about = names.filter("pos = 0").select("_row", *carried)

    found, level = [], 0
    longest = names.agg(F.max("left")).first()[0] or 1
    while True:
        found.append(names.filter("left = 1").select("_row", F.lit(level).alias("level"), "name"))
        if longest == 1:
            break
        even = F.col("pos") % 2 == 0
        pairs = names.filter("left > 1").groupBy("_row", F.shiftright("pos", 1).alias("pos")).agg(
            F.shiftright(F.max("left") + 1, 1).alias("left"), F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("b"),
        )
        names = _name(pairs, ["a", "b"], hot_rows)
        longest, level = (longest + 1) // 2, level + 1
    last = found[0]
    for part in found[1:]:
        last = last.unionByName(part)
    return last.join(about, "_row")


def mark_copies(
    docs: DataFrame, id: str = "doc_id", text: str = "text", row: Column | None = None,
    block_bytes: int = BLOCK_BYTES, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256, and ``_row``.

    Of equal texts the row with the most code points in its text as given stays, then the smallest id. ``row`` is a
    number of the row that is the same whenever ``docs`` is read; by default its place in the files.
    """
    data = normalised(F.col(text))
    plain = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("_row"), F.col(id).alias("_id"),
        F.coalesce(F.char_length(text), F.lit(0)).alias("_chars"), data.alias("data"),
    ).withColumn("_digest", F.unhex(F.sha2("data", 256)))
    rows = stage(identities(plain, block_bytes, hot_rows), "identities")
    order = F.struct(-F.col("_chars"), F.col("_id").isNull(), F.col("_id"), F.col("_row"))
    groups = stage(
        rows.groupBy("level", "name").agg(F.count(F.lit(1)).alias("_size"), F.min(order).alias("_best"))
        .filter("_size > 1").select("level", "name", "_size", F.col("_best._id").alias("_keep"), F.col("_best._row").alias("_stays")),
        "copies",
    )
    single = F.col("_size").isNull()
    return rows.join(groups, ["level", "name"], "left").select(
        F.col("_id").alias(id), F.when(single, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), (single | (F.col("_row") == F.col("_stays"))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"), "_row",
    )


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. The numbered rows are written once."""
    numbered = stage(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("_row")), "numbered")
    flat = numbered.select("_row", F.col(f"doc.`{id}`").alias("id"), F.col(f"doc.`{text}`").alias("text"))
    kept = mark_copies(flat, "id", "text", F.col("_row")).filter("kept").select("_row")
    return numbered.join(kept, "_row").select("doc.*")
