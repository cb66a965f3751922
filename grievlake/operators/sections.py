"""Statute text in pages to numbered sections, without ever holding a whole document in one task.

Pages are joined in fixed-size buckets of page numbers. Within a bucket, headers are found on the
joined text. Three things cross bucket borders and are settled on narrow tables with one row per
bucket, never with page text:

* a header may start at the very end of a bucket ("Section" or "12."), so such a tail moves to the
  front of the next bucket before headers are searched;
* the text before a bucket's first header belongs to the section left open earlier;
* a section that stays open over several buckets gets its parts joined by its key at the end.

What tail a bucket leaves can depend on what comes in: a bucket of one line may be the title of a number that stands
before it. Each bucket therefore states both cases, with a number before it and without. Every statement is constant,
or turns one case into the other, or passes it on; along a document such statements compose to "the last constant, and
how often it was turned since", which two running numbers per bucket tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.text import longer_than, strip
from ..sources.storage import stage

PAGES_PER_BUCKET = 256

# Code points that never occur in text (Unicode noncharacters) mark the headers found.
_START, _NUMBER, _TITLE, _BODY = "\uFDD0", "\uFDD1", "\uFDD2", "\uFDD3"
_HEADER = "(?U)" + fixed.SECTION_HEADER
_MARKED = f"{_START}$1{_NUMBER}$2{_TITLE}$3{_BODY}"
_STOP = "(?U)" + fixed.SECTION_STOP
# text at the end of a bucket that may open a header continued on the next page
_TAIL = r"(?U)(?:Section|(?:Section\s+)?\d{1,3}\.)\z"
_NUMBER_END = r"\.\z"
_ONLY_NUMBER = r"(?U)\A\d{1,3}\.\z"

# a line break that no header can span: the line before it does not end in "Section" or a number
_SAFE_BREAK = r"(?U)(?<=\S)(?<!\d\.)(?<!Section)\s*\n\s*\S"


def _joined(parts: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.sort_array(parts), lambda p: p["text"]), separator)


def _page_buckets(pages: DataFrame) -> DataFrame:
    bucket = F.floor(F.col("page_number") / F.lit(PAGES_PER_BUCKET))
    part = F.struct(F.col("page_number").alias("at"), F.col("raw_text").alias("text"))
    return pages.groupBy("doc_id", bucket.alias("bucket")).agg(_joined(F.collect_list(part), "\n").alias("text"))


def assemble_documents(pages: DataFrame) -> DataFrame:
    """doc_id and the text of its pages in page order. Buckets are joined first, then their texts."""
    part = F.struct(F.col("bucket").alias("at"), "text")
    return _page_buckets(pages).groupBy("doc_id").agg(_joined(F.collect_list(part), "\n").alias("text"))


def _mark(text: Column) -> Column:
    return F.regexp_replace(text, _HEADER, _MARKED)


def _tail_of(text: Column) -> Column:
    """What may open a header at the end of a text. Looked for behind the last header only: a title keeps all it holds."""
    free = F.substring_index(_mark(F.concat(text, F.lit("\n"))), _BODY, -1)
    return F.when(text.rlike(_TAIL), F.regexp_extract(F.regexp_replace(free, r"\n\z", ""), _TAIL, 0)).otherwise("")


def _border_summary(buckets: DataFrame) -> DataFrame:
    """Per bucket its tail, and the tail it leaves if a number stands before it. The two can differ only where no line
    break surely lies outside a header: then the first line may be a title."""
    text = F.col("text")
    after_number = _tail_of(F.concat(F.lit("1.\n"), text))
    return buckets.withColumns({
        "tail": _tail_of(text),
        "tail_after": F.when(~text.rlike(_SAFE_BREAK), after_number),
        "only_number": text.rlike(_ONLY_NUMBER),
    }).withColumn("tail_after", F.coalesce("tail_after", "tail"))


def _settled_tails(summary: DataFrame) -> DataFrame:
    """doc_id, bucket, takes (the length of the tail that leaves the bucket), goes_to (the bucket that gets it).

    Only numbers and flags pass through the windows. A tail goes to the next bucket; a "Section" before a bucket that
    is nothing but a number goes on with it.
    """
    order = W.partitionBy("doc_id").orderBy("bucket")
    number = lambda tail: F.col(tail).rlike(_NUMBER_END)
    stated = summary.select(
        "doc_id", "bucket", "only_number", number("tail").alias("leaves"), number("tail_after").alias("leaves_after"),
        F.length("tail").alias("size"), F.length("tail_after").alias("size_after"),
    )
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    constant = F.col("leaves") == F.col("leaves_after")
    turns = F.sum(F.when(F.col("leaves") & ~F.col("leaves_after"), 1).otherwise(0)).over(so_far)
    counted = stated.withColumn("turns", turns).withColumn("base", F.when(constant, F.struct("leaves", "turns")))
    last = F.last("base", ignorenulls=True).over(so_far)
    turned = (F.col("turns") - F.coalesce("last.turns", F.lit(0))) % 2 == 1
    known = counted.withColumn("last", last).withColumn("after", F.coalesce("last.leaves", F.lit(False)) != turned)
    entered = known.withColumn("entered", F.coalesce(F.lag("after").over(order), F.lit(False)))
    settled = entered.select(
        "doc_id", "bucket", "only_number",
        F.when(F.col("entered"), F.col("size_after")).otherwise(F.col("size")).alias("takes"),
        F.when(F.col("entered"), F.col("leaves_after")).otherwise(F.col("leaves")).alias("number"),
    )
    next_bucket, next_only = F.lead("bucket").over(order), F.lead("only_number").over(order)
    passed_on = (F.col("takes") > 0) & ~F.col("number") & F.coalesce(next_only, F.lit(False))
    second = F.lead("bucket", 2).over(order)
    return settled.select(
        "doc_id", "bucket", next_bucket.isNull().alias("is_last"),
        F.when(next_bucket.isNull(), 0).otherwise(F.col("takes")).alias("takes"),
        F.when(passed_on, F.coalesce(second, next_bucket)).otherwise(next_bucket).alias("goes_to"),
    )


def _with_borders(buckets: DataFrame) -> DataFrame:
    """Buckets whose texts concatenate to the document, each starting where no header is open.

    The joined page texts are written once, with what they say of their borders.
    """
    tailed = stage(_border_summary(buckets), "pages")
    settled = _settled_tails(tailed.drop("text"))
    cut = tailed.join(settled, ["doc_id", "bucket"])
    moved = cut.filter("takes > 0").select(
        "doc_id", F.col("goes_to").alias("bucket"),
        F.struct(F.col("bucket").alias("at"), F.expr("right(text, takes)").alias("text")).alias("part"),
    )
    lead_ins = moved.groupBy("doc_id", "bucket").agg(_joined(F.collect_list("part"), "\n").alias("lead_in"))
    own = F.expr("substring(text, 1, length(text) - takes)")
    body = F.when(F.col("is_last") | (F.col("takes") > 0), own).otherwise(F.concat("text", F.lit("\n")))
    front = F.when(F.col("lead_in").isNotNull(), F.concat("lead_in", F.lit("\n"))).otherwise("")
    return cut.join(lead_ins, ["doc_id", "bucket"], "left").select("doc_id", "bucket", F.concat(front, body).alias("text"))


def _segments(pieces: str) -> Column:
    """One struct per piece: a first one for the text before any header, then one per header."""

    def cut(piece: Column, index: Column) -> Column:
        head, body = F.substring_index(piece, _BODY, 1), F.substring_index(piece, _BODY, -1)
        following = F.get(F.col(pieces), index + 1)
        # a stop may need the first letter of the next header ("7. Section 8. ...")
        visible = F.concat(body, F.coalesce(F.substring(following, 1, 1), F.lit("")))
        before_stop = F.get(F.split(visible, _STOP, 2), F.lit(0))
        stopped = F.length(before_stop) < F.length(visible)
        return F.struct(
            index.alias("index"),
            F.substring_index(F.substring_index(head, _TITLE, 1), _NUMBER, -1).alias("number"),
            F.substring_index(head, _TITLE, -1).alias("title"),
            F.when(stopped, before_stop).otherwise(body).alias("text"),
            (stopped | following.isNotNull()).alias("closed"),
        )

    return F.transform(pieces, cut)


def split_sections(pages: DataFrame, min_body: int = fixed.MIN_SECTION_BODY) -> DataFrame:
    """doc_id, section_id, section_num, title, content, source, one row per section found.

    ``pages`` has doc_id, page_number and trimmed, non-empty raw_text (see ``clean_pages``). The segments
    are written once. A section that ends inside its bucket is final as it stands; only those left open
    are grouped with the text that follows them.
    """
    found = F.split(_mark(F.col("text")), _START).alias("pieces")
    segments = stage(
        _with_borders(_page_buckets(pages)).select("doc_id", "bucket", found)
        .select("doc_id", "bucket", F.explode_outer(_segments("pieces")).alias("s")).select("doc_id", "bucket", "s.*"),
        "segments",
    )
    last = segments.groupBy("doc_id", "bucket").agg(F.max(F.struct("index", "closed")).alias("last"))
    # what the next bucket inherits: this bucket's open section, nothing (0), or what came before (null)
    bucket, index, closed = F.col("bucket"), F.col("last.index"), F.col("last.closed")
    leaves_open = F.when(
        (index > 0) | closed, F.struct(bucket.alias("home"), F.when(closed, 0).otherwise(index).alias("index"))
    )
    earlier = W.partitionBy("doc_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    inherited = last.select("doc_id", "bucket", F.last(leaves_open, ignorenulls=True).over(earlier).alias("open"))
    part = F.struct(F.col("bucket").alias("at"), "text").alias("part")
    opened = segments.filter("index > 0 and not closed").select(
        "doc_id", bucket.alias("home"), "index", "number", "title", part
    )
    leads = segments.filter("index = 0").select("doc_id", "bucket", part)
    continued = leads.join(inherited.filter("open.index > 0"), ["doc_id", "bucket"]).select("doc_id", "open.*", "part")
    spanning = (
        opened.unionByName(continued, allowMissingColumns=True)
        .groupBy("doc_id", "home", "index")
        .agg(
            F.max("number").alias("number"), F.max("title").alias("title"),
            _joined(F.collect_list("part"), "").alias("text"),
        )
    )
    columns = ["doc_id", "number", "title", "text"]
    whole = segments.filter("index > 0 and closed").select(*columns).unionByName(spanning.select(*columns))
    return whole.select(
        "doc_id",
        F.concat(F.lit(fixed.SECTION_PREFIX), "number").alias("section_id"),
        F.col("number").alias("section_num"),
        strip("title").alias("title"),
        F.replace(strip("text"), F.lit("\n"), F.lit(" ")).alias("content"),
        F.lit(fixed.SECTION_SOURCE).alias("source"),
    ).filter(longer_than("content", min_body))
