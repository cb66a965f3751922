"""Model replies (free text that should hold one JSON object) to typed columns.

``from_json`` accepts text after the first complete object. A candidate is therefore read as the only element of a
list inside a larger object whose last member must be seen too. Where an object is followed by the end of a list, the
candidate's brackets (outside its strings) are counted as well: one that closes before its end is more than one object.
So a reply counts as parsed only when it is one object and nothing else. All fields are first read as text, so a wrong
type in one field never spoils the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fixed
from ..schemas import ACTION, ENTITIES
from .text import as_column, bind, strip

_JSON_OPTIONS = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "columnNameOfCorruptRecord": "_corrupt",
}
_STRING = r'"(?:[^"\\]|\\.)*+"'
_LEAVES_LIST = r"\}\s*\]"
# a Python literal standing for a value: after a colon, a comma or an opening bracket
_PY_VALUE = r"([:,\[]\s*)%s(?=\s*[,}\]])"


def _closes_once(candidate: Column) -> Column:
    """Brackets outside strings close for the first time where the last of them stands."""
    brackets = F.regexp_replace(F.regexp_replace(candidate, _STRING, ""), r"[^\[\]{}]", "")
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed"))

    def step(s: Column, b: Column) -> Column:
        depth = s["depth"] + F.when(b.isin("{", "["), 1).otherwise(-1)
        return F.struct(depth.alias("depth"), (s["closed"] + F.when(depth <= 0, 1).otherwise(0)).alias("closed"))

    return F.aggregate(F.regexp_extract_all(brackets, F.lit("."), F.lit(0)), state, step)["closed"] == 1


def _read_object(candidate: Column, fields: list[str]) -> Column:
    """Struct of text fields, or null when the candidate is not exactly one JSON object."""
    text = T.StringType()
    row = T.StructType([T.StructField(name, text) for name in fields])
    wrapped = T.StructType([
        T.StructField("r", T.ArrayType(row)), T.StructField("end", text), T.StructField("_corrupt", text),
    ])
    parsed = F.from_json(F.concat(F.lit('{"r":['), candidate, F.lit('],"end":1}')), wrapped, _JSON_OPTIONS)

    def only_element(p: Column) -> Column:
        read = p["_corrupt"].isNull() & p["end"].isNotNull() & (F.size(p["r"]) == 1)
        # only an object that is followed by the end of a list can have left the one put around it: the others need
        # no count of their brackets
        alone = F.when(candidate.rlike(_LEAVES_LIST), _closes_once(candidate)).otherwise(True)
        return F.when(F.when(read, alone), F.get(p["r"], F.lit(0)))

    return bind(parsed, only_element)


def _python_literals_to_json(candidate: Column) -> Column:
    """Strings stay as they are: the literals are looked for between them, so a JSON object does not change."""
    def outside(piece: Column) -> Column:
        # what follows a literal is not part of its match, so neighbours in a list are found in one pass
        for python, json in (("True", "true"), ("False", "false"), ("None", "null")):
            piece = F.regexp_replace(piece, _PY_VALUE % python, "$1" + json)
        return piece

    def joined(both: Column) -> Column:
        parts, strings = both["parts"], both["strings"]
        text = F.array_join(F.zip_with(parts, strings, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
        # a quote without its partner: the text is no object either way
        return F.when(F.size(parts) == F.size(strings) + 1, text)

    # a string takes part as one mark, so that what stands around it still reads as one text
    strings = F.regexp_extract_all(candidate, F.lit(_STRING), F.lit(0))
    parts = F.split(outside(F.regexp_replace(candidate, _STRING, '"')), '"')
    return F.coalesce(bind(F.struct(parts.alias("parts"), strings.alias("strings")), joined), candidate)


def outer_braces(raw: Column | str) -> Column:
    """The span from the first ``{`` to the last ``}`` after dropping thinking text and fences."""
    raw = as_column(raw)
    answer = F.substring_index(raw, "</think>", -1)
    unfenced = F.when(F.contains(raw, F.lit("```")), F.regexp_replace(answer, r"```(?:json)?", "")).otherwise(answer)
    return F.regexp_extract(unfenced, r"(?s)\{.*\}", 0)


def between_fences(raw: Column | str) -> Column:
    """Text between the first two code fences without a leading ``json`` tag, else the whole text."""
    text = strip(raw)
    fenced = F.regexp_replace(F.try_element_at(F.split(text, "```"), F.lit(2)), "^json", "")
    return strip(F.when(F.contains(text, F.lit("```")), fenced).otherwise(text))


def parse_entities(raw: Column | str, repair: bool = True) -> Column:
    """Entity struct of text fields; null when no object can be read."""
    names = ENTITIES.fieldNames()

    def read(candidate: Column) -> Column:
        return _read_object(candidate, names)

    if not repair:
        return bind(outer_braces(raw), read)

    def repaired(candidate: Column) -> Column:
        # what is JSON already stays as it is: one reading does for both
        literals = candidate.rlike(_PY_VALUE % "(?:True|False|None)")
        return bind(F.when(literals, _python_literals_to_json(candidate)).otherwise(candidate), read)

    return bind(outer_braces(raw), repaired)


def coerce_entities(parsed: Column) -> Column:
    """Typed entity struct. Absent or unusable fields take their defaults, whatever the others hold."""
    stated = parsed["violence_threatened"]
    flag = F.lower(strip(stated))
    workers = parsed["worker_count_mentioned"]
    # a text without a digit is no number; to find that out by casting costs an exception for each
    count = F.when(workers.rlike("[0-9]"), F.coalesce(workers.try_cast("int"), workers.try_cast("double").try_cast("int")))
    return F.struct(
        F.coalesce(parsed["contractor_name"], F.lit(fixed.UNKNOWN)).alias("contractor_name"),
        F.coalesce(parsed["work_site"], F.lit(fixed.UNKNOWN)).alias("work_site"),
        F.coalesce(parsed["issue_type"], F.lit(fixed.OTHER_ISSUE)).alias("issue_type"),
        F.when(stated == "true", True).when(stated == "false", False)
        .otherwise(F.coalesce(~flag.isin("", "false", "0", "0.0", "[]", "{}"), F.lit(False))).alias("violence_threatened"),
        F.coalesce(count, F.lit(0)).alias("worker_count_mentioned"),
    )


def parse_fenced_json(raw: Column | str, schema: T.StructType = ACTION) -> Column:
    """Struct of ``schema`` read from a fenced or bare reply; null when it is not one JSON object."""
    def typed(texts: Column) -> Column:
        values = []
        for field in schema.fields:
            text = texts[field.name]
            if isinstance(field.dataType, T.StringType):
                value = text
            elif isinstance(field.dataType, T.ArrayType | T.StructType | T.MapType):
                value = F.from_json(text, field.dataType)
            else:
                value = text.try_cast(field.dataType)
            values.append(value.alias(field.name))
        return F.when(texts.isNotNull(), F.struct(*values))

    return bind(_read_object(between_fences(raw), schema.fieldNames()), typed)


def first_readable(replies: DataFrame, parse: Callable[[Column], Column], order: str | None = None) -> DataFrame:
    """call_id, raw, parsed: per call its first reply that can be read, or its first one with ``parsed`` null.

    A client that tried twice answers twice. ``order`` is the column that tells which answer came first; without it,
    and for equal ones, text order decides. Replies are read where they are, and each task hands on one per call.
    """
    read = replies.select("call_id", "raw", *[order] if order else [], parse(F.col("raw")).alias("parsed"))
    rank = F.struct(F.col("parsed").isNull(), *[F.col(order).isNull(), F.col(order)] if order else [], F.col("raw").isNull(), F.col("raw"))
    best = F.min_by(F.struct("raw", "parsed"), rank).alias("best")
    return read.groupBy("call_id").agg(best).select("call_id", "best.raw", "best.parsed")


def with_entities(df: DataFrame, raw: str = "raw", repair: bool = True) -> DataFrame:
    """Entity columns plus ``parse_status`` (ok / default) for a reply column."""
    def read(parsed: Column) -> Column:
        status = F.when(parsed.isNull(), "default").otherwise("ok")
        return F.struct(coerce_entities(parsed).alias("typed"), status.alias("status"))

    found = df.withColumn("_found", bind(parse_entities(raw, repair), read))
    return found.select(*df.columns, "_found.typed.*", F.col("_found.status").alias("parse_status"))
