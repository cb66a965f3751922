"""String, array and lookup helpers used by every layer."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Drop leading and trailing white space of every kind (``trim`` drops blanks only)."""
    return F.regexp_replace(as_column(value), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def or_default(value: Column | str, default: str) -> Column:
    """The value, or ``default`` where it is null or empty."""
    return F.coalesce(F.nullif(as_column(value), F.lit("")), F.lit(default))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often and in whichever branches it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def literal(value) -> Column:
    """A constant of plain Python data; lists and tuples become arrays."""
    if isinstance(value, list | tuple):
        return F.array(*[literal(v) for v in value])
    return F.lit(value)


def lookup(key: Column | str, table: Mapping[str, object], default: object = None) -> Column:
    """Constant-map lookup. The map is part of the plan, so no join and no broadcast are needed."""
    pairs = [part for k, v in table.items() for part in (F.lit(k), literal(v))]
    found = F.try_element_at(F.create_map(*pairs), as_column(key))
    return found if default is None else F.coalesce(found, literal(default))


def fill_template(template: str) -> Column:
    """Text with ``{column}`` places filled from columns; null columns print as empty text."""
    parts: list[Column] = []
    for text, field, spec, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is not None:
            value = F.format_string("%" + spec, F.col(field)) if spec else F.col(field).cast("string")
            parts.append(F.coalesce(value, F.lit("")))
    return F.concat(*parts)


def issue_label(issue: Column | str) -> Column:
    """``WAGE_THEFT`` to ``Wage Theft``; labels pass unchanged."""
    return F.initcap(F.replace(as_column(issue), F.lit("_"), F.lit(" ")))


def head(value: Column | str, size: int) -> Column:
    """First ``size`` characters."""
    return F.substring(as_column(value), 1, size)


def first_items(value: Column | str, size: int) -> Column:
    """First ``size`` elements of an array."""
    return F.slice(as_column(value), 1, size)


def longer_than(value: Column | str, size: int) -> Column:
    return F.length(as_column(value)) > size


def base_name(path: Column | str) -> Column:
    return F.substring_index(as_column(path), "/", -1)


def extension(path: Column | str) -> Column:
    return F.lower(F.substring_index(as_column(path), ".", -1))


def string_columns(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema.fields if isinstance(field.dataType, T.StringType)]


def any_column_contains(df: DataFrame, keywords: list[str], cols: list[str] | None = None) -> DataFrame:
    """Rows where any string column holds any keyword, ignoring case.

    One scan per column with a single alternation; keywords are quoted, so they match literally.
    """
    cols = string_columns(df) if cols is None else cols
    if not cols or not keywords:
        return df.filter(F.lit(False))
    pattern = "|".join(r"\Q" + word.lower() + r"\E" for word in keywords)
    hit = F.lit(False)
    for name in cols:
        hit = hit | F.coalesce(F.lower(F.col(name)).rlike(pattern), F.lit(False))
    return df.filter(hit)


def iso_timestamp(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
