"""Small schema adjustments that depend on which columns are present."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import literal


def rename_if_present(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename the listed columns that exist. A target that already exists is an error."""
    present = {old: new for old, new in mapping.items() if old in df.columns}
    clash = [new for old, new in present.items() if new in df.columns and new != old]
    if clash:
        raise ValueError(f"rename would duplicate columns {clash}")
    return df.withColumnsRenamed(present)


def json_without(row: Column | str, left_out: list[str]) -> Column:
    """A struct as JSON text, without the named fields."""
    row = F.col(row) if isinstance(row, str) else row
    return F.to_json(row.dropFields(*left_out))


def ensure_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add each missing column with its default value or default column."""
    missing = {n: v if isinstance(v, Column) else literal(v) for n, v in defaults.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in schema order with schema types; values that do not fit become null."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def missing_fields(df: DataFrame, required: list[str], out: str = "missing_fields") -> DataFrame:
    """List, per row, the required columns that are absent or null."""
    names = [F.when(F.col(n).isNull(), F.lit(n)) if n in df.columns else F.lit(n) for n in required]
    return df.withColumn(out, F.array_compact(F.array(*names)))


def split_rejects(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows); a null verdict counts as rejected."""
    verdict = F.coalesce(ok, F.lit(False))
    return df.filter(verdict), df.filter(~verdict)
