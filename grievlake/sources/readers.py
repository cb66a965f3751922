"""Batch and streaming readers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fixed
from ..functions.text import base_name, extension, strip
from ..schemas import CALLS, VECTORS

_UNREAD = "_unread"


def is_path(target: str) -> bool:
    """Targets holding a slash are folders; all others are catalog tables."""
    return "/" in target


def read_table(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target) if is_path(target) else spark.table(target)


def _raw_calls(reader, path: str, lines: bool, pattern: str) -> DataFrame:
    """Call records with the file they come from and, where they cannot be read, their text."""
    schema = T.StructType([*CALLS.fields, T.StructField(_UNREAD, T.StringType())])
    raw = (
        reader.format("json").schema(schema).option("columnNameOfCorruptRecord", _UNREAD)
        .option("multiLine", not lines).option("pathGlobFilter", pattern).load(path)
    )
    return raw.select("*", F.col("_metadata.file_path").alias("path"))


def split_calls(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(call records, rejects): a reject has the path of its file, its text, and the call id if that was legible.

    A file that is not JSON is one reject; so is a record with a value of another type than its column.
    """
    # Spark refuses to read the text of rejects alone, as a count of rows would: the test names another column, too
    bad = F.array_position(F.array(F.col(_UNREAD).isNotNull(), F.col("call_id").isNull()), True) == 1
    rejects = raw.filter(bad).select("path", "call_id", F.col(_UNREAD).alias("text"))
    return raw.filter(~bad).select(*CALLS.fieldNames()), rejects


def read_calls_and_rejects(
    spark: SparkSession, path: str, lines: bool = False, pattern: str = "*.json"
) -> tuple[DataFrame, DataFrame]:
    return split_calls(_raw_calls(spark.read, path, lines, pattern))


def read_calls(spark: SparkSession, path: str, lines: bool = False, pattern: str = "*.json") -> DataFrame:
    """Call records. A file holds one pretty-printed object or an array; ``lines`` reads one per line.

    What cannot be read is left out here: ``read_calls_and_rejects`` hands it out.
    """
    return read_calls_and_rejects(spark, path, lines, pattern)[0]


def sample_call(spark: SparkSession, path: str) -> DataFrame:
    return read_calls(spark, path).limit(1)


def stream_calls_and_rejects(
    spark: SparkSession, path: str, lines: bool = False, pattern: str = "*.json", files_per_trigger: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Incremental read of a folder of call files under the fixed schema: (call records, rejects)."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return split_calls(_raw_calls(reader, path, lines, pattern))


def stream_calls(
    spark: SparkSession, path: str, lines: bool = False, pattern: str = "*.json", files_per_trigger: int | None = None
) -> DataFrame:
    """The call records alone."""
    return stream_calls_and_rejects(spark, path, lines, pattern, files_per_trigger)[0]


def rows_table(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType) -> DataFrame:
    """Inline rows under an explicit schema (seed rows, demo rows, scenarios)."""
    return spark.createDataFrame(list(rows), schema)


def table_or_default(spark: SparkSession, name: str, rows: Iterable[tuple], schema: T.StructType) -> DataFrame:
    """The table, or the given rows when it is absent or empty."""
    if spark.catalog.tableExists(name):
        table = spark.table(name)
        if not table.isEmpty():
            return table
    return rows_table(spark, rows, schema)


def read_schemes(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header. Give the schema once it is known: inference reads all files twice.

    ``multi_line`` is for fields that hold line ends; a file is then one task, however large.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def clean_pages(pages: DataFrame) -> DataFrame:
    """Page rows with trimmed text; pages without text are dropped."""
    return pages.filter(F.col("raw_text") != "").withColumn("raw_text", strip("raw_text"))


def file_manifest(spark: SparkSession, folder: str, exts: list[str] | None = None) -> DataFrame:
    """path, name, ext, length, modified of matching files. File contents are never read."""
    pattern = "*.{" + ",".join(exts or fixed.AUDIO_GLOBS) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(
        "path",
        base_name("path").alias("name"),
        extension("path").alias("ext"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def read_vectors(spark: SparkSession, target: str) -> DataFrame:
    return read_table(spark, target).select(*VECTORS.fieldNames())
