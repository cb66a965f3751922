"""A sink that writes every row to a file of its own name, and the way back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import base_name

_WRITING = "_writing"


class _OneFilePerRow(DataSourceWriter):
    """Tasks write each text under a name of their own first and then move it to its place, which replaces whatever
    an earlier try of the task has put there; the text of a name is the same in every try."""

    def __init__(self, folder: str):
        self.folder = folder

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, base = self._open()
        files.create_dir(f"{base}/{_WRITING}")
        for row in iterator:
            part = f"{base}/{_WRITING}/{uuid.uuid4().hex}"
            with files.open_output_stream(part) as out:
                out.write((row["value"] or "").encode())
            files.move(part, f"{base}/{row['file_name']}")
        return WriterCommitMessage()

    def _clean(self) -> tuple[fs.FileSystem, str]:
        files, base = self._open()
        files.create_dir(f"{base}/{_WRITING}")
        files.delete_dir(f"{base}/{_WRITING}")
        return files, base

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = self._clean()
        with files.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()


class OneFilePerRow(DataSource):
    """Format of rows (file_name, value): option ``path`` names a folder that pyarrow's file systems reach."""

    @classmethod
    def name(cls) -> str:
        return "one_file_per_row"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _OneFilePerRow(self.options["path"])


def write_text_files(files: DataFrame, folder: str) -> None:
    """Write ``value`` of every row to ``file_name`` (unique) in the folder; ``_SUCCESS`` tells that all are there."""
    files.sparkSession.dataSource.register(OneFilePerRow)
    files.select("file_name", "value").write.format("one_file_per_row").mode("append").option("path", folder).save()


def read_text_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(file_name, value) of the files whose names match the pattern, each read whole as UTF-8; Spark passes over empty files."""
    # the text source takes several times as long to open a file as the binary one
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(base_name("path").alias("file_name"), F.col("content").cast("string").alias("value"))
