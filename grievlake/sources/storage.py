"""Where intermediate data may be written, and how it goes again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = "grievlake.staged.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or else a part of the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def _session_folder(spark: SparkSession) -> str:
    """All staged data of one session stand under one folder, so that ``clear`` touches no other session's."""
    folder = spark.conf.get(_OWN, None)
    if folder is None:
        folder = f"{shared_folder(spark)}/grievlake/{uuid.uuid4().hex}"
        spark.conf.set(_OWN, folder)
    return folder


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder; nothing is created yet."""
    return f"{_session_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back: fixed contents, short lineage."""
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that no result reads any more."""
    if not path.startswith(_session_folder(spark) + "/"):
        raise ValueError(f"not a staged folder of this session: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this session has staged. DataFrames that were built on it cannot be read any more."""
    folder = spark.conf.get(_OWN, None)
    if folder is not None:
        spark.conf.unset(_OWN)
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
