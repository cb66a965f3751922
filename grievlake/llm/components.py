"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import storage


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _with_lowest(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the lowest neighbour m of u. The centre of a large star is a hot key: the other side
    is dealt by an expression of its own, so that both sides are plain shuffles and adaptive execution can split it."""
    keyed = lowest.select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("_u"), "m")
    return edges.join(keyed, F.col("u") == F.col("_u")).drop("_u")


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = _with_lowest(both.filter("v > u"), lowest).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    return (
        _with_lowest(large, lowest).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(lowest.select("u", F.col("m").alias("v"))).distinct()
    )


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node with a link to another one.

    The number of edges never grows beyond that of the input. Every round is written to the shared folder, and the
    round before it goes then.
    """
    spark = links.sparkSession

    def written(edges: DataFrame) -> tuple[DataFrame, str]:
        path = storage.new_folder(spark, "edges")
        edges.write.parquet(path)
        return spark.read.schema(edges.schema).parquet(path), path

    edges, path = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    )
    before = _fingerprint(edges)
    while True:
        edges, new_path = written(_stars(edges))
        storage.remove(spark, path)
        path, now = new_path, _fingerprint(edges)
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
