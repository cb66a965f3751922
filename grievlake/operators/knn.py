"""Exact nearest neighbours on squared Euclidean distance, of dense vectors or of sparse ones of unit length.

Both sides are cut into tiles of bounded size by a hash of their ids. Each pair of a query tile and a chunk tile is one
group of a cogrouped Arrow function, which scores the pair as matrices and hands on the k best rows of every query; a
window picks the final k. No pair of query and chunk ever becomes a row, no side is sent whole to any task, and
nothing but counts comes to the driver. With few queries there is one query tile, and the chunks are dealt once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..fixed_values import CONTEXT_CHARS
from ..functions.text import head
from ..sources.storage import stage
from .vectors import UNIT

TILE_BYTES = 8 << 20  # of vectors on either side of a tile pair
LEAST_TILE_BYTES = 1 << 20  # tiles are made smaller, down to this, to keep all cores busy
TILE_CELLS = 1_000_000  # distances held at once inside a task
QUERY_ROWS, CHUNK_ROWS = 1024, 4096  # of sparse vectors taken at once
_SLACK = 1e-9  # far above the rounding error of the fast distance, relative to the vector lengths


def usable(vector: Column | str, dimensions: int) -> Column:
    """Has the wanted length, and every element is a finite number."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def split_vectors(df: DataFrame, dimensions: int, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows that a search can use, and the rejects: null, of another length, or with elements that are not finite."""
    good = usable(column, dimensions)
    return df.filter(good), df.filter(~good)


def _first_k(row: np.ndarray, col: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of candidates (row, col, distance) the k nearest per row; columns are in id order, so ties go to the lower id."""
    order = np.lexsort((col, distance, row))
    row, col, distance = row[order], col[order], distance[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k], distance[place < k]


def _within(distance: np.ndarray, k: int, slack: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """(row, col) of all cells that may belong to the k nearest of their row."""
    if distance.shape[1] <= k:
        return np.nonzero(np.ones_like(distance, bool))
    limit = np.partition(distance, k - 1, axis=1)[:, k - 1:k]
    return np.nonzero(distance <= limit + slack)


def _closest(targets: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(target, point, squared distance) of the k nearest points of every target."""
    lengths, norms = np.square(targets).sum(axis=1), np.square(points).sum(axis=1)
    step, found = max(1, TILE_CELLS // len(points)), []
    for start in range(0, len(targets), step):
        part = targets[start:start + step]
        fast = lengths[start:start + step, None] + norms[None, :] - 2.0 * (part @ points.T)
        row, col = _within(fast, k, _SLACK * (lengths[start:start + step, None] + norms.max()))
        few = max(1, TILE_CELLS // points.shape[1])
        exact = [
            np.square(points[col[i:i + few]] - part[row[i:i + few]]).sum(axis=1) for i in range(0, len(row), few)
        ]
        row, col, distance = _first_k(row, col, np.concatenate(exact), k)
        found.append((row + start, col, distance))
    return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = pc.list_flatten(vectors).to_numpy().astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _postings(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of sparse vectors, by row."""
    buckets, weights = (pc.struct_field(vectors, name) for name in ("buckets", "weights"))
    lengths = pc.list_value_length(buckets).to_numpy()
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, pc.list_flatten(buckets).to_numpy(), pc.list_flatten(weights).to_numpy().astype(np.float64)


def _products(query: tuple, chunk: tuple, queries: int, chunks: int) -> np.ndarray:
    """Inner products (queries x chunks) through an inverted index of the queries: whole numbers, exact in float64."""
    q_row, q_bucket, q_weight = query
    order = np.argsort(q_bucket, kind="stable")
    q_row, q_weight = q_row[order], q_weight[order]
    terms, first, count = np.unique(q_bucket[order], return_index=True, return_counts=True)
    c_row, c_bucket, c_weight = chunk
    at = np.minimum(np.searchsorted(terms, c_bucket), len(terms) - 1)
    shared = np.flatnonzero(terms[at] == c_bucket)
    at, c_row, c_weight = at[shared], c_row[shared], c_weight[shared]
    total, out = np.cumsum(count[at]), np.zeros(queries * chunks)
    start = 0
    while start < len(at):  # pieces of postings whose products fit
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + TILE_CELLS)))
        times = count[at[start:end]]
        begins = np.cumsum(times) - times
        spot = np.arange(times.sum()) - np.repeat(begins - first[at[start:end]], times)
        cell = q_row[spot] * chunks + np.repeat(c_row[start:end], times)
        out += np.bincount(cell, q_weight[spot] * np.repeat(c_weight[start:end], times), queries * chunks)
        start = end
    return out.reshape(queries, chunks)


def _between(postings: tuple, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, bucket, weight = postings
    a, b = np.searchsorted(row, [low, high])
    return row[a:b] - low, bucket[a:b], weight[a:b]


def _closest_sparse(targets: tuple, points: tuple, queries: int, chunks: int, k: int) -> tuple[np.ndarray, ...]:
    found = []
    for q in range(0, queries, QUERY_ROWS):
        some = min(QUERY_ROWS, queries - q)
        part = _between(targets, q, q + some)
        for c in range(0, chunks, CHUNK_ROWS):
            few = min(CHUNK_ROWS, chunks - c)
            far = -_products(part, _between(points, c, c + few), some, few)
            row, col = _within(far, k, 0.0)
            row, col, far = _first_k(row, col, far[row, col], k)
            found.append((row + q, col + c, far))
    row, col, far = _first_k(*(np.concatenate(x) for x in zip(*found)), k)
    return row, col, 2.0 + 2.0 * far / float(UNIT) ** 2


def _scorer(k: int, sparse: bool, schema: pa.Schema):
    """Function of a tile pair: the k nearest chunks of the tile for each of the pair's queries."""

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        held = held.take(pc.sort_indices(held, [("chunk_id", "ascending")]))
        if sparse:
            row, col, distance = _closest_sparse(
                _postings(asked["embedding"]), _postings(held["embedding"]), asked.num_rows, held.num_rows, k
            )
        else:
            row, col, distance = _closest(_matrix(asked["embedding"]), _matrix(held["embedding"]), k)
        columns = [asked["query_id"].take(pa.array(row)), held["chunk_id"].take(pa.array(col)), pa.array(distance)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return score


def _tiles(sizes: tuple[int, int], cores: int, tile_bytes: int) -> tuple[int, int]:
    """Number of tiles of the queries and of the chunks. Chunks are cut finer while cores are free, then the queries:
    each further tile of queries deals all chunks once more."""
    def cut(size: int, wanted: int) -> int:
        return max(1, math.ceil(size / tile_bytes), min(wanted, size // LEAST_TILE_BYTES))

    held = cut(sizes[1], cores)
    return cut(sizes[0], cores // held), held


def _search(queries: DataFrame, corpus: DataFrame, sizes: tuple[int, int], k: int, sparse: bool, tile_bytes: int) -> DataFrame:
    """query_id, chunk_id, score, rank. ``sizes`` are the bytes of vectors on both sides."""
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("chunk_id", corpus.schema["chunk_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    asked, held = _tiles(sizes, corpus.sparkSession.sparkContext.defaultParallelism, tile_bytes)

    def tiled(df: DataFrame, key: str, own: str, own_count: int, other: str, other_count: int) -> DataFrame:
        return df.select(
            key, "embedding", F.pmod(F.xxhash64(key), F.lit(own_count)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(other_count - 1))).alias(other),
        ).groupBy("asked", "held")

    pairs = tiled(queries, "query_id", "asked", asked, "held", held).cogroup(
        tiled(corpus, "chunk_id", "held", held, "asked", asked)
    )
    near = pairs.applyInArrow(_scorer(k, sparse, to_arrow_schema(schema)), schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "chunk_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def knn(
    queries: DataFrame, corpus: DataFrame, k: int = 3, dimensions: int | None = None, tile_bytes: int = TILE_BYTES
) -> DataFrame:
    """query_id, <corpus columns but the vector>, score, rank: the k nearest chunks of every query.

    ``queries`` has query_id (unique) and embedding; ``corpus`` has chunk_id (unique), embedding and any
    columns to carry along, such as content and source. Scores are squared distances; ties go to the
    lower chunk_id. Only ids and vectors reach Python: the other columns are joined to the hits.
    ``dimensions`` is the length of a vector, by default the most frequent one of the corpus; vectors of another
    length, or with an element that is null or not finite, match nothing (``split_vectors`` hands them out).
    """
    if dimensions is None:
        common = corpus.groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("n")).filter("length > 0")
        first = common.orderBy(F.desc("n"), "length").first()
        dimensions = first["length"] if first else 1
    # queries are written once: counting and dealing would each compute them anew
    asked = stage(queries.select("query_id", "embedding").filter(usable("embedding", dimensions)), "questions")
    held = corpus.select("chunk_id", "embedding").filter(usable("embedding", dimensions))
    sizes = (8 * dimensions * asked.count(), 8 * dimensions * corpus.count())
    return with_chunks(_search(asked, held, sizes, k, False, tile_bytes), corpus)


def sparse_knn(queries: DataFrame, corpus: DataFrame, k: int = 3, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """The same for sparse vectors as ``vectors.vectorise`` makes them. Texts that share no word with a query are all
    at distance 2 and take part in the order; only null vectors match nothing."""
    asked = stage(queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull()), "questions")
    held = corpus.filter(F.col("embedding").isNotNull())
    length = F.coalesce(F.sum(F.size("embedding.buckets")), F.lit(0))
    sizes = (8 * asked.agg(length).first()[0], 8 * held.agg(length).first()[0])
    return with_chunks(_search(asked, held.select("chunk_id", "embedding"), sizes, k, True, tile_bytes), corpus)


def with_chunks(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Hits with the other columns of their chunks. Spark picks the join by its own size threshold, and
    adaptive execution splits the partition of a chunk that very many queries hit."""
    names = [c for c in corpus.columns if c not in ("chunk_id", "embedding")]
    if not names:
        joined = hits
    else:
        joined = hits.join(corpus.select("chunk_id", *names), "chunk_id")
    return joined.select("query_id", "chunk_id", *names, "score", "rank")


def context_of_hits(chars: int = CONTEXT_CHARS) -> Column:
    """Aggregate of one query's hits (at most k rows) to its context text and chunk ids, in rank order."""
    start = F.coalesce(head("content", chars), F.lit(""))
    line = F.concat(F.lit("- "), "chunk_id", F.lit(": "), start)
    ordered = F.sort_array(F.collect_list(F.struct("rank", F.col("chunk_id").alias("id"), line.alias("line"))))
    return F.struct(
        F.array_join(F.transform(ordered, lambda h: h["line"]), "\n").alias("context"),
        F.transform(ordered, lambda h: h["id"]).alias("retrieved_chunks"),
    )


def build_context(hits: DataFrame, chars: int = CONTEXT_CHARS) -> DataFrame:
    """query_id, context, retrieved_chunks."""
    return hits.groupBy("query_id").agg(context_of_hits(chars).alias("c")).select("query_id", "c.*")
