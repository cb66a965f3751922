"""Short codes for vectors: product codebooks fitted in exact integers, with norm-of-sum bounds.

Every component becomes floor(1024 * x). Vectors are cut into equal parts, and each part is assigned to the nearest
entry of its own codebook in every round, ties to the lower index; then entries move to the floored mean of their
parts. What is kept with a row between rounds is small: per part the assigned entry and, for each group of entries, a
lower bound on the distance to all of the group's other entries with the round it was measured in. All codebooks of
all rounds are kept, so in round t a bound of round T shrinks only by the largest true way of an entry of the group
from round T to t, |C_t - C_T|, which is at most the sum of its single moves and mostly far less. A group is scanned
exactly only where its bound does not exceed the distance to the assigned entry, which is always measured exactly.
Bounds are rounded down and compared with a margin, so the results are those of a full search.

Rows stay where they are: tasks read them in Arrow batches and hand on at most one partial sum per entry; only sums
per entry and codebooks (bounded by the parameters) reach the driver. Each round is written to the shared folder, and
the round before it is deleted then.

Rows without a vector, or with a component that is null or not finite, are dropped. The length of a vector is the
most frequent one among the rest that the parts divide; rows of other lengths, or with a component beyond
2**24 / 1024, have a null code and error. Fewer rows than entries make smaller codebooks. Null ids come last, repeated
ids are told apart by their vectors; an empty table gives an empty result. Other columns are kept only if named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources import storage

PARTS, ENTRIES, ROUNDS, GROUPS = 4, 256, 4, 8
SCALE = 1024
LARGEST = 1 << 24  # of a scaled component: squared distances then fit 64 bits up to 8,191 components a part
_EXACT = float(1 << 53)
_DOWN, _MARGIN = 1 - 2e-7, 1e-9


def scaled(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, as float64 where that holds them and else as int64."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if points.shape[1] * 4 * largest**2 < _EXACT:
        a, b = points.astype(np.float64), entries.astype(np.float64)
        return np.square(a).sum(1)[:, None] + np.square(b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.stack([np.square(points - entry).sum(1) for entry in entries], axis=1)


def _state_type(groups: int) -> np.dtype:
    return np.dtype([("entry", "<u2"), ("bound", "<f4", (groups,)), ("stamp", "u1", (groups,))])


def assign(points: np.ndarray, state: np.ndarray | None, history: list[np.ndarray], groups: int) -> tuple:
    """The new state of one part's rows, their exact squared errors, and how many distances were measured.

    ``history`` has the codebook of every round so far; ``state`` is that after the round before, if there is one.
    """
    now, entries = len(history) - 1, history[-1]
    members = [g for g in np.array_split(np.arange(len(entries)), groups)]
    rows = len(points)
    new = np.zeros(rows, _state_type(groups))
    if state is None:
        best = np.full(rows, np.iinfo(np.int64).max)
        entry = np.full(rows, len(entries))
        low = np.zeros((rows, groups))
        scan, measured = np.ones((rows, groups), bool), 0
    else:
        entry = state["entry"].astype(np.int64)
        best = np.square(points - entries[entry]).sum(1)
        moved = np.zeros((now, groups))
        for round_, old in enumerate(history[:-1]):
            way = np.sqrt(np.square(entries - old).sum(1).astype(np.float64))
            moved[round_] = [way[g].max(initial=0.0) for g in members]
        low = state["bound"].astype(np.float64) - moved[state["stamp"], np.arange(groups)] * (1 + _MARGIN)
        reach = np.sqrt(best.astype(np.float64))
        scan, measured = low <= (reach * (1 + _MARGIN) + _MARGIN)[:, None], rows
    before, held = entry.copy(), best.copy()
    nearest = np.full((rows, groups), np.inf)
    second = np.full((rows, groups), np.inf)
    first = np.full((rows, groups), -1)
    for g, own in enumerate(members):
        seen = np.flatnonzero(scan[:, g])
        if not len(seen) or not len(own):
            continue
        found = distances(points[seen], entries[own])
        measured += found.size
        at = found.argmin(1)
        value, index = found[np.arange(len(seen)), at], own[at]
        nearest[seen, g], first[seen, g] = value, index
        if len(own) > 1:
            second[seen, g] = np.partition(found, 1, axis=1)[:, 1]
        closer = (value < best[seen]) | ((value == best[seen]) & (index < entry[seen]))
        best[seen] = np.where(closer, value, best[seen])
        entry[seen] = np.where(closer, index, entry[seen])
    # a scanned group's bound leaves out the assigned entry; a group that the row has just left gains its old entry
    bound = np.where(first == entry[:, None], second, nearest)
    fresh = np.where(scan, np.sqrt(bound) * _DOWN, 0.0)
    new["bound"] = np.where(scan, fresh, 0.0 if state is None else state["bound"])
    new["stamp"] = np.where(scan, now, 0 if state is None else state["stamp"])
    if state is not None:
        group_of = np.concatenate([np.full(len(g), i) for i, g in enumerate(members)])
        left = np.flatnonzero((before != entry) & ~scan[np.arange(rows), group_of[before]])
        old = group_of[before[left]]
        new["bound"][left, old] = np.minimum(low[left, old], np.sqrt(held[left].astype(np.float64))) * _DOWN
        new["stamp"][left, old] = now
    new["entry"] = entry
    return new, best.astype(np.int64), measured


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _states(column: pa.Array, parts: int, groups: int) -> np.ndarray:
    kind = _state_type(groups)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, parts)


def _assigner(books, parts: int, groups: int, schema: pa.Schema):
    """Batch function: rows with their new state and error. ``books.value`` has the codebooks by round and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch.column("_point"), batch.num_rows)
            width = points.shape[1] // parts
            known = _states(batch.column("_state"), parts, groups) if len(books.value) > 1 else None
            states, error = [], np.zeros(batch.num_rows, np.int64)
            for p in range(parts):
                state, squares, _ = assign(
                    points[:, p * width:(p + 1) * width], None if known is None else known[:, p],
                    [book[p] for book in books.value], groups,
                )
                states.append(state)
                error += squares
            packed = np.stack(states, axis=1)
            size = packed.dtype.itemsize * parts
            flat = packed.tobytes()
            columns = {
                "_state": pa.array([flat[i * size:(i + 1) * size] for i in range(batch.num_rows)], pa.binary()),
                "_entries": pa.array([row.tolist() for row in packed["entry"]], pa.list_(pa.int32())),
                "_error": pa.array(error, pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([
                columns[f.name] if f.name in columns else batch.column(f.name).cast(f.type) for f in schema
            ], schema=schema)

    return run


_SUMS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()),
    T.StructField("count", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType())),
])


def _summer(parts: int, entries: int, schema: pa.Schema):
    """Batch function: one row per part and entry used in this task, with its number of rows and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = counts = None
        for batch in batches:
            if not batch.num_rows:
                continue
            points, chosen = _matrix(batch.column("_point"), batch.num_rows), _matrix(batch.column("_entries"), batch.num_rows)
            width = points.shape[1] // parts
            if sums is None:
                sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
            for p in range(parts):
                np.add.at(sums[p], chosen[:, p], points[:, p * width:(p + 1) * width])
                counts[p] += np.bincount(chosen[:, p], minlength=entries)
        if sums is None:
            return
        part, entry = np.nonzero(counts)
        columns = [part, entry, counts[part, entry], sums[part, entry].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _moved(assigned: DataFrame, book: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks with every used entry at the floored mean of its parts."""
    sums = assigned.select("_point", "_entries").mapInArrow(_summer(len(book), len(book[0]), to_arrow_schema(_SUMS)), _SUMS)
    # sums of all tasks as exact decimals: one row per part, entry and place
    places = sums.select("part", "entry", "count", F.posexplode("sums").alias("place", "sum"))
    totals = places.groupBy("part", "entry", "place").agg(
        F.sum("count").alias("count"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")
    )
    new = [part.copy() for part in book]
    for row in totals.collect():
        new[row["part"]][row["entry"], row["place"]] = int(row["sum"]) // row["count"]
    return new


def digest(book: list[np.ndarray]) -> str:
    numbers = ",".join(str(int(x)) for part in book for x in part.reshape(-1))
    return hashlib.sha256(numbers.encode()).hexdigest()


def compress(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (),
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, the columns of ``keep``, code, error; the final codebooks): each code has two hex digits a part."""
    spark = vectors.sparkSession
    names = [f"_keep{i}" for i in range(len(keep))]
    rows = vectors.filter(_usable(F.col(vector))).select(
        F.col(id).alias("_id"), *[F.col(c).alias(n) for c, n in zip(keep, names)], scaled(F.col(vector)).alias("_point")
    )
    common = (
        rows.groupBy(F.size("_point").alias("length")).agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("length") % parts == 0).orderBy(F.desc("n"), F.desc("length")).first()
    )
    length = common["length"] if common else -1
    fits = (F.size("_point") == length) & F.forall("_point", lambda x: F.abs(x) <= LARGEST)
    out = [F.col("_id").alias(id), *[F.col(n).alias(c) for c, n in zip(keep, names)]]
    code = F.concat(*[F.lpad(F.lower(F.hex(F.get("_entries", F.lit(p)))), 2, "0") for p in range(parts)])
    nothing = rows.filter(~fits).select(*out, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))

    path = storage.new_folder(spark, "vector-points")
    rows.filter(fits).withColumn("_point", F.col("_point").cast("array<int>")).write.parquet(path)
    points = spark.read.parquet(path)
    first = points.orderBy(F.col("_id").asc_nulls_last(), "_point").limit(entries).select("_point").collect()
    width = max(length, 0) // parts
    start = np.array([r["_point"] for r in first], np.int64).reshape(len(first), parts, width)
    history = [[start[:, p] for p in range(parts)]]
    if not first:
        return nothing, history[-1]

    schema = T.StructType([
        *[f for f in points.schema.fields if f.name != "_point"], T.StructField("_point", T.ArrayType(T.IntegerType())),
        T.StructField("_state", T.BinaryType()), T.StructField("_entries", T.ArrayType(T.IntegerType())),
        T.StructField("_error", T.LongType()),
    ])
    current = points
    for _ in range(rounds + 1):
        books = spark.sparkContext.broadcast(history)
        run = _assigner(books, parts, groups, to_arrow_schema(schema))
        read = [c for c in ("_id", *names, "_point", "_state") if c in current.columns]
        new_path = storage.new_folder(spark, "vector-states")
        current.select(*read).mapInArrow(run, schema).write.parquet(new_path)
        current = spark.read.schema(schema).parquet(new_path)
        storage.remove(spark, path)
        path = new_path
        if len(history) <= rounds:
            history = [*history, _moved(current, history[-1])]
    return current.select(*out, code.alias("code"), F.col("_error").alias("error")).unionByName(nothing), history[-1]
