"""Similarity self-join on word 5-grams: Bayesian pruning of MinHash candidates, then exact Jaccard.

1. ``sign``: every text becomes its set of shingles, a digest of that set, 96 MinHash values and 24 band keys
   (four values each; a pair of similarity 0.8 misses all bands once in 300,000 cases).
2. Texts of equal sets are one node, so exact copies are never paired.
3. Nodes that share a band key are candidates. Large buckets are cut into tiles of bounded size. Inside a
   tile MinHash values are compared 16 at a time; a pair is dropped as soon as the posterior probability
   that its similarity reaches the threshold falls below ``tolerance``.
4. Surviving pairs are verified on whole sets. They are grouped by cluster, again in tiles of bounded size,
   so that a set is shipped once per tile and not once per pair. Pairs travel as one list per node.

Words are runs of ASCII letters and digits and of everything outside ASCII, A-Z lower-cased. A text with
fewer than five words is one shingle; a text without words (also a null) is alone in its class and has no
links. Repeated rows count as copies of each other. Rows with a null id take part; their class is the
smallest id in it, null if there is none. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stage
from .components import connected
from .scan import WORD, letter_values, mix, run_hashes, runs, slices, text_bytes, window_hashes

WIDTH, THRESHOLD, TOLERANCE = 5, 0.8, 1e-5
BANDS, ROWS, STEP = 24, 4, 16
HASHES = BANDS * ROWS
#: Nodes of a bucket, and nodes or shingles of a cluster, that one side of a tile may hold on average.
TILE_NODES, TILE_SHINGLES = 512, 500_000


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of the texts: first, last, all shingle hashes in order of the texts, n + 1 offsets."""
    data, offsets = text_bytes(texts)
    values = letter_values(fold_case=True)
    for first, last in slices(offsets):
        at = offsets[first: last + 1] - offsets[first]
        part = data[offsets[first]: offsets[last]]
        starts, ends, owner = runs(part, at, WORD)
        words = run_hashes(part, starts, ends, values)
        shingles, begin = window_hashes(words, owner, width)
        owners = owner[begin]
        n_words = np.bincount(owner, minlength=last - first)
        short = np.flatnonzero((n_words > 0) & (n_words < width))
        if len(short):
            from_word = np.searchsorted(owner, short)
            whole = np.zeros(len(short), np.uint64)
            for k in range(width - 1):
                more = n_words[short] > k
                whole[more] = mix(whole[more] + words[from_word[more] + k] * np.uint64(2 * k + 3))
            shingles, owners = np.concatenate([shingles, whole]), np.concatenate([owners, short])
            order = np.argsort(owners, kind="stable")
            shingles, owners = shingles[order], owners[order]
        yield first, last, shingles, np.searchsorted(owners, np.arange(last - first + 1))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return (draw[:HASHES] | np.uint64(1)).astype(np.uint32), draw[HASHES:].astype(np.uint32)


def signatures(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values (rows: the non-empty sets)."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), HASHES), np.uint32)
    if len(starts):
        points, work = (shingles >> np.uint64(32)).astype(np.uint32), np.empty(len(shingles), np.uint32)
        for k, (a, b) in enumerate(zip(*permutations(), strict=True)):
            np.multiply(points, a, out=work)
            np.add(work, b, out=work)
            out[:, k] = np.minimum.reduceat(work, starts)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(values), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(31) + values[:, r::ROWS].astype(np.uint64))
    return keys.view(np.int64)


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sizes, values, keys = [], [], [], []
        for first, last, shingles, at in shingle_sets(batch.column(1)):
            mins = signatures(shingles, at)
            bands, row = band_keys(mins), 0
            for k in range(last - first):
                own = np.unique(shingles[at[k]: at[k + 1]])
                sizes.append(len(own))
                full = len(own) > 0
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if full else None)
                values.append(mins[row].tobytes() if full else None)
                keys.append(bands[row] if full else None)
                row += full
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
             pa.array(values, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            names=["doc", "shingle_set", "n", "mins", "bands"],
        )


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of texts; rows whose set is not the wanted one (an id used twice) go."""
    for batch in batches:
        wanted, found = batch.column(1).to_pylist(), []
        for first, last, shingles, at in shingle_sets(batch.column(0)):
            for k in range(last - first):
                own = np.unique(shingles[at[k]: at[k + 1]]).tobytes()
                same = hashlib.blake2b(own, digest_size=16).digest() == wanted[first + k]
                found.append(own if same else None)
        out = pa.RecordBatch.from_arrays(
            [*batch.columns[2:], pa.array(found, pa.binary())], names=[*batch.schema.names[2:], "shingles"]
        )
        yield out.filter(out.column("shingles").is_valid())


def fewest_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For n compared values the fewest matches m that keep a pair.

    With a uniform prior the similarity has the posterior Beta(m + 1, n - m + 1), whose tail above the
    threshold is a binomial sum.
    """
    def tail(m: int, n: int) -> float:
        return sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return {n: next(m for m in range(n + 1) if tail(m, n) >= tolerance) for n in range(STEP, HASHES + 1, STEP)}


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def make_screen(threshold: float, tolerance: float):
    """The task function that prunes the pairs of each tile."""
    keep = fewest_matches(threshold, tolerance)

    def pairs_of(side: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
        if cross:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            return np.repeat(left, len(right)), np.tile(right, len(left))
        return np.triu_indices(len(side), 1)

    def survivors(mins, p, q, band):
        """Compare step by step, then leave each pair to the first band it shares."""
        same = np.zeros(len(p), np.int64)
        for n, least in keep.items():
            same += (mins[p, n - STEP: n] == mins[q, n - STEP: n]).sum(1)
            live = same >= least
            if not live.all():
                p, q, band, same = p[live], q[live], band[live], same[live]
        shared = (mins[p] == mins[q]).reshape(-1, BANDS, ROWS).all(2)
        mine = shared.argmax(1) == band
        return p[mine], q[mine]

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = batch.column(3)
            rows, at = tiles.flatten(), tiles.offsets.to_numpy().astype(np.int64)
            at = at - at[0]
            node, side = rows.field(0).to_numpy(), rows.field(1).to_numpy()
            mins = np.frombuffer(text_bytes(rows.field(2))[0], np.uint32).reshape(-1, HASHES)
            band, cross = batch.column(0).to_numpy(), batch.column(1).to_numpy() != batch.column(2).to_numpy()
            left, right, p, q, of, waiting = [], [], [], [], [], 0
            for k in range(len(tiles)):
                a, b = pairs_of(side[at[k]: at[k + 1]], cross[k])
                p.append(a + at[k])
                q.append(b + at[k])
                of.append(np.full(len(a), band[k]))
                waiting += len(a)
                if waiting > 100_000 or k == len(tiles) - 1:
                    a, b = survivors(mins, *map(np.concatenate, (p, q, of)))
                    left.append(a)
                    right.append(b)
                    p, q, of, waiting = [], [], [], 0
            if left:
                yield link_rows(node, np.concatenate(left), np.concatenate(right))

    def link_rows(node, a, b):
        """A row per node with a surviving pair: its local root, and its partners in one list."""
        root = smallest_labels(len(node), a, b)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        members = np.union1d(a, b)
        starts = np.append(np.searchsorted(a, members), len(a))
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(node[b], pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(node[members]), pa.array(node[root[members]]), lists], names=["node", "root", "partners"]
        )

    return screen


def make_verify(threshold: float):
    """The task function that computes exact similarities of the surviving pairs of each tile."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, lists in zip(batch.column(0), batch.column(1), strict=True):
                out = verify_tile(members.values, lists.values)
                if out is not None:
                    yield out

    def verify_tile(members, lists):
        node, first = np.unique(members.field("node").to_numpy(), return_index=True)
        copies = members.field("copies").to_numpy()[first]
        own = [np.frombuffer(members.field("shingles")[int(k)].as_buffer(), np.uint64) for k in first]
        sizes = np.array([len(s) for s in own])
        _, number = np.unique(np.concatenate(own), return_inverse=True)
        at = np.concatenate([[0], np.cumsum(sizes)])
        flag = np.zeros(int(number.max()) + 1, bool)
        left, right, similarity = [], [], []
        partners = lists.field("partners")
        for k, a in enumerate(lists.field("node").to_pylist()):
            a = int(np.searchsorted(node, a))
            b = np.searchsorted(node, partners[k].values.to_numpy())
            mine = number[at[a]: at[a + 1]]
            flag[mine] = True
            for c in b:
                both = int(np.count_nonzero(flag[number[at[c]: at[c + 1]]]))
                value = both / (sizes[a] + sizes[c] - both)
                if value >= threshold:
                    left.append(a)
                    right.append(int(c))
                    similarity.append(value)
            flag[mine] = False
        if not left:
            return None
        a, b = np.array(left + right), np.array(right + left)
        value = np.array(similarity * 2)
        root = smallest_labels(len(node), a, b)
        order = np.argsort(a, kind="stable")
        a, b, value = a[order], b[order], value[order]
        linked, starts = np.unique(a, return_index=True)
        ends = pa.array(np.append(starts, len(a)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(node[linked]), pa.array(node[root[linked]]), pa.array(np.add.reduceat(copies[b], starts)),
             pa.ListArray.from_arrays(ends, pa.array(node[b])), pa.ListArray.from_arrays(ends, pa.array(value))],
            names=["node", "root", "links", "partners", "similarities"],
        )

    return verify


def _tiles(block, blocks):
    """One row per tile that a row of block ``block`` takes part in."""
    other = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    return other.alias("_other"), F.least(block, "_other").alias("i"), F.greatest(block, "_other").alias("j")


def link(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The verified graph: signed documents (``doc``, ``shingle_set``), nodes, and links between nodes.

    ``links`` has rows (node, root, links, partners, similarities); a node can have several.
    """
    plain = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    id_type = dict(plain.dtypes)["doc"]
    signed = stage(
        plain.mapInArrow(sign, f"doc {id_type}, shingle_set binary, n bigint, mins binary, bands array<bigint>"),
        "signed",
    )
    nodes = stage(
        signed.filter("shingle_set is not null").groupBy("shingle_set")
        .agg(F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
             F.first("mins").alias("mins"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    crowded = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = (
        keys.join(crowded, "key").join(nodes.select("node", "mins"), "node")
        .withColumn("blocks", F.ceil(F.col("m") / TILE_NODES).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    )
    other, i, j = _tiles("block", "blocks")
    tiles = (
        members.select("key", "band", "block", "node", "mins", other).select("*", i, j)
        .groupBy("key", "band", "i", "j")
        .agg(F.collect_list(F.struct("node", (F.col("block") != F.col("i")).cast("int").alias("side"), "mins")).alias("t"))
        .select("band", "i", "j", "t")
    )
    kept = stage(
        tiles.mapInArrow(make_screen(threshold, tolerance), "node bigint, root bigint, partners array<bigint>"), "kept"
    )
    clusters = connected(kept, "node", "root")
    sized = clusters.join(nodes.select("node", "n", "copies", "first_doc", "shingle_set"), "node")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / TILE_NODES, F.sum("n") / TILE_SHINGLES)).cast("int")
    placed = stage(
        sized.join(sized.groupBy("component").agg(blocks.alias("blocks")), "component")
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")),
        "placed",
    )
    columns = ("component", "node", "copies", "block", "blocks")
    with_sets = (
        # merged at every size: the candidates grow with the documents, so they are never broadcast
        plain.join(placed.hint("merge"), F.col("doc").eqNullSafe(F.col("first_doc"))).select("text", "shingle_set", *columns)
        .mapInArrow(sets, "component bigint, node bigint, copies bigint, block int, blocks int, shingles binary")
    )
    member = F.struct("node", "copies", "shingles")
    set_rows = with_sets.select("*", other).select(
        "component", i, j, member.alias("member"), F.lit(None).cast("struct<node:bigint,partners:array<bigint>>").alias("pairs"))
    block_of = lambda x: F.pmod(F.xxhash64(x), F.col("blocks")).cast("int")
    listed = F.struct("node", F.when(F.col("blocks") == 1, F.col("partners")).otherwise(
        F.filter("partners", lambda x: block_of(x) == F.col("_other"))).alias("partners"))
    pair_rows = (
        kept.filter(F.size("partners") > 0).join(placed.select("node", "component", "block", "blocks"), "node")
        .select("*", F.explode(F.array_distinct(F.transform("partners", block_of))).alias("_other"))
        .select("component", i, j, listed.alias("pairs"))
        .select("component", "i", "j", F.lit(None).cast("struct<node:bigint,copies:bigint,shingles:binary>").alias("member"), "pairs")
    )
    links = stage(
        set_rows.union(pair_rows).groupBy("component", "i", "j")
        .agg(F.collect_list("member").alias("members"), F.collect_list("pairs").alias("lists"))
        .filter(F.size("lists") > 0).select("members", "lists")
        .mapInArrow(
            make_verify(threshold),
            "node bigint, root bigint, links bigint, partners array<bigint>, similarities array<double>",
        ),
        "links",
    )
    return signed, nodes, links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row per document: id, ``class_id`` (smallest id among all texts it is linked to, directly or through
    others), ``set_id`` (smallest id among texts of the same shingles), ``n_links`` (how many other documents
    are at or above the threshold)."""
    signed, nodes, links = link(docs, id_col, text_col, **options)
    classes = connected(links, "node", "root")
    first = nodes.select("node", "first_doc")
    smallest = classes.join(first, "node").groupBy("component").agg(F.min("first_doc").alias("class_doc"))
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    by_node = (
        nodes.select("node", "shingle_set", "first_doc", "copies")
        .join(classes.join(smallest, "component").join(degree, "node"), "node", "left")
        .select(
            "shingle_set", F.col("first_doc").alias("set_id"),
            F.when(F.col("component").isNull(), F.col("first_doc")).otherwise(F.col("class_doc")).alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    wordless = F.col("shingle_set").isNull()
    return signed.select("doc", "shingle_set").join(by_node, "shingle_set", "left").select(
        F.col("doc").alias(id_col),
        F.when(wordless, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(wordless, F.col("doc")).otherwise(F.col("set_id")).alias("set_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Links between different shingle sets: ``set_id`` and a list of (``set_id``, ``similarity``), both directions."""
    _, nodes, links = link(docs, id_col, text_col, **options)
    name = nodes.select("node", F.col("first_doc").alias("set_id"))
    pairs = links.select("node", F.explode(F.arrays_zip("partners", "similarities")).alias("p"))
    other = name.select(F.col("node").alias("_other"), F.col("set_id").alias("_id"))
    return (
        pairs.select("node", F.col("p.partners").alias("_other"), F.col("p.similarities").alias("similarity"))
        .join(other, "_other").join(name, "node").groupBy("node")
        .agg(F.first("set_id").alias("set_id"),
             F.collect_list(F.struct(F.col("_id").alias("set_id"), "similarity")).alias("links"))
        .select("set_id", "links")
    )


#: What makes a word: see ``scan``.
_WORDED = r"[0-9A-Za-z]|[^\x00-\x7F]"


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without near-duplicates: one row of each class, that of the smallest id, and of rows that share it
    the one of the smallest hash of all columns.

    Classes belong to rows, known by id and hash, so an id that several texts share loses none of them; rows without an
    id come after the others. Rows that are equal in all columns are one row. Texts without words have no duplicates and
    are all kept.
    """
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(*docs.columns).alias("row"))
    keyed = docs.select(F.struct("*").alias("_doc"), key.alias("_key"))
    classes = near_duplicates(keyed.select("_key", F.col("_doc")[text_col].alias("text")), "_key", "text", **options)
    gone = classes.filter(F.col("_key") != F.col("class_id")).select(F.col("_key").alias("_gone")).distinct()
    left = keyed.join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0)))
    worded = F.coalesce(F.col("_doc")[text_col].rlike(_WORDED), F.lit(False))
    first = left.filter(worded).withColumn("_rank", rank).filter("_rank = 1").select("_doc.*")
    return first.unionByName(left.filter(~worded).select("_doc.*"))
