"""Repair of conversation structure: the cheapest edits that give ``(s?(ua)+)?``, found by an auction.

A conversation is a lattice: a column for every place between its rows, and in each column four states (nothing yet, or
the last role is system, user or assistant). Keep, Rerole, Delete and Insert are arcs of integer cost, and each of them
leads to one node only, so a string of edits is a path. The auction shortest-path algorithm finds the prices: a path
grows from its origin along the cheapest arc while the price of its last node equals the arc's cost plus the price
behind it; where the price is lower it rises to that sum and the path gives the node up. A path that meets a node of
settled price settles all its nodes. Columns are settled from the end backwards in strips, each starting from the
lowest price behind it, so that the work grows with the length of the conversation. Settled prices are the exact
distances to the end: an arc is tight if the prices of its ends differ by its cost, and the first tight arc in ASCII
order, node by node, spells the least of the cheapest edit strings.

Rows get a number in the order of (conversation, turn, role, text) by a range sort, and are written once. Only one
letter a row (role and fault) goes to the task of its conversation, as short as the edit string that the result holds
in one value anyhow; texts are joined to the edits by row number, and hashed row by row in order, never held together.

Nulls in any column count as one space, but a null turn stays null and comes first, and a null conversation is one of
its own. Equal turns are ordered by role and the first ``TIE_CHARS`` of the text, then by its hash, so repeated rows are adjacent. Blank texts
must go, and so must rows that repeat an earlier role and text. Very long texts stay one value of one row. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import stage

WHITE_SPACE = " \t\n\v\f\r"
FAULTS = ("none", "blank", "duplicate", "truncated")
RUN_BITS = 12  # letters are joined in runs of 4,096 rows before they go to their conversation
STRIP = 16
TIE_CHARS = 256
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
_NEXT = (_USER, _USER, _ASSISTANT, _USER)  # what may follow each state, other than an opening system turn
_INITIALS = "sua"
_DELETE, _INSERT, _REROLE, _CUT = 2, 5, 1, 5


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a checksum of conversation and turn draws."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = (
        F.when(draw == 1, F.lit("")).when(draw == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    )
    copies = F.array_repeat(F.lit(0), F.when(draw == 3, 2).otherwise(1))
    return turns.filter(draw != 0).select(
        "conv_id", "turn", F.when(draw == 4, F.lit("user")).otherwise(blank("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def _arcs() -> dict[str, list[list[tuple[str, int, int, int]]]]:
    """Per letter and state: (edit, cost, columns ahead, new state), edits in ASCII order."""
    table = {}
    for code in range(16):
        kind, fault = divmod(code, 4)
        states = []
        for state in range(4):
            after = _NEXT[state]
            out = [("D", _DELETE, 1, state), ("I", _INSERT, 0, after)]
            if FAULTS[fault] not in ("blank", "duplicate"):
                extra = _CUT if FAULTS[fault] == "truncated" else 0
                if kind + 1 == after or (kind + 1 == _SYSTEM and state == _START):
                    out.append(("K", extra, 1, kind + 1))
                out.append(("R", _REROLE + extra, 1, after))
            states.append(out)
        table[chr(65 + code)] = states
    return table


_ARCS = _arcs()
_END = [[("I", _INSERT, 0, _NEXT[s])] + ([("", 0, 1, 0)] if s in (_START, _ASSISTANT) else []) for s in range(4)]


class Lattice:
    """Prices over the nodes (column, state) of one conversation, given as one letter per row."""

    def __init__(self, letters: str):
        self.letters = letters
        self.price = [0] * (4 * len(letters) + 5)
        self.settled = [False] * len(self.price)
        self.settled[4 * len(letters) + 4] = True  # the end
        self.rises = 0
        high = len(letters)
        self._open(high, high + 1, 0)
        while high:
            low = max(0, high - STRIP)
            self._open(low, high, min(self.price[4 * high:4 * high + 4]))
            high = low

    def _open(self, low: int, high: int, floor: int) -> None:
        self.price[4 * low:4 * high] = [floor] * (4 * (high - low))
        for state in range(4):
            self.settle(4 * low + state)

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        column, state = divmod(node, 4)
        kinds = _ARCS[self.letters[column]][state] if column < len(self.letters) else _END[state]
        return [(edit, cost, 4 * (column + ahead) + after) for edit, cost, ahead, after in kinds]

    def settle(self, origin: int) -> None:
        """Run the auction from ``origin`` until its price is its distance to the end."""
        price, settled = self.price, self.settled
        path = [origin]
        while not settled[path[-1]]:
            node = path[-1]
            best, target = min((cost + price[to], to) for _, cost, to in self.arcs(node))
            if price[node] < best:
                price[node] = best
                self.rises += 1
                if len(path) > 1:
                    path.pop()
            else:
                path.append(target)
        for node in path:
            settled[node] = True

    def trace(self) -> str:
        """The least in ASCII order of the cheapest edit strings."""
        node, last, edits = 0, len(self.price) - 1, []
        while node != last:
            for edit, cost, to in self.arcs(node):
                self.settle(to)
                if self.price[node] == cost + self.price[to]:
                    edits.append(edit)
                    node = to
                    break
        return "".join(edits)


@lru_cache(maxsize=20_000)
def cheapest(letters: str) -> tuple[int, str]:
    """(cost, edits) for one conversation."""
    lattice = Lattice(letters)
    return lattice.price[0], lattice.trace()


def lines(letters: str, edits: str) -> list[tuple[int | None, str | None]]:
    """(row, new role) of every turn after the edits; no row for an inserted turn, no role where it is kept."""
    out, row, state = [], 0, _START
    for edit in edits:
        if edit == "D":
            row += 1
        elif edit == "K":
            state = (ord(letters[row]) - 65) // 4 + 1
            out.append((row, None))
            row += 1
        else:
            state = _NEXT[state]
            out.append((row if edit == "R" else None, _ROLES[state]))
            row += edit == "R"
    return out


def illegal_pairs(letters: str) -> int:
    kinds = [(ord(c) - 65) // 4 for c in letters]
    return sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(kinds, kinds[1:]))


_REPAIR = T.StructType([
    T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("illegal", T.LongType()),
    T.StructField("lines", T.ArrayType(T.StructType([
        T.StructField("at", T.LongType()), T.StructField("role", T.StringType()),
    ]))),
])
_REPAIR_ARROW = pa.struct([
    ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()),
    ("lines", pa.list_(pa.struct([("at", pa.int64()), ("role", pa.string())]))),
])


def _repair(runs: pa.Array) -> pa.Array:
    out = []
    for value in runs:
        parts = [(r["at"], r["letters"]) for r in value.as_py()]
        letters = "".join(p[1] for p in parts)
        cost, edits = cheapest(letters) if len(letters) < 1000 else cheapest.__wrapped__(letters)
        numbers = [first + i for first, own in parts for i in range(len(own))]
        # inserted turns have no row: numbers below zero, all different, match none
        placed = [
            {"at": numbers[row] if row is not None else -1 - numbers[0] - i, "role": role}
            for i, (row, role) in enumerate(lines(letters, edits))
        ]
        out.append({"cost": cost, "audit": edits, "illegal": illegal_pairs(letters), "lines": placed})
    return pa.array(out, _REPAIR_ARROW)


def _fault(text: Column, first: Column) -> Column:
    bare = F.rtrim(text, F.lit(WHITE_SPACE))
    return (
        F.when(bare == "", 1).when(first.isNull(), 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    )


def _numbered(turns: DataFrame) -> DataFrame:
    """Rows with ``at``: increasing in the order of their conversations and turns, consecutive within a task's part."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"))
    order = [
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(),
        F.left("text", F.lit(TIE_CHARS)).asc(), F.xxhash64("text").asc(),
    ]
    # equal rows are told apart so that even they can be dealt to several tasks
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    return stage(ordered.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at")), "turns")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; the repaired turns:
    conv_id, line, role, text). ``turns`` has conv_id, turn, role, text."""
    rows = _numbered(turns)
    firsts = rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(F.min("at").alias("at")).select(
        "at", F.col("at").alias("_first")
    )
    initial = F.instr(F.lit(_INITIALS), F.left("role", F.lit(1)))
    kind = F.when((initial > 0) & (F.col("role") != ""), initial - 1).otherwise(3)
    letter = F.char(65 + 4 * kind + _fault(F.col("text"), F.col("_first")))
    coded = rows.join(firsts, "at", "left").select("conv_id", "at", letter.alias("letter"))

    ordered = lambda c: F.array_join(F.transform(F.sort_array(c), lambda r: r["letter"]), "")
    runs = coded.groupBy("conv_id", F.shiftright("at", RUN_BITS).alias("run")).agg(
        F.min("at").alias("at"), ordered(F.collect_list(F.struct("at", "letter"))).alias("letters")
    )
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "letters"))).alias("runs"))
    solved = stage(
        whole.withColumn("r", F.arrow_udf(_repair, _REPAIR)("runs"))
        .select("conv_id", F.array_join(F.col("runs.letters"), "").alias("letters"), "r.*"), "repairs",
    )

    turns_seen = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")
    ).withColumnRenamed("conv_id", "_conv")
    of_kind = lambda fault: F.regexp_count("letters", F.lit(
        "[" + "".join(chr(65 + 4 * k + FAULTS.index(fault)) for k in range(4)) + "]"
    )).cast("long").alias(fault)
    summary = solved.join(turns_seen, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"),
        of_kind("blank"), of_kind("duplicate"), of_kind("truncated"), "illegal", "cost", "audit",
    )
    placed = solved.select("conv_id", F.posexplode("lines").alias("line", "l")).select(
        "conv_id", "line", F.col("l.at").alias("at"), F.col("l.role").alias("new_role")
    )
    texts = rows.select("at", "role", "text")
    repaired = placed.join(texts, "at", "left").select(
        "conv_id", "line", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return summary, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines in order, read one line at a time."""
    id_type = repaired.schema["conv_id"].dataType.simpleString()

    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done, kind = None, None, [], None

        def packed() -> pa.RecordBatch:
            columns = [pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "digest"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("body").to_pylist()):
                if state is not None and conv == at:
                    state.update(b"\n" + line.encode())
                    continue
                if state is not None:
                    done.append((at, state.hexdigest()))
                at, state = conv, hashlib.sha256(line.encode())
            if len(done) >= 1000:
                yield packed()
                done = []
        if state is not None:
            done.append((at, state.hexdigest()))
            yield packed()

    body = repaired.select("conv_id", "line", F.concat_ws(":", "role", "text").alias("body"))
    return body.repartition("conv_id").sortWithinPartitions("conv_id", "line").mapInArrow(
        hash_lines, f"conv_id {id_type}, digest string"
    )
