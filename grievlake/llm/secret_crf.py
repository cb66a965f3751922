"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they miss.

Tokens are runs of ASCII letters, digits and non-ASCII bytes, or single other bytes. Each is tagged O, B
(begins a secret) or I (goes on with it) from its shape, the two words before and the one after it, and the
share of digits and equals signs in its text. Weights are trained on the driver by forward-backward on at
most ``max_windows`` windows of tokens, taken from at most ``max_docs`` documents chosen by a hash of the id: around
pattern matches, around the same places with a string of another alphabet in place of the match, so that the field
learns what stands for a secret and not which kind the patterns know, and at drawn places, numbers among them.

Decoding is exact Viterbi over whole texts. A token whose O beats B and I by more than transitions can ever
make up is O on every best path, so texts fall apart there and only the short stretches between are searched.

A null text counts as empty and has no spans. Repeated rows are scanned each. Without any match to learn
from, the field tags nothing and the patterns stand alone. Other columns are kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import LEAD, NONSPACE, WORD, byte_table, letter_values, mix, per_text, run_hashes, slices, text_bytes

# The patterns and least lengths of the three base kinds.
ASSIGN = re.compile(
    rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

KINDS = ("assign", "access", "hex", "crf")
MAX_DOCS, MAX_WINDOWS, WINDOW = 8000, 2500, 24
#: Shortest span, in bytes, that the field may add; a parameter of ``find_secrets`` and ``redact``.
LEAST_FOUND = 12

_BUCKETS = 4096
_SIZES = (257, 32, 8, 16, _BUCKETS, _BUCKETS, _BUCKETS, 4, 12)
_OFFSETS = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])
FEATURES = int(sum(_SIZES))
O, B, I = 0, 1, 2  # noqa: E741


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the assign and access patterns, in bytes."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if b"AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out


def secret_parts(text: bytes) -> list[tuple[int, int]]:
    """What to learn from: the secret itself, without the name it is assigned to."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [m.span() for m in re.finditer(rb"[0-9a-f]{16,}", text)]


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every token."""
    inside = WORD[data]
    single = NONSPACE[data] & ~inside
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = at[1:] > at[:-1]
    before[at[:-1][full]] = False
    after[at[1:][full] - 1] = False
    starts = np.flatnonzero((inside & ~before) | single)
    ends = np.flatnonzero((inside & ~after) | single) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def features(data: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> np.ndarray:
    """One active feature per group for every token: an array (groups, tokens)."""
    lower, upper = byte_table(lambda b: 97 <= b <= 122), byte_table(lambda b: 65 <= b <= 90)
    digit, wide = byte_table(lambda b: 48 <= b <= 57), byte_table(lambda b: b >= 128)
    beyond_hex = byte_table(lambda b: 103 <= b <= 122 or 71 <= b <= 90)

    def inside(table):
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=sums[1:])
        return sums[ends] - sums[starts]

    size, digits = ends - starts, inside(digit)
    change = np.zeros(len(data) + 1, np.int32)
    if len(data):
        kind = digit[data]
        np.cumsum(np.concatenate([[False], kind[1:] != kind[:-1]]), out=change[1:])
    turns = change[ends] - change[starts + 1]
    parts = [(inside(t) > 0).astype(np.int64) for t in (lower, upper, wide, beyond_hex)]
    shape = parts[0] + 2 * parts[1] + 4 * parts[2] + 8 * parts[3] + 16 * (digits > 0)
    length = np.searchsorted([2, 4, 8, 12, 16, 24, 40], size, "right")
    share = np.searchsorted([0.01, 0.25, 0.6], digits / np.maximum(size, 1), "right")
    turning = np.searchsorted([1, 2, 4], turns, "right")
    bucket = (run_hashes(data, starts, ends, letter_values(True)) % np.uint64(_BUCKETS - 1)).astype(np.int64) + 1
    n = len(starts)

    def neighbour(step):
        """Bucket of the word ``step`` tokens away, 0 outside the text."""
        out = np.zeros(n, np.int64)
        if abs(step) < n:
            own, other = (slice(-step, n), slice(0, n + step)) if step < 0 else (slice(0, n - step), slice(step, n))
            out[own] = np.where(text[own] == text[other], bucket[other], 0)
        return out

    glued = np.zeros(n, np.int64)
    if n > 1:
        touch = (ends[:-1] == starts[1:]) & (text[:-1] == text[1:])
        glued[1:] += touch
        glued[:-1] += 2 * touch
    length_of = np.maximum(np.diff(at), 1)
    digit_share = np.searchsorted([0.001, 0.01, 0.05], per_text(digit[data], at) / length_of, "right")
    equals = np.searchsorted([0.0005, 0.005], per_text(data == 61, at) / length_of, "right")
    file = (digit_share * 3 + equals)[text]
    groups = (shape * 8 + length, shape, length, turning * 4 + share, neighbour(-1), neighbour(-2), neighbour(1), glued, file)
    return np.stack([g + o for g, o in zip(groups, _OFFSETS, strict=True)]) if n else np.zeros((len(_SIZES), 0), np.int64)


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # features x 3
    moves: np.ndarray  # 3 x 3, from and to
    first: np.ndarray  # 3

    @property
    def slack(self) -> float:
        """The most that any choice of neighbours can speak for a tag against O."""
        m = self.moves
        ends = np.concatenate([m, self.first[None]])
        return max(
            float((ends[:, s] - ends[:, O]).max() + max(0.0, float((m[s] - m[O]).max()))) for s in (B, I)
        )


def silent() -> Field:
    weights = np.zeros((FEATURES, 3), np.float32)
    weights[:, O] = 1.0
    return Field(weights, np.zeros((3, 3)), np.zeros(3))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def train(rows: np.ndarray, tags: np.ndarray, rounds: int = 100, rate: float = 0.2, decay: float = 1e-4) -> Field:
    """Maximum likelihood by Adam. rows: windows x tokens x groups; tags: windows x tokens, -1 past the end."""
    if not (tags > O).any():
        return silent()
    m, n, groups = rows.shape
    real = tags >= 0
    flat = rows.reshape(-1, groups)
    weights, moves, first = np.zeros((FEATURES, 3)), np.zeros((3, 3)), np.zeros(3)
    gold = np.eye(3)[np.maximum(tags, 0)] * real[..., None]
    gold_moves = np.einsum("mta,mtb->ab", gold[:, :-1], gold[:, 1:])
    state = [np.zeros_like(x) for x in (weights, moves, first) for _ in range(2)]
    for step in range(1, rounds + 1):
        score = weights[flat].sum(1).reshape(m, n, 3)
        ahead, back = np.zeros((m, n, 3)), np.zeros((m, n, 3))
        ahead[:, 0] = score[:, 0] + first
        for t in range(1, n):
            new = _log_sum(ahead[:, t - 1, :, None] + moves, 1) + score[:, t]
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        total = _log_sum(ahead[:, -1], 1)
        expected = np.zeros((3, 3))
        for t in range(n - 2, -1, -1):
            then = (score[:, t + 1] + back[:, t + 1])[:, None, :] + moves
            both = np.exp(ahead[:, t, :, None] + then - total[:, None, None]) * real[:, t + 1, None, None]
            expected += both.sum(0)
            back[:, t] = np.where(real[:, t + 1, None], _log_sum(then, 2), 0.0)
        chance = np.exp(ahead + back - total[:, None, None]) * real[..., None]
        error = (gold - chance).reshape(-1, 3)
        grad = np.stack(
            [np.bincount(flat.ravel(), np.repeat(error[:, s], groups), FEATURES) for s in range(3)], axis=1
        )
        grads = (grad / m - decay * weights, (gold_moves - expected) / m - decay * moves, (gold[:, 0] - chance[:, 0]).sum(0) / m)
        for k, (x, g) in enumerate(zip((weights, moves, first), grads, strict=True)):
            a, b = state[2 * k], state[2 * k + 1]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Field(weights.astype(np.float32), moves, first)


def viterbi(score: np.ndarray, moves: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> list[int]:
    """Best tags of a stretch, given what coming in and going out add."""
    best, came = score[0] + entry, []
    for row in score[1:]:
        options = best[:, None] + moves
        came.append(options.argmax(0))
        best = options.max(0) + row
    tag = int((best + leave).argmax())
    path = [tag]
    for pointers in reversed(came):
        tag = int(pointers[tag])
        path.append(tag)
    return path[::-1]


def decode(field: Field, active: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Tags of all tokens; ``active`` from ``features``."""
    n = active.shape[1]
    score = np.zeros((n, 3), np.float32)
    for group in active:
        score += field.weights[group]
    tags = np.zeros(n, np.int64)
    # an O here cannot be beaten: it may also cost the next tag, hence the slack counts both neighbours
    open_at = np.flatnonzero(score[:, O] - score[:, 1:].max(1) <= field.slack + 1e-3)
    if not len(open_at):
        return tags
    cuts = np.flatnonzero((np.diff(open_at) > 1) | (text[open_at[1:]] != text[open_at[:-1]]))
    first, last = open_at[np.concatenate([[0], cuts + 1])], open_at[np.concatenate([cuts, [len(open_at) - 1]])]
    order = np.argsort(first - last, kind="stable")  # the longest first, so that those still going are the first ones
    first, last = first[order], last[order]
    inner = (first > 0) & (text[first - 1] == text[first])
    after = np.minimum(last + 1, n - 1)
    outer = (last + 1 < n) & (text[after] == text[last])
    best = score[first].astype(float) + np.where(inner[:, None], field.moves[O], field.first)
    size, came = last - first + 1, []
    for step in range(1, int(size[0])):
        going = int(np.searchsorted(-size, -step, "left"))
        options = best[:going, :, None] + field.moves
        came.append(options.argmax(1).astype(np.int8))
        best[:going] = options.max(1) + score[first[:going] + step]
    tag = (best + np.where(outer[:, None], field.moves[:, O], 0.0)).argmax(1)
    for step in range(len(came), 0, -1):
        pointers = came[step - 1]
        going = len(pointers)
        tags[first[:going] + step] = tag[:going]
        tag[:going] = pointers[np.arange(going), tag[:going]]
    tags[first] = tag
    return tags


def found_spans(field: Field, data: np.ndarray, at: np.ndarray, least: int = LEAST_FOUND) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) in bytes of the slice of every secret of ``least`` bytes or more that the field finds."""
    starts, ends, text = tokens(data, at)
    tags = decode(field, features(data, at, starts, ends, text), text)
    hot = np.flatnonzero(tags > O).tolist()
    k = 0
    while k < len(hot):
        first = last = hot[k]
        k += 1
        while k < len(hot) and hot[k] == last + 1 and tags[hot[k]] == I and text[hot[k]] == text[first]:
            last = hot[k]
            k += 1
        if ends[last] - starts[first] >= least:
            yield int(text[first]), int(starts[first]), int(ends[last])


def scan(texts: pa.Array, field: Field | None, least: int = LEAST_FOUND) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of all spans of every text in code points, by start and kind. A find of the field counts
    unless a match of a pattern holds all of it; it may go on beyond one."""
    data, offsets = text_bytes(texts)
    hexes = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 102)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for first, last in slices(offsets):
        at = offsets[first: last + 1] - offsets[first]
        part = data[offsets[first]: offsets[last]]
        points = np.zeros(len(part) + 1, np.int64)
        np.cumsum(LEAD[part], out=points[1:])
        spans: list[list[tuple[int, int, int]]] = [[] for _ in range(last - first)]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hexes[part], [False]]).astype(np.int8)))
        begin, end = edges[::2], edges[1::2]
        # a run over several texts is cut where they meet
        for a, b in zip(begin[end - begin >= LEAST_HEX].tolist(), end[end - begin >= LEAST_HEX].tolist(), strict=True):
            k = int(np.searchsorted(at, a, "right")) - 1
            while a < b:
                stop = min(b, int(at[k + 1]))
                if stop - a >= LEAST_HEX:
                    spans[k].append((2, a, stop))
                a, k = max(a, stop), k + 1
        for k in range(last - first):
            spans[k] += [(kind, a + int(at[k]), b + int(at[k])) for kind, a, b in base_spans(part[at[k]: at[k + 1]].tobytes())]
        if field is not None:
            extra: dict[int, list[tuple[int, int, int]]] = {}
            for k, a, b in found_spans(field, part, at, least):
                if not any(x <= a and b <= y for _, x, y in spans[k]):
                    extra.setdefault(k, []).append((3, a, b))
            for k, more in extra.items():
                spans[k] += more
        for k, own in enumerate(spans):
            zero = points[at[k]]
            out[first + k] = sorted(
                ((kind, int(points[a] - zero), int(points[b] - zero)) for kind, a, b in own), key=lambda s: (s[1], s[0], s[2])
            )
    return out


#: Alphabets and lengths of the strings that stand in for a secret in a second example of its surroundings.
_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
STAND_INS = (
    (_LETTERS.upper() + _DIGITS, (16, 20, 24, 32)), (_LETTERS + _LETTERS.upper() + _DIGITS, (20, 24, 32, 40)),
    (_LETTERS + _LETTERS.upper() + _DIGITS + "+/", (28, 40, 64)), (_LETTERS + _LETTERS.upper() + _DIGITS + "_-", (22, 36, 43)),
    (_LETTERS + _DIGITS, (16, 25, 32)), ("0123456789ABCDEF", (32, 40)),
)
#: Bytes on either side of a match that a second example keeps.
AROUND = 300


#: How often a match is followed by other strings in its place, and what may join the groups of one.
VARIANTS, JOINTS = 2, ("", "", "-", "_", ".")


def stand_in(secret: bytes, number: int = 0) -> bytes:
    """Another string in place of a secret, drawn by a hash of it: one group of an alphabet, or several with a joint."""
    draw = hashlib.shake_128(secret + bytes([number])).digest(200)
    alphabet, sizes = STAND_INS[draw[0] % len(STAND_INS)]
    size, joint = sizes[draw[1] % len(sizes)], JOINTS[draw[2] % len(JOINTS)]
    out = "".join(alphabet[x % len(alphabet)] for x in draw[8:8 + size])
    if joint:
        cuts = sorted({2 + x % (size - 4) for x in draw[3:4 + draw[4] % 4]})
        out = joint.join(out[a:b] for a, b in zip([0, *cuts], [*cuts, size]))
    return out.encode()


def _tagged(part: np.ndarray, secrets: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    at = np.array([0, len(part)])
    starts, ends, text = tokens(part, at)
    tag = np.zeros(len(starts), np.int8)
    for a, b in reversed(secrets):
        own = np.flatnonzero((starts >= a) & (ends <= b))
        tag[own] = I
        tag[own[:1]] = B
    return starts, features(part, at, starts, ends, text).T.astype(np.int32), tag


def examples(part: np.ndarray, secrets: list[tuple[int, int]]) -> Iterator[tuple[bytes, bytes, int, bool]]:
    """(features, tags, draw, whether a match is in it) of windows of one text: around every match, around every match
    with other strings in its place, at a drawn token and at a drawn token of digits that is no match."""
    starts, active, tag = _tagged(part, secrets)
    if not len(starts):
        return
    digit = byte_table(lambda b: 48 <= b <= 57)
    draw = int(mix(np.array([len(part) * 31 + len(starts)], np.uint64))[0])
    plain = np.flatnonzero(digit[part[starts]] & (tag == O))
    middles = [(int(np.searchsorted(starts, a)), True) for a, _ in secrets] + [(draw % len(starts), False)]
    middles += [(int(plain[draw % len(plain)]), False)] if len(plain) else []

    def window(active: np.ndarray, tag: np.ndarray, middle: int, number: int, hit: bool):
        low = max(0, min(middle - WINDOW // 2, len(tag) - WINDOW))
        rows, marks = active[low: low + WINDOW], tag[low: low + WINDOW]
        pad = WINDOW - len(rows)
        drawn = int(mix(np.array([draw % (1 << 32) + number * 7919 + len(part)], np.uint64))[0] >> np.uint64(1))
        return np.pad(rows, ((0, pad), (0, 0))).tobytes(), np.pad(marks, (0, pad), constant_values=-1).tobytes(), drawn, hit

    for number, (middle, hit) in enumerate(middles):
        yield window(active, tag, middle, number, hit)
    for number, (a, b) in enumerate(x for x in secrets for _ in range(VARIANTS)):
        new, low = stand_in(part[a:b].tobytes(), number % VARIANTS), max(0, a - AROUND)
        around = np.concatenate([part[low:a], np.frombuffer(new, np.uint8), part[b: b + AROUND]])
        own = (a - low, a - low + len(new))
        others = [(x - low, y - low) for x, y in secrets if low <= x and y <= a]
        others += [(x - b + own[1], y - b + own[1]) for x, y in secrets if x >= b and y <= b + AROUND]
        starts, active, tag = _tagged(around, sorted([own, *others]))
        yield window(active, tag, int(np.searchsorted(starts, own[0])), len(middles) + number, True)


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of features and tags to learn from."""
    for batch in batches:
        order, rows, tags = [], [], []
        data, offsets = text_bytes(batch.column(0))
        for first, last in slices(offsets):
            for k in range(first, last):
                part = data[offsets[k]: offsets[k + 1]]
                for active, tag, drawn, hit in examples(part, sorted(secret_parts(part.tobytes()))):
                    rows.append(active)
                    tags.append(tag)
                    order.append(drawn // 4 if hit else drawn)  # windows with a match come first
        yield pa.RecordBatch.from_arrays(
            [pa.array(order, pa.int64()), pa.array(rows, pa.binary()), pa.array(tags, pa.binary())],
            names=["drawn", "features", "tags"],
        )


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, max_windows: int = MAX_WINDOWS,
) -> Field:
    """Train the field on a bounded sample of the documents, labelled by the patterns."""
    chosen = (
        docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(id_col).alias("_order"))
        .distinct().orderBy("_order", "_id").limit(max_docs).select("_id")
    )
    # at most max_docs ids: safe to broadcast
    sample = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id"), "left_semi").select(text_col)
    got = (
        sample.mapInArrow(windows, "drawn bigint, features binary, tags binary")
        .orderBy("drawn", "features", "tags").limit(max_windows).collect()
    )
    if not got:
        return silent()
    rows = np.stack([np.frombuffer(r["features"], np.int32).reshape(WINDOW, len(_SIZES)) for r in got])
    tags = np.stack([np.frombuffer(r["tags"], np.int8).astype(np.int64) for r in got])
    # once as they are, once without exact shapes and neighbours, so that general traits carry weight of their own
    return train(np.concatenate([rows, without_details(rows)]), np.concatenate([tags, tags]))


def without_details(rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    out[..., 0] = _SIZES[0] - 1
    for group in (4, 5, 6):
        out[..., group] = _OFFSETS[group]
    return out


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("after", T.IntegerType()),
]))


def find_secrets(text: Column, field: Field | None, least: int = LEAST_FOUND) -> Column:
    """All spans of a text as an array of (kind, start, after), by start, then kind; without a field the base ones.
    ``least`` is the shortest find of the field, in bytes."""
    def run(texts: pa.Array) -> pa.Array:
        spans = scan(texts, field, least)
        at = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)
        every = [x for s in spans for x in s]
        items = pa.StructArray.from_arrays(
            [pa.array([KINDS[k] for k, _, _ in every], pa.string()), pa.array([a for _, a, _ in every], pa.int32()),
             pa.array([b for _, _, b in every], pa.int32())], names=["kind", "start", "after"],
        )
        return pa.ListArray.from_arrays(pa.array(at), items)

    return F.arrow_udf(run, SPANS)(text)


def redact(
    docs: DataFrame, field: Field | None, text_col: str = "text", mask: str = "[SECRET]", least: int = LEAST_FOUND
) -> DataFrame:
    """``docs`` with every span of every text replaced; overlapping spans become one mask."""
    def run(texts: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for k, spans in enumerate(scan(texts, field, least)):
            done, pieces = 0, []
            for _, a, b in spans:
                if a >= done:
                    pieces += [out[k][done:a], mask]
                done = max(done, b)
            if spans:
                out[k] = "".join(pieces) + out[k][done:]
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, F.arrow_udf(run, T.StringType())(F.col(text_col)))
