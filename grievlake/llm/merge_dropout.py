"""SentencePiece merges with seeded dropout: varied segmentations that decode to the same text.

Encoding follows the model's own rule: the adjacent pair whose joined piece has the best score is merged
first, the leftmost of equals. Each candidate (a pair of neighbours with its place in the word) is met once
on that agenda; a hash keyed by seed, text, the word's number in the text, word and place skips it with
probability ``dropout``, so that every occurrence of a word has a draw of its own. At ``dropout=0`` the pieces are
those of the library.

No piece holds a space after another character, nor a line feed, so merges never leave a word with the
spaces before it; words are therefore encoded apart. Each worker remembers a word's pieces without dropout and
the candidates met on the way to them: an occurrence that skips none of these has these pieces, any other one goes
through the agenda by itself. Characters that the
model does not know become byte pieces. A literal U+2581 does too, as the model could not tell it from a space.

``decode`` is exact for every text. A null text counts as empty and has no pieces. Repeated rows with equal
text get equal pieces; other columns are kept.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import letter_values, mix, run_hashes, text_bytes, worker_cache

DROPOUT, SEED = 0.1, 17
#: Longer words take the heap, shorter ones are merged side by side.
SHORT_WORD = 48
REMEMBERED = 600_000
#: Symbols of words merged side by side at a time.
SIDE_SYMBOLS = 1 << 15
#: Characters of text worked on at a time.
SLICE_CHARS = 1 << 19

_NONE = np.int64(1) << np.int64(62)
WORDS = re.compile(r" *[^ \n]+| +|\n")


@dataclass(frozen=True)
class Model:
    """The tables of a merge model, as arrays that travel to the tasks."""

    char_ids: dict[int, int]
    byte_ids: tuple[int, ...]
    pair_keys: np.ndarray
    pair_ids: np.ndarray
    order: np.ndarray  # rank of each piece on the agenda
    pieces: tuple[bytes, ...]
    dummy_prefix: bool

    @property
    def size(self) -> int:
        return len(self.pieces)


def load_model(path: str) -> Model:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    text = [model.id_to_piece(i) for i in range(n)]
    plain = {t: i for i, t in enumerate(text) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    pairs = {}
    for piece, i in plain.items():
        for k in range(1, len(piece)):
            left, right = plain.get(piece[:k]), plain.get(piece[k:])
            if left is not None and right is not None:
                pairs[left * n + right] = i
    if any("\n" in p or "▁" in p.lstrip("▁") for p in plain):
        raise ValueError("a piece crosses words: this model needs another way of cutting texts")
    keys = np.array(sorted(pairs), np.int64)
    scores = np.array([model.get_score(i) for i in range(n)])
    out = [p.replace("▁", " ").encode() for p in text]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    for b, i in enumerate(byte_ids):
        out[i] = bytes([b])
    chars = {ord(p): i for p, i in plain.items() if len(p) == 1 and p != "▁"} | {32: plain["▁"]}
    # an empty text would not show it
    prefix = model.encode("a", out_type=str)[0].startswith("▁")
    order = np.empty(n, np.int64)
    order[np.argsort(-scores, kind="stable")] = np.arange(n)
    return Model(chars, tuple(byte_ids), keys, np.array([pairs[k] for k in keys], np.int64), order, tuple(out), prefix)


def candidate(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The place of a candidate in its word as one number."""
    return (start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)


class Agenda:
    """Merges of many words at once, for one model, seed and dropout."""

    def __init__(self, model: Model, dropout: float, seed: int):
        self.model, self.limit = model, np.uint64(min(int(dropout * 2**64), 2**64 - 1))
        self.drops = dropout > 0
        self.seed = mix(np.array([seed], np.uint64) + np.uint64(0x9E3779B97F4A7C15))[0]
        self.by_char = np.full(0x110000, -1, np.int32)
        self.by_char[list(model.char_ids)] = list(model.char_ids.values())
        unknown = np.flatnonzero(self.by_char[:128] < 0)
        self.by_char[unknown] = np.array(model.byte_ids, np.int32)[unknown]

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbours make, -1 for none."""
        keys = left * self.model.size + right
        at = np.minimum(np.searchsorted(self.model.pair_keys, keys), len(self.model.pair_keys) - 1)
        return np.where(self.model.pair_keys[at] == keys, self.model.pair_ids[at], -1)

    def skipped(self, word: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.skips(word, candidate(start, middle, end))

    def skips(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        return mix(mix(word + place) ^ self.seed) < self.limit

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of all words, and how many each has."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.by_char[points].astype(np.int64)
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            owner = np.repeat(np.arange(len(words)), sizes)
            spelled = [chr(points[k]).encode("utf-8", "surrogatepass") for k in odd]
            extra = np.array([len(s) for s in spelled])
            repeat = np.ones(len(ids), np.int64)
            repeat[odd] = extra
            sizes = sizes + np.bincount(owner[odd], extra - 1, len(words)).astype(np.int64)
            spread = np.repeat(ids, repeat)
            spread[spread < 0] = np.array(self.model.byte_ids, np.int64)[np.frombuffer(b"".join(spelled), np.uint8)]
            ids = spread
        return ids, sizes

    def encode(self, words: list[str], draws: list[int]) -> list[bytes]:
        """Piece ids of every word as little-endian 32-bit numbers."""
        ids, sizes = self.symbols(words)
        flat, counts = self.merge(ids, sizes, drawn(word_hashes(words), np.array(draws, np.uint64)))
        raw, stops = flat.astype("<i4").tobytes(), np.cumsum(counts) * 4
        return [raw[a:b] for a, b in zip((stops - counts * 4).tolist(), stops.tolist(), strict=True)]

    def merge(self, ids: np.ndarray, sizes: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all words one after the other, and how many each has, from their symbols."""
        short, at = sizes <= SHORT_WORD, np.concatenate([[0], np.cumsum(sizes)])
        parts, counts = [np.zeros(0, np.int64)], np.zeros(len(sizes), np.int64)
        inside, chosen = ids[np.repeat(short, sizes)], np.flatnonzero(short & (sizes > 0))
        ends = np.cumsum(sizes[chosen])
        first = begin = 0
        while first < len(chosen):
            last = max(first + 1, int(np.searchsorted(ends, begin + SIDE_SYMBOLS, "right")))
            some = chosen[first:last]
            flat, counts[some] = self.side_by_side(inside[begin: ends[last - 1]], sizes[some], names[some])[:2]
            parts.append(flat)
            first, begin = last, int(ends[last - 1])
        flat, long = np.concatenate(parts), np.flatnonzero(~short)
        if not len(long):
            return flat, counts
        coded = [np.frombuffer(self.by_heap(ids[at[k]: at[k + 1]].tolist(), names[k]), "<i4") for k in long]
        counts[long] = [len(c) for c in coded]
        out, mine = np.empty(int(counts.sum()), np.int64), np.repeat(short, counts)
        out[mine], out[~mine] = flat, np.concatenate(coded)
        return out, counts

    def side_by_side(
        self, ids: np.ndarray, sizes: np.ndarray, names: np.ndarray | None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One merge per word and turn, for all words that still have one. Without ``names`` none is skipped, and the
        candidates met come third, with the numbers of their words."""
        n, total = len(ids), len(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        owner = np.repeat(np.arange(total), sizes)
        place = np.arange(n) - starts[owner]
        ids = np.append(ids, 0)
        owner_end = np.append(owner, -1)
        alive = np.ones(n + 1, bool)
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        stop = np.append(place + 1, 0)  # where the symbol ends in its word
        best = np.full(n, _NONE)
        met, whose = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

        def propose(left: np.ndarray):
            right = after[left]
            ok = (right < n) & (owner_end[np.minimum(right, n)] == owner[left])
            best[left[~ok]] = _NONE
            left, right = left[ok], right[ok]
            piece = self.merged(ids[left], ids[right])
            found = piece >= 0
            if names is None:
                met.append(candidate(place[left], place[right], stop[right])[found])
                whose.append(owner[left][found])
            elif self.drops:
                found &= ~self.skipped(names[owner[left]], place[left], place[right], stop[right])
            best[left] = np.where(found, (self.model.order[piece] << 6) | place[left], _NONE)

        propose(np.arange(n))
        ranked = np.argsort(self.model.order)
        live = np.arange(total)
        flat, cuts = np.arange(n), starts
        while len(live):
            low = np.minimum.reduceat(best[flat], cuts)
            going = low < _NONE
            if not going.all():
                keep = np.repeat(going, sizes[live])
                flat, live, low = flat[keep], live[going], low[going]
                cuts = np.concatenate([[0], np.cumsum(sizes[live])[:-1]]) if len(live) else cuts
            if not len(live):
                break
            left = starts[live] + (low & 63)
            right = after[left]
            ids[left] = ranked[low >> 6]
            stop[left] = stop[right]
            alive[right] = False
            best[right] = _NONE
            after[left] = after[right]
            beyond = after[right]
            before[beyond[beyond < n]] = left[beyond < n]
            previous = before[left]
            mine = (previous >= 0) & (owner[np.maximum(previous, 0)] == live)
            propose(np.concatenate([left, previous[mine]]))
        alive = alive[:n]
        return ids[:n][alive], np.bincount(owner[alive], minlength=total), np.concatenate(met), np.concatenate(whose)

    def by_heap(self, ids: list[int], name: np.uint64) -> bytes:
        """The agenda as a heap, for one long word."""
        n = len(ids)
        after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive, heap = [True] * n, []

        def propose(left: np.ndarray):
            left = left[[after[k] < n for k in left]]
            if not len(left):
                return
            right = np.array([after[k] for k in left])
            piece = self.merged(np.array([ids[k] for k in left]), np.array([ids[k] for k in right]))
            found = piece >= 0
            if self.drops:
                found &= ~self.skipped(np.full(len(left), name), left, right, np.array([stop[k] for k in right]))
            for k, r, p in zip(left[found].tolist(), right[found].tolist(), piece[found].tolist(), strict=True):
                heapq.heappush(heap, (int(self.model.order[p]), k, r, stop[r], p))

        propose(np.arange(n))
        while heap:
            _, left, right, end, piece = heapq.heappop(heap)
            if not (alive[left] and alive[right] and after[left] == right and stop[right] == end and stop[left] == right):
                continue
            ids[left], stop[left], alive[right] = piece, end, False
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            propose(np.array([left] if before[left] < 0 else [left, before[left]]))
        return np.array([i for i, a in zip(ids, alive, strict=True) if a], "<i4").tobytes()


def word_hashes(words: list[str]) -> np.ndarray:
    data = "".join(words).encode("utf-8", "surrogatepass")
    ends = np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in words])
    return run_hashes(np.frombuffer(data, np.uint8), np.concatenate([[0], ends[:-1]]), ends, letter_values(False))


def drawn(names: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """What the skips of one occurrence of a word are keyed by."""
    return mix(names + draws * np.uint64(0xA0761D6478BD642F))


class Pool:
    """Stretches of one growing array."""

    def __init__(self, kind: type):
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.data, self.used = np.zeros(1 << 16, kind), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.start = np.append(self.start, self.used + np.cumsum(sizes) - sizes)
        self.size = np.append(self.size, sizes)
        if self.used + len(flat) > len(self.data):
            grown = np.zeros(max(2 * len(self.data), self.used + len(flat)), self.data.dtype)
            grown[: self.used] = self.data[: self.used]
            self.data = grown
        self.data[self.used: self.used + len(flat)] = flat
        self.used += len(flat)

    def take(self, numbers: np.ndarray) -> np.ndarray:
        return gather(self.data, self.start[numbers], self.size[numbers])


class Known(dict):
    """Numbers of the words met so far, up to ``most`` after a slice; of each word its hash, symbols, pieces without
    dropout and candidates on the way to these. Words that take the heap have no pieces here if candidates can be skipped."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.words = most, []
        self.names = np.zeros(0, np.uint64)
        self.symbols, self.pieces, self.candidates = Pool(np.int32), Pool(np.int32), Pool(np.uint64)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        return number

    def fill(self, agenda: Agenda) -> None:
        """Take up the words that have no pieces yet."""
        while len(self.names) < len(self.words):
            words = self.words[len(self.names): len(self.names) + SIDE_SYMBOLS // 8]
            ids, sizes = agenda.symbols(words)
            self.names = np.append(self.names, word_hashes(words))
            self.symbols.add(ids, sizes)
            if not agenda.drops:
                self.pieces.add(*agenda.merge(ids, sizes, self.names[-len(words):]))
                continue
            short = sizes <= SHORT_WORD
            pieces, counts = np.zeros(0, np.int64), np.zeros((2, len(words)), np.int64)
            met = np.zeros(0, np.uint64)
            if short.any():
                pieces, counts[0, short], met, whose = agenda.side_by_side(ids[np.repeat(short, sizes)], sizes[short], None)
                met = met[np.argsort(whose, kind="stable")]
                counts[1, short] = np.bincount(whose, minlength=int(short.sum()))
            self.pieces.add(pieces, counts[0])
            self.candidates.add(met, counts[1])

    def encode(self, numbers: np.ndarray, draws: np.ndarray, agenda: Agenda) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the words with these numbers and draws, and how many each has."""
        self.fill(agenda)
        sizes = self.pieces.size[numbers]
        if not agenda.drops or not len(numbers):
            return self.pieces.take(numbers), sizes
        names, met = drawn(self.names[numbers], draws), self.candidates.size[numbers]
        skipped = agenda.skips(np.repeat(names, met), self.candidates.take(numbers))
        sums = np.concatenate([[0], np.cumsum(skipped)])
        ends = np.cumsum(met)
        own = (sums[ends] > sums[ends - met]) | (self.symbols.size[numbers] > SHORT_WORD)
        other = numbers[own]
        flat, counts = agenda.merge(self.symbols.take(other).astype(np.int64), self.symbols.size[other], names[own])
        sizes[own] = counts
        out, mine = np.empty(int(sizes.sum()), np.int32), np.repeat(own, sizes)
        out[mine], out[~mine] = flat, self.pieces.take(numbers[~own])
        return out, sizes


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of a pool one after the other."""
    before = np.cumsum(size) - size
    total = int(size.sum())
    return pool[np.repeat(start - before, size) + np.arange(total)]


def encode_texts(texts: list[str], agenda: Agenda, known: Known) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of the texts: all piece ids in order, and how many each text has."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (size == 0 or size + len(texts[last]) <= SLICE_CHARS):
            size += len(texts[last]) + 1
            last += 1
        words = [WORDS.findall(" " + t if agenda.model.dummy_prefix and t else t) for t in texts[first:last]]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        numbers = np.array(list(map(known.__getitem__, chain.from_iterable(words))), np.int64)
        draws = np.zeros(len(numbers), np.uint64)
        if agenda.drops:
            data, at = text_bytes(pa.array(texts[first:last], pa.large_string()))
            own = run_hashes(data, at[:-1], at[1:], letter_values(False))
            place = np.arange(len(numbers)) - np.repeat(np.cumsum(counts) - counts, counts)
            draws = mix(np.repeat(mix(own + agenda.seed), counts) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        ids, sizes = known.encode(numbers, draws, agenda)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        yield ids, np.diff(ends, prepend=0)
        if len(known.words) > known.most:
            known.clear()
            known.__init__(known.most)
        first = last


def decode_ids(ids: list[int], pieces: tuple[bytes, ...], dummy_prefix: bool) -> bytes:
    raw = b"".join(map(pieces.__getitem__, ids))
    return raw[1:] if dummy_prefix and raw else raw


class Speller:
    """Decodes many texts at once."""

    def __init__(self, model: Model):
        self.bytes = np.frombuffer(b"".join(model.pieces), np.uint8)
        self.size = np.array([len(p) for p in model.pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.prefix = model.dummy_prefix

    def exact(self, ids: np.ndarray, counts: np.ndarray, texts: list[str]) -> list[bool]:
        """Whether the pieces of each text spell it."""
        spelled = gather(self.bytes, self.start[ids], self.size[ids]).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])[np.cumsum(counts)].tolist()
        out, begin = [], 0
        for text, end in zip(texts, ends, strict=True):
            out.append(spelled[begin + (self.prefix and end > begin): end] == text.encode("utf-8", "surrogatepass"))
            begin = end
        return out


ENCODED = T.StructType([
    T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()),
    T.StructField("lossless", T.BooleanType()),
])


def encode(
    docs: DataFrame, model_path: str, text_col: str = "text", dropout: float = DROPOUT, seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``pieces`` (ids), ``n_pieces`` and ``lossless``: whether the pieces decode to the text. Columns of
    these names that ``docs`` has already give way to them, as ``withColumn`` would have it."""
    model = load_model(model_path)
    key = ("pieces", model_path, dropout, seed)

    def run(texts: pa.Array) -> pa.Array:
        cache = worker_cache()
        if key not in cache:
            cache[key] = (Agenda(model, dropout, seed), Known(), Speller(model))
        agenda, known, speller = cache[key]
        given = [t or "" for t in texts.to_pylist()]
        parts, sizes, exact = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], []
        for ids, counts in encode_texts(given, agenda, known):
            exact += speller.exact(ids, counts, given[len(exact): len(exact) + len(counts)])
            parts.append(ids)
            sizes.append(counts)
        sizes = np.concatenate(sizes)
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts), pa.int32()))
        return pa.StructArray.from_arrays([lists, pa.array(sizes), pa.array(exact, pa.bool_())], names=["pieces", "n_pieces", "lossless"])

    coded = F.arrow_udf(run, ENCODED)(F.col(text_col))
    names = ENCODED.fieldNames()
    both = docs.select(F.struct("*").alias("doc"), coded.alias("coded"))
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c not in names]
    return both.select(*kept, *[F.col("coded")[f].alias(f) for f in names])


def decode(encoded: DataFrame, model_path: str, pieces_col: str = "pieces") -> DataFrame:
    """``encoded`` with ``decoded``, the text that the pieces spell."""
    model = load_model(model_path)
    table, prefix = model.pieces, model.dummy_prefix

    def run(lists: pa.Array) -> pa.Array:
        return pa.array([decode_ids(x or [], table, prefix).decode("utf-8", "replace") for x in lists.to_pylist()])

    return encoded.withColumn("decoded", F.arrow_udf(run, T.StringType())(F.col(pieces_col)))
