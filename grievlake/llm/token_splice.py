"""Exact token counts of texts of any length, by splicing overlapping chunks.

A text of more than ``chunk_chars`` is encoded in chunks of that size that overlap, each as a whole and with offsets.
Near a cut two encodings can differ, since each of them sees only one side of it. They are spliced at a common boundary
that is proven stable: inside the overlap both have the same tokens at the same places for ``agree`` tokens before the
boundary and as many behind it, so neither the start of one chunk nor the end of the other reaches there any more. The
tokens before it are counted from the left encoding, those behind it from the right one. Where no such boundary is
found the overlap is widened, up to the whole left chunk, and then the chunk itself.

Shorter texts are encoded whole. If the tokenizer provably drops white space before it looks for tokens, their tokens
are those of their runs between ASCII white space one after the other: then every run that a worker has not met lately
is encoded, and its count remembered. (The given tokenizer lower-cases; runs are remembered in lower case only then.)

A null text counts as empty and has no tokens. Repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import worker_cache

#: Longest text that is encoded at once, least overlap of two chunks, and tokens that must agree on either side.
CHUNK_CHARS, OVERLAP_CHARS, AGREE = 65_536, 512, 8
#: Runs whose token counts a worker remembers before it starts afresh, and their longest bytes.
REMEMBERED, REMEMBERED_BYTES = 500_000, 64

Encode = Callable[[str], tuple[np.ndarray, np.ndarray]]
SPACE = " \t\n\v\f\r"
#: A full stop or comma after an ASCII letter is a token of its own, so words are counted without it.
MARKS = b".,"


def stable_boundary(left: tuple, right: tuple, agree: int) -> tuple[int, int] | None:
    """Numbers of a token in both encodings (ids, places) such that the ``agree`` tokens before it and as many from it on
    are the same in both, at the middle of the longest such run; None if there is none."""
    (left_ids, left_at), (right_ids, right_at) = left, right
    best, i, j, run = None, 0, 0, 0
    longest = 2 * agree - 1
    while i < len(left_ids) and j < len(right_ids):
        if left_at[i] == right_at[j] and left_ids[i] == right_ids[j]:
            run += 1
            i, j = i + 1, j + 1
            if run > longest:
                longest, best = run, (i, j)
        else:
            run = 0
            if left_at[i] < right_at[j]:
                i += 1
            elif right_at[j] < left_at[i]:
                j += 1
            else:
                i, j = i + 1, j + 1
    if best is None:
        return None
    back = longest // 2
    first, second = best[0] - back, best[1] - back
    # several tokens can spell one character: a boundary stands before the first of them
    low = best[0] - longest + agree
    while first >= low and left_at[first] == left_at[first - 1]:
        first, second = first - 1, second - 1
    return (first, second) if first >= low else None


def spliced_count(text: str, encode: Encode, chunk: int, overlap: int, agree: int) -> int:
    """Number of tokens of a long text."""
    def piece(first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        ids, at = encode(text[first:last])
        return ids, at + first

    # ``left`` holds the tokens from ``begin`` on of the encoding of text[origin:end]
    n, origin, begin, end = len(text), 0, 0, min(chunk, len(text))
    left, total = piece(begin, end), 0
    while end < n:
        wide = overlap
        while True:
            start = max(begin, end - wide)
            if start == begin:  # nothing in the chunk is stable: take a longer one
                end = min(n, begin + 2 * (end - begin))
                ids, at = piece(origin, end)
                a = int(np.searchsorted(at, begin))
                left = ids[a:], at[a:]
                break
            stop = min(n, start + max(chunk, wide + overlap))
            right = piece(start, stop)
            a = int(np.searchsorted(left[1], start))
            b = int(np.searchsorted(right[1], end))
            found = stable_boundary((left[0][a:], left[1][a:]), (right[0][:b], right[1][:b]), agree)
            if found:
                total += a + found[0]
                left = right[0][found[1]:], right[1][found[1]:]
                origin, begin, end = start, int(left[1][0]), stop
                break
            wide *= 2
    return total + len(left[0])


def drops_white_space(tokenizer_json: str) -> bool:
    """Whether the tokens of a text are those of its runs between white space: the pre-tokenizer looks for a pattern and
    drops the rest, and no find can hold white space, whatever stands beside it."""
    steps = json.loads(tokenizer_json).get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    pattern = (first.get("pattern") or {}).get("Regex")
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert") or not pattern:
        return False
    sides = ["a", "Z", "é", "漢", "1", "!", "'", "'s", "_", "-", ""]
    return not any(
        any(c.isspace() for c in found)
        for a in sides for b in sides for c in SPACE for found in regex.findall(pattern, a + c + b) + regex.findall(pattern, a + c + c + b)
    )


def load(path_or_json: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(path_or_json)


def make_counter(tokenizer_json: str, chunk: int, overlap: int, agree: int = AGREE):
    """The task function: token counts of an Arrow array of texts."""
    by_runs = drops_white_space(tokenizer_json)
    lower = '"Lowercase"' in tokenizer_json

    def count(texts: pa.Array) -> np.ndarray:
        cache = worker_cache()
        key = ("tokenizer", hash(tokenizer_json))
        if key not in cache:
            cache[key] = (load(tokenizer_json), {})
        tokenizer, known = cache[key]

        def encode(text: str) -> tuple[np.ndarray, np.ndarray]:
            coded = tokenizer.encode(text, add_special_tokens=False)
            return np.array(coded.ids, np.int64), np.array([a for a, _ in coded.offsets], np.int64)

        out, waiting, size = np.zeros(len(texts), np.int64), [], 0

        def count_runs(new: set[bytes]):
            bare = {r: r[:-1] if r[-1] in MARKS and r[-2:-1].isalpha() else r for r in new}
            todo = list(set(bare.values()).difference(known))
            coded = tokenizer.encode_batch_fast([r.decode() for r in todo], add_special_tokens=False)
            known.update(zip(todo, (len(e.ids) for e in coded), strict=True))
            fresh.update(todo)
            for run, core in bare.items():
                if run is not core:
                    known[run] = known[core] + mark_tokens[run[-1]]

        def settle():
            for k, runs in waiting:
                out[k] += sum(map(known.__getitem__, runs))
            waiting.clear()
            for run in [r for r in fresh if len(r) > REMEMBERED_BYTES]:
                del known[run]
            fresh.clear()
            if len(known) > REMEMBERED:
                known.clear()

        mark_tokens = {m: len(encode(chr(m))[0]) for m in MARKS}
        fresh: set[bytes] = set()
        for k in range(len(texts)):
            text = texts[k].as_py()
            if not text:
                continue
            if len(text) > chunk:
                out[k] = spliced_count(text, encode, chunk, overlap, agree)
                continue
            if not by_runs:
                out[k] = len(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
                continue
            raw = text.encode()
            runs = (raw.lower() if lower and b"<|" not in raw else raw).split()  # special tokens keep their case
            new = set(runs).difference(known)
            if new:
                count_runs(new)
                fresh.update(new)
            waiting.append((k, runs))
            size += len(text)
            if size > 1 << 20:
                settle()
                size = 0
        settle()
        return out

    return count


def token_count(
    text: Column, tokenizer_path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, agree: int = AGREE,
) -> Column:
    """Number of tokens of a text. The tokenizer file is read here and travels to the tasks."""
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    count = make_counter(tokenizer_json, chunk_chars, overlap_chars, agree)

    def tokens(texts: pa.Array) -> pa.Array:
        return pc.cast(pa.array(count(texts)), pa.int64())

    return F.arrow_udf(tokens, T.LongType())(text)
