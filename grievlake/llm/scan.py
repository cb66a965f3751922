"""NumPy scans over whole Arrow batches of texts: runs of bytes, their hashes, equal items of one text.

A batch is worked through in slices of about ``SLICE_BYTES``; a single longer text is a slice of its own,
so memory follows the longest text, not the batch.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C13)
_ODD = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def byte_table(member) -> np.ndarray:
    """256 flags: which bytes belong to a run."""
    return np.array([bool(member(b)) for b in range(256)])


#: Bytes of words split at ASCII white space.
NONSPACE = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
#: Bytes of words made of ASCII letters and digits and of everything outside ASCII.
WORD = byte_table(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
#: Bytes of lines.
LINE = byte_table(lambda b: b != 10)
#: First bytes of code points.
LEAD = byte_table(lambda b: b & 0xC0 != 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_values(fold_case: bool) -> np.ndarray:
    """A 64-bit value per byte; with ``fold_case`` A-Z share those of a-z."""
    code = np.arange(256, dtype=np.uint64)
    if fold_case:
        code[65:91] += np.uint64(32)
    return mix(code * np.uint64(_ODD[0]) + np.uint64(_ODD[1]))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets; a null is an empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0]: at[-1]]
    return raw, at.astype(np.int64) - int(at[0])


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts holding about ``limit`` bytes each, at least one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of member bytes inside one text: start, end, number of the text."""
    inside = member[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash per run, from prefix sums: every byte counts once, whatever the length of a run."""
    n = len(data)
    up = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, _BASE), out=up[1:])
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * up[:n], out=sums[1:])
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    down = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, inverse), out=down[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``width`` consecutive items of one owner, and the position of its first item."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = mix(total + hashes[k: k + n] * np.uint64(_ODD[k % len(_ODD)]))
    at = np.flatnonzero(owner[:n] == owner[width - 1:])
    return total[at], at


def same_in_owner(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every item: is there an equal one of the same owner; is it the first of its kind in sorted order."""
    keys = mix(hashes + owner.astype(np.uint64) * np.uint64(_ODD[2]))
    order = np.argsort(keys)
    ranked = keys[order]
    equal = ranked[1:] == ranked[:-1]
    repeated, first = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    again = np.zeros(len(keys), bool)
    again[1:] |= equal
    first[order] = ~again
    again[:-1] |= equal
    repeated[order] = again
    return repeated, first


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flagged bytes each text has."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for tables that tasks would build again."""
    name = "grievlake_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__
