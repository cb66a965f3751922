from __future__ import annotations

import math

import numpy as np
import pytest

from grievlake.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, parts, entries, rounds):
    """Full searches in Python integers: ({vec_id: (code, error)}, codebooks)."""
    kept = sorted((i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows
                  if v is not None and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    cut = {i: [v[p * width:(p + 1) * width] for p in range(parts)] for i, v in kept}
    books = [[cut[i][p] for i, _ in kept[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for pieces in cut.values():
                held.setdefault(nearest(pieces[p], books[p])[1], []).append(pieces[p])
            books[p] = [
                [sum(x) // len(held[j]) for x in zip(*held[j])] if j in held else c for j, c in enumerate(books[p])
            ]
    coded = {}
    for i, pieces in cut.items():
        found = [nearest(pieces[p], books[p]) for p in range(parts)]
        coded[i] = ("".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found))
    return coded, books


def clustered(count, length, seed, spread=0.05):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, length))
    return (centres[draw.integers(0, 12, count)] + draw.normal(scale=spread, size=(count, length))).astype(np.float32)


@pytest.mark.parametrize("parts, entries, rounds, groups", [(4, 16, 4, 3), (2, 5, 3, 8), (1, 40, 2, 1)])
def test_equals_full_search(spark, parts, entries, rounds, groups):
    vectors = clustered(150, 8, 4)
    vectors[50:70] = vectors[3]  # ties and repeated vectors
    rows = [(1000 - i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)]
    coded, books = vc.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=parts, entries=entries, rounds=rounds, groups=groups)
    want, want_books = by_hand(rows, parts, entries, rounds)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in coded.collect()} == want
    assert [b.tolist() for b in books] == want_books


def test_bounds_spare_most_distances_and_change_nothing():
    points = np.floor(clustered(2000, 16, 1) * 1024).astype(np.int64)
    state, history, measured = None, [points[:64].copy()], []
    for _ in range(6):
        state, error, count = vc.assign(points, state, history, 8)
        full = vc.distances(points, history[-1])
        assert (state["entry"] == full.argmin(1)).all() and (error == full.min(1)).all()
        measured.append(count)
        # every bound holds for all other entries of its group
        way = [[np.sqrt(np.square(history[-1][g] - old[g]).sum(1).max()) for g in np.array_split(np.arange(64), 8)] for old in history]
        for g, own in enumerate(np.array_split(np.arange(64), 8)):
            others = np.where(state["entry"][:, None] == own[None, :], np.inf, full[:, own]).min(1)
            low = state["bound"][:, g] - np.array([way[t][g] for t in state["stamp"][:, g]])
            assert (low <= np.sqrt(others) + 1e-6).all()
        sums = np.stack([points[state["entry"] == j].sum(0) if (state["entry"] == j).any() else history[-1][j] for j in range(64)])
        counts = np.maximum(np.bincount(state["entry"], minlength=64), 1)[:, None]
        history.append(np.where((counts > 0), sums // counts, history[-1]))
    assert measured[0] == 2000 * 64 and measured[-1] < measured[0] / 3


def test_net_displacement_is_tighter_than_drift():
    """An entry that moves there and back keeps its bounds: nothing but the assigned entry is measured."""
    points = np.array([[0, 0], [0, 4], [100, 0], [100, 4]], np.int64)
    home, away = np.array([[0, 2], [100, 2]], np.int64), np.array([[45, 2], [55, 2]], np.int64)
    state, _, _ = vc.assign(points, None, [home], 2)
    state, _, first = vc.assign(points, state, [home, home], 2)
    assert first == 4
    kept = state.copy()
    _, _, back = vc.assign(points, kept, [home, away, home], 2)
    assert back == 4


def test_large_components_stay_exact():
    points = np.array([[1 << 24, -(1 << 24)], [(1 << 24) - 1, -(1 << 24)]], np.int64)
    wide = np.tile(points, (1, 64))
    assert vc.distances(wide, wide).dtype == np.int64
    assert vc.distances(wide, wide).tolist() == [[0, 64], [64, 0]]


def test_unusable_rows(spark, rows):
    given = [
        (1, [0.5, -0.5, 0.25, 1.0], 1), (2, None, 1), (3, [0.5, None, 0.25, 1.0], 1), (4, [float("nan")] * 4, 1),
        (5, [float("inf"), 0.0, 0.0, 0.0], 1), (6, [0.5] * 3, 1), (7, [], 1), (8, [1e9, 0.0, 0.0, 0.0], 1),
        (None, [0.0, 0.0, 0.0, -0.0001], 2), (1, [0.5, -0.5, 0.25, 1.0], 1),
    ]
    coded, books = vc.compress(spark.createDataFrame(given, SCHEMA))
    got = rows(coded)
    assert [r[0] for r in got if r[1] is None] == [6, 7, 8]
    assert sorted([r for r in got if r[1] is not None], key=repr) == sorted(
        [(1, "00000000", 0), (1, "00000000", 0), (None, "02020202", 0)], key=repr)
    assert [b.tolist() for b in books] == [[[512], [512], [0]], [[-512], [-512], [0]], [[256], [256], [0]], [[1024], [1024], [-1]]]


def test_empty_table_and_kept_columns(spark):
    empty, books = vc.compress(spark.createDataFrame([], SCHEMA), keep=("label",))
    assert empty.collect() == [] and empty.columns == ["vec_id", "label", "code", "error"]
    assert vc.digest(books) == __import__("hashlib").sha256(b"").hexdigest()
    one, _ = vc.compress(
        spark.createDataFrame([(1, [1.0] * 4, 9, "x")], "vec_id long, embedding array<float>, _state int, _point string"),
        keep=("_state", "_point"),
    )
    assert [tuple(r) for r in one.collect()] == [(1, 9, "x", "00000000", 0)]
