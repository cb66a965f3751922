from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from grievlake.llm import jaccard_join
from grievlake.llm.components import connected

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_force(rows, threshold=0.8):
    """Links per row and smallest id of each component, by an inverted index over all shingles."""
    sets = [shingles(t) for _, t in rows]
    where, links, parent = defaultdict(list), Counter(), list(range(len(rows)))
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, s in enumerate(sets):
        shared = Counter(j for g in s for j in where[g] if j != k)
        for j, n in shared.items():
            if n / (len(s) + len(sets[j]) - n) >= threshold:
                links[k] += 1
                parent[max(find(k), find(j))] = min(find(k), find(j))
    ids = [i for i, _ in rows]
    classes = defaultdict(list)
    for k in range(len(rows)):
        classes[find(k)].append(ids[k])
    low = lambda some: min((i for i in some if i is not None), default=None)
    return sorted(((ids[k], low(classes[find(k)]), links[k]) for k in range(len(rows))), key=repr)


def near_copies(n, words=60, edits=2, seed=1):
    draw = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for k in draw.choice(words, edits, replace=False):
            own[k] = f"x{draw.integers(1_000_000)}"
        out.append(" ".join(own))
    return out


def result(spark, rows):
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, text string, node string, component int")
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(df).collect()), key=repr)


def test_against_brute_force_with_odd_rows(spark):
    texts = near_copies(40, edits=1) + near_copies(25, words=200, edits=8, seed=3)
    texts += [None, "", "  ...  ", "one two", "One, two!", "one two three", "ä ö ü ß é ê", texts[0], texts[0].upper()]
    texts += ["long " + " ".join(f"v{i}" for i in range(30_000))] * 2
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    rows += [(0, rows[0][1]), (3, "another text under a used number of words"), (None, texts[2]), (None, "alone and without an id")]
    assert result(spark, rows) == brute_force(rows)


def test_large_group_is_tiled(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE_NODES", 16)
    rows = list(enumerate(near_copies(120, edits=1)))
    assert result(spark, rows) == brute_force(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_pairs_and_keep_one(spark):
    texts = near_copies(6, edits=1)
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)] + [(9, "quite another text of some words", "s"), (9, "quite another text of some words", "s")], "doc_id long, text string, source string")
    pairs = {r.set_id: {x.set_id: x.similarity for x in r.links} for r in jaccard_join.similar_pairs(df).collect()}
    for a, others in pairs.items():
        for b, value in others.items():
            x, y = shingles(texts[a]), shingles(texts[b])
            assert value == pytest.approx(len(x & y) / len(x | y)) and pairs[b][a] == value
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    linked = {r[0] for r in brute_force(list(enumerate(texts))) if r[0] != r[1]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*range(6), 9} - linked)


def one_of_each_class(rows):
    """Rows that stay, from classes found by comparing all rows: the least (no id, id, place in ``order``) of each."""
    distinct = list(dict.fromkeys(rows))
    classes = {k: c for k, c, _ in brute_force([(k, t) for k, (_, t) in enumerate(distinct)])}
    members = {}
    for k, c in classes.items():
        members.setdefault(c, []).append(distinct[k])
    kept = {}
    for c, own in members.items():
        kept[c] = [r for r in rows if r in own] if not shingles(own[0][1] or "") else own
    return kept


@pytest.mark.parametrize("rows", [
    [(1, "a"), (1, "b"), (2, "a x"), (3, "b y")],
    [(5, "a"), (7, "a"), (7, "g")],
    [(None, "same words"), (None, "same words"), (None, "other words"), (4, "same words"), (4, None), (4, None), (6, "..."), (6, "...")],
])
def test_classes_belong_to_rows_not_to_ids(spark, rows):
    long = lambda t: t and f"{t} " * 2 if t in ("a", "b", "g") else t
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    text = {"a": base, "a x": base + "x", "b": base.upper()[::-1], "b y": base.upper()[::-1] + " y"}
    rows = [(i, text.get(t, long(t))) for i, t in rows]
    got = sorted((tuple(r) for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = one_of_each_class(rows)
    left = list(got)
    for own in want.values():
        if not shingles(own[0][1] or ""):
            for r in own:
                left.remove(r)
            continue
        stay = [r for r in left if r in own]
        assert len(stay) == 1 and (stay[0][0] is None, stay[0][0] or 0) == min((i is None, i or 0) for i, _ in own)
        left.remove(stay[0])
    assert not left


def test_reused_and_missing_ids_lose_no_class(spark):
    import random

    draw = random.Random(9)
    texts = near_copies(25, edits=1) + near_copies(25, words=60, edits=40, seed=5) + ["", None, "!!"]
    rows = [(draw.choice([None, *range(8)]), draw.choice(texts)) for _ in range(150)]
    got = [tuple(r) for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = one_of_each_class(rows)
    worded = [own for own in want.values() if shingles(own[0][1] or "")]
    assert all(sum(r in own for r in got) == 1 for own in worded)
    assert len(got) == len(worded) + sum(not shingles(t or "") for _, t in rows)


def test_pruning_rarely_loses_a_pair_at_the_threshold():
    least = jaccard_join.fewest_matches(0.8, 1e-5)
    draw = np.random.default_rng(0)
    matches = draw.random((20_000, jaccard_join.HASHES)) < 0.8
    seen = np.cumsum(matches, 1)
    lost = np.zeros(len(seen), bool)
    for n, m in least.items():
        lost |= seen[:, n - 1] < m
    assert lost.mean() < 1e-3 and least[96] > 50


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (200, 200)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 70: 50, 100: 50}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(spark, rows) == brute_force(rows)
