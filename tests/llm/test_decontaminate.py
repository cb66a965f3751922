from __future__ import annotations

import re

import pytest

from grievlake.llm import decontaminate as d

ITEM = " ".join(f"q{i}" for i in range(20))
ITEMS = [(1, ITEM), (10, " ".join(f"q{i}" for i in range(5, 30))), (2, "short item here"), (3, None), (4, ""), (5, "?!"), (None, "w0 w1 w2"), (2, "short item here")]
DOCS = [
    (1, "Intro. " + ITEM.upper() + " outro words"), (2, "nothing of it"), (3, None), (4, ""), (5, "a Short, item (here) b short item here"),
    (6, " ".join(f"q{i}" for i in range(12))), (7, "x " * 600 + "short item here"), (8, ITEM + " " + ITEM), (8, "same id, other text: w0 w1 w2"),
    (9, "ÄÖ short item hereä"), (None, "short item here"), (11, " ".join(f"v{i}" for i in range(30_000)) + " " + ITEM),
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items):
    w, hit, named = words(text), set(), set()
    for item, t in items:
        v = words(t)
        k = min(len(v), 13)
        grams = {tuple(v[i: i + k]) for i in range(len(v) - k + 1)} if k else set()
        for p in range(len(w) - k + 1):
            if tuple(w[p: p + k]) in grams:
                hit |= set(range(p, p + k))
                if item is not None:
                    named.add(str(item))
    return len(w), hit, sorted(named)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_hits_against_plain_python(spark, broadcast_bytes):
    docs = spark.createDataFrame([(*r, "x") for r in DOCS], "doc_id long, text string, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(
        ((r.doc_id, r.n_words, tuple(k for s in r.spans for k in range(s.first, s.after)), tuple(r["items"]))
         for r in d.find_hits(docs, items, broadcast_bytes=broadcast_bytes).collect()), key=repr,
    )
    want = []
    for i, t in DOCS:
        n, hit, named = plain(t, ITEMS)
        want.append((i, n, tuple(sorted(hit)), tuple(named)))
    assert got == sorted(want, key=repr)


def test_removal_of_documents_and_spans(spark):
    docs = spark.createDataFrame([(*r, "x") for r in DOCS], "doc_id long, text string, source string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = d.remove(docs, items)
    assert left.columns == docs.columns
    clean = [i for i, t in DOCS if not (lambda n, hit, _: hit and 20 * len(hit) >= n)(*plain(t, ITEMS))]
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(map(str, clean))
    cut = {(r.doc_id, r.text) for r in d.remove(docs, items, what="spans").collect()}
    for i, text in ((1, "Intro outro words"), (2, "nothing of it"), (3, None), (4, ""), (5, "a) b"), (10, None)):
        assert (i, text) in cut or i == 10
    for _, text in cut:
        assert not plain(text, ITEMS)[1] or len(words(text)) < 40


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.spans == [] and r["items"] == [] for r in d.find_hits(docs, none).collect())
    assert d.find_hits(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_plan_has_no_python(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = d.find_hits(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_columns_of_any_name_pass_through(spark, rows):
    docs = spark.createDataFrame(
        [(1, "one two", 5, "x", "y"), (2, "quite other words", 6, "z", "w")],
        "doc_id long, text string, spans int, _doc string, n_words string",
    )
    items = spark.createDataFrame([("i", "one two")], "item_id string, text string")
    assert d.remove(docs, items).columns == docs.columns
    assert rows(d.remove(docs, items)) == [(2, "quite other words", 6, "z", "w")]
    assert rows(d.remove(docs, items, what="spans")) == [(1, "", 5, "x", "y"), (2, "quite other words", 6, "z", "w")]


def test_a_very_long_text_with_very_many_spans(spark):
    text = " ".join(f"filler{k} hit" for k in range(40_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([("i", "hit")], "item_id string, text string")
    row = d.find_hits(docs, items).first()
    assert len(row["spans"]) == 40_000 and tuple(row["spans"][1]) == (3, 4) and row["n_words"] == 80_000
    cut = d.remove(docs, items, what="spans").first()["text"]
    assert cut == " ".join(f"filler{k}" for k in range(40_000))
