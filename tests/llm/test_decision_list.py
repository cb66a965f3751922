from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from grievlake.llm import decision_list, scan
from grievlake.llm.decision_list import Condition

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t ", "a", "a b", "a b c a b c", "x\nx\n\nx y\nx y\n  \n  ", "é # $ %\n |<>&*", "A b. A b. A b. A b!",
    "a a a a", "one two three four one two", "\r\n".join(["line"] * 4), "w " * 30_000, "漢字 漢字　漢字",
]


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i: i + 3])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    seen, later = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            later += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), later, len(covered), len(set(w))


def test_counts_against_plain_python(monkeypatch):
    for limit in (7, 1 << 20):
        monkeypatch.setattr(decision_list, "slices", lambda o, limit=limit: scan.slices(o, limit))
        got = decision_list.count_texts(pa.array(TEXTS, pa.string()))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_unique_words")
        for k, text in enumerate(TEXTS):
            assert tuple(got[c][k] for c in names) == plain_counts(text), text


def test_counts_of_a_sliced_array():
    whole = decision_list.count_texts(pa.array(TEXTS[3:9], pa.string()))
    part = decision_list.count_texts(pa.array(TEXTS, pa.string()).slice(3, 6))
    assert all((whole[c] == part[c]).all() for c in whole)


def made_counts(n=900, seed=2):
    draw = np.random.default_rng(seed)
    counts = {c: np.full(n, 100) for c in decision_list.COUNTS}
    counts["n_symbols"] = draw.integers(0, 100, n)
    counts["n_unique_words"] = draw.integers(10, 101, n)
    bad = (counts["n_symbols"] > 60) | ((counts["n_unique_words"] < 40) & (counts["n_symbols"] > 20))
    return counts, bad, np.arange(n) % 3 == 0


def test_covering_finds_planted_rules():
    counts, bad, held = made_counts()
    rules = decision_list.fit_rules(counts, bad, held)
    values = decision_list.ratio_values(counts)
    said = np.any([decision_list.covers(r, values) for r in rules], axis=0)
    assert 1 <= len(rules) <= 8 and (said == bad).mean() > 0.97


def test_one_class_gives_no_rules():
    counts, bad, held = made_counts()
    assert decision_list.fit_rules(counts, np.zeros_like(bad), held) == []


def test_first_rule_that_holds_wins(spark):
    rules = [(Condition("symbols_per_word", True, 1.0), Condition("chars_per_word", False, 3.0)), (Condition("symbols_per_word", True, 0.5),)]
    df = spark.createDataFrame([(1, "# # # #"), (2, "abcdefg# # abcdef abcdef"), (3, "plain words only"), (4, None)], "doc_id int, text string")
    got = {r.doc_id: (r.rule, r.kept, r.base_failed) for r in decision_list.judge(df, rules, min_words=1).collect()}
    assert got == {1: (1, False, True) if got[1][2] else (1, False, False), 2: (2, False, False), 3: (0, True, False), 4: (0, False, True)}


def test_filter_keeps_columns_and_takes_empty_tables(spark):
    docs = spark.createDataFrame(
        [(k, " ".join(f"w{i}" for i in range(60)), "x", 5, 6) for k in range(3)] + [(7, "short", "x", 5, 6)] * 2,
        "doc_id long, text string, rule string, kept int, n_words int",
    )
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = decision_list.filter_documents(docs, none)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
    assert decision_list.filter_documents(docs.limit(0), none).count() == 0


def test_query_against_plain_counts_and_labels(spark):
    from grievlake.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    right = total = 0
    for r in QUERIES["op5_quality_rules"](spark, folder).collect():
        want = plain_counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[:5]
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and (r.kept is False if failed else r.kept == (r.rule == 0))
        if r.doc_id in label and not failed:
            total += 1
            right += r.kept == (label[r.doc_id] == 1)
    assert right / total > 0.97
