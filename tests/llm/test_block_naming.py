from __future__ import annotations

import hashlib
import random
import re

import pytest

from grievlake.llm import block_naming

SCHEMA = "doc_id long, text string"


def by_hand(rows):
    """The contract, from whole texts in a dictionary."""
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for number, (doc, text) in enumerate(rows):
        groups.setdefault(plain(text), []).append((-len(text or ""), doc is None, doc or 0, number))
    out = []
    for number, (doc, text) in enumerate(rows):
        group = groups[plain(text)]
        best = min(group)
        out.append((
            doc, None if best[1] else best[2], len(group), best[3] == number,
            hashlib.sha256(plain(text).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def marked(spark, rows, **options):
    got = block_naming.mark_copies(spark.createDataFrame(rows, SCHEMA), **options).drop("_row").collect()
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("block_bytes, hot_rows", [(3, 20), (1, 7), (4096, 100)])
def test_equals_whole_texts(spark, block_bytes, hot_rows):
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab \n") for _ in range(draw.randint(0, 24))) for _ in range(300)]
    texts += ["a hot text, same for many"] * 120 + ["x" * n for n in (11, 12, 13, 24, 25)]
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    assert marked(spark, rows, block_bytes=block_bytes, hot_rows=hot_rows) == by_hand(rows)


def test_nulls_empty_texts_ties_and_repeated_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (None, "a b"), (5, "ab "), (6, "a\xa0b"), (6, "a\xa0b"),
        (8, "é"), (9, "é"), (10, "\U0001F600 x"), (11, "\U0001F600x "),
    ]
    assert marked(spark, rows, block_bytes=2) == by_hand(rows)


def test_hashes_only_deal_out(spark, monkeypatch):
    """With one hash for everything the names are the same: no decision rests on a hash."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(block_naming.F, "xxhash64", lambda *cols: F.lit(7).cast("long"))
    rows = [(i, t) for i, t in enumerate(["abc", "a b c", "abd", "ab", "abcabd", "abcabd", "abdabc"] * 3)]
    assert marked(spark, rows, block_bytes=3, hot_rows=4) == by_hand(rows)


def test_a_very_long_text_has_levels_and_one_name(spark):
    long = "word" * 60_000
    rows = [(1, long), (2, long + "x"), (3, " ".join([long[:100], long[100:]])), (4, "y" + long)]
    assert marked(spark, rows, block_bytes=64) == by_hand(rows)


def test_empty_table(spark):
    assert marked(spark, []) == []
    assert block_naming.drop_copies(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "text"]


def test_drop_copies_keeps_all_columns(spark, rows):
    docs = spark.createDataFrame(
        [(1, "a b", 5, "p"), (2, "ab  ", 6, "q"), (3, "c", 7, "r"), (3, "d", 8, "s")],
        "doc_id long, text string, _row int, kept string",
    )
    got = block_naming.drop_copies(docs)
    assert got.columns == docs.columns
    assert rows(got) == [(2, "ab  ", 6, "q"), (3, "c", 7, "r"), (3, "d", 8, "s")]
