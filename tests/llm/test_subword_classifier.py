from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from grievlake.llm import subword_classifier as c


def plain_items(text):
    """Counts of words, character grams and window forms by plain Python: only how many, and which repeat."""
    raw = (text or "").encode()
    words, space = raw.split(), b" \t\n\v\f\r"
    grams = sum(
        1 for n in c.GRAMS for i in range(len(raw) - n + 1) if not any(b in space for b in raw[i + 1: i + n - 1])
    )
    windows = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    return len(words), grams, len(windows), sum(windows.count(x) > 1 for x in windows)


TEXTS = [None, "", "a", "ab c", "one two three one two three", "é ü\n\nxyz  ab", "x" * 50, " lead and trail "]


def test_items_against_plain_python():
    data, offsets = c.text_bytes(pa.array(TEXTS, pa.string()))
    (_, w), (_, g), (forms, f) = c._slice_items(data, offsets)
    for k, text in enumerate(TEXTS):
        mine = int((w == k).sum()), int((g == k).sum()), int((f == k).sum()), int((forms[f == k] == c.ROWS - 1).sum())
        assert mine == plain_items(text), text


def test_score_is_the_softmax_of_averages():
    draw = np.random.default_rng(0)
    model = c.Classifier(draw.normal(size=c.ROWS), 0.25)
    got = model.scores(pa.array(TEXTS, pa.string()))
    for k, text in enumerate(TEXTS):
        z = 0.25
        data, at = c.text_bytes(pa.array([text], pa.string()))
        for ids, _ in c._slice_items(data, at):
            z += model.table[ids].mean() if len(ids) else 0.0
        assert abs(got[k] - 1 / (1 + np.exp(-z))) < 1e-9
    assert got[0] == got[1]


def made(spark, n=300):
    draw = np.random.default_rng(1)
    rows = []
    for k in range(n):
        good = k % 4 != 0
        part = ["the", "and", "ing", "ous"] if good else ["zqx", "##", "vvk", "$$"]
        rows.append((k, " ".join("".join(draw.choice(part, 2)) for _ in range(30)), int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_learns_and_scores_unseen_texts(spark):
    all_rows = made(spark)
    docs, labels = all_rows.select("doc_id", "text"), all_rows.select("doc_id", "quality", F.lit(0).alias("toxic"))
    model = c.learn(docs, labels.filter(~c.held_out(F.col("doc_id"))))
    scored = all_rows.withColumn("score", c.score(F.col("text"), model)).filter(c.held_out(F.col("doc_id"))).collect()
    assert len(scored) > 30 and all((r.score > 0.5) == bool(r.quality) for r in scored)
    again = c.learn(docs, labels.filter(~c.held_out(F.col("doc_id"))))
    assert (again.table == model.table).all() and again.bias == model.bias


def test_odd_tables(spark):
    docs = made(spark).select("doc_id", "text")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.s for r in docs.select(c.score(F.col("text"), c.learn(docs, none)).alias("s")).distinct().collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert c.learn(docs, one).bias > 0 and docs.limit(0).select(c.score(F.col("text"), c.learn(docs, one))).count() == 0


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = spark.range(200).select("id", c.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_held_out_accuracy_on_given_labels(spark):
    from grievlake.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    got = QUERIES["op9_quality_classifier"](spark, folder)
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    low, high = [r.score for r in rows if r.quality == 0], [r.score for r in rows if r.quality == 1]
    assert np.mean([a < b for a in low for b in high]) > 0.97
