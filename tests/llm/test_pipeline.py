from __future__ import annotations

import corpus_pipeline
from grievlake.llm import decision_list, decontaminate, jaccard_join, secret_crf

from .test_decontaminate import plain
from .test_jaccard_join import brute_force, near_copies

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_against_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    judged = decision_list.judge(docs, decision_list.learn(docs, labels)).collect()
    kept = [(r.doc_id, r.text) for r in judged if r.kept]
    classes = {i: c for i, c, _ in brute_force(kept)}
    one = [(i, t) for i, t in kept if classes[i] == i]
    clean = {i: t for i, t in one if not (lambda n, hit, _: hit and 20 * len(hit) >= n)(*plain(t, items))}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == set(clean) and 0 < len(got) < docs.count()
    for i, r in got.items():
        assert r.lossless and r.n_chars == len(r.text) and r.n_pieces == len(r.pieces)
        if "[SECRET]" not in r.text:
            assert r.text == clean[i]


def test_stages_keep_the_columns_and_take_odd_rows(spark, tmp_path):
    good = near_copies(3, words=80, edits=1) + near_copies(1, words=90, edits=60, seed=9)
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(good)] + [(50, None, None, None, None), (51, "", "en", "s", 0), (3, good[3], "en", "s", len(good[3])), (None, good[3] + " more", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert step.columns == docs.columns, name
        step = spark.createDataFrame(step.collect(), step.schema)
    # the row without an id is a near copy of document 3, which comes first
    assert sorted(str(r.doc_id) for r in step.collect()) == ["0", "3"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = spark.createDataFrame([], stage(spark, empty, str(tmp_path)).schema)
    assert {"pieces", "lossless"} <= set(empty.columns)


def test_parts_are_the_ten_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding"]
    assert all((jaccard_join.keep_one, decontaminate.remove, secret_crf.redact))
