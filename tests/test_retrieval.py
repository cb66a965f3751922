from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grievlake.operators import knn, retrieval, vectors
from grievlake.operators.legal import contexts_for
from grievlake.schemas import CHUNKS


def by_hand(queries, corpus, k):
    found = []
    for qid, q in queries:
        scored = sorted((float(np.square(np.float32(q) - np.float64(np.float32(v))).sum()), cid) for cid, v in corpus)
        found += [(qid, cid, round(d, 6), rank) for rank, (d, cid) in enumerate(scored[:k], 1)]
    return sorted(found)


def frames(spark, n_queries=13, n_chunks=120, dims=5, seed=3):
    rnd = np.random.default_rng(seed)
    corpus = [(i, rnd.normal(size=dims).astype("float32").tolist()) for i in range(n_chunks)]
    corpus += [(1000 - i, corpus[7][1]) for i in range(40)]  # copies of one vector
    queries = [(f"q{i}", rnd.normal(size=dims).astype("float32").tolist()) for i in range(n_queries - 1)]
    queries.append(("copy", corpus[7][1]))
    chunks = spark.createDataFrame(corpus, "chunk_id long, embedding array<float>").repartition(5)
    chunks = chunks.withColumn("content", F.concat(F.lit("text "), "chunk_id"))
    return queries, corpus, spark.createDataFrame(queries, "query_id string, embedding array<float>"), chunks


def hits_of(df):
    return sorted((r["query_id"], r["chunk_id"], round(r["score"], 6), r["rank"]) for r in df.collect())


def test_nearest_chunks_equal_a_full_search(spark):
    queries, corpus, q, c = frames(spark)
    got = knn.knn(q, c, 3)
    assert hits_of(got) == by_hand(queries, corpus, 3)
    copies = [r["chunk_id"] for r in got.filter("query_id = 'copy'").orderBy("rank").collect()]
    assert copies == [7, 961, 962]
    assert got.filter(F.col("content") != F.concat(F.lit("text "), "chunk_id")).count() == 0


def test_many_tiles_change_nothing(spark, monkeypatch):
    queries, corpus, q, c = frames(spark)
    monkeypatch.setattr(knn, "TILE_CELLS", 7)
    # 13 queries and 160 chunks of 40 bytes each: seven by sixteen tiles
    assert knn._tiles((13 * 40, 160 * 40), 1, 80) == (7, 80)
    assert hits_of(knn.knn(q, c, 4, tile_bytes=400)) == by_hand(queries, corpus, 4)
    assert hits_of(knn.knn(q, c, 3, tile_bytes=80)) == by_hand(queries, corpus, 3)


def test_tiles_fill_the_cores_and_stay_bounded():
    mega = knn.LEAST_TILE_BYTES
    assert knn._tiles((10, 10), 8, knn.TILE_BYTES) == (1, 1)
    assert knn._tiles((10, 5 * mega), 8, knn.TILE_BYTES) == (1, 5)
    assert knn._tiles((40 * mega, 100), 8, knn.TILE_BYTES) == (8, 1)
    assert knn._tiles((40 * mega, 3200 * mega), 8, knn.TILE_BYTES) == (5, 400)


def test_the_corpus_sets_the_dimension(spark):
    q = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0, 3.0])], "query_id string, embedding array<float>")
    c = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 2.0]), (3, [5.0])], "chunk_id long, embedding array<float>")
    assert hits_of(knn.knn(q, c, 2)) == [("a", 1, 1.0, 2), ("a", 2, 0.0, 1)]
    assert hits_of(knn.knn(q, c, 2, dimensions=1)) == []


def test_bad_vectors_match_nothing_and_spoil_nothing(spark):
    q = spark.createDataFrame([("a", [0.0, 0.0]), ("nan", [float("nan"), 1.0]), ("short", [1.0])], "query_id string, embedding array<float>")
    c = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [float("nan"), 0.0]), (3, [2.0, 0.0]), (4, [None, 1.0]), (5, [1.0]), (6, [2.0, 2.0, 2.0]), (7, [float("inf"), 0.0]), (8, None), (9, [3.0, 0.0])],
        "chunk_id long, embedding array<float>")
    assert hits_of(knn.knn(q, c, 5)) == [("a", 1, 1.0, 1), ("a", 3, 4.0, 2), ("a", 9, 9.0, 3)]
    good, rejects = knn.split_vectors(c, 2)
    assert {r.chunk_id for r in good.collect()} == {1, 3, 9} and {r.chunk_id for r in rejects.collect()} == {2, 4, 5, 6, 7, 8}


def test_issue_codes_find_what_their_words_find(spark, rows):
    model, table = retrieval.embed_chunks(spark.createDataFrame(CHUNK_ROWS, CHUNKS))
    best = {}
    for issue in ("PHYSICAL_ASSAULT", "Physical Assault", "WAGE_THEFT"):
        asked = spark.createDataFrame([(issue, "HIGH")], "issue_type string, threat_level string")
        best[issue] = retrieval.retrieve(asked, model, table, 1).first()
    assert best["PHYSICAL_ASSAULT"]["issue_type"] == "PHYSICAL_ASSAULT"
    assert best["PHYSICAL_ASSAULT"]["chunk_id"] == best["Physical Assault"]["chunk_id"] == "BNS_115"


def test_fewer_chunks_than_k_and_missing_vectors(spark):
    q = spark.createDataFrame([("a", [0.0]), ("none", None)], "query_id string, embedding array<float>")
    c = spark.createDataFrame([(1, [1.0]), (2, None), (3, [3.0])], "chunk_id long, embedding array<float>")
    assert hits_of(knn.knn(q, c, 3)) == [("a", 1, 1.0, 1), ("a", 3, 9.0, 2)]
    assert knn.knn(q.limit(0), c, 3).count() == 0


def test_context_lists_hits_in_rank_order(spark):
    hits = spark.createDataFrame([("q", "b", "x" * 400, 2), ("q", "a", "near", 1)], "query_id string, chunk_id string, content string, rank int")
    row = knn.build_context(hits, 300).first()
    assert row["context"] == "- a: near\n- b: " + "x" * 300 and row["retrieved_chunks"] == ["a", "b"]


CHUNK_ROWS = [
    ("BNS_316", "BNS Section 316 - Criminal breach of trust: the wage of a worker and property entrusted", "BNS_2023"),
    ("BNS_115", "BNS Section 115 - Voluntarily causing hurt: physical assault and injury to a person", "BNS_2023"),
    ("Pension", "Scheme: Pension. Eligibility: old age. Benefits: monthly pension. Apply at: office", "GOV_SCHEMES"),
    ("Empty", "!!! ... ---", "GOV_SCHEMES"),
]


def words_of(text):
    return re.findall(r"\w+", text.lower())


def bucket_of(word, buckets):
    return (zlib.crc32(word.encode()) * 1640531527 % 2**32) * buckets // 2**32


def vectors_by_hand(texts, corpus, buckets):
    """Unit vectors of texts as dictionaries of whole weights, with the frequencies of ``corpus``."""
    held = Counter(b for t in corpus for b in {bucket_of(w, buckets) for w in words_of(t)})
    out = []
    for text in texts:
        times = Counter(bucket_of(w, buckets) for w in words_of(text))
        weights = {b: n * math.log((len(corpus) + 1) / (held[b] + 1)) for b, n in times.items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        whole = {b: math.floor(w / length * vectors.UNIT + 0.5) for b, w in weights.items()} if length else {}
        out.append({b: w for b, w in whole.items() if w})
    return out


def nearest_by_hand(asked, corpus, buckets, k):
    texts = [t for _, t in corpus]
    held = [(cid, v) for (cid, _), v in zip(corpus, vectors_by_hand(texts, texts, buckets)) if v]
    found = []
    for (qid, _), q in zip(asked, vectors_by_hand([t for _, t in asked], texts, buckets)):
        scored = sorted((-sum(w * v.get(b, 0) for b, w in q.items()), cid) for cid, v in held)
        found += [(qid, cid, round(2 + 2 * p / vectors.UNIT**2, 6), rank) for rank, (p, cid) in enumerate(scored[:k], 1) if q]
    return sorted(found)


@pytest.mark.parametrize("buckets", [64, vectors.BUCKETS])
@pytest.mark.parametrize("tile_bytes", [200, knn.TILE_BYTES])
def test_sparse_search_equals_a_full_search(spark, monkeypatch, buckets, tile_bytes):
    draw = random.Random(6)
    monkeypatch.setattr(knn, "TILE_CELLS", 50)
    monkeypatch.setattr(knn, "QUERY_ROWS", 3)
    monkeypatch.setattr(knn, "CHUNK_ROWS", 11)
    vocabulary = ["heron", "Éclair", "ÜBER", "tide", "x1", "日本", "a_b"] + [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n)) + "!"
    corpus = [(i, text(draw.randint(0, 12))) for i in range(60)] + [(100 + i, "heron tide") for i in range(5)] + [(200, None), (201, "...")]
    asked = [(f"q{i}", text(draw.randint(1, 4))) for i in range(8)] + [("none", "??"), ("new", "unseen words"), ("tie", "tide heron")]
    chunks = spark.createDataFrame(corpus, "chunk_id long, content string").repartition(4)
    model = vectors.fit_vectors(chunks, buckets=buckets)
    table = vectors.vectorise(model, chunks)
    queries = vectors.vectorise(model, spark.createDataFrame(asked, "query_id string, content string"))
    hits = knn.sparse_knn(queries, table.drop("content"), 3, tile_bytes)
    known = [(c, t) for c, t in corpus if t is not None]
    assert hits_of(hits) == nearest_by_hand(asked, known, buckets, 3)


def test_a_vocabulary_of_fifty_thousand_words(spark):
    """Every text has words of its own; 2^18 buckets tell them apart, and each finds itself and its neighbour."""
    size, each = 2_000, 25
    own = lambda i, n: " ".join(f"term{i % size * each + j}" for j in range(n))
    corpus = [(i, f"{own(i, each)} {own(i + 1, 8)}") for i in range(size)]
    chunks = spark.createDataFrame(corpus, "chunk_id long, content string")
    model, table = retrieval.embed_chunks(chunks.withColumn("source", F.lit("s")))
    assert len(model.idf) == 1 << 18 and np.count_nonzero(model.idf < model.idf.max()) > 45_000
    asked = [(i, corpus[i][1]) for i in range(0, size, 40)]
    hits = retrieval.search(model, table, spark.createDataFrame(asked, "query_id long, query_text string"), 2)
    got = {}
    for r in hits.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"]))
    assert hits_of(hits.drop("content", "source")) == nearest_by_hand(asked, corpus, 1 << 18, 2)
    assert all(sorted(got[i])[0] == (1, i) and sorted(got[i])[1][1] in ((i - 1) % size, (i + 1) % size) for i, _ in asked)


def test_different_issues_find_different_chunks(spark):
    from grievlake.plans import retrieval_queries

    sf_dir = "/root/testdata/sf0.001"
    got = retrieval_queries.complaint_prompts(spark, sf_dir).select("retrieved_chunks", "prompt_digest").distinct().collect()
    assert len({r["retrieved_chunks"] for r in got}) >= 5 and len({r["prompt_digest"] for r in got}) == len(got)


def test_text_retrieval_end_to_end(spark, rows):
    chunks = spark.createDataFrame(CHUNK_ROWS, CHUNKS)
    model, table = retrieval.embed_chunks(chunks, min_letters=2)
    assert table.filter("embedding is null").first()["chunk_id"] == "Empty"
    stored = [(r["chunk_id"], r["embedding"]["weights"]) for r in table.collect() if r["embedding"]]
    lengths = {cid: round(float(np.linalg.norm(v)) / vectors.UNIT, 5) for cid, v in stored}
    assert lengths == {"BNS_316": 1.0, "BNS_115": 1.0, "Pension": 1.0}
    asked = spark.createDataFrame(
        [("Physical Assault", "HIGH"), ("Wage Theft", "LOW"), ("Physical Assault", "HIGH")], "issue_type string, threat_level string"
    )
    questions = retrieval.questions(asked)
    assert rows(questions, "query_text") == [
        ("Physical Assault worker rights India HIGH threat",), ("Wage Theft worker rights India LOW threat",),
    ]
    hits = retrieval.retrieve(asked, model, table, 2)
    contexts = {r["issue_type"]: r for r in contexts_for(asked, model, table, 2).collect()}
    assert contexts["Physical Assault"]["retrieved_chunks"][0] == "BNS_115" and len(contexts) == 2
    assert contexts["Wage Theft"]["context"].startswith("- BNS_316: BNS Section 316")
    first = hits.filter("rank = 1 and issue_type = 'Physical Assault'").first()
    assert first["chunk_id"] == "BNS_115"
