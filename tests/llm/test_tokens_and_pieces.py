from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grievlake.llm import merge_dropout, token_splice

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n\n", "  two  spaces ", "don't stop; it's 2024.", "<|endoftext|>x<|startoftext|> <|STARTOFTEXT|>", "É é á ́x ﬁ Ǆ", "a\x85b\xa0c　d",
    "漢字かな 한국어 🙂👩‍👩‍👧", "Ends. Here, and.. there,. x.,y", "q" * 3000, ("z" * 90 + " ") * 40, "tab\tand\vother\x1cspace\x00nul", "▁ literal ▁▁", "the " * 500,
]


def prose(n, seed=0):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("aeiou thrnsé.,'\n1") for _ in range(draw.randrange(1, 12))) for _ in range(n))


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


@pytest.mark.parametrize("chunk, overlap", [(65_536, 512), (400, 40), (60, 4)])
def test_counts_are_those_of_the_library(chunk, overlap):
    texts = ODD + [prose(900, k) for k in range(3)]
    with open(WORD_BPE, encoding="utf-8") as file:
        got = token_splice.make_counter(file.read(), chunk, overlap)(pa.array(texts, pa.string()))
    assert got.tolist() == [len(e.ids) for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_boundaries_need_agreement_on_both_sides():
    tokens = lambda *pairs: tuple(np.array(x) for x in zip(*pairs))
    left = tokens((7, 0), (8, 2), (1, 4), (2, 5), (3, 7), (4, 9), (5, 11), (99, 12))
    right = tokens((1, 4), (2, 5), (3, 7), (4, 9), (5, 11), (6, 13))
    assert token_splice.stable_boundary(left, right, 2) == (5, 3)
    assert token_splice.stable_boundary(left, right, 3) is None
    # two tokens that spell one character are not parted
    left = tokens((1, 4), (2, 5), (3, 5), (4, 9))
    assert token_splice.stable_boundary(left, left, 2) is None and token_splice.stable_boundary(left, left, 1) == (1, 1)


def joining_tokenizer():
    """Merges reach across white space, and a run of one letter is cut in twos from its start."""
    from tokenizers import Tokenizer, models

    merges = [("a", "a"), ("b", " "), (" ", "c"), ("b ", "aa"), ("c", "c"), ("cc", "cc"), ("x", "y"), (" ", "xy")]
    words = ["a", "b", "c", "x", "y", " "] + [m + n for m, n in merges]
    return Tokenizer(models.BPE(vocab={w: k for k, w in enumerate(words)}, merges=merges))


@pytest.mark.parametrize("chunk, overlap, agree", [(40, 6, 4), (90, 30, 8), (17, 3, 2)])
def test_splicing_is_right_where_runs_alone_are_not(chunk, overlap, agree):
    tokenizer, draw = joining_tokenizer(), random.Random(chunk)
    assert not token_splice.drops_white_space(tokenizer.to_str()) and token_splice.drops_white_space(library().to_str())
    texts = ["".join(draw.choice(["a", "b", "c", "xy", " ", "b a", "aaa", "cccc"]) for _ in range(draw.randrange(400))) for _ in range(60)]
    texts += ["a" * 501, " " * 300, "b " * 200, "c" * 200 + " " + "a" * 99, "cab " * 90]
    want = [len(tokenizer.encode(t).ids) for t in texts]
    assert token_splice.make_counter(tokenizer.to_str(), chunk, overlap, agree)(pa.array(texts)).tolist() == want
    assert sum(len(tokenizer.encode(r).ids) for t in texts for r in t.split()) != sum(want)


def test_long_texts_are_encoded_in_chunks_and_overlaps_widen():
    seen, tokenizer = [], library()

    def encode(text):
        seen.append(len(text))
        coded = tokenizer.encode(text, add_special_tokens=False)
        return np.array(coded.ids), np.array([a for a, _ in coded.offsets])

    text = prose(3000)
    assert token_splice.spliced_count(text, encode, 1000, 120, 8) == len(tokenizer.encode(text, add_special_tokens=False).ids)
    assert max(seen) <= 1000 and len(text) < sum(seen) < 1.4 * len(text)
    seen.clear()
    wall = "a" * 900 + " b c" + " d" * 300
    assert token_splice.spliced_count(wall, encode, 100, 10, 8) == len(tokenizer.encode(wall, add_special_tokens=False).ids)
    assert max(seen) > 100, "the overlap and the chunk grow over what is never stable"


def test_token_count_column(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(ODD)] * 2, "doc_id int, text string, n_tokens int")
    got = {r.doc_id: r.n for r in df.select("doc_id", token_splice.token_count(F.col("text"), WORD_BPE, 500, 20).alias("n")).collect()}
    want = [len(e.ids) for e in library().encode_batch([t or "" for t in ODD], add_special_tokens=False)]
    assert [got[k] for k in range(len(ODD))] == want
    assert df.limit(0).select(token_splice.token_count(F.col("text"), WORD_BPE)).count() == 0


def encoded(texts, dropout, seed=17):
    model = merge_dropout.load_model(PIECES)
    texts, out = [t or "" for t in texts], []
    for ids, counts in merge_dropout.encode_texts(texts, merge_dropout.Agenda(model, dropout, seed), merge_dropout.Known(4)):
        assert all(merge_dropout.Speller(model).exact(ids, counts, texts[len(out): len(out) + len(counts)]))
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return model, out


def test_without_dropout_pieces_are_those_of_the_library():
    import sentencepiece

    texts = [t for t in ODD if t is None or "▁" not in t] + [prose(200)]
    _, got = encoded(texts, 0.0)
    assert got == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode([t or "" for t in texts])


def test_dropout_varies_and_decodes_exactly():
    texts = ODD + [prose(400)]
    seen = set()
    for dropout, seed in ((0.0, 1), (0.1, 1), (0.1, 2), (0.5, 1), (1.0, 1)):
        model, got = encoded(texts, dropout, seed)
        for text, ids in zip(texts, got, strict=True):
            assert merge_dropout.decode_ids(ids, model.pieces, model.dummy_prefix) == (text or "").encode()
        seen.add(tuple(got[-1]))
        assert encoded(texts, dropout, seed)[1] == got
    assert len(seen) == 5
    assert all(len(model.pieces[i]) <= 4 for i in got[-1]), "nothing is merged at dropout 1"


def reference_agenda(word, model, agenda, name):
    """The agenda one candidate at a time, on plain lists."""
    symbols = [(int(i), k, k + 1) for k, i in enumerate(agenda.symbols([word])[0])]
    while True:
        options = []
        for k in range(len(symbols) - 1):
            (a, start, middle), (b, _, end) = symbols[k], symbols[k + 1]
            piece = int(agenda.merged(np.array([a]), np.array([b]))[0])
            if piece >= 0 and not agenda.skipped(np.array([name]), np.array([start]), np.array([middle]), np.array([end]))[0]:
                options.append((int(model.order[piece]), k, piece))
        if not options:
            return [i for i, _, _ in symbols]
        _, k, piece = min(options)
        symbols[k: k + 2] = [(piece, symbols[k][1], symbols[k + 1][2])]


def test_both_ways_of_merging_follow_the_agenda(monkeypatch):
    model = merge_dropout.load_model(PIECES)
    agenda = merge_dropout.Agenda(model, 0.3, 5)
    words = sorted({w for w in merge_dropout.WORDS.findall(" " + prose(150))})
    names = merge_dropout.run_hashes(np.frombuffer("".join(words).encode(), np.uint8), *[np.array(x) for x in zip(*spans(words), strict=True)], merge_dropout.letter_values(False))
    names = merge_dropout.mix(names + np.array([3], np.uint64) * np.uint64(0xA0761D6478BD642F))
    want = [reference_agenda(w, model, agenda, n) for w, n in zip(words, names, strict=True)]
    for limit in (48, 0):
        monkeypatch.setattr(merge_dropout, "SHORT_WORD", limit)
        assert [np.frombuffer(x, "<i4").tolist() for x in agenda.encode(words, [3] * len(words))] == want


def test_every_occurrence_has_its_own_draw(monkeypatch):
    word = " international"
    model, (ids,) = encoded([word[1:] + word * 3000], 0.1)
    cuts, one, at = {}, [], 0
    for i in ids:
        one.append(i)
        at += len(model.pieces[i])
        if at == len(word):
            cuts[tuple(one)] = cuts.get(tuple(one), 0) + 1
            one, at = [], 0
    assert sum(cuts.values()) == 3001 and len(cuts) > 20, "four segmentations at most when occurrences share draws"
    # the remembered way and the agenda of every occurrence agree
    texts = ["".join(prose(120, k)) for k in range(3)] + ODD
    model, want = encoded(texts, 0.2)

    def plain(self, numbers, draws, agenda):
        self.fill(agenda)
        coded = agenda.encode([self.words[k] for k in numbers], draws) if len(numbers) else []
        flat = np.frombuffer(b"".join(coded), "<i4")
        return flat, np.array([len(c) // 4 for c in coded], np.int64)

    monkeypatch.setattr(merge_dropout.Known, "encode", plain)
    assert encoded(texts, 0.2)[1] == want


def spans(words):
    at = 0
    for w in words:
        yield at, at + len(w.encode())
        at += len(w.encode())


def test_encode_and_decode_columns(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)] * 2, "doc_id int, text string, kind string")
    out = merge_dropout.decode(merge_dropout.encode(df, PIECES), PIECES)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "kind", "pieces", "n_pieces", "lossless", "decoded"] and len(rows) == 2 * len(ODD)
    assert all(r.lossless and r.decoded == (r.text or "") and r.n_pieces == len(r.pieces) for r in rows)
    assert merge_dropout.encode(df.limit(0), PIECES).count() == 0
    clash = merge_dropout.encode(df.selectExpr("*", "1 AS _coded", "'old' AS pieces", "2 AS coded", "3 AS doc"), PIECES)
    assert clash.columns == ["doc_id", "text", "kind", "_coded", "coded", "doc", "pieces", "n_pieces", "lossless"]
    row = clash.filter("doc_id = 4").first()
    assert (row["_coded"], row["coded"], row["doc"]) == (1, 2, 3) and isinstance(row["pieces"], list)
