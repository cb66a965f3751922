from __future__ import annotations

import random

import pytest

from grievlake.operators import corpus, sections
from grievlake.schemas import CHUNKS, PAGES, SCHEMES, SECTIONS
from grievlake.sources.readers import clean_pages

BODY = "This body is surely longer than thirty characters."
TITLES = ["Wages", "Hours of work", "Short title and extent", "Duty of the contractor towards those employed"]


def draft(draw):
    """A statute as known sections, and its text: a preface, then every section under its header."""
    known, text = [], draw.choice(["", "An Act to know.\n", "Preface of two\nlines\n"])
    for number in sorted(draw.sample(range(1, 400), draw.randint(0, 7))):
        title = draw.choice(TITLES) + f" {number}"
        lines = [f"it is said that {draw.choice(['a', 'b', 'c'])} {k} shall hold" for k in range(draw.randint(1, 6))]
        known.append((str(number), title, " ".join(lines)))
        head = draw.choice(["", "Section ", "Section\n"]) + f"{number}." + draw.choice([" ", "  ", "\n"]) + title
        text += head + "\n" + "\n".join(lines) + "\n"
    return known, text.strip()


def paged(draw, doc, text):
    """The text cut into pages at some of its line ends."""
    pages, held = [], []
    for line in text.split("\n"):
        held.append(line)
        if draw.random() < 0.6:
            pages.append("\n".join(held))
            held = []
    pages += ["\n".join(held)] if held else []
    return [(doc, n * 2, p) for n, p in enumerate(pages) if p.strip()]


def found(spark, pages, size, monkeypatch):
    monkeypatch.setattr(sections, "PAGES_PER_BUCKET", size)
    df = clean_pages(spark.createDataFrame(pages, PAGES)).filter("raw_text <> ''").repartition(3)
    got = sections.split_sections(df, -1).select("doc_id", "section_num", "title", "content").collect()
    return sorted(tuple(r) for r in got)


def test_the_three_sections_of_the_example(spark, rows):
    text = f"1. Short title and extent\n{BODY}\nSection 351. Criminal intimidation\n{BODY}\n3. Tiny Body\nshort"
    pages = spark.createDataFrame([("d", 1, text)], PAGES)
    assert rows(sections.split_sections(pages)) == [
        ("d", "BNS_1", "1", "Short title and extent", BODY, "BNS_2023"),
        ("d", "BNS_351", "351", "Criminal intimidation", BODY, "BNS_2023"),
    ]


def test_sections_cross_pages_and_buckets(spark, rows, monkeypatch):
    monkeypatch.setattr(sections, "PAGES_PER_BUCKET", 2)
    pages = [("d", 0, "preface 12."), ("d", 1, "Title on next page"), ("d", 2, "a\nb"), ("d", 5, "c " + BODY), ("d", 9, "7. Last one here")]
    got = rows(sections.split_sections(spark.createDataFrame(pages, PAGES), 0), "section_num", "title", "content")
    assert got == [("12", "Title on next page", "a b c " + BODY)]


@pytest.mark.parametrize("size", [1, 3])
def test_known_sections_are_found_again(spark, monkeypatch, size):
    draw = random.Random(size)
    pages, want = [], []
    for doc in range(80):
        known, text = draft(draw)
        pages += paged(draw, str(doc), text)
        want += [(str(doc), *section) for section in known]
    assert found(spark, pages, size, monkeypatch) == sorted(want)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_borders_change_nothing(spark, monkeypatch, size):
    """Odd texts cut anywhere give what they give in one bucket, which has no border."""
    draw = random.Random(size)
    words = ["Section", "12.", "7.", "1234.", "Alpha beta gamma", "Short", "x", "\n", "\n", "\n", " ", "S", "8",
             "Section 9. Title of nine\n", "5. Fifth title here\n", "Long title " + "w" * 85, "१२. Nagari digits here\n", BODY]
    pages = []
    for doc in range(150):
        for page in range(draw.randint(1, 9)):
            text = "".join(draw.choice(words) + draw.choice(["", " ", "\n"]) for _ in range(draw.randint(1, 12)))
            pages.append((str(doc), page, text))
    assert found(spark, pages, size, monkeypatch) == found(spark, pages, 1000, monkeypatch)


@pytest.mark.parametrize("size", [1, 2])
def test_documents_of_single_lines(spark, monkeypatch, size):
    """Pages without line breaks, among them long runs that may each be a title or leave a number open."""
    draw = random.Random(size)
    lines = ["Alpha beta 5.", "See Section", "7.", "Section", "Section 3.", "Beta gamma delta", "low text", "Gamma delta 12.", "4. Title here"]
    pages = [(str(doc), page, draw.choice(lines[: 3 + doc])) for doc in range(6) for page in range(160)]
    pages += [("turns", page, "Alpha beta 5.") for page in range(1001)]
    got = found(spark, pages, size, monkeypatch)
    assert got == found(spark, pages, 10_000, monkeypatch)
    assert sum(r[0] == "turns" for r in got) == 500


def test_no_text_passes_through_a_window(spark):
    from pyspark.sql import types as T

    pages = spark.createDataFrame([("d", 1, "1. Some title\nbody"), ("d", 300, "more")], PAGES)
    summary = sections._border_summary(sections._page_buckets(pages)).drop("text")
    plan = sections._settled_tails(summary)._jdf.queryExecution().optimizedPlan()
    waiting, seen = [plan], 0
    while waiting:
        node = waiting.pop()
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "Window":
            seen += 1
            out = node.output()
            names = {(out.apply(i).name(), out.apply(i).dataType().simpleString()) for i in range(out.size())}
            assert {n for n, kind in names if kind == "string"} == {"doc_id"}
    assert seen >= 2 and T.StringType() not in [f.dataType for f in sections._settled_tails(summary).schema.fields[1:]]


def test_assembled_documents_keep_page_order(spark, rows, monkeypatch):
    monkeypatch.setattr(sections, "PAGES_PER_BUCKET", 2)
    pages = [("a", n, f"p{n}") for n in (10, 2, 1, 5)] + [("b", 1, "only")]
    got = rows(sections.assemble_documents(spark.createDataFrame(pages, PAGES)))
    assert got == [("a", "p1\np2\np5\np10"), ("b", "only")]


def test_parsed_rows_win_over_seed(spark, rows):
    parsed = spark.createDataFrame([("BNS_351", "351", "T", "parsed", "BNS_2023"), ("BNS_1", "1", "T", "b", "BNS_2023"),
                                    ("BNS_1", "1", "T", "a", "BNS_2023")], SECTIONS)
    got = {r["section_id"]: r["content"] for r in corpus.fill_gaps(parsed, corpus.seed_sections(spark)).collect()}
    assert got["BNS_351"] == "parsed" and got["BNS_1"] == "a" and len(got) == 7
    assert got["BNS_143"].startswith("Whoever unlawfully compels")


def test_one_row_per_key_is_chosen_before_the_shuffle(spark):
    plan = corpus.dedup_sections(corpus.seed_sections(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_chunks(spark, rows):
    found = spark.createDataFrame([("BNS_1", "1", "Title", BODY, "BNS_2023"), ("BNS_2", "2", "T", "x", "BNS_2023")], SECTIONS)
    schemes = spark.createDataFrame(
        [("Pension", "workers over sixty years", "monthly pay", "office"), ("Gap", "anyone who works on sites", None, "office")],
        SCHEMES,
    )
    chunks = corpus.build_chunks(found, schemes)
    assert chunks.columns == CHUNKS.fieldNames()
    assert rows(chunks) == [
        ("BNS_1", f"BNS Section 1 - Title: {BODY}", "BNS_2023"),
        ("Pension", "Scheme: Pension. Eligibility: workers over sixty years. Benefits: monthly pay. Apply at: office", "GOV_SCHEMES"),
    ]
    assert rows(corpus.build_chunks(found, schemes, null_as_empty=True), "chunk_id") == [("BNS_1",), ("Gap",), ("Pension",)]
    assert rows(corpus.labour_schemes(schemes), "scheme_name") == [("Pension",)]
