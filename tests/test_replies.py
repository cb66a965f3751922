from __future__ import annotations

import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grievlake.functions.replies import parse_fenced_json, with_entities
from grievlake.functions.shape import (
    conform, ensure_columns, missing_fields, rename_if_present, split_rejects,
)
from grievlake.functions.text import any_column_contains, fill_template, lookup, or_default, strip
from grievlake.functions.scores import with_mime
from grievlake.schemas import SILVER

DEFAULTS = ("UNKNOWN", "UNKNOWN", "OTHER", False, 0)

CASES = [
    ('{"contractor_name":"R","worker_count_mentioned":3}', ("R", "UNKNOWN", "OTHER", False, 3)),
    ('<think>a{b}</think>\n```json\n{"contractor_name":"R"}\n```', ("R", "UNKNOWN", "OTHER", False, 0)),
    ('{"violence_threatened": True, "work_site": None}', ("UNKNOWN", "UNKNOWN", "OTHER", True, 0)),
    ("no json", DEFAULTS),
    ("{'bad'", DEFAULTS),
    ("{'contractor_name': 'R'}", DEFAULTS),
    ('{"worker_count_mentioned":"many","work_site":"Thane"}', ("UNKNOWN", "Thane", "OTHER", False, 0)),
    ('{"worker_count_mentioned":"7"}', ("UNKNOWN", "UNKNOWN", "OTHER", False, 7)),
    ('{"worker_count_mentioned":3.9}', ("UNKNOWN", "UNKNOWN", "OTHER", False, 3)),
    ('{"violence_threatened":"false"}', DEFAULTS),
    ('{"violence_threatened":"yes","contractor_name":"True story: True"}', ("True story: True", "UNKNOWN", "OTHER", True, 0)),
    ('{"contractor_name":"R"} and {"contractor_name":"S"}', DEFAULTS),
    ('{"contractor_name":"R"} junk }', DEFAULTS),
    ('text } before {"contractor_name":"R"}', ("R", "UNKNOWN", "OTHER", False, 0)),
    ("} only {", DEFAULTS),
    ("", DEFAULTS),
    (None, DEFAULTS),
    ('Sure!\n{"contractor_name":\n "R"\n}', ("R", "UNKNOWN", "OTHER", False, 0)),
]


def test_entity_replies(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, raw string")
    got = {r["id"]: tuple(r)[2:7] for r in with_entities(df).collect()}
    for i, (raw, want) in enumerate(CASES):
        assert got[i] == want, raw


def test_without_repair_python_literals_are_defaults(spark):
    df = spark.createDataFrame([('{"violence_threatened": True}',)], "raw string")
    row = with_entities(df, repair=False).first()
    assert row["violence_threatened"] is False and row["parse_status"] == "default"


def python_entities(raw: str):
    """What a reader of one reply at a time returns for clean or broken JSON."""
    if "</think>" in raw:
        raw = raw.split("</think>")[-1]
    raw = re.sub(r"```(?:json)?|```", "", raw)
    start, end = raw.find("{"), raw.rfind("}") + 1
    try:
        found = json.loads(raw[start:end]) if start >= 0 and end else {}
    except ValueError:
        found = {}
    return found.get("contractor_name", "UNKNOWN") if isinstance(found, dict) else "UNKNOWN"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(
    st.sampled_from(["", "ok ", "<think>x</think>", "```json\n", "<think>{</think>\n", "} "]),
    st.text(alphabet="ab{}\"\\:, é1`", max_size=12),
    st.sampled_from(["", "\n```", " }", " end", ",", "</think>"]),
), min_size=1, max_size=20))
def test_replies_agree_with_a_json_reader(spark, parts):
    raws = [a + json.dumps({"contractor_name": name}, ensure_ascii=False) + b for a, name, b in parts]
    df = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    got = {r["id"]: r["contractor_name"] for r in with_entities(df).select("id", "contractor_name").collect()}
    assert got == {i: python_entities(raw) for i, raw in enumerate(raws)}


def test_fenced_replies(spark):
    body = '{"bns_sections_cited":["A","B"],"action_steps":["x"],"government_portal":"p","urgency":"LOW"}'
    raws = ["```json\n" + body + "\n```", "  " + body + "\n", "```\n" + body + "```tail", "note " + body, "```json\n[1]\n```",
            '{"bns_sections_cited":"A","urgency":"LOW"}', None]
    df = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    got = {r["id"]: r["p"] for r in df.select("id", parse_fenced_json("raw").alias("p")).collect()}
    for i in (0, 1, 2):
        assert got[i]["bns_sections_cited"] == ["A", "B"] and got[i]["urgency"] == "LOW"
    assert got[3] is None and got[4] is None and got[6] is None
    assert got[5]["bns_sections_cited"] is None and got[5]["urgency"] == "LOW"


def test_rejects_hold_the_rest(spark, rows):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, ok boolean")
    good, bad = split_rejects(df, F.col("ok"))
    assert rows(good, "id") == [(1,)] and rows(bad, "id") == [(2,), (3,)]


def test_text_helpers(spark):
    df = spark.createDataFrame([(" \t a b \n\x1c", "", 3), (None, None, None)], "a string, b string, n int")
    first, second = df.select(
        strip("a").alias("s"), or_default("b", "000000").alias("d"),
        fill_template("{{x}} {n} of {b}!").alias("t"), lookup("n", {3: "three"}, "?").alias("l"),
    ).collect()
    assert tuple(first) == ("a b", "000000", "{x} 3 of !", "three")
    assert tuple(second) == (None, "000000", "{x}  of !", "?")


def test_keywords_match_literally_in_any_text_column(spark, rows):
    df = spark.createDataFrame(
        [(1, "Minimum WAGES act", None), (2, None, "for a worker"), (3, "w.ge", "x"), (4, None, None)],
        "id int, a string, b string",
    )
    assert rows(any_column_contains(df, ["wage", "Worker"]), "id") == [(1,), (2,)]
    assert rows(any_column_contains(df, ["w.ge"]), "id") == [(3,)]
    assert any_column_contains(df, []).count() == 0
    assert rows(any_column_contains(df, ["worker"], ["a"]), "id") == []


def test_shape_helpers(spark):
    df = spark.createDataFrame([(1, "x")], "id int, old string")
    assert rename_if_present(df, {"old": "new", "gone": "other"}).columns == ["id", "new"]
    with pytest.raises(ValueError):
        rename_if_present(df, {"old": "id"})
    assert ensure_columns(df, {"id": 9, "n": 1, "tags": ["a"]}).first().asDict() == {"id": 1, "old": "x", "n": 1, "tags": ["a"]}
    gaps = missing_fields(df.withColumn("empty", F.lit(None).cast("string")), ["id", "empty", "absent"])
    assert gaps.first()["missing_fields"] == ["empty", "absent"]


def test_conform_turns_unfit_values_into_nulls(spark):
    text = {f.name: F.lit("many") for f in SILVER.fields}
    row = conform(spark.range(1).select(*[v.alias(k) for k, v in text.items()]), SILVER).first()
    assert row["worker_count_mentioned"] is None and row["violence_threatened"] is None and row["call_id"] == "many"


def test_mime(spark):
    df = spark.createDataFrame([("/a/b.MP3",), ("x.m4a",), ("noext",), ("y.mp4",)], "path string")
    assert [r["mime"] for r in with_mime(df).collect()] == ["audio/mpeg", "audio/mp4", "audio/wav", "audio/wav"]


def test_literals_in_lists_and_inside_strings(spark):
    raw = [
        '{"contractor_name":"R","flags":[True, None, False]}', '{"contractor_name":"S", "work_site": "gate: True, west", "violence_threatened": True}',
        '{"contractor_name":"A"}],"r":[{"contractor_name":"B"}', '{"contractor_name":"C", "x": {"y": [1, {"z": "}]{"}]}}', '{"contractor_name":"D"} {"contractor_name":"E"}',
        '{"contractor_name":"F", "x": None, "y": 1"}',
    ]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, raw string")
    got = {r.k: (r.contractor_name, r.work_site, r.violence_threatened) for r in with_entities(df).collect()}
    assert got[0][0] == "R" and got[1] == ("S", "gate: True, west", True)
    assert got[2][0] == "UNKNOWN" and got[3][0] == "C" and got[4][0] == "UNKNOWN" and got[5][0] == "UNKNOWN"


def test_a_reply_is_read_once(spark):
    raw = ['{"contractor_name":"say, True, or, None, so","flags":[True,True, None,None,False]}', '{"worker_count_mentioned":" 1e1 "}',
           '{"worker_count_mentioned":"NaN","violence_threatened":" TRUE "}', '{"contractor_name":"a, True, b"}']
    df = with_entities(spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, raw string"))
    got = {r.k: (r.contractor_name, r.violence_threatened, r.worker_count_mentioned, r.parse_status) for r in df.collect()}
    assert got == {0: ("say, True, or, None, so", False, 0, "ok"), 1: ("UNKNOWN", False, 10, "ok"),
                   2: ("UNKNOWN", True, 0, "ok"), 3: ("a, True, b", False, 0, "ok")}
    # a second reading, and the exception of the first, cost more than all else
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
