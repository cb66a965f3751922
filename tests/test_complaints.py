from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from grievlake.operators import complaints as calls
from grievlake.operators import legal, notices
from grievlake.operators.calls import assign_call_ids, call_records, run_scoped_ids, web_id
from grievlake.operators.hotspots import build_gold
from grievlake.operators.recency import complaints_48h
from grievlake.schemas import ACTION_LOG, CALLS, SILVER
from tests.test_hotspots import SIX_CALLS, silver_of

SENTENCES = [
    ("Contractor Ramesh fired 8 workers without notice at Andheri site.", ("Ramesh", "Andheri", "WRONGFUL_TERMINATION", False, 8)),
    ("Contractor Suresh has not paid wages for 5 days and is threatening to beat us.", ("Suresh", "UNKNOWN", "WAGE_THEFT", True, 0)),
    ("Ramesh has not given money for two days.", ("UNKNOWN", "UNKNOWN", "WAGE_THEFT", False, 0)),
    ("supervisor Mohan slapped 3 labourers at the Thane bridge site", ("Mohan", "Thane bridge", "PHYSICAL_ASSAULT", False, 3)),
    ("ühit whitepaid", ("UNKNOWN", "UNKNOWN", "OTHER", False, 0)),
    ("99999999999 workers unpaid", ("UNKNOWN", "UNKNOWN", "OTHER", False, 0)),
    ("", ("UNKNOWN", "UNKNOWN", "OTHER", False, 0)),
    (None, ("UNKNOWN", "UNKNOWN", "OTHER", False, 0)),
]


def test_entity_rules(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SENTENCES)], "id int, english_text string")
    got = {r["id"]: tuple(r)[2:] for r in calls.extract_entities(df).collect()}
    for i, (sentence, want) in enumerate(SENTENCES):
        assert got[i] == want, sentence


def test_silver_from_calls(spark):
    bronze = spark.createDataFrame(
        [(1, "000000", "  Contractor Ramesh has not paid wages near 400053\n", "t", 30, "a.wav"), (None, "1", None, None, None, None)],
        CALLS,
    )
    silver = calls.build_silver(bronze, find_pincode=True)
    assert silver.schema.simpleString() == SILVER.simpleString()
    row = silver.filter("call_id = '1'").first()
    assert (row["pincode"], row["english_text"], row["contractor_name"]) == ("400053", "Contractor Ramesh has not paid wages near 400053", "Ramesh")
    assert silver.filter("call_id is null").count() == 1


def test_translation_memory_and_work_list(spark, rows):
    df = spark.createDataFrame([(1, " a "), (2, "a"), (3, "b\n"), (4, None), (5, " ")], "call_id int, raw_text string")
    memory = spark.createDataFrame([("a", "A!")], "source_text string, translated_text string")
    assert rows(calls.with_translation(df, memory), "call_id", "english_text") == [(1, "A!"), (2, "A!"), (3, "b"), (4, None), (5, "")]
    assert rows(calls.untranslated(df, memory)) == [("b",)]


def test_silver_from_replies(spark):
    bronze = spark.createDataFrame([(1, "1", "x", None, None, None), (2, "2", "y", None, None, None)], CALLS)
    replies = spark.createDataFrame([("1", '{"contractor_name":"R","violence_threatened":True}')], "call_id string, raw string")
    got = {r["call_id"]: r for r in calls.build_silver(bronze, replies=replies).collect()}
    assert got["1"]["contractor_name"] == "R" and got["1"]["violence_threatened"] is True
    assert got["2"]["contractor_name"] == "UNKNOWN" and got["2"]["issue_type"] == "OTHER"


def test_batch_client(spark, rows):
    def client(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "upper": batch["text"].str.upper()})

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    assert rows(calls.enrich_with(df, client, "id long, upper string")) == [(1, "A"), (2, "B")]


def test_call_ids_are_dense_in_path_order(spark):
    paths = [f"/audio/{random.Random(i).randint(0, 500):04d}-{i}.wav" for i in range(500)] + ["/audio/dup.wav"] * 30
    df = spark.createDataFrame([(p,) for p in paths], "path string").repartition(7)
    got = assign_call_ids(df, offset=9).orderBy("call_id").collect()
    assert [r["call_id"] for r in got] == list(range(10, 10 + len(paths)))
    assert [r["path"] for r in got] == sorted(paths)
    assert got[0]["file_name"] == "call_010.json"


def test_call_records(spark):
    df = spark.createDataFrame([("/a/b.wav", "two"), ("/a/a.wav", "one"), ("/a/0.wav", ""), ("/a/1.wav", None)], "path string, text string")
    got = call_records(df).orderBy("call_id").collect()
    assert [(r["call_id"], r["hindi_audio_text"], r["audio_source"], r["pincode"]) for r in got] == [
        (1, "one", "a.wav", "000000"), (2, "two", "b.wav", "000000"),
    ]
    assert all(30 <= r["call_duration_seconds"] <= 180 and len(r["timestamp"]) == 26 for r in got)
    assert call_records(df).schema.simpleString() == CALLS.simpleString()


def test_scoped_ids(spark, rows):
    df = spark.createDataFrame([("b",), ("a",)], "k string")
    assert rows(run_scoped_ids(df, "DYNAMIC-", ["k"]), "call_id", "k") == [("DYNAMIC-1", "a"), ("DYNAMIC-2", "b")]
    assert spark.range(1).select(web_id().alias("i")).first()["i"].startswith("WEB-1")


def test_48_hours_equals_a_count_by_hand(spark):
    rnd = random.Random(1)
    start = datetime(2026, 1, 1)
    events = []
    for i in range(400):
        hours = rnd.choice([0, 1, 47, 48, 49, 96]) + rnd.choice([0, 0.25, 0.5, rnd.random()])
        events.append((i, rnd.choice(["hot", "hot", "hot", "b", None]), start + timedelta(hours=hours)))
    df = spark.createDataFrame(events, "id int, contractor_name string, timestamp timestamp")
    got = {r["id"]: r["complaints_48h"] for r in complaints_48h(df).collect()}
    for i, who, at in events:
        want = sum(1 for _, w, t in events if w == who and at - timedelta(hours=48) <= t <= at)
        assert got[i] == want, (i, who, at)


def test_actions_and_log(spark, rows):
    silver = silver_of(spark, SIX_CALLS)
    gold = build_gold(silver)
    log = legal.build_legal_actions(silver, gold)
    assert log.schema.simpleString() == ACTION_LOG.simpleString()
    assert rows(log, "call_id", "issue_type", "threat_level", "urgency", "retrieved_chunks") == [
        ("1", "WAGE_THEFT", "HIGH", "HIGH", ""), ("2", "PHYSICAL_ASSAULT", "HIGH", "HIGH", ""),
        ("3", "UNSAFE_CONDITIONS", "HIGH", "HIGH", ""), ("4", "WAGE_THEFT", "HIGH", "HIGH", ""),
    ]
    assert log.filter("call_id = '2'").first()["bns_sections_cited"] == (
        "BNS Section 115 - Voluntarily Causing Hurt, BNS Section 351 - Criminal Intimidation"
    )
    assert log.filter("call_id = '1'").first()["action_steps"].count(" | ") == 2
    plain = legal.build_legal_actions(silver, gold, normalise=False)
    assert plain.filter("call_id = '2'").first()["government_portal"] == "shramsuvidha.gov.in or call helpline 14434"


def test_replies_and_contexts_reach_the_log(spark):
    silver = silver_of(spark, SIX_CALLS)
    replies = spark.createDataFrame(
        [("1", '```json\n{"bns_sections_cited":["S1"],"urgency":"LOW"}\n```'), ("2", '{"bns_sections_cited":[]}'), ("3", "bad")],
        "call_id string, raw string",
    )
    contexts = spark.createDataFrame(
        [("WAGE_THEFT", "HIGH", ["c1", "c2"]), ("PHYSICAL_ASSAULT", "HIGH", ["c3"])],
        "issue_type string, threat_level string, retrieved_chunks array<string>",
    )
    advice = {r["call_id"]: r for r in legal.build_legal_actions(silver, build_gold(silver), replies, contexts).collect()}
    assert (advice["1"]["bns_sections_cited"], advice["1"]["urgency"], advice["1"]["retrieved_chunks"]) == ("S1", "LOW", "c1, c2")
    assert (advice["1"]["action_steps"], advice["1"]["government_portal"]) == ("", "")
    assert advice["2"]["urgency"] == "HIGH" and advice["2"]["retrieved_chunks"] == ""
    generic = {
        r["call_id"]: r
        for r in legal.build_legal_actions(silver, build_gold(silver), replies, contexts, on_failure="generic").collect()
    }
    assert generic["2"]["bns_sections_cited"] == "" and generic["2"]["urgency"] == "MEDIUM"
    assert generic["2"]["retrieved_chunks"] == "c3"
    assert generic["3"]["bns_sections_cited"] == "BNS Section 351, BNS Section 316" and generic["3"]["urgency"] == "HIGH"


def test_generic_urgency_by_threat(spark):
    df = spark.createDataFrame([("High",), ("HIGH",), ("Low",), (None,)], "threat_level string")
    loose = [r["action"]["urgency"] for r in legal.with_generic_action(df).collect()]
    strict = [r["action"]["urgency"] for r in legal.with_generic_action(df, "portal", strict_case=True).collect()]
    assert loose == ["HIGH", "HIGH", "MEDIUM", "MEDIUM"] and strict == ["HIGH", "MEDIUM", "MEDIUM", "MEDIUM"]


def test_log_views(spark, rows):
    log = spark.createDataFrame(
        [(c, None, None, None, None, None, None, None, None, t) for c, t in [("a", "2026-01-01"), ("a", "2026-01-03"), ("b", "2026-01-02")]],
        ACTION_LOG,
    )
    assert [r["timestamp"] for r in legal.recent_actions(log, 2).collect()] == ["2026-01-03", "2026-01-02"]
    assert rows(legal.latest_per_call(log), "call_id", "timestamp") == [("a", "2026-01-03"), ("b", "2026-01-02")]


def test_metrics_and_requests(spark, rows):
    df = legal.with_fallback_action(spark.createDataFrame([("1", "OTHER"), ("2", "Forced Labour")], "call_id string, issue_type string"))
    assert rows(legal.action_metrics(df)) == [("1", 2, 3), ("2", 1, 3)]
    request = notices.translation_requests(notices.advice_text(df)).filter("call_id = '2'").first()["prompt"]
    assert request.startswith("Translate the following legal advice to simple Hindi.") and "District Magistrate" in request


def test_advice_steps_skip_blank_lines(spark, rows):
    df = spark.createDataFrame([("1", " first \n\nthird"), ("2", "  ")], "call_id string, english_text string")
    assert rows(notices.advice_steps(df)) == [("1", "01", "first"), ("1", "03", "third")]


def test_notices(spark):
    df = spark.createDataFrame(
        [("Suresh Patil", "380001", 3, "Wage Theft"), ("Suresh Patil", "400053", 15, "Wage Theft"), ("A", "1", 1, "x")],
        "contractor_name string, pincode string, total_complaints int, primary_issue string",
    )
    chosen = notices.notice_target(df, "Suresh Patil")
    short = notices.show_cause_notice(chosen).first()
    assert short["file_key"] == "notice_Suresh_Patil"
    assert short["notice"].splitlines()[1:3] == [
        "To: Contractor Suresh Patil, Pincode 400053", "This office has received 15 complaints of Wage Theft.",
    ]
    assert "in the past 48 hours" in notices.show_cause_notice(chosen, long=True).first()["notice"]
    assert notices.notice_candidates(df).count() == 1
    assert notices.notice_requests(chosen).filter(F.col("prompt").contains("in 48 hours: 15")).count() == 1


def test_stems_stand_in_every_text_that_matches(spark):
    import re

    words = ["assaulted", "beaten", "hit", "slapped", "struck", "fired", "terminated", "dismissal", "without notice", "unsafe",
             "safety", "helmet", "accident", "wage", "wages", "salary", "money", "paid", "payment", "threats", "beating", "killed", "white"]
    for pattern, stems in [(p, calls.WORD_STEMS[i]) for p, i in calls.ISSUE_PATTERNS] + [
        (calls.VIOLENCE_PATTERN, calls.VIOLENCE_STEMS)
    ]:
        matched = [w for w in words if re.search(pattern, f"he was {w}.")]
        assert matched and all(any(s in w for s in stems) for w in matched)
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "english_text string")
    got = {r.english_text: (r.issue_type, r.violence_threatened) for r in calls.extract_entities(df).collect()}
    for word in words:
        issue = next((i for p, i in calls.ISSUE_PATTERNS if re.search(p, word)), "OTHER")
        assert got[word] == (issue, bool(re.search(calls.VIOLENCE_PATTERN, word)))
    assert got[None] == ("OTHER", False)
