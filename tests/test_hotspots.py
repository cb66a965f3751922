from __future__ import annotations

from pyspark.sql import functions as F

from grievlake.functions.scores import classify_threat, high_priority, score_to_urgency
from grievlake.operators import hotspots, legal, radar, skew
from grievlake.schemas import GOLD, RADAR, SILVER
from grievlake.fixed_values import DEMO_RADAR

# call_id, pincode, contractor, issue, violence, workers
SIX_CALLS = [
    ("1", "400053", "Rajesh", "WAGE_THEFT", False, 3),
    ("2", "400053", "Rajesh", "PHYSICAL_ASSAULT", True, 2),
    ("3", "400053", "Rajesh", "UNSAFE_CONDITIONS", False, 3),
    ("4", "110001", "Suresh", "WAGE_THEFT", False, 15),
    ("5", "560001", "Amit", "WAGE_THEFT", False, 1),
    ("6", "400053", "Prakash", "OTHER", False, 1),
]


def silver_of(spark, calls):
    full = [(c, p, "raw", "english", who, "Site " + c, issue, v, n) for c, p, who, issue, v, n in calls]
    return spark.createDataFrame(full, SILVER)


def test_six_calls_give_the_expected_gold(spark, rows):
    gold = hotspots.build_gold(silver_of(spark, SIX_CALLS))
    assert gold.schema.simpleString() == GOLD.simpleString()
    got = rows(gold, "pincode", "contractor_name", "total_complaints", "total_workers_affected", "violence_flagged",
               "threat_label", "severity_score", "escalate_immediately")
    assert got == [
        ("110001", "Suresh", 1, 15, False, "HIGH", 3, True),
        ("400053", "Prakash", 1, 1, False, "LOW", 1, False),
        ("400053", "Rajesh", 3, 8, True, "HIGH", 9, True),
        ("560001", "Amit", 1, 1, False, "LOW", 1, False),
    ]
    sets = gold.filter("contractor_name = 'Rajesh'").first()
    assert sets["issue_types_reported"] == ["PHYSICAL_ASSAULT", "UNSAFE_CONDITIONS", "WAGE_THEFT"]
    assert sets["work_sites"] == ["Site 1", "Site 2", "Site 3"]


def test_parts_of_batches_add_up(spark, rows):
    calls = SIX_CALLS + [(None, "1", None, None, None, None), ("9", "1", None, "OTHER", None, None)]
    silver = silver_of(spark, [c if c[0] else ("x", *c[1:]) for c in calls]).withColumn(
        "call_id", F.nullif("call_id", F.lit("x"))
    )
    batches = [silver.filter(F.pmod(F.xxhash64("work_site"), F.lit(3)) == n) for n in range(3)] + [silver.limit(0)]
    parts = hotspots.hotspot_parts(batches[0])
    for batch in batches[1:]:
        parts = hotspots.merge_parts(parts.unionByName(hotspots.hotspot_parts(batch)))
    assert rows(hotspots.hotspots_of_parts(parts)) == rows(hotspots.aggregate_hotspots(silver))


def test_nulls_count_as_the_rules_say(spark):
    silver = silver_of(spark, [("1", "1", "A", "OTHER", None, None), ("2", "1", "B", "OTHER", None, 12)])
    gold = {r["contractor_name"]: r for r in hotspots.build_gold(silver).collect()}
    assert gold["A"]["total_workers_affected"] is None and gold["A"]["threat_label"] == "LOW"
    assert gold["A"]["escalate_immediately"] is None
    assert gold["B"]["threat_label"] == "HIGH" and gold["B"]["escalate_immediately"] is True
    assert [r["contractor_name"] for r in high_priority(hotspots.build_gold(silver)).collect()] == ["B"]


def test_threat_boundaries(spark):
    cases = {
        (1, None): "LOW", (1, 4): "LOW", (1, 5): "MEDIUM", (1, 9): "MEDIUM", (1, 10): "HIGH",
        (2, None): "MEDIUM", (2, 4): "MEDIUM", (2, 10): "HIGH", (3, None): "HIGH", (3, 0): "HIGH", (0, 0): "LOW",
    }
    df = spark.createDataFrame(list(cases), "total_complaints long, total_workers_affected long")
    got = {(r[0], r[1]): r[2] for r in classify_threat(df).collect()}
    assert got == cases


def test_four_high_priority_complaints(spark, rows):
    silver = silver_of(spark, SIX_CALLS)
    gold = hotspots.build_gold(silver)
    assert rows(legal.high_priority_complaints(silver, gold), "call_id") == [("1",), ("2",), ("3",), ("4",)]
    assert rows(legal.enrich(silver, gold), "call_id", "threat_label") == [
        ("1", "HIGH"), ("2", "HIGH"), ("3", "HIGH"), ("4", "HIGH"), ("5", "LOW"), ("6", "LOW"),
    ]


def test_salting_changes_no_result(spark, rows, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 7)
    left = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        "id",
    )
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4), ("other", 5)], "k string, v int")
    for how in ("left", "inner"):
        salted = skew.salted_join(left, right, ["k"], how, floor=20)
        assert rows(salted, "k", "id", "v") == rows(left.join(right, ["k"], how), "k", "id", "v")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = skew.hot_keys(counts, ["k"], "n", 20).collect()
    assert {r["k"]: r["_salts"] for r in hot} == {"hot": 20, None: 8}


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan")[0].count("Exchange hashpartitioning")


def test_labels_are_those_of_gold_in_one_shuffle(spark, rows):
    silver = silver_of(spark, SIX_CALLS)
    labels = hotspots.hotspot_labels(silver)
    assert rows(labels) == rows(hotspots.build_gold(silver), *labels.columns)
    assert shuffles(labels) == 1
    assert rows(legal.enrich(silver, labels)) == rows(legal.enrich(silver, hotspots.build_gold(silver)))


def test_hot_keys_cost_no_shuffle(spark, tmp_path):
    """The counts are too large for a broadcast by Spark's own measure; the few hot ones among them are not."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    counts = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 100).alias("_rows"))
    counts.write.parquet(str(tmp_path / "counts"))
    stored = spark.read.parquet(str(tmp_path / "counts"))
    spark.conf.set(threshold, "-1")
    try:
        joined = skew.salted_join(spark.range(50).toDF("k"), stored.select("k"), ["k"], counts=stored, floor=99_000)
        assert shuffles(joined) == 2
    finally:
        spark.conf.set(threshold, before)


def demo(spark):
    return radar.with_urgency(spark.createDataFrame(DEMO_RADAR, RADAR.fieldNames()))


def test_six_radar_rows(spark):
    kpis = radar.radar_kpis(demo(spark)).first()
    assert (kpis["total_complaints"], kpis["critical_zones"], kpis["unique_contractors"], kpis["affected_pincodes"]) == (
        47, 1, 5, 6,
    )
    urgency = [r["urgency"] for r in demo(spark).orderBy(F.desc("total_complaints")).collect()]
    assert urgency == ["CRITICAL", "HIGH", "HIGH", "HIGH", "MEDIUM", "LOW"]


def test_markers(spark):
    by_count = {r["pincode"]: r for r in radar.marker_table(demo(spark)).collect()}
    by_score = {r["pincode"]: r for r in radar.marker_table(demo(spark), "severity_score").collect()}
    first = by_count["400053"]
    assert (first["radius"], first["glow_radius"], first["color"]) == (45.0, 51.0, "#e74c3c")
    assert by_score["400053"]["radius"] == 47.5
    assert first["tooltip"] == "Suresh Patil — 15 complaints"
    assert "Severity: 9.5" in first["popup"]
    tiny = demo(spark).withColumn("total_complaints", F.lit(1))
    assert radar.marker_table(tiny).agg(F.min("radius")).first()[0] == 8.0


def test_radar_filter_and_ranking(spark, rows):
    assert radar.radar_filter(demo(spark), [], ["Wage Theft"]).count() == 0
    chosen = radar.radar_filter(demo(spark), ["CRITICAL", "LOW"], ["Wage Theft"])
    assert rows(chosen, "pincode") == [("380001",), ("400053",)]
    ranked = [r["total_complaints"] for r in radar.radar_ranked(demo(spark)).collect()]
    assert ranked == [15, 11, 8, 6, 4, 3]
    assert rows(radar.filter_values(demo(spark), "primary_issue"))[0] == ("Criminal Intimidation",)


def test_coordinates_and_primary_issue(spark):
    silver = silver_of(spark, SIX_CALLS + [("7", "400053", "Rajesh", "WAGE_THEFT", False, 1)])
    got = {r["contractor_name"]: r for r in radar.build_radar(silver, hotspots.build_gold(silver)).collect()}
    assert got["Rajesh"]["primary_issue"] == "WAGE_THEFT" and (got["Rajesh"]["lat"], got["Rajesh"]["lon"]) == (19.076, 72.8777)
    assert (got["Amit"]["lat"], got["Amit"]["lon"]) == (20.5937, 78.9629)
    tied = radar.primary_issue(silver_of(spark, SIX_CALLS)).filter("contractor_name = 'Rajesh'").first()
    assert tied["primary_issue"] == "PHYSICAL_ASSAULT"


def test_old_radar_columns_are_accepted(spark):
    old = spark.createDataFrame([("A", 400053, 4, 3.5, "x")], "contractor string, pincode int, complaint_count int, score double, issue string")
    row = radar.normalise_radar(old).first()
    assert (row["contractor_name"], row["total_complaints"], row["severity_score"], row["lat"]) == ("A", 4, 3.5, 19.076)


def test_urgency_steps(spark):
    df = spark.createDataFrame([(9.5,), (8.0,), (7.9,), (5.0,), (3.0,), (2.9,), (None,)], "s double")
    got = [r[0] for r in df.select(score_to_urgency("s")).collect()]
    assert got == ["CRITICAL", "CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW", "LOW"]


def test_radar_in_one_pass_equals_the_join(spark, rows):
    silver = silver_of(spark, SIX_CALLS)
    assert rows(radar.radar_from_silver(silver)) == rows(radar.build_radar(silver, hotspots.build_gold(silver)))


def test_radar_from_complaints_does_not_group_by_site(spark, rows):
    calls = SIX_CALLS + [("x", "400053", "Rajesh", None, None, None), ("8", "400053", "Nobody", None, None, None)]
    silver = silver_of(spark, calls).withColumn("call_id", F.nullif("call_id", F.lit("x")))
    radar_rows = radar.radar_from_silver(silver)
    assert rows(radar_rows) == rows(radar.build_radar(silver, hotspots.build_gold(silver)))
    assert radar_rows._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2  # by issue, then by hotspot
