from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from grievlake.fixed_values import DEMO_RADAR, DEMO_SCENARIOS
from grievlake.operators import audit
from grievlake.operators.hotspots import build_gold
from grievlake.schemas import CALLS, CHUNKS, RADAR, SCENARIOS, SCHEMES
from grievlake.sources import readers, sinks, storage, text_files
from grievlake.streaming import jobs
from tests.test_hotspots import SIX_CALLS, silver_of


def write_call(folder, number, text="hello"):
    call = {
        "call_id": number, "pincode": "000000", "hindi_audio_text": text, "timestamp": "2026-03-29T09:23:56.419701",
        "call_duration_seconds": 108, "audio_source": "a b.mp4",
    }
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/call_{number:03d}.json", "w", encoding="utf-8") as out:
        json.dump(call, out, ensure_ascii=False, indent=2)


def test_reruns_take_up_new_files_only(spark, tmp_path):
    folder, table, checkpoint = str(tmp_path / "in"), str(tmp_path / "bronze"), str(tmp_path / "checkpoint")
    write_call(folder, 1)
    write_call(folder, 2, "दो दिन")
    counts = []
    for extra in (None, None, 3):
        if extra:
            write_call(folder, extra)
        jobs.ingest_calls(spark, folder, table, checkpoint)
        counts.append(spark.read.parquet(table).count())
    assert counts == [2, 2, 3]
    assert spark.read.parquet(table).filter("hindi_audio_text = 'दो दिन'").first()["call_id"] == 2


def test_ingest_into_a_catalog_table(spark, tmp_path):
    write_call(str(tmp_path / "in"), 1)
    sinks.reset(spark, "bronze_calls")
    jobs.ingest_calls(spark, str(tmp_path / "in"), "bronze_calls", str(tmp_path / "checkpoint"))
    assert readers.read_table(spark, "bronze_calls").count() == 1
    sinks.reset(spark, "bronze_calls")


def test_written_calls_are_read_back(spark, tmp_path, rows):
    calls = spark.createDataFrame([(1, "1", "a\nb", "t", 3, "s"), (2, "2", None, None, None, None)], CALLS)
    sinks.write_calls(calls.coalesce(1), str(tmp_path / "single"))
    sinks.write_calls(calls, str(tmp_path / "bulk"), lines=True)
    assert rows(readers.read_calls(spark, str(tmp_path / "single"))) == rows(calls)
    assert rows(readers.read_calls(spark, str(tmp_path / "bulk"), lines=True)) == rows(calls)
    assert readers.sample_call(spark, str(tmp_path / "single")).count() == 1


def test_gold_follows_the_stream(spark, tmp_path, rows):
    folder, gold, checkpoint = str(tmp_path / "silver"), str(tmp_path / "gold"), str(tmp_path / "checkpoint")
    assert jobs.read_current_gold(spark, gold).count() == 0
    for part in (SIX_CALLS[:2], SIX_CALLS[2:]):
        sinks.append(silver_of(spark, part), folder)
        stream = jobs.stream_table(spark, folder, silver_of(spark, part).schema)
        jobs.refresh_gold(stream, gold, checkpoint, once=True)
    assert rows(jobs.read_current_gold(spark, gold)) == rows(build_gold(silver_of(spark, SIX_CALLS)))


def test_silver_stream_needs_no_state(spark, tmp_path):
    write_call(str(tmp_path / "in"), 1, "Contractor Ramesh has not paid wages")
    silver = jobs.silver_stream(readers.stream_calls(spark, str(tmp_path / "in")))
    assert silver.isStreaming
    sinks.ingest_bronze(silver, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert spark.read.parquet(str(tmp_path / "out")).first()["contractor_name"] == "Ramesh"


def test_merge_keeps_stored_columns(spark, tmp_path, rows):
    for target in (str(tmp_path / "t"), "merged"):
        sinks.overwrite(spark.createDataFrame([(1, "x")], "id int, note string"), target)
        sinks.overwrite_merge_schema(spark.createDataFrame([(2, 5.0)], "id int, score double"), target)
        assert rows(readers.read_table(spark, target), "id", "score", "note") == [(2, 5.0, None)]
    sinks.reset(spark, "merged")
    sinks.overwrite_merge_schema(spark.createDataFrame([(3,)], "id int"), str(tmp_path / "new"))
    assert readers.read_table(spark, str(tmp_path / "new")).columns == ["id"]


def test_tables_and_defaults(spark, rows):
    sinks.ensure_table(spark, "chunks", CHUNKS)
    sinks.ensure_table(spark, "chunks", CHUNKS)
    assert readers.table_or_default(spark, "chunks", [("c", "t", "s")], CHUNKS).count() == 1
    sinks.append(spark.createDataFrame([("c", "t", "s"), ("d", "t", "s")], CHUNKS), "chunks")
    assert readers.table_or_default(spark, "chunks", [], CHUNKS).count() == 2
    assert readers.table_or_default(spark, "absent", DEMO_RADAR, RADAR_ROWS).count() == 6
    assert readers.table_or_default(spark, "absent", DEMO_SCENARIOS, SCENARIOS).count() == 4
    found = rows(audit.audit_tables(spark, ["chunks", "default.absent"]))
    assert found == [("absent", None, "MISSING", False), ("chunks", 2, "OK", False)]
    assert audit.audit_tables(spark, ["chunks"]).first()["all_good"] is True
    sinks.reset(spark, "chunks")
    assert not spark.catalog.tableExists("chunks")


RADAR_ROWS = RADAR


def test_csv_and_manifest(spark, tmp_path):
    (tmp_path / "schemes.csv").write_text('scheme_name,eligibility,benefits,application,year\nA,"x, ""y""",b,c,2020\n', encoding="utf-8")
    inferred = readers.read_schemes(spark, str(tmp_path / "schemes.csv"))
    assert dict(inferred.dtypes)["year"] == "int" and inferred.first()["eligibility"] == 'x, "y"'
    assert readers.read_schemes(spark, str(tmp_path / "schemes.csv"), SCHEMES).columns == SCHEMES.fieldNames()
    for name in ("a.wav", "b c.MP3", "d.mp3", "e.txt"):
        (tmp_path / name).write_bytes(b"12345")
    files = readers.file_manifest(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r["name"], r["ext"], r["length"]) for r in files] == [("a.wav", "wav", 5), ("d.mp3", "mp3", 5)]


def test_exported_notices(spark, tmp_path, rows):
    df = spark.createDataFrame(
        [("Suresh Patil", "line 1\nline 2"), ("A", "x"), ("M K", "1"), ("M_K", "2"), ("B", "1"), ("B", "2"), (None, "n"),
         ("../up", "u"), ("Z#1 é%20", None)],
        "contractor_name string, notice string").repartition(3)
    others = sinks.write_notices(df, str(tmp_path / "n"))
    found = {p.name: p.read_text() for p in (tmp_path / "n").iterdir()}
    assert found == {"_SUCCESS": "", "notice_Suresh_Patil.txt": "line 1\nline 2", "notice_A.txt": "x", "notice_Z#1_é%20.txt": ""}
    assert rows(others) == sorted([
        ("M K", "notice_M_K"), ("M_K", "notice_M_K"), ("B", "notice_B"), ("B", "notice_B"), (None, None), ("../up", "notice_../up")], key=repr)
    sinks.write_notices(df.filter("contractor_name = 'A'").withColumn("notice", F.lit("new")), str(tmp_path / "n"))
    assert (tmp_path / "n" / "notice_A.txt").read_text() == "new"


def test_notice_files_take_one_pass_over_the_notices(spark):
    df = spark.createDataFrame([("A", "x"), ("M K", "1"), ("M_K", "2"), (None, "n")], "contractor_name string, notice string")
    files, _ = sinks.notice_files(df)
    assert [tuple(r) for r in files.collect()] == [("notice_A.txt", "x")]
    plan = files._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_files_by_name_are_read_whole(spark, tmp_path, rows):
    wanted = [("notice_A.txt", "one\ntwo\n"), ("notice_Z#1_+ é%20.txt", "मज़दूर\r\nx")]
    others = [("other.txt", "o"), ("notice_empty.txt", "")]
    folder = str(tmp_path / "n")
    text_files.write_text_files(spark.createDataFrame([*wanted, *others], "file_name string, value string"), folder)
    assert rows(text_files.read_text_files(spark, folder, "notice_*.txt")) == sorted(wanted, key=repr)


def test_a_repeated_task_leaves_one_whole_file(tmp_path):
    from grievlake.sources.text_files import _OneFilePerRow

    writer = _OneFilePerRow(str(tmp_path))
    rows = [{"file_name": f"notice_{i}.txt", "value": "text " * i} for i in range(5)]

    def broken():
        yield from rows[:3]
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    writer.write(iter(rows))
    writer.commit([])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["_SUCCESS"] + [f"notice_{i}.txt" for i in range(5)]
    assert all((tmp_path / r["file_name"]).read_text() == r["value"] for r in rows)


def test_pages_and_previews(spark, rows, capsys):
    pages = spark.createDataFrame([("d", 1, " a "), ("d", 2, ""), ("d", 3, None)], "doc_id string, page_number long, raw_text string")
    assert rows(readers.clean_pages(pages)) == [("d", 1, "a")]
    sinks.preview(pages, 1)
    assert "page_number: long" in capsys.readouterr().out


def test_staged_rows_stay_in_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    staged = storage.stage(spark.range(3), "numbers")
    assert staged.count() == 3 and folder in staged.inputFiles()[0]


def test_staged_data_goes_when_asked(spark, tmp_path):
    first, second = storage.stage(spark.range(3), "first"), storage.stage(spark.range(4), "second")
    place = os.path.dirname(first.inputFiles()[0].removeprefix("file://"))
    storage.remove(spark, place)
    assert not os.path.exists(place) and second.count() == 4
    with pytest.raises(ValueError, match="not a staged folder"):
        storage.remove(spark, str(tmp_path))
    other = spark.newSession()
    kept = storage.stage(other.range(2), "kept")
    storage.clear(spark)
    assert not os.path.exists(os.path.dirname(second.inputFiles()[0].removeprefix("file://"))) and kept.count() == 2
    storage.clear(other)


def test_without_a_checkpoint_folder_the_warehouse_is_used():
    from types import SimpleNamespace

    class Conf(dict):
        def get(self, key, *default):
            return super().get(key, *default) if default else self[key]

    settings = Conf({"spark.sql.warehouse.dir": "file:/w/", "spark.checkpoint.dir": "hdfs://c/"})
    assert storage.shared_folder(SimpleNamespace(conf=settings)) == "hdfs://c"
    del settings["spark.checkpoint.dir"]
    assert storage.shared_folder(SimpleNamespace(conf=settings)) == "file:/w"


@pytest.mark.parametrize("delay,closed", [("1 hour", 1), ("0 seconds", 2)])
def test_only_closed_windows_are_written(spark, tmp_path, delay, closed):
    rows = [("A", "2026-01-01 05:00:00"), ("A", "2026-01-01 06:00:00"), ("A", "2026-01-03 00:30:00")]
    sinks.overwrite(spark.createDataFrame(rows, "contractor_name string, timestamp string"), str(tmp_path / "in"))
    stream = jobs.stream_table(spark, str(tmp_path / "in"), "contractor_name string, timestamp string")
    jobs.write_counts(jobs.counts_48h_stream(stream, delay=delay), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == closed and {r["complaints"] for r in got} == {2}


def test_calls_without_a_readable_time_count_each_other(spark):
    from grievlake.operators.recency import complaints_48h

    df = spark.createDataFrame(
        [(1, "a", "2024-01-01 10:00:00"), (2, "a", None), (3, "a", "no time"), (4, "b", None), (5, "a", "2024-01-02 10:00:00")],
        "id int, contractor_name string, timestamp string")
    assert {r.id: r.complaints_48h for r in complaints_48h(df).collect()} == {1: 1, 2: 2, 3: 2, 4: 1, 5: 2}


def test_of_several_replies_the_first_that_can_be_read_counts(spark):
    from grievlake.operators.complaints import failed_replies, read_replies

    good, other = '{"contractor_name":"A"}', '{"contractor_name":"B"}'
    df = spark.createDataFrame(
        [("1", "I cannot", 1), ("1", good, 2), ("2", None, 1), ("3", other, 1), ("3", good, 2), ("4", "no", 2), ("4", "nay", 1),
         ("5", other, None), ("5", good, 7)], "call_id string, raw string, attempt int")
    names = lambda read: {r["call_id"]: r["parsed"] and r["parsed"]["contractor_name"] for r in read.collect()}
    assert names(read_replies(df.drop("attempt"))) == {"1": "A", "2": None, "3": "A", "4": None, "5": "A"}
    read = read_replies(df, order="attempt")
    assert names(read) == {"1": "A", "2": None, "3": "B", "4": None, "5": "A"}
    assert sorted(map(tuple, failed_replies(read).collect()), key=repr) == [("2", None), ("4", "nay")]


def test_a_refusal_does_not_beat_the_answer_of_the_second_try(spark):
    from grievlake.operators import complaints, legal

    bronze = spark.createDataFrame([(1, "1", "text")], "call_id long, pincode string, hindi_audio_text string")
    replies = spark.createDataFrame([("1", "I cannot answer"), ("1", '{"contractor_name":"Ravi","issue_type":"WAGE_THEFT"}')], "call_id string, raw string")
    row = complaints.build_silver(bronze, replies=replies).first()
    assert (row["contractor_name"], row["issue_type"]) == ("Ravi", "WAGE_THEFT")
    read = complaints.read_replies(replies)
    assert complaints.build_silver(bronze, replies=read).first() == row
    silver = silver_of(spark, SIX_CALLS)
    answers = spark.createDataFrame([("1", "Error 500"), ("1", '{"bns_sections_cited":["S 1"],"urgency":"LOW"}')], "call_id string, raw string")
    log = {r["call_id"]: r["bns_sections_cited"] for r in legal.build_legal_actions(silver, build_gold(silver), answers).collect()}
    assert log["1"] == "S 1" and log["2"] != "S 1" and len(log) == 4


def test_a_broken_file_is_set_aside_once(spark, tmp_path):
    folder, table, checkpoint = str(tmp_path / "in"), str(tmp_path / "bronze"), str(tmp_path / "checkpoint")
    write_call(folder, 1)
    write_call(folder, 2)
    (tmp_path / "in" / "call_003.json").write_text('{"call_id": 3, "pincode": "00')
    for _ in range(2):
        jobs.ingest_calls(spark, folder, table, checkpoint)
        assert sorted(r["call_id"] for r in spark.read.parquet(table).collect()) == [1, 2]
        reject = spark.read.parquet(f"{table}_rejects").collect()
        assert len(reject) == 1 and reject[0]["path"].endswith("/in/call_003.json")
        assert reject[0]["text"] == '{"call_id": 3, "pincode": "00'
    good, rejects = readers.read_calls_and_rejects(spark, folder)
    assert good.count() == 2 and rejects.select("text").collect() == [(reject[0]["text"],)] and good.columns == CALLS.fieldNames()
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text('{"call_id":1}\n{"call_id":"x","pincode":"9"}\nnot json\n')
    good, rejects = readers.read_calls_and_rejects(spark, str(tmp_path / "lines"), lines=True)
    assert [r["call_id"] for r in good.collect()] == [1] and len(rejects.collect()) == 2


def test_unreadable_tables_are_not_called_missing(spark, tmp_path):
    from grievlake.operators.audit import audit_tables

    (tmp_path / "empty").mkdir()
    spark.range(3).write.parquet(f"{tmp_path}/full")
    got = {r.table_name: (r.rows, r.status) for r in audit_tables(spark, [f"{tmp_path}/{n}" for n in ("full", "empty", "none")]).collect()}
    assert got == {"full": (3, "OK"), "empty": (None, "UNREADABLE"), "none": (None, "MISSING")}


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path, rows):
    folder, gold, checkpoint = (str(tmp_path / n) for n in ("silver", "gold", "checkpoint"))
    schema, files, seen = silver_of(spark, SIX_CALLS[:1]).schema, [], []
    parts = [SIX_CALLS[:3], [SIX_CALLS[4]], [SIX_CALLS[5], ("7", None, None, None, None, None)]]
    for part in parts:
        sinks.append(silver_of(spark, part), folder)
        jobs.refresh_gold(jobs.stream_table(spark, folder, schema), gold, checkpoint, once=True, buckets=64)
        seen += part
        assert rows(jobs.read_current_gold(spark, gold)) == rows(build_gold(silver_of(spark, seen)))
        files.append(set(jobs.read_current_gold(spark, gold).inputFiles()))
    # each hotspot of these calls has a bucket of its own: earlier ones keep their files
    assert files[0] < files[1] and len(files[1] - files[0]) == 1
    assert len(files[1] & files[2]) >= 1 and len(files[2]) > len(files[1])
    # nothing new: no new version
    jobs.refresh_gold(jobs.stream_table(spark, folder, schema), gold, checkpoint, once=True)
    assert set(jobs.read_current_gold(spark, gold).inputFiles()) == files[2]


def test_several_batches_in_one_run_and_a_repeated_batch(spark, tmp_path, rows):
    import shutil

    folder, gold, checkpoint = (str(tmp_path / n) for n in ("silver", "gold", "checkpoint"))
    for call in SIX_CALLS[:4]:
        sinks.append(silver_of(spark, [call]).coalesce(1), folder)
    schema = silver_of(spark, SIX_CALLS[:1]).schema
    jobs.refresh_gold(jobs.stream_table(spark, folder, schema, files_per_trigger=2), gold, checkpoint, once=True, buckets=2)
    want = rows(build_gold(silver_of(spark, SIX_CALLS[:4])))
    assert rows(jobs.read_current_gold(spark, gold)) == want
    count = len(jobs._versions(spark, gold))
    assert count >= 2
    # the stream forgets that it committed its last batch: the repeated batch adds nothing
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    for crc in (tmp_path / "checkpoint" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    jobs.refresh_gold(jobs.stream_table(spark, folder, schema, files_per_trigger=2), gold, checkpoint, once=True, buckets=2)
    assert rows(jobs.read_current_gold(spark, gold)) == want and len(jobs._versions(spark, gold)) == count
    # a list that was not written whole is not followed
    newest = tmp_path / "gold" / "versions" / "batch-99"
    newest.mkdir()
    assert rows(jobs.read_current_gold(spark, gold)) == want
    shutil.rmtree(newest)


def test_a_large_bucket_is_dealt_over_several_tasks(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(jobs, "SLICE_ROWS", 10, raising=False)
    folder, gold, checkpoint = (str(tmp_path / n) for n in ("silver", "gold", "checkpoint"))
    calls = spark.range(200).select(
        F.col("id").cast("string").alias("call_id"), (F.col("id") % 40).cast("string").alias("pincode"),
        F.lit("C").alias("contractor_name"), (F.col("id") % 3).cast("string").alias("issue_type"),
        F.lit("S").alias("work_site"), F.lit(False).alias("violence_threatened"), F.lit(1).alias("worker_count_mentioned"),
    )
    for _ in range(2):
        sinks.append(calls, folder)
        jobs.refresh_gold(jobs.stream_table(spark, folder, calls.schema), gold, checkpoint, once=True, buckets=1)
        seen = spark.read.parquet(folder)
        current = jobs.read_current_gold(spark, gold)
        assert rows(current) == rows(build_gold(seen))
        # a task writes one file of the only bucket: several tasks have shared it
        assert len(current.inputFiles()) > 3


def test_old_gold_versions_go_only_when_asked(spark, tmp_path, rows):
    folder, gold, checkpoint = (str(tmp_path / n) for n in ("silver", "gold", "checkpoint"))
    schema = silver_of(spark, SIX_CALLS[:1]).schema
    for call in SIX_CALLS[:3]:
        sinks.append(silver_of(spark, [call]), folder)
        jobs.refresh_gold(jobs.stream_table(spark, folder, schema), gold, checkpoint, once=True, buckets=1)
    want = rows(jobs.read_current_gold(spark, gold))
    assert jobs.drop_versions(spark, gold, keep=2) == 1
    assert len(list((tmp_path / "gold" / "parts").iterdir())) == 2
    assert jobs.drop_versions(spark, gold, keep=1) == 1
    assert rows(jobs.read_current_gold(spark, gold)) == want


def counts_by_hand(rows, hours=48):
    width = hours * 3600 * 1_000_000
    return {i: sum(k2 == k and (t2 is None if t is None else t2 is not None and t - width <= t2 <= t) for _, k2, t2 in rows)
            for i, k, t in rows}


def test_sliding_counts_equal_a_search_over_all_rows(spark):
    import random

    from pyspark.sql import functions as F

    from grievlake.operators.recency import complaints_48h

    draw, hour = random.Random(4), 3_600_000_000
    times = [None, 0, 1, 48 * hour, 48 * hour + 1, -5] + [draw.randrange(200 * hour) for _ in range(40)]
    rows = [(i, draw.choice(["a", "b", "", None]), draw.choice(times)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, contractor_name string, at long").withColumn("timestamp", F.timestamp_micros("at"))
    got = {r["id"]: r["complaints_48h"] for r in complaints_48h(df.repartition(5)).collect()}
    assert got == counts_by_hand(rows)


def test_one_hour_of_one_key_is_counted_by_several_tasks(spark):
    from pyspark.sql import functions as F

    from grievlake.operators import ordering
    from grievlake.operators.recency import complaints_48h

    df = spark.range(20_000).select(
        F.col("id"), F.lit("busy").alias("contractor_name"), F.timestamp_micros(F.col("id") * 100_000).alias("timestamp"))
    seen = []
    place = ordering.place_sorted
    merged = "spark.sql.adaptive.coalescePartitions.enabled"  # so few rows would be one partition otherwise
    try:
        spark.conf.set(merged, "false")
        ordering.place_sorted = lambda rows, order: seen.append(place(rows, order)) or seen[-1]
        counted = complaints_48h(df)
        assert counted.filter("complaints_48h != id + 1").count() == 0 and counted.count() == 20_000
    finally:
        ordering.place_sorted = place
        spark.conf.unset(merged)
    parts = [r["count"] for r in seen[0].groupBy("_part").count().collect()]
    assert len(parts) >= 3 and max(parts) < 0.6 * sum(parts)


def test_first_items_and_head(spark):
    from pyspark.sql import functions as F

    from grievlake.functions.text import first_items, head

    row = spark.range(1).select(first_items(F.array(F.lit(1), F.lit(2), F.lit(3)), 2).alias("a"), head(F.lit("abc"), 2).alias("b")).first()
    assert (row.a, row.b) == ([1, 2], "ab")


def test_failed_replies_can_be_seen(spark):
    from grievlake.operators import complaints, legal

    df = spark.createDataFrame([("1", '{"contractor_name":"A"}'), ("2", "sorry"), ("3", None), ("4", "```json\n{\"urgency\":\"HIGH\"}\n```")], "call_id string, raw string")
    for part in (complaints, legal):
        assert sorted(r.call_id for r in part.failed_replies(part.read_replies(df)).collect()) == ["2", "3"]
