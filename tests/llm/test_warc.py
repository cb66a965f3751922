from __future__ import annotations

import gzip
import hashlib
import os

import numpy as np
import pytest

from grievlake.llm import warc


def record(k, payload=b"<p>x</p>", digest=None):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha1:"
        f"{digest or hashlib.sha1(payload).hexdigest()}\r\nContent-Type: application/http; msgtype=response\r\n"
        f"Content-Length: {len(http) + len(payload)}\r\n\r\n"
    )
    return head.encode() + http + payload + b"\r\n\r\n"


def ids(found):
    return [x[4]["record_id"][10:-1] for x in found if x[0] == "record"]


def gaps(found):
    return [x[1:4] for x in found if x[0] == "gap"]


EMPTY = gzip.compress(b"", mtime=0)
RECORDS = [record(k, f"page {k} WARC/1.1\r\nnot a header\r\n".encode() * (k + 1)) for k in range(6)]


def test_plain_file_with_damage():
    good = b"".join(RECORDS)
    assert ids(warc.read_file(good)) == list("012345") and gaps(warc.read_file(good)) == []
    flipped = bytearray(good)
    at = len(RECORDS[0]) + len(RECORDS[1]) - 10
    flipped[at] ^= 1
    found = list(warc.read_file(bytes(flipped)))
    assert ids(found) == list("02345") and gaps(found) == [(-1, len(RECORDS[0]), len(RECORDS[0]) + len(RECORDS[1]))]
    noise = b"garbage" + RECORDS[0] + b"\0\0junk\0" + RECORDS[1][:-9] + RECORDS[2] + RECORDS[3][:40]
    found = list(warc.read_file(noise))
    assert ids(found) == list("02")
    covered = sum(b - a for _, a, b in gaps(found)) + len(RECORDS[0]) + len(RECORDS[2])
    assert covered == len(noise)


def test_gzip_members_with_damage():
    members = [gzip.compress(r) for r in RECORDS]
    raw = b"".join(members)
    assert ids(warc.read_file(raw)) == list("012345")
    broken = bytearray(raw)
    start = len(members[0]) + len(members[1])
    broken[start + len(members[2]) - 12] ^= 255
    found = list(warc.read_file(bytes(broken)))
    assert set("01345") <= set(ids(found))
    # only what stands from the bad byte on is lost of the file
    (place, low, high), = [g for g in gaps(found) if g[0] == -1]
    assert start + len(members[2]) - 12 - warc.CRUMB <= low < high == start + len(members[2])
    cut = members[0] + members[1][: len(members[1]) // 2] + members[2] + members[3][:-4]
    found = list(warc.read_file(cut))
    assert {"0", "2"} <= set(ids(found))
    lost = [g[1:] for g in gaps(found) if g[0] == -1]
    assert 0 < lost[0][0] < lost[0][1] == len(members[0]) + len(members[1]) // 2 and len(lost) <= 2


def test_one_member_for_all_records_gives_what_it_can():
    draw = np.random.default_rng(0)
    many = [record(k, draw.bytes(3000).hex().encode()) for k in range(60)]
    raw = bytearray(gzip.compress(b"".join(many)))
    raw[len(raw) // 2] ^= 255
    found = list(warc.read_file(bytes(raw)))
    assert 20 <= len(ids(found)) < 60 and set(ids(found)) >= {str(k) for k in range(25)} and gaps(found)


@pytest.mark.parametrize("data", [b"", b"no archive at all", b"\x1f\x8b\x08 broken", EMPTY])
def test_files_without_records(data):
    found = list(warc.read_file(data))
    assert ids(found) == [] and (not data or bool(gaps(found)) == (data != EMPTY))


def test_random_damage_never_raises_and_loses_only_what_it_touches():
    good, draw = b"".join(RECORDS), np.random.default_rng(5)
    ends = np.cumsum([len(r) for r in RECORDS])
    for _ in range(200):
        raw, at = bytearray(good), int(draw.integers(len(good)))
        raw[at] = int(draw.integers(256))
        hit = str(int(np.searchsorted(ends, at, "right")))
        assert set(ids(warc.read_file(bytes(raw)))) >= set("012345") - {hit}


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, compression):
    long = "é" * 800
    rows = [(1, "http://a/ b", long), (5, None, long), (3, "http://c", long), (2, "http://d", "short"), (4, "http://e", "short"), (6, "http://f", None),
            (7, "http://g", ""), (8, "http://h", "x" * 999), (9, "http://i", "x" * 999), (10, "http://j", "WARC/1.1\r\nWARC-Type: x\r\n\r\n" * 90),
            (11, "http://k", "z" * 3_000_000), (11, "http://k", "z" * 3_000_000), (None, "http://l", "n" * 1000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string")
    folder = os.path.join(tmp_path, "warc")
    warc.write_archives(pages, folder, compression=compression, records_per_file=3)
    back = warc.read_archives(spark, folder)
    assert back.filter("kind = 'gap'").count() == 0
    got = sorted(((r.page, r.length, r.type, r.other, bytes(r.payload)) for r in back.select(
        warc.page_id("record_id").alias("page"), "length", "type", warc.page_id("refers_to").alias("other"), "payload").collect()), key=repr)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html == long and i != 5
        want.append((i, len(raw), "revisit" if revisit else "response", 5 if revisit else None, b"" if revisit else raw))
    assert got == sorted(want, key=repr)


def test_a_bad_byte_in_an_archive_costs_one_record(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"page {k} " * 40) for k in range(50)], "page_id long, url string, html string").coalesce(1)
    folder = os.path.join(tmp_path, "warc")
    warc.write_archives(pages, folder, bytes_per_file=4000)
    files = sorted(f for f in os.listdir(folder) if f.endswith(".warc.gz"))
    assert len(files) > 5 and not [f for f in os.listdir(folder) if f.startswith("_")]
    for name in files:
        raw = open(os.path.join(folder, name), "rb").read()
        assert len(gzip.decompress(raw)) <= 4000
    raw = bytearray(raw)
    raw[len(raw) // 2] ^= 255
    with open(os.path.join(folder, files[-1]), "wb") as out:
        out.write(raw)
    back = warc.read_archives(spark, folder)
    assert back.filter("kind = 'record'").count() >= 49 and back.filter("kind = 'gap'").count() >= 1


def test_files_of_tasks_that_do_not_count_are_not_moved(tmp_path):
    import pyarrow as pa

    options = {"path": str(tmp_path), "compression": "gzip", "records": "2", "bytes": "100000"}
    batch = pa.RecordBatch.from_pydict({"value": [RECORDS[k].decode()[:-2] for k in range(3)]})
    writer = warc._Archives(options)
    writer.write(iter([batch]))  # a try that was lost
    writer.commit([writer.write(iter([batch])), None])
    files = sorted(os.listdir(tmp_path))
    assert len(files) == 2 and all(f.startswith("part-00000-") for f in files)
    found = [x for f in files for x in warc.read_file(open(tmp_path / f, "rb").read())]
    assert sorted(ids(found)) == ["0", "1", "2"] and gaps(found) == []


def test_empty_table(spark, tmp_path):
    folder = os.path.join(tmp_path, "none")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(spark, folder).count() == 0
