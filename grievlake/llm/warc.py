"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writing goes through a Spark data source whose tasks write files of their own, one gzip member per record and a bounded
number of bytes per file; the files of tasks that count are put in place at the end, so a lost executor leaves none that
is half-written. A record is an HTTP response; of equal payloads of at least ``least_bytes`` only that of
the largest page id is stored, the others are revisit records with the response's headers.

Reading takes files as they are, plain or gzip, one member for all records or one for each. A record is valid
if its headers, length, closing blank lines and SHA-1 agree. After a failed check the reader searches for the
next valid gzip member, or inside a member for the next version line with valid headers, goes on there and
reports the bytes between as a gap. A file is read as one row (at most 2 GB), so ``bytes_per_file`` bounds
what one task holds.

A null html is an empty payload, a null url leaves the target out. Rows that share the largest page id of
equal payloads are all responses. A null page id counts as smaller than any other. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

LEAST_BYTES, RECORDS_PER_FILE, BYTES_PER_FILE = 1000, 10_000, 64 << 20
WRITING = "_writing"
#: Every page gets this date unless another is given: archives of the same rows are then the same.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def with_roles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``pages`` plus ``_payload``, ``_bytes``, ``_digest`` and ``_refers`` (the response's id; null for responses)."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    sized = pages.withColumns({
        "_payload": payload, "_bytes": F.octet_length(payload), "_digest": F.sha1(payload.cast("binary")),
    })
    # copies are counted before the join, which leaves a group of many copies to adaptive splitting
    groups = (
        sized.filter(F.col("_bytes") >= least_bytes).groupBy("_digest")
        .agg(F.max(id_col).alias("_latest"), F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
        .select(F.col("_digest").alias("_key"), "_latest")
    )
    large = F.when(F.col("_bytes") >= least_bytes, F.col("_digest"))
    joined = sized.withColumn("_own", large).join(groups, F.col("_own") == F.col("_key"), "left")
    refers = F.when(~F.col(id_col).eqNullSafe(F.col("_latest")), F.col("_latest"))
    return joined.withColumn("_refers", refers).drop("_own", "_key", "_latest")


def record_text(id_col: str, url_col: str, date: str) -> Column:
    """A record up to the first of the two line ends that close it."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("_bytes").cast("string"), F.lit(END + END),
    )
    revisit = F.col("_refers").isNotNull()
    block_bytes = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("_bytes"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7F]", "%20")
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(END))
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col(id_col))), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", name(F.col("_refers"))), line("WARC-Profile", F.lit(PROFILE)),
        )).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block_bytes.cast("string")),
        F.lit(END), http, F.when(revisit, F.lit("")).otherwise(F.col("_payload")), F.lit(END),
    )


class _Archives(DataSourceArrowWriter):
    """Each task writes files of its own under names of their own; only those of tasks that count are moved to their
    places in the end."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.packed = options["path"], options["compression"] == "gzip"
        self.records, self.bytes = int(options["records"]), int(options["bytes"])

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, base = self._open()
        files.create_dir(f"{base}/{WRITING}")
        names, out, records, held = [], None, 0, 0
        for batch in iterator:
            for value in batch.column(0):
                record = value.as_py().encode() + END.encode()
                if out is not None and (records >= self.records or held + len(record) > self.bytes):
                    out.close()
                    out = None
                if out is None:
                    names.append(uuid.uuid4().hex + (".warc.gz" if self.packed else ".warc"))
                    out, records, held = files.open_output_stream(f"{base}/{WRITING}/{names[-1]}", compression=None), 0, 0
                # a member for each record: a bad byte costs one record, and readers need not inflate a whole file
                out.write(gzip.compress(record, 6, mtime=0) if self.packed else record)
                records, held = records + 1, held + len(record)
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = self._open()
        files.create_dir(f"{base}/{WRITING}")
        for task, message in enumerate(messages):
            for name in message.names if message else ():
                files.move(f"{base}/{WRITING}/{name}", f"{base}/part-{task:05d}-{name}")
        files.delete_dir(f"{base}/{WRITING}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = self._open()
        files.create_dir(f"{base}/{WRITING}")
        files.delete_dir(f"{base}/{WRITING}")


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class Archives(DataSource):
    """Format of rows (value): option ``path`` names a folder that pyarrow's file systems reach."""

    @classmethod
    def name(cls) -> str:
        return "warc_archives"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Archives(dict(self.options))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = LEAST_BYTES, records_per_file: int = RECORDS_PER_FILE, bytes_per_file: int = BYTES_PER_FILE,
    compression: str = "gzip", date: str = DATE,
) -> None:
    """One record per row under ``path``. ``compression``: gzip (one member per record) or none. A file ends before it
    has more than ``bytes_per_file`` bytes of records, unless a single record has more."""
    records = with_roles(pages, id_col, html_col, least_bytes).select(record_text(id_col, url_col, date).alias("value"))
    pages.sparkSession.dataSource.register(Archives)
    (
        records.write.format("warc_archives").mode("append").option("path", path).option("compression", compression)
        .option("records", records_per_file).option("bytes", bytes_per_file).save()
    )


VERSION = re.compile(rb"WARC/\d\.\d\r?\n(?=[A-Za-z-]+:)")
HEAD_END = re.compile(rb"\r?\n\r?\n")
MAGIC = b"\x1f\x8b\x08"


def parse_head(head: bytes) -> dict[str, str]:
    out = {}
    for row in head.splitlines():
        key, colon, value = row.partition(b":")
        if colon:
            out[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def read_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at ``at`` and where it ends, or None, ``at`` and what is wrong."""
    version = VERSION.match(data, at)
    if not version:
        return None, at, "no version line"
    head = HEAD_END.search(data, version.end() - 1)
    if not head:
        return None, at, "headers do not end"
    fields = parse_head(data[version.end(): head.start()])
    size = fields.get("content-length", "")
    if not size.isdigit():
        return None, at, "no length"
    if not (fields.get("warc-type") and fields.get("warc-record-id")):
        return None, at, "no type or id"
    start, end = head.end(), head.end() + int(size)
    if end > len(data):
        return None, at, "cut off"
    close = re.compile(rb"\r\n\r\n|\n\n").match(data, end)
    if not close:
        return None, at, "no closing lines"
    block, payload, http = memoryview(data)[start:end], None, {}
    payload_at = start
    if fields.get("content-type", "").startswith("application/http"):
        inner = HEAD_END.search(data, start, end)
        if inner:
            http, payload_at = parse_head(data[start: inner.start()]), inner.end()
    payload = memoryview(data)[payload_at:end]
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:").lower()
    revisit = fields.get("warc-type") == "revisit"
    if not revisit and len(stated) == 40 and hashlib.sha1(payload).hexdigest() != stated:
        return None, at, "payload digest differs"
    whole = fields.get("warc-block-digest", "").removeprefix("sha1:").lower()
    if len(whole) == 40 and hashlib.sha1(block).hexdigest() != whole:
        return None, at, "block digest differs"
    length = int(http["content-length"]) if http.get("content-length", "").isdigit() else len(payload)
    return {
        "type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"), "digest": stated or hashlib.sha1(payload).hexdigest(),
        "length": length if revisit else len(payload), "payload": payload,
    }, close.end(), ""


def salvage(data: bytes, member: int) -> Iterator[tuple]:
    """Records and gaps of plain bytes: ("record", member, start, end, fields) or ("gap", member, start, end, why)."""
    at = 0
    while at < len(data):
        record, end, why = read_record(data, at)
        if record:
            yield "record", member, at, end, record
            at = end
            continue
        start = at
        while record is None:
            following = VERSION.search(data, at + 1)
            if not following:
                at = len(data)
                break
            at = following.start()
            record, _, _ = read_record(data, at)
        yield "gap", member, start, at, why


#: Compressed bytes given to the decoder at a time; after an error the last of them are given again in crumbs.
PIECE, CRUMB = 1 << 16, 16


def inflate(raw: bytes, at: int) -> tuple[bytes, int, str]:
    """The member at ``at``: its bytes (as far as they go), where it ends or cannot be read any more, and what is wrong."""
    member, parts, place = zlib.decompressobj(31), [], at
    while not member.eof:
        piece = raw[place: place + PIECE]
        if not piece:
            return b"".join(parts), len(raw), "member cut off"
        before = member.copy()
        try:
            parts.append(member.decompress(piece))
        except zlib.error as error:
            for k in range(0, len(piece), CRUMB):
                try:
                    parts.append(before.decompress(piece[k: k + CRUMB]))
                except zlib.error:
                    return b"".join(parts), place + k, f"bad member: {str(error)[:60]}"
        place += len(piece)
    return b"".join(parts), place - len(member.unused_data), ""


def next_member(raw: bytes, at: int) -> int:
    """Start of the next member after ``at`` that can be read and holds a record."""
    while (at := raw.find(MAGIC, at + 1)) >= 0:
        data, _, why = inflate(raw, at)
        if VERSION.match(data) and (not why or read_record(data, 0)[0]):
            return at
    return len(raw)


def read_file(raw: bytes) -> Iterator[tuple]:
    """Records and gaps of a whole file. In gzip files gaps of member -1 are bytes of the file itself, others bytes of
    the member as far as it could be inflated; what stands before a member's bad byte and was recovered is in neither."""
    if raw[:2] != MAGIC[:2] and (VERSION.match(raw) or MAGIC not in raw):
        yield from salvage(raw, -1)
        return
    at = 0
    while at < len(raw):
        data, end, why = inflate(raw, at) if raw.startswith(MAGIC, at) else (b"", at, "no member")
        yield from salvage(data, at)
        if why:
            following = next_member(raw, at)
            # a member that is cut off may have taken in the start of the next one; decoders look ahead a little
            yield "gap", -1, max(at, min(end, following) - CRUMB), following, why
            end = following
        at = end


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of all archives under ``path``: ``kind`` is record or gap. ``member`` is the place of the gzip member
    in the file (-1: none), ``start`` and ``after`` are bytes inside it. Records have the other columns, gaps ``reason``."""
    names = ("kind", "path", "member", "start", "after", "reason", "type", "record_id", "target_uri", "refers_to", "digest", "length", "payload")
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
    flush_bytes = 8 << 20

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1), strict=True):
                where, rows, held = where.as_py(), [], 0
                for kind, member, start, end, rest in read_file(content.as_py()):
                    if kind == "gap":
                        rows.append((kind, where, member, start, end, rest, *[None] * 7))
                    else:
                        payload = bytes(rest["payload"]) if with_payload else None
                        held += len(payload or b"")
                        rows.append((kind, where, member, start, end, None, *[
                            rest[k] for k in ("type", "record_id", "target_uri", "refers_to", "digest", "length")], payload))
                    if held > flush_bytes or len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    schema = ", ".join(f"{n} {'bigint' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}" for n, t in zip(names, kinds, strict=True))
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def page_id(record_id: str) -> Column:
    """The number in a record id of ``write_archives``."""
    return F.expr(f"try_cast(regexp_extract({record_id}, '^<urn:page:(.*)>$', 1) AS BIGINT)")
