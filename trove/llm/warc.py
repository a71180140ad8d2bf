"""Operator 11, WARC archives: index first, then byte ranges.

Writing: each task streams its pages into archive files of its own in a shared
folder, one gzip member a record, and hands on an index row per record with
file, offset, length, URL and digest. The index is stored by Spark; a file
counts only through it, so files of failed or repeated tasks are never read.
Equal payloads (SHA-256) of at least ``min_bytes`` are stored once: the row of
the smallest id is the response, the others are revisit records that refer to
it. Which rows revisit is settled on (row number, id, digest) alone; texts are
shuffled at most once, by the unique row number, so a payload that a third of
all pages share crowds no task.

Reading: the wanted rows are picked from the index, dealt out in ranges of
(file, offset), and records that lie close together are read in one request.

The archives and the index lie in ``folder``, which every executor must reach:
a path of the cluster's shared storage as pyarrow.fs understands it (file,
hdfs, s3 or s3a, gs, abfs). The pages must be a stored table, as its rows are
numbered in two passes.

Defined results: a null payload is an empty one; a null URL is written as
about:blank and stays null in the index; rows without an id are archived, and
come last when a response is chosen; rows that repeat id and payload count one
by one, so all but one of them are revisits; empty tables give no archives and
an empty index; extra columns are left behind. Payloads of any length are kept
whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import map_batches

INDEX = ("file string, offset long, length long, url string, payload_digest string, payload_bytes long, "
         "record_type string, page_id long, refers_to long")
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: A file is closed once it is this long.
FILE_BYTES = 1 << 30
#: Records less than GAP bytes apart are read together, up to RANGE bytes at once.
GAP, RANGE = 64 << 10, 8 << 20
#: Compressed bytes for one reading task.
TASK_BYTES = 32 << 20
#: Bytes of payloads in one Arrow batch.
BATCH_BYTES = 8 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(rb"[\x00-\x20\x7F]")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


# ------------------------------------------------------------------ records

def record_id(run: str, row: int) -> bytes:
    return f"<urn:uuid:{uuid.uuid5(uuid.UUID(run), str(row))}>".encode()


def build_record(kind: str, rec_id: bytes, date: str, fields: list[tuple[bytes, bytes]], content_type: bytes, block: bytes) -> bytes:
    """One WARC/1.1 record."""
    head = [(b"WARC-Type", kind.encode()), (b"WARC-Record-ID", rec_id), (b"WARC-Date", date.encode()), *fields,
            (b"Content-Type", content_type), (b"Content-Length", b"%d" % len(block))]
    return b"WARC/1.1\r\n" + b"".join(b"%b: %b\r\n" % f for f in head) + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[bytes, bytes], bytes, bytes]:
    """(WARC fields, HTTP head, payload) of a record; raises on a broken one."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/1."):
        raise ValueError("no WARC record at this place")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    n = int(fields[b"content-length"])
    if len(rest) != n + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("WARC record of another length than it says")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, http, payload


def page_record(run: str, date: str, row: int, page_id, url, digest: str, payload: bytes, target_row, refers_to) -> bytes:
    """A response, or a revisit of the record of ``target_row`` without payload."""
    number = lambda x: b"" if x is None else b"%d" % x
    uri = b"about:blank" if url is None else _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode())
    fields = [(b"WARC-Target-URI", uri), (b"WARC-Payload-Digest", b"sha256:" + digest.encode()), (b"Page-ID", number(page_id))]
    if target_row is not None:
        fields += [(b"WARC-Profile", REVISIT_PROFILE.encode()), (b"WARC-Refers-To", record_id(run, target_row)),
                   (b"Refers-To-Page-ID", number(refers_to))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if target_row is None else "revisit"
    return build_record(kind, record_id(run, row), date, fields, b"application/http; msgtype=response", block + (payload if target_row is None else b""))


class Archive:
    """Appends gzip members to files of a folder; each file starts with a warcinfo record."""

    def __init__(self, folder: str, name: str, run: str, date: str, most: int):
        self.fs, self.folder = file_system(folder)
        self.name, self.run, self.date, self.most = name, run, date, most
        self.out, self.files, self.at, self.file = None, 0, 0, ""

    def append(self, record: bytes) -> tuple[str, int, int]:
        """(file, offset, length) of the stored record."""
        if self.out is None or self.at >= self.most:
            self.close()
            self.file = f"{self.name}-{self.files:05d}.warc.gz"
            self.out, self.at, self.files = self.fs.open_output_stream(f"{self.folder}/{self.file}", compression=None), 0, self.files + 1
            self._put(build_record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>".encode(), self.date, [(b"WARC-Filename", self.file.encode())],
                                   b"application/warc-fields", b"software: trove\r\nformat: WARC File Format 1.1\r\n"))
        return (self.file, *self._put(record))

    def _put(self, record: bytes) -> tuple[int, int]:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = pack.compress(record) + pack.flush()
        self.out.write(data)
        at, self.at = self.at, self.at + len(data)
        return at, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


# ------------------------------------------------------------------ writing

def _revisits(rows: DataFrame, min_bytes: int) -> DataFrame:
    """(row, target_row, refers_to) of the rows whose payload another row keeps."""
    keys = write_scratch(rows.where(F.octet_length("payload") >= min_bytes)
                         .select("row", "page_id", F.sha2("payload", 256).alias("digest")), "warc-keys")
    first = (keys.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first"),
                                        F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    return write_scratch(keys.join(first, "digest").where(F.col("row") != F.col("first.row"))
                         .select("row", F.col("first.row").alias("target_row"), F.col("first.page_id").alias("refers_to")), "warc-revisits")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 100, file_bytes: int = FILE_BYTES, date: datetime | None = None,
                   id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives the pages into ``folder`` and returns the stored index, a row
    (see ``INDEX``) per page."""
    spark = pages.sparkSession
    run = str(uuid.uuid4())
    stamp = (date or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("page_id"),
                        F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    marked = rows.join(_revisits(rows, min_bytes), "row", "left")
    store, at = file_system(folder)
    store.create_dir(at, recursive=True)

    def write(batches):
        context = TaskContext.get()
        archive = Archive(folder, f"part-{context.partitionId():06d}-{uuid.uuid4().hex}", run, stamp, file_bytes)
        try:
            for b in batches:
                out = []
                for row, page_id, url, payload, target, refers in zip(*(b.column(i) for i in range(6))):
                    row, page_id, url, payload, target, refers = (x.as_py() for x in (row, page_id, url, payload, target, refers))
                    digest = hashlib.sha256(payload).hexdigest()
                    place = archive.append(page_record(run, stamp, row, page_id, url, digest, payload, target, refers))
                    out.append((*place, url, digest, len(payload), "response" if target is None else "revisit", page_id, refers))
                yield _batch(out, INDEX)
        finally:
            archive.close()

    index = map_batches(marked.select("row", "page_id", "url", "payload", "target_row", "refers_to"), write, INDEX)
    return write_scratch(index, "warc-index")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    cols = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(cols)], names=[n for n, _ in cols])


# ------------------------------------------------------------------ reading

def byte_ranges(places: list[tuple[str, int, int]], gap: int = GAP, most: int = RANGE) -> Iterator[list[tuple[str, int, int]]]:
    """Groups of sorted (file, offset, length) that one request reads: same
    file, at most ``gap`` bytes between neighbours, ``most`` bytes in all
    unless a single record is longer."""
    held: list[tuple[str, int, int]] = []
    for place in places:
        file, offset, length = place
        if held and (file != held[0][0] or offset - (held[-1][1] + held[-1][2]) > gap or offset + length - held[0][1] > most):
            yield held
            held = []
        held.append(place)
    if held:
        yield held


def read_records(spark: SparkSession, index: DataFrame, folder: str, where: Column | None = None, payloads: bool = True,
                 gap: int = GAP, most: int = RANGE) -> DataFrame:
    """The records of the selected index rows (see ``RECORD``), as the archives
    hold them. The payload digest of every response is computed again; a
    difference raises. A revisit has no payload of its own, but the digest and
    size of the one it refers to."""
    wanted = (index.where(where) if where is not None else index).select("file", "offset", "length")
    total = wanted.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // TASK_BYTES))
    dealt = wanted.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches):
        store, at = file_system(folder)
        opened, source = None, None
        out, size = [], 0
        for b in batches:
            for group in byte_ranges(list(zip(*(c.to_pylist() for c in b.columns))), gap, most):
                if group[0][0] != opened:
                    if source is not None:
                        source.close()
                    opened, source = group[0][0], store.open_input_file(f"{at}/{group[0][0]}")
                start = group[0][1]
                data = memoryview(source.read_at(group[-1][1] + group[-1][2] - start, start))
                for _, offset, length in group:
                    fields, http, payload = parse_record(zlib.decompress(data[offset - start:offset - start + length], 31))
                    out.append(_row(fields, http, payload, payloads))
                    size += len(out[-1][-1] or b"")
                    if size >= BATCH_BYTES:
                        yield _batch(out, RECORD)
                        out, size = [], 0
        if source is not None:
            source.close()
        if out:
            yield _batch(out, RECORD)

    return map_batches(dealt, read, RECORD)


def _row(fields: dict, http: bytes, payload: bytes, with_payload: bool) -> tuple:
    kind = fields[b"warc-type"].decode()
    digest = fields[b"warc-payload-digest"].decode().removeprefix("sha256:")
    said = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    if kind == "response" and (len(payload) != said or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields[b'warc-record-id'].decode()} is not what was written")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    uri = fields[b"warc-target-uri"].decode()
    return (number(b"page-id"), uri, kind, number(b"refers-to-page-id"), said, digest, payload if with_payload and kind == "response" else None)
