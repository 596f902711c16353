"""WARC archives with a two-level capture index.

Pages become WARC records, one gzip member each, in one archive per task. Of records whose payloads are equal and long enough,
one is the response and the others revisit it without a payload of their own. The index has a line per record, sorted by the
reversed-host form of its address, in compressed blocks; a directory per index part keeps the first key, place and size of
each block, and a manifest the first key of each part. A look-up bisects manifest and directory, reads one block, then the
bytes of the record alone. Reading many addresses back goes the same way: their keys are bisected in manifest and directories,
and the blocks found are spread over tasks, each of which reads its blocks and then the ranges that they name.

Archives and index parts are named by task and attempt, and only what an attempt itself returns refers to its files, so a task
that runs twice leaves a file that nothing reads. All of them are in the folder shared by driver and executors and are reached
through its file system's interface, not as local files.

Pages whose html is null have an empty payload; those whose url is null or no address at all are kept under what is there. A
null page_id never becomes the one to refer to. Repeated rows with the greatest page_id of their payload are all responses.
Payloads of any length are written and read one by one. Other columns of ``pages`` are not read, whatever their names; an empty
table gives no archive and no index.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import durable, new_path

#: Payloads below this size are stored again and again: a revisit record would save nothing.
LEAST_SHARED = 1000
BLOCK_LINES = 512
#: Payloads that occur twice are broadcast up to this number of them; bytes of archives that a task reads back, about.
BROADCAST_PAYLOADS, TASK_BYTES = 500_000, 16 << 20
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for addresses in RFC 4122
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None) -> str:
    """The address as a sort key: host labels from the top domain down, then the path, without scheme and user."""
    text = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", (url or "").strip())
    try:
        parts = urlsplit(text if "//" in text else f"//{text}")
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return f"){text}"
    labels = ",".join(reversed([x for x in host.split(".") if x]))
    labels += f":{port}" if port not in (None, 80, 443) else ""
    return f"{labels}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed. ``refers_to`` set: a revisit, whose block has the headers only."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", (url or "").strip()) or "about:blank"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's block does not end where its length says")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    page = int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None
    if fields["WARC-Type"] == "response":
        digest = hashlib.sha1(payload).hexdigest()
        if base64.b32encode(bytes.fromhex(digest)).decode() != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
            raise ValueError("the payload is not what its digest says")
        return page, len(payload), digest, "response", None
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    return page, length, digest, "revisit", int(fields["X-Refers-To-Page-Id"])


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _own_name(kind: str) -> str:
    task = TaskContext.get()
    return f"{kind}-{task.partitionId():06d}-{task.taskAttemptId()}"


def write_archives(pages: DataFrame, uri: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``uri``; returns a row per record: surt, page_id, file, offset, size."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    shared = rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = durable(shared, "payloads")
    few = shared.count() <= BROADCAST_PAYLOADS  # then the pages stay where they are
    rows = rows.join(F.broadcast(shared) if few else shared, "digest", "left").withColumn("refers_to", F.expr("if(first is not null and not (page_id <=> first), first, null)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(uri)
        name = _own_name("archive") + ".warc.gz"
        fs.create_dir(root, recursive=True)
        at = 0
        out = None
        try:
            for batch in batches:
                made = []
                for i in range(batch.num_rows):
                    page_id, url, payload, digest, refers_to = (c[i].as_py() for c in batch.columns)
                    raw = gzip.compress(make_record(page_id, url, payload, digest, refers_to, date), 6, mtime=0)
                    out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(raw)
                    made.append((surt(url), page_id, name, at, len(raw)))
                    at += len(raw)
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()])], names=["surt", "page_id", "file", "offset", "size"])
        finally:
            if out:
                out.close()

    written = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "surt string, page_id long, file string, offset long, size long")
    return durable(written, "captures")


def write_index(captures: DataFrame, uri: str, block_lines: int = BLOCK_LINES) -> None:
    """Sort the captures and write blocks, a directory for each index part, and the manifest below ``uri``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(uri)
        name = _own_name("index")
        fs.create_dir(root, recursive=True)
        blocks: list[tuple[str, int, int]] = []
        lines: list[str] = []
        at, first, out = 0, "", None

        def close_block() -> None:
            nonlocal at, out
            raw = zlib.compress("".join(lines).encode(), 6)
            out = out or fs.open_output_stream(f"{root}/{name}.blocks")
            out.write(raw)
            blocks.append((first, at, len(raw)))
            at += len(raw)
            lines.clear()

        for batch in batches:
            for key, page_id, file, offset, size in zip(*(c.to_pylist() for c in batch.columns)):
                first = first if lines else key
                lines.append(f"{key} {json.dumps([page_id, file, offset, size])}\n")
                if len(lines) == block_lines:
                    close_block()
        if lines:
            close_block()
        if not blocks:
            return
        out.close()
        with fs.open_output_stream(f"{root}/{name}.dir") as directory:
            directory.write("".join(f"{k} {a} {n}\n" for k, a, n in blocks).encode())
        yield pa.RecordBatch.from_arrays([pa.array([blocks[0][0]]), pa.array([name])], names=["first", "part"])

    order = ["surt", "page_id", "file", "offset"]
    ranged = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    # what an attempt wrote counts only if its row was committed; a row per index part
    parts = durable(ranged.mapInArrow(run, "first string, part string"), "parts").orderBy("first", "part").collect()
    fs, root = _open(uri)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest") as out:
        out.write("".join(f"{r.first} {r.part}\n" for r in parts).encode())


def _read(fs: pafs.FileSystem, path: str, offset: int, size: int) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return f.read(size)


def _block_lines(raw: bytes) -> list[tuple[str, list]]:
    return [(k, json.loads(v)) for k, v in (x.split(" ", 1) for x in zlib.decompress(raw).decode().split("\n") if x)]


RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class Index:
    """Manifest and directories of an index, of which the last directory is kept."""

    def __init__(self, uri: str):
        self.fs, self.root = _open(uri)
        self.parts = self._table("manifest", 1)
        self.part, self.blocks = "", []

    def _table(self, name: str, numbers: int) -> list[list[str]]:
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return [x.rsplit(" ", numbers) for x in f.read().decode().split("\n") if x]

    def locate(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Part, place and size of the blocks that can hold a key: bisect the manifest, then directories."""
        for _, part in self.parts[max(0, bisect.bisect_left(self.parts, key, key=lambda x: x[0]) - 1) :]:
            if part != self.part:
                self.part, self.blocks = part, self._table(f"{part}.dir", 2)
            if self.blocks[0][0] > key:
                return
            for first, offset, size in self.blocks[max(0, bisect.bisect_left(self.blocks, key, key=lambda x: x[0]) - 1) :]:
                if first > key:
                    return
                yield part, int(offset), int(size)

    def lines(self, part: str, offset: int, size: int) -> list[tuple[str, list]]:
        return _block_lines(_read(self.fs, f"{self.root}/{part}.blocks", offset, size))


def find_blocks(urls: DataFrame, index_uri: str) -> DataFrame:
    """part, offset, size: the index blocks that can hold the addresses ``urls`` (url), each block once.

    Keys come sorted, so a task reads few directories, and each of them once.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(0).to_pylist()], pa.string())], names=["surt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or Index(index_uri)
            found = sorted({b for key in batch.column(0).to_pylist() for b in index.locate(key)})
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 3, [pa.string(), pa.int64(), pa.int64()])], names=["part", "offset", "size"])

    asked = durable(urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(keys, "surt string").distinct(), "keys")
    return asked.repartitionByRange("surt").sortWithinPartitions("surt").mapInArrow(run, "part string, offset long, size long").distinct()


def read_blocks(blocks: DataFrame, archive_uri: str, index_uri: str, tasks: int) -> DataFrame:
    """The records that index blocks name, parsed and checked against their digests, by so many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, archives = _open(archive_uri)
        index = None
        for batch in batches:
            index = index or Index(index_uri)
            for part, offset, size in zip(*(c.to_pylist() for c in batch.columns)):
                places = sorted(v[1:] for _, v in index.lines(part, offset, size))
                rows, file, name = [], None, ""
                try:
                    for where, at, n in places:
                        if where != name:
                            if file:
                                file.close()
                            file, name = fs.open_input_file(f"{archives}/{where}"), where
                        file.seek(at)
                        rows.append(parse_record(gzip.decompress(file.read(n))))
                finally:
                    if file:
                        file.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])], names=[x.split()[0] for x in RECORD_SCHEMA.split(", ")])

    # a number given is kept; one by hash would be coalesced, since the rows are few and small
    return blocks.select("part", "offset", "size").repartition(tasks).mapInArrow(run, RECORD_SCHEMA)


def look_up(archive_uri: str, index_uri: str, url: str) -> list[tuple[int | None, int, str, str, int | None]]:
    """The records of one address: bisect the manifest, then directories, then read the blocks and ranges that can hold it."""
    index, found = Index(index_uri), []
    fs, archives = _open(archive_uri)
    key = surt(url)
    for block in index.locate(key):
        lines = index.lines(*block)
        for k, (_, file, at, n) in lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) :]:
            if k != key:
                break
            found.append(parse_record(gzip.decompress(_read(fs, f"{archives}/{file}", at, n))))
    return found


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives and an index in the shared folder, then read the records of all their addresses back."""
    archive_uri, index_uri = new_path(spark, "warc"), new_path(spark, "index")
    captures = write_archives(pages, archive_uri)
    write_index(captures, index_uri)
    blocks = durable(find_blocks(pages, index_uri), "blocks")
    size = captures.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, min(blocks.count(), max(size // TASK_BYTES, spark.sparkContext.defaultParallelism)))
    return read_blocks(blocks, archive_uri, index_uri, tasks)
