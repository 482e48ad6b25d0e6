"""WARC archives: a writer, and a reader that splits gzip members by byte ranges."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm import text as X
from halocline.session import cut, scratch, shared_dir

MAGIC = b"\x1f\x8b\x08"
#: What a record's content begins with.
HEAD = b"WARC/1."
SPLIT_BYTES = 4 << 20
READ_BYTES = 128 << 10
DAMAGED = "damaged"
#: Payloads under this size are always stored.
LEAST_REVISIT = 100
#: Up to so many repeated payloads are broadcast (under 100 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = [("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary())]
SCHEMA = "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"


def record(page: int | None, url: str | None, payload: bytes, digest: str, length: int, refers: int | None, date: str) -> bytes:
    """One gzip member. A revisit has the HTTP head only, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > "\x20" and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    coder = zlib.compressobj(3, zlib.DEFLATED, 31)
    return coder.compress("\r\n".join(head).encode() + b"\r\n\r\n") + coder.compress(block) + coder.compress(b"\r\n\r\n") + coder.flush()


def plan_revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, url, payload (null for a revisit), digest, length, refers_to."""
    raw = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"), raw.alias("payload"), F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("long").alias("length"))
    firsts = rows.where(F.col("length") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    firsts = cut(firsts)
    few = firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = rows.join(F.broadcast(firsts) if few else firsts, "digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    return met.withColumn("refers_to", refers).select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "length", "refers_to")


def write(pages: DataFrame, folder: str, page_id: str = "page_id", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row below ``folder`` (a URI that executors share); returns (path, bytes, records) of the files.

    A file's name has its task attempt, and only attempts that Spark accepts are
    in the returned table: leavings of a lost executor are never read. Null html
    is an empty payload; a null id is kept as empty; among equal payloads of 100
    bytes or more every row with the smallest non-null id is a response, the
    others revisit it (a null id too); an empty table writes no file; other
    columns are not read.
    """
    X.small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        path = f"{base}/part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.warc.gz"
        out, size, n = None, 0, 0
        for batch in batches:
            for page, url, payload, digest, length, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                member = record(page, url, payload or b"", digest, length, refers, date)
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    return cut(plan_revisits(pages, page_id, html).mapInArrow(run, "path string, bytes long, records long"))


class _Window:
    """Bytes of a file by offset, through one buffered range."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, at: int) -> memoryview:
        """From ``at`` on, READ_BYTES or what there is."""
        if not self.at <= at < self.at + len(self.data) or self.at + len(self.data) - at < min(64, self.size - at):
            self.at, self.data = at, self.file.read_at(min(READ_BYTES, self.size - at), at)
        return memoryview(self.data)[at - self.at :]


def _member(window: _Window, at: int) -> tuple[bytes | None, int] | None:
    """(content, end) of the gzip member at ``at``, if its head decodes to that of a WARC record; content is None if the rest is cut off or damaged."""
    first, coder, head = at, zlib.decompressobj(31), b""
    try:
        while len(head) < len(HEAD) and not coder.eof and at < window.size:
            piece = window.get(at)
            head += coder.decompress(piece, len(HEAD) - len(head))
            at += len(piece) - len(coder.unconsumed_tail) - len(coder.unused_data)
            if not HEAD.startswith(head):
                return None
    except zlib.error:
        return None
    if head != HEAD:
        return None
    parts = [head]
    try:
        while not coder.eof and at < window.size:
            piece = window.get(at)
            parts.append(coder.decompress(piece))
            at += len(piece) - len(coder.unused_data)
        parts.append(coder.flush())
    except zlib.error:
        return None, first + len(MAGIC)
    return (b"".join(parts), at) if coder.eof else (None, first + len(MAGIC))


def _fields(head: bytes) -> dict[str, str]:
    rows = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in rows}


def parse(content: bytes | None) -> tuple:
    """(type, id, uri, refers to, digest, payload length, payload) of a record; of a damaged one only the type, ``damaged``."""
    if content is None:
        return DAMAGED, *[None] * 6
    head, _, rest = content.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = warc["warc-type"] == "revisit"
    length = int(_fields(http).get("content-length", 0)) if revisit else len(payload)
    bare = lambda k: warc[k].strip("<>") if k in warc else None
    return warc["warc-type"], bare("warc-record-id"), warc.get("warc-target-uri"), bare("warc-refers-to"), warc.get("warc-payload-digest"), length, None if revisit else payload


def members(window: _Window, start: int, end: int) -> Iterator[tuple[int, bytes | None]]:
    """(offset, content) of the records that start in [start, end); a damaged one has no content, and what follows its magic is searched again."""
    at = start
    while at < end:
        piece = bytes(window.get(at)[: end - at + len(MAGIC) - 1])
        found = piece.find(MAGIC)
        if found < 0:
            at += max(1, len(piece) - len(MAGIC) + 1)
            continue
        at += found
        got = _member(window, at) if at < end else None
        if got:
            yield at, got[0]
            at = got[1]
        else:
            at += 1


def read(files: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """The records of ``files`` (path, bytes), a task for each range of ``split`` bytes; a record belongs to the range its member starts in.

    A record that is cut off or damaged is a row of type ``damaged`` with its
    path and offset and nulls. Other columns of ``files`` are not read; repeated
    files give their records again; empty files and an empty table give none. A
    record of any length is read by the one task that owns its start.
    """
    spark = files.sparkSession
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    store = shared_dir(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(store) if "://" in store or store.startswith("file:") else (pafs.LocalFileSystem(), None)
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(path) as file:
                    rows, held = [], 0
                    for at, content in members(_Window(file, size), start, min(size, start + split)):
                        rows.append((path, at, *parse(content)))
                        held += len(content or b"")
                        if held > X.BLOCK_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return ranges.repartition(int(min(n, 20_000))).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), COLUMNS)], names=[n for n, _ in COLUMNS])


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives, as a URI in the scratch folder."""
    store = scratch(spark)
    return f"{store if ':' in store else 'file://' + store}/warc-{uuid.uuid4().hex}"
