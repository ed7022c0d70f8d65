"""WARC archives: a deterministic sharded writer and a reader."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm.common import Workspace, arrow_map, byte_slices, cut_points, deal, open_fs, order_key, text_column, whole_number, write_file

#: Payloads below this many bytes are written again rather than referred to.
LEAST_SHARED = 1000
ROLL_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "manifest.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 6
CRLF = b"\r\n"


def _member(record: bytes, level: int) -> bytes:
    """One gzip member, with no name or time in its header."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def _sha1(data: bytes) -> tuple[str, str]:
    digest = hashlib.sha1(data).digest()
    return digest.hex(), "sha1:" + base64.b32encode(digest).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def _record_id(key: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{key}/{digest}'.encode()).hexdigest()[:32])}>"


def record(key: str | None, url: str, payload: bytes, date: str, refers_to: tuple[str, str] | None) -> bytes:
    """A response record, or a revisit of ``refers_to`` (key and URL of the response), with fresh headers and digests."""
    payload_hex, payload_digest = _sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {_record_id(key or '', payload_hex)}", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {url}")
    head += [f"WARC-Payload-Digest: {payload_digest}", f"WARC-Block-Digest: {_sha1(block)[1]}"]
    if key is not None:
        head.append(f"X-Page-ID: {quote(key)}")
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to[0], payload_hex)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {quote(refers_to[0])}"]
        if refers_to[1]:
            head.append(f"WARC-Refers-To-Target-URI: {refers_to[1]}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


class _Roller:
    """Writes members to numbered files of about ``roll`` compressed bytes, each renamed to its name once whole."""

    def __init__(self, folder: str, part: int, roll: int) -> None:
        self.store, self.path = open_fs(folder)
        self.part, self.roll, self.attempt = part, roll, uuid.uuid4().hex
        self.done: list[dict] = []
        self.out = None

    def add(self, member: bytes) -> None:
        if self.out and self.size + len(member) > self.roll:
            self.close()
        if not self.out:
            self.name = f"part-{self.part:06d}-{len(self.done):05d}.warc.gz"
            self.out, self.size, self.count, self.sum = self.store.open_output_stream(f"{self.path}/{self.name}.tmp-{self.attempt}"), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sum.update(member)
        self.size += len(member)
        self.count += 1

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.store.move(f"{self.path}/{self.name}.tmp-{self.attempt}", f"{self.path}/{self.name}")
            self.done.append({"file": self.name, "bytes": self.size, "records": self.count, "sha256": self.sum.hexdigest()})
            self.out = None


def write_warc(spark: SparkSession, df: DataFrame, folder: str | None = None, roll_bytes: int = ROLL_BYTES, least_shared: int = LEAST_SHARED, date: str = DATE, level: int = LEVEL, page_id: str = "page_id", url: str = "url", payload: str = "html") -> str:
    """Write one record per row, in order of page_id, and return the folder's URI.

    Of the rows with one payload of ``least_shared`` bytes or more, that with the
    largest page_id is the response and the others revisit it.  One pass over the
    payloads writes a narrow table of digests; the first record of each digest is
    counted from it (combined before the shuffle) and written, so that the join that
    finds the revisits stands on plain exchanges, whose skewed partitions Spark splits:
    a payload in a third of the pages is many tasks.  Pages and the notes of what they
    revisit are then dealt by cut points of (page_id, hash of the payload), sorted
    together, and each range streams its records to files that roll by compressed size.

    Cut points, order, record ids, digests and headers depend on the rows alone, the
    date is given and gzip members carry no time: the same rows give the same bytes,
    however they were partitioned.  A file is renamed from a temporary name when
    whole, a partition's manifest follows its files, and the folder's manifest, which
    names every file with its size and checksum, is written last.

    Whole-number ids are in order of number, others of their text; both come back as
    they were.  A null payload is empty; a null URL leaves the target out; a null
    page_id is written without an id, sorts first and revisits like any other (it is
    never a response if another page has the payload).  Rows that repeat the largest
    page_id of a payload are all responses.  An empty table gives a manifest without
    files.  A payload of any length is one record, held whole by its task.  Further
    columns are not read.  Without ``folder`` the archive lies in the run's workspace,
    which is removed when the driver ends.
    """
    ws = Workspace(spark, "warc")
    folder = folder or ws.mkdir("archive")
    kind, sorted_as = df.schema[page_id].dataType, "bigint" if whole_number(df.schema[page_id].dataType) else "string"
    pages = df.select(order_key(df, page_id).alias("key"), text_column(df, url).alias("url"), text_column(df, payload).alias("payload"))
    tie, size = F.xxhash64("payload"), F.octet_length("payload").cast("long")
    digests = ws.cut(pages.select("key", tie.alias("tie"), "url", size.alias("bytes"), F.when(size >= least_shared, F.sha1(F.encode("payload", "UTF-8"))).alias("digest")), "digests")
    shared = digests.where(F.col("digest").isNotNull())
    first = ws.cut(shared.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("key", "url")).alias("first")).where("n > 1"), "first")
    notes = shared.join(first, "digest").where(~F.col("key").eqNullSafe(F.col("first.key")))
    notes = notes.select("key", "tie", F.col("first.url").alias("url"), F.lit(None).cast("string").alias("payload"), "digest", F.col("first.key").cast("string").alias("refers_to"))
    nothing = F.lit(None).cast("string")
    both = pages.select("key", tie.alias("tie"), "url", "payload", nothing.alias("digest"), nothing.alias("refers_to")).unionByName(notes)
    points = cut_points(digests.select("key", "tie", (F.col("bytes") + 64).alias("bytes")))
    placed = deal(both, points, sorted_as).sortWithinPartitions("key", "tie", F.col("payload").isNotNull(), "url", "payload").select("key", "tie", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        roller = _Roller(folder, part, roll_bytes)
        at, notes = None, {}  # notes stand before the page of their id and payload
        for whole in batches:
            for rows in byte_slices(whole, "payload", 8 << 20):
                for page, tie, link, html, digest, refers in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    if at != (page, tie):
                        at, notes = (page, tie), {}
                    if html is None:
                        notes[digest] = (refers, link)
                        continue
                    body = html.encode()
                    target = notes.get(hashlib.sha1(body).hexdigest()) if notes else None
                    roller.add(_member(record(None if page is None else str(page), _clean(link), body, date, target), level))
        roller.close()
        if roller.done:
            write_file(f"{folder}/part-{part:06d}.manifest.json", [json.dumps(roller.done).encode()])
            yield pa.RecordBatch.from_pylist([{"part": part, **d} for d in roller.done], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())]))

    files = arrow_map(placed, run, "part int, file string, bytes long, records long, sha256 string").sort("file").collect()  # a row a file
    write_file(f"{folder}/{MANIFEST}", [json.dumps({"page_id": kind.simpleString(), "files": [r.asDict() for r in files]}).encode()])
    return folder


def _members(source: pa.NativeFile) -> Iterator[bytes]:
    """The uncompressed records of a file of gzip members, read a block at a time."""
    data = b""
    inflate, out = zlib.decompressobj(31), []
    while block := data or source.read(1 << 20):
        out.append(inflate.decompress(block))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(out)
            inflate, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, by lower-case name, and its block."""
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a folder that has a manifest, checked against their digests.

    page_id, record_type, url, refers_to, payload (null for a revisit), payload_bytes
    and payload_digest (lower-case hex; of the full payload, for a revisit as its
    headers say).
    """
    store, path = open_fs(folder)
    with store.open_input_stream(f"{path}/{MANIFEST}") as f:
        manifest = json.loads(f.read())
    files = [(e["file"],) for e in manifest["files"]]
    names = spark.createDataFrame(files, "file string").repartition(max(len(files), 1), "file")
    schema = pa.schema([("page_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, root = open_fs(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[dict] = []
                held = 0
                with inner.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for data in _members(source):
                        headers, block = parse(data)
                        if _sha1(block)[1] != headers["warc-block-digest"]:
                            raise ValueError(f"{name}: a block does not match its digest")
                        http, _, payload = block.partition(CRLF + CRLF)
                        revisit = headers["warc-type"] == "revisit"
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload does not match its digest")
                        size = next(int(line.split(b":")[1]) for line in http.split(CRLF) if line.lower().startswith(b"content-length:"))
                        key = lambda k: unquote(headers[k]) if k in headers else None  # noqa: B023, E731
                        rows.append(
                            {"page_id": key("x-page-id"), "record_type": headers["warc-type"], "url": headers.get("warc-target-uri"), "refers_to": key("x-refers-to-page-id"), "payload": None if revisit else payload.decode(), "payload_bytes": size, "payload_digest": digest}
                        )
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    found = arrow_map(names, run, "page_id string, record_type string, url string, refers_to string, payload string, payload_bytes long, payload_digest string")
    return found.withColumn("page_id", F.col("page_id").cast(manifest["page_id"])).withColumn("refers_to", F.col("refers_to").cast(manifest["page_id"]))
