"""Token-id files: flat unsigned integers and 64-bit document offsets, written in document order and memory-mapped."""

from __future__ import annotations

import json
import mmap
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm.common import Workspace, arrow_map, byte_slices, cut_points, deal, open_fs, order_key, text_column, whole_number, write_file
from pagelode.llm.tokens import END_ID, default_vocabulary, encoder, id_type

#: Stands for a null doc_id in the file of document ids.
NO_ID = -(1 << 63)
MANIFEST = "manifest.json"


def write_token_files(spark: SparkSession, df: DataFrame, folder: str | None = None, vocabulary: str | None = None, end: int | None = END_ID, doc_id: str = "doc_id", text: str = "text") -> str:
    """Encode all documents and write their ids in ascending doc_id order; returns the folder's URI.

    Documents are dealt by cut points of (doc_id, hash of the text) to ranges of about
    equal bytes, which bounds a file whatever the session's settings, and sorted.  Each
    range streams three files under temporary names and renames them at its end:
    ``ids-N`` (the ids, the vocabulary's smallest unsigned type), ``offsets-N`` (64-bit,
    ids before each document of the range, and the total) and ``docs-N`` (64-bit ids;
    an Arrow stream of texts where ids are no whole numbers).  Prefix sums over the
    ranges' totals give each range's base; the manifest that holds them is written
    last, so a folder with one is whole.  The same rows give the same files, however
    they were partitioned.  An executor lost midway leaves only temporary files that no
    manifest names.

    Whole-number ids are in order of number, others of their text; both come back as
    they were.  Null and empty texts are the end id alone; a text of any length is
    encoded whole; rows that repeat a doc_id are written one after another; a null
    doc_id comes first; an empty table gives a manifest without ranges; further columns
    are not read.  Without ``folder`` the files lie in the run's workspace, which is
    removed when the driver ends.
    """
    ws = Workspace(spark, "tokens")
    vocabulary = vocabulary or default_vocabulary()
    folder = folder or ws.mkdir("files")
    kind = id_type(vocabulary)
    own, numbers = df.schema[doc_id].dataType, whole_number(df.schema[doc_id].dataType)
    docs = df.select(order_key(df, doc_id).alias("key"), text_column(df, text).alias("text")).withColumn("tie", F.xxhash64("text"))
    keys = ws.cut(docs.select("key", "tie", (F.octet_length("text") + 16).cast("long").alias("bytes")), "keys")
    placed = deal(docs, cut_points(keys), "bigint" if numbers else "string").sortWithinPartitions("key", "tie", "text").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, cut = TaskContext.get().partitionId(), encoder(vocabulary)
        store, path = open_fs(folder)
        attempt = uuid.uuid4().hex
        names = {n: f"{path}/{n}-{part:06d}" for n in ("ids", "offsets", "docs")}
        files, stream, total, count = {}, None, 0, 0
        for whole in batches:
            for rows in byte_slices(whole, "text", 24 << 20):
                if not files:
                    files = {n: store.open_output_stream(f"{to}.tmp-{attempt}") for n, to in names.items()}
                ids, edges = cut.encode(rows.column("text").cast(pa.string()), end)
                files["ids"].write(ids.astype(kind).tobytes())
                files["offsets"].write((total + edges[:-1]).astype("<u8").tobytes())
                if numbers:
                    files["docs"].write(rows.column("key").fill_null(NO_ID).to_numpy().astype("<i8").tobytes())
                else:
                    batch = pa.RecordBatch.from_arrays([rows.column("key").cast(pa.string())], names=["doc_id"])
                    stream = stream or pa.ipc.new_stream(files["docs"], batch.schema)
                    stream.write_batch(batch)
                total += int(edges[-1])
                count += len(rows)
        if files:
            files["offsets"].write(np.array([total], "<u8").tobytes())
            if stream:
                stream.close()
            for n, to in names.items():
                files[n].close()
                store.move(f"{to}.tmp-{attempt}", to)
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [count], "n_tokens": [total]}, schema=pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    written = sorted(arrow_map(placed, run, "part int, n_docs long, n_tokens long").collect())  # a row a range
    tokens = accumulate((r.n_tokens for r in written), initial=0)
    before = accumulate((r.n_docs for r in written), initial=0)
    parts = [{"part": r.part, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "first_token": t, "first_doc": d} for r, t, d in zip(written, tokens, before, strict=False)]
    write_file(f"{folder}/{MANIFEST}", [json.dumps({"dtype": kind.str, "doc_id": own.simpleString(), "numbers": numbers, "parts": parts}).encode()])
    return folder


class FileArray:
    """A file as an array: memory-mapped where the store is a mounted folder, else each slice is read as it is asked for."""

    def __init__(self, uri: str, kind: str) -> None:
        store, path = open_fs(uri)
        self.kind = np.dtype(kind)
        if isinstance(store, pafs.LocalFileSystem):
            with open(path, "rb") as f:
                f.seek(0, 2)
                self.whole = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if f.tell() else b"", self.kind)
        else:
            self.whole, self.file = None, store.open_input_file(path)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.whole is not None:
            return self.whole[part]
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at((part.stop - part.start) * size, part.start * size), self.kind)


#: Documents and ids of one slice that a reader takes at a time.
DOCS_READ, IDS_READ = 1 << 16, 4 << 20


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder of token files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit).

    Ranges are read in parallel, each in slices of its files: a task holds no whole file.
    """
    store, path = open_fs(folder)
    with store.open_input_stream(f"{path}/{MANIFEST}") as f:
        manifest = json.loads(f.read())
    kind, numbers = manifest["dtype"], manifest["numbers"]
    rows = [(p["part"], p["n_docs"], p["first_token"]) for p in manifest["parts"]]
    parts = spark.createDataFrame(rows, "part int, n_docs long, first_token long").repartition(max(len(rows), 1), "part")

    def keys(part: int, n: int) -> Iterator[pa.Array]:
        """The ids of the range's documents, in pieces."""
        if numbers:
            docs = FileArray(f"{folder}/docs-{part:06d}", "<i8")
            for a in range(0, n, DOCS_READ):
                key = docs[a : min(a + DOCS_READ, n)]
                yield pa.array(key, mask=key == NO_ID)
        else:
            inner, root = open_fs(folder)
            with inner.open_input_stream(f"{root}/docs-{part:06d}") as f:
                for batch in pa.ipc.open_stream(f):
                    yield from (batch.column(0).slice(a, DOCS_READ) for a in range(0, len(batch), DOCS_READ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, offsets = FileArray(f"{folder}/ids-{part:06d}", kind), FileArray(f"{folder}/offsets-{part:06d}", "<u8")
                before = 0
                for key in keys(part, n):
                    edges = offsets[before : before + len(key) + 1].astype(np.int64)
                    before += len(key)
                    at = 0
                    while at < len(key):
                        upto = min(max(int(np.searchsorted(edges, edges[at] + IDS_READ, side="right")) - 1, at + 1), len(key))
                        data = ids[int(edges[at]) : int(edges[upto])].astype("<u4")
                        places = pa.py_buffer((4 * (edges[at : upto + 1] - edges[at])).astype(np.int32).tobytes())
                        yield pa.RecordBatch.from_arrays(
                            [key.slice(at, upto - at), pa.array(first + edges[at:upto]), pa.array(np.diff(edges[at : upto + 1])), pa.Array.from_buffers(pa.binary(), upto - at, [None, places, pa.py_buffer(data)])],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        at = upto

    found = arrow_map(parts, run, f"doc_id {'long' if numbers else 'string'}, start long, n_tokens long, ids binary")
    return found.withColumn("doc_id", F.col("doc_id").cast(manifest["doc_id"]))
