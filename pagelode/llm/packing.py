"""Packing: concatenate and cut, with offsets from prefix sums over partition token totals."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm.common import Workspace, arrow_map, bounds, byte_slices, named, schema_of, text_column
from pagelode.llm.tokens import END_ID, default_vocabulary, encoder, id_type

LENGTH = 4096


def encoded_table(ws: Workspace, docs: DataFrame, vocabulary: str, end: int | None) -> DataFrame:
    """Pass one: ids of every document, written with the writing task's number and the ids before it in that task.

    The table is written once and committed per task, so what later passes read
    never changes, whichever executors are lost.
    """
    kind = id_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, cut = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for whole in batches:
            for rows in byte_slices(whole, "text", 24 << 20):
                ids, edges = cut.encode(rows.column("text").cast(pa.string()), end)
                data = pa.py_buffer(ids.astype(kind).tobytes())
                places = pa.py_buffer((edges * kind.itemsize).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.full(len(rows), part, np.int32)), pa.array(before + edges[:-1]), pa.array(np.diff(edges)), pa.Array.from_buffers(pa.binary(), len(rows), [None, places, data])],
                    names=["doc_id", "part", "before", "n_tokens", "ids"],
                )
                before += int(edges[-1])

    kept = docs.schema["doc_id"].dataType
    return ws.cut(arrow_map(docs, run, schema_of(("doc_id", kept), ("part", "int"), ("before", "long"), ("n_tokens", "long"), ("ids", "binary"))), "encoded")


def pack(spark: SparkSession, df: DataFrame, length: int = LENGTH, vocabulary: str | None = None, end: int | None = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Concatenate all documents' ids and cut the stream every ``length`` ids.

    Pass one encodes (see ``encoded_table``); prefix sums over the tasks' token
    totals, one number a task, give each task's global offset; pass two adds it and
    cuts, without a shuffle, so no key can be hot.  A document over a cut is a
    boundary record in each sequence it touches.  Only the last sequence is short.

    Returns one row per piece: doc_id (of any type, as it was), start (the document's ids before the piece),
    length, doc_tokens, sequence_id, offset (in the sequence) and ids (little-endian
    unsigned 32-bit).  Documents keep the order of the input's partitions.  Null and
    empty texts are the end id alone; rows that repeat a doc_id are documents of
    their own; a null doc_id stays null; an empty table gives no rows; further
    columns are not read.  A text of any length is encoded whole, alone in its slice.
    ``vocabulary`` is any tokenizers file.  Without an end id a document without ids has no piece.
    """
    vocabulary = vocabulary or default_vocabulary()
    ws = Workspace(spark, "packing")
    kind = id_type(vocabulary)
    table = encoded_table(ws, df.select(named(df, doc_id).alias("doc_id"), text_column(df, text).alias("text")), vocabulary, end)
    totals = dict(table.groupBy("part").agg(F.sum("n_tokens")).collect())
    parts = sorted(totals)
    base = dict(zip(parts, accumulate((totals[p] for p in parts), initial=0), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in byte_slices(whole, "ids", 16 << 20):
                sizes = rows.column("n_tokens").to_numpy()
                first = rows.column("before").to_numpy() + np.array([base[p] for p in rows.column("part").to_pylist()], np.int64)
                column = rows.column("ids")
                where = np.frombuffer(column.buffers()[1], np.int32, count=len(rows) + 1, offset=4 * column.offset)
                ids = np.frombuffer(column.buffers()[2] or b"", np.uint8)[where[0] : where[-1]].view(kind).astype("<u4")
                # A document has a piece in each sequence from its first id's to its last id's.
                spans = np.where(sizes > 0, (first + sizes - 1) // length - first // length + 1, 0)
                doc = np.repeat(np.arange(len(rows)), spans)
                nth = np.arange(len(doc)) - np.repeat(bounds(spans)[:-1], spans)
                sequence = first[doc] // length + nth
                begin = np.maximum(first[doc], sequence * length)
                end_at = np.minimum(first[doc] + sizes[doc], (sequence + 1) * length)
                places = pa.py_buffer((4 * bounds(end_at - begin)).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id").take(pa.array(doc)), pa.array(begin - first[doc]), pa.array(end_at - begin), pa.array(sizes[doc]),
                        pa.array(sequence), pa.array(begin - sequence * length), pa.Array.from_buffers(pa.binary(), len(doc), [None, places, pa.py_buffer(ids)]),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    pieces = schema_of(("doc_id", df.schema[doc_id].dataType), ("start", "long"), ("length", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("ids", "binary"))
    return arrow_map(table, run, pieces)
