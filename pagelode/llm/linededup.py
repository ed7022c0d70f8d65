"""Line dedup: lines that many documents hold stay in one of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm.common import WHITE, Workspace, arrow_map, byte_slices, named, rest_of, schema_of, text_column

LEAST_LENGTH = 20
LEAST_DOCUMENTS = 3


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """All lines, their texts, their keys, and which keys count."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=WHITE))
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    return lines, row, keys, pc.utf8_length(keys).to_numpy()


def _digests(keys: pa.Array) -> np.ndarray:
    """128-bit hashes as two signed numbers each; equal keys of a block are hashed once."""
    coded = keys.dictionary_encode()
    data = b"".join(xxhash.xxh3_128_digest(k) for k in coded.dictionary.cast(pa.binary()).to_pylist())
    return np.frombuffer(data, "<i8").reshape(-1, 2)[coded.indices.to_numpy()]


def dedup_lines(spark: SparkSession, df: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Drop lines whose key stands in ``least_documents`` documents or more, except in the one with the largest doc_id.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased;
    keys shorter than ``least_length`` code points are left alone.  Each document
    gives each of its keys once, as a 128-bit hash; rows are counted per hash
    (combined before the shuffle, so a line in every document is one row a task); the
    few frequent hashes meet the lines again, split where skewed, and their distinct
    documents are counted; each document then meets its own list of lines to drop and
    is reassembled from the rest by position.

    Returns the input's columns, the text reassembled, with n_lines (before) and
    n_dropped.  A null or empty text is one empty line and becomes the empty text.
    A document is a doc_id of any type: rows that repeat one count once, and all keep
    their lines where that id is the largest.  A null doc_id is one document, smaller
    than any.  An empty table gives no rows.  Input columns named n_lines or n_dropped
    are replaced; others may have any name.
    """
    ws = Workspace(spark, "linededup")
    kind = df.schema[doc_id].dataType
    docs = df.select(named(df, doc_id).alias("id"), text_column(df, text).alias("text"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in byte_slices(whole, "text"):
                _, row, keys, length = _lines(rows.column("text").cast(pa.string()))
                counted = length >= least_length
                digest = _digests(keys.filter(pa.array(counted)))
                found = np.unique(np.column_stack([row[counted], digest]), axis=0) if counted.any() else np.zeros((0, 3), np.int64)
                yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(found[:, 0])), pa.array(found[:, 1]), pa.array(found[:, 2])], names=["id", "h1", "h2"])

    lines = ws.cut(arrow_map(docs, hashes, schema_of(("id", kind), ("h1", "long"), ("h2", "long"))), "lines")
    # Tables are written before they are joined, so that joins stand on plain exchanges, whose skewed partitions Spark splits.
    frequent = ws.cut(lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= least_documents), "frequent")
    held = ws.cut(lines.join(frequent, ["h1", "h2"]).select("id", "h1", "h2", "keeper"), "held")
    ws.drop(lines)
    documents = held.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("documents"))
    few = ws.cut(documents.where(F.col("documents") < least_documents).select("h1", "h2"), "few")  # held by rows enough, but not by documents
    drops = held.where(~F.col("id").eqNullSafe(F.col("keeper"))).join(few, ["h1", "h2"], "left_anti")
    drops = ws.cut(drops.groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("drops")), "drops")
    rest = [c for c in df.columns if c.lower() not in (text.lower(), "n_lines", "n_dropped")]
    whole_rows = df.select(named(df, doc_id).alias("own"), text_column(df, text).alias("text"), rest_of(df, *(c for c in df.columns if c not in rest)).alias("rest"))
    joined = whole_rows.join(drops.hint("shuffle_hash"), F.col("own").eqNullSafe(F.col("id")), "left").select("text", "rest", "drops")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in byte_slices(whole, "text"):
                texts, drop = rows.column("text").cast(pa.string()), rows.column("drops")
                n_lines = pc.add(pc.count_substring(texts, "\n"), 1).cast(pa.int64()).to_numpy()
                n_dropped = np.zeros(len(rows), np.int64)
                hit = np.flatnonzero(drop.is_valid().to_numpy(zero_copy_only=False))
                if len(hit):
                    wanted = drop.take(pa.array(hit))
                    pairs = wanted.flatten()
                    owner = np.repeat(np.arange(len(hit)), pc.list_value_length(wanted).to_numpy())
                    gone = set(zip(owner.tolist(), pairs.field(0).to_pylist(), pairs.field(1).to_pylist(), strict=True))
                    lines, row, keys, length = _lines(texts.take(pa.array(hit)))
                    at = np.flatnonzero(length >= least_length)
                    digest = _digests(keys.take(pa.array(at)))
                    out = np.fromiter((k in gone for k in zip(row[at].tolist(), *digest.T.tolist(), strict=True)), np.bool_, len(at))
                    stays = np.ones(len(lines), np.bool_)
                    stays[at[out]] = False
                    n_dropped[hit] = np.bincount(row[~stays], minlength=len(hit))
                    left = np.bincount(row[stays], minlength=len(hit))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32()), lines.filter(pa.array(stays)))
                    joined_again = pc.binary_join(lists, "\n")
                    mask = np.zeros(len(rows), np.bool_)
                    mask[hit] = True
                    texts = pc.replace_with_mask(texts, pa.array(mask), joined_again)
                yield pa.RecordBatch.from_arrays([texts, rows.column("rest"), pa.array(n_lines), pa.array(n_dropped)], names=["text", "rest", "n_lines", "n_dropped"])

    found = arrow_map(joined, rebuild, schema_of(("text", "string"), ("rest", joined.schema["rest"].dataType), ("n_lines", "long"), ("n_dropped", "long")))
    kept = [F.col("text").alias(c) if c == text else F.col("rest")[c].alias(c) for c in df.columns if c == text or c in rest]
    return found.select(*kept, "n_lines", "n_dropped")
