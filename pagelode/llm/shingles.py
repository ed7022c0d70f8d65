"""Near-duplicates by the similarity of word shingle sets: SimHash fingerprints joined in their trie propose, MinHash buckets add what these cannot reach, the sets themselves decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm.common import Workspace, arrow_groups, arrow_map, bounds, byte_slices, gather_ranges, named, schema_of, split_words, text_column
from pagelode.llm.components import Forest, connected_components
from pagelode.llm.simhash import component_of, fingerprints, trie_join

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: Buckets a text falls in, and the minima that a bucket takes: a pair at 0.8 shares none with probability (1 - 0.8^5)^20 = 0.0004.
BANDS, ROWS = 20, 5
#: Bits in which fingerprints may differ, the most at which the trie still prunes at tens of millions of texts, and its nodes' size.
ERRORS, NODE_SIZE = 3, 1 << 17
#: Places of other texts that are counted at a time.
COUNTED = 1 << 20
#: Text of a block of a group.
GROUP_BYTES = 16 << 20
_ODD = np.uint64(0xBF58476D1CE4E5B9)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a ^ b) * _ODD
    return out ^ (out >> np.uint64(29))


def shingle_hashes(texts: pa.Array, width: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles of ``width`` words, one after another, and where each text's begin and end.

    Words are compared with A-Z in lower case.  A text of fewer words is one shingle, one without words has none.
    """
    words, counts = split_words(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w.as_buffer(), seed) for w in coded.dictionary.cast(pa.binary())], np.uint64)
    hashes = known[coded.indices.to_numpy()]
    n = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    edges, begin = bounds(n), bounds(counts)
    at = np.arange(edges[-1]) + np.repeat(begin[:-1] - edges[:-1], n)
    end = np.repeat(begin[1:], n)
    out = np.full(len(at), seed, np.uint64)
    for k in range(width):
        inside = at + k < end
        out = _mix(out, np.where(inside, hashes[np.where(inside, at + k, 0)], np.uint64(k)))
    return out, edges


def bucket_keys(hashes: np.ndarray, edges: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> np.ndarray:
    """For each text with shingles, ``bands`` keys, each of ``rows`` minima of its hashes."""
    salt = np.random.default_rng(seed).integers(0, 1 << 64, (bands, rows, 2), np.uint64)
    starts = edges[:-1][np.diff(edges) > 0]
    out = np.empty((len(starts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(starts), band, np.uint64)
        for row in range(rows):
            a, b = salt[band, row]
            mixed = _mix(hashes * (b | np.uint64(1)), a)
            key = _mix(key, np.minimum.reduceat(mixed, starts)) if len(starts) else key
        out[:, band] = key
    return out


def similar(values: np.ndarray, edges: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Labels of sets, each a range of ``values``, by links of Jaccard similarity ``similarity`` or more.

    A set is counted against all that share a value with it, until all that are not
    counted lie in the largest component: a pair of two of them is joined already, and
    any other pair has an end that is counted.  Sets left out with a component that is
    then outgrown are counted after all.  So a group of copies costs a pass, not its square.
    """
    n = len(edges) - 1
    forest = Forest(n)
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.zeros(len(values), np.bool_)
    first[1:] = ordered[1:] != ordered[:-1]
    del ordered
    codes = np.empty(len(values), np.int32)
    codes[order] = np.cumsum(first, dtype=np.int32)
    holders = np.repeat(np.arange(n, dtype=np.int32), np.diff(edges))[order]
    del order, first
    begin = bounds(np.bincount(codes))
    sizes = np.diff(edges)
    counted = np.zeros(n, np.bool_)
    todo = ~counted
    while todo.any():
        i = int(np.argmax(todo))
        counted[i] = True
        own = codes[edges[i] : edges[i + 1]]
        shared = np.zeros(n, np.int64)
        turn = np.cumsum(begin[own + 1] - begin[own]) // COUNTED
        for part in np.split(own, np.flatnonzero(np.diff(turn)) + 1):
            shared += np.bincount(gather_ranges(holders, begin[part], begin[part + 1] - begin[part]), minlength=n)
        near = np.flatnonzero(shared > 0)
        near = near[shared[near] / (sizes[i] + sizes[near] - shared[near]) >= similarity]
        forest.link(np.full(len(near), i), near)
        todo = ~counted & (forest.label != np.argmax(np.bincount(forest.label, minlength=n)))
    return forest.label


def near_duplicates(spark: SparkSession, df: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Link whole texts whose sets of word shingles have a Jaccard similarity of ``similarity`` or more; each document with its component.

    Texts of equal sets are one class from the start, so a group of copies of any
    size is one row.  The classes' SimHash fingerprints, of the same shingles, are joined
    within ``ERRORS`` bits by the trie of ``simhash``.  That reaches few of the pairs near
    ``similarity``, so each class also falls in ``BANDS`` buckets.  Classes that either
    joins, directly or through others, are a group.  There the sets are compared
    themselves, so no link is below ``similarity``.  A group of over ``GROUP_BYTES`` of
    text is cut into blocks, and each two blocks meet in a task of their own, so memory
    is that of two blocks however many near copies there are; a task emits a forest.

    Returns doc_id (of any type, as it was) and component_id (the smallest doc_id
    reachable).  Null and empty texts and texts without words are one class, linked to
    no other.  A text of any length is taken whole.  Rows that repeat a doc_id are each
    returned.  A null doc_id is never a smallest one unless its component has no other.
    An empty table gives no rows.  Further columns are not read.
    """
    ws = Workspace(spark, "shingles")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in byte_slices(whole, "text", 4 << 20):
                hashes, edges = shingle_hashes(rows.column("text").cast(pa.string()), width)
                sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                fp = np.array([xxhash.xxh64_intdigest(s, SEED) for s in sets], np.uint64).view(np.int64)
                marks = fingerprints(rows.column("text").cast(pa.binary()).to_pylist(), width).view(np.int64)
                keys = bucket_keys(hashes, edges).view(np.int64)
                offsets = bounds(np.where(np.diff(edges) > 0, BANDS, 0)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fp), pa.array(marks), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())), rows.column("text")], names=["doc_id", "fp", "mark", "keys", "text"])

    signed = arrow_map(df.select(named(df, doc_id).alias("doc_id"), text_column(df, text).alias("text")), sign, schema_of(("doc_id", df.schema[doc_id].dataType), ("fp", "long"), ("mark", "long"), ("keys", "array<long>"), ("text", "string")))
    signed = ws.cut(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    classes = ws.cut(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.min("mark").alias("mark")), "classes")
    marked = ws.cut(classes.groupBy("mark").agg(F.min("fp").alias("v")), "marked")
    close = trie_join(ws, marked.select(F.col("mark").alias("fp")), ERRORS, NODE_SIZE)
    ends = [marked.select(F.col("mark").alias(m), F.col("v").alias(e)) for m, e in (("u", "a"), ("v", "b"))]
    close = close.join(ends[0], "u").join(ends[1], "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    close = close.union(classes.join(marked, "mark").select(F.col("fp").alias("u"), "v"))
    dealt = ws.cut(signed.join(classes.select("row"), "row", "left_semi").select("fp", F.explode("keys").alias("key")), "dealt")
    first = dealt.groupBy("key").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "v")
    groups = connected_components(ws, close.union(dealt.join(first, "key").select(F.col("fp").alias("u"), "v")))
    ws.drop(dealt)
    members = groups.join(classes, groups["node"] == classes["fp"]).select("row", "fp", "label")
    texts = ws.cut(signed.select("row", "text").join(members, "row").select("fp", "label", "text"), "texts")
    sizes = texts.groupBy("label").agg(F.ceil(F.sum(F.octet_length("text")) / GROUP_BYTES).cast("int").alias("blocks"))
    large = ws.cut(sizes.where("blocks > 1"), "large")
    block = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda b: F.struct(F.least(F.col("block"), b).alias("i"), F.greatest(F.col("block"), b).alias("j")))
    texts = texts.join(large, "label", "left").withColumn("block", block).select("fp", "label", "text", pairs.alias("pairs"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in byte_slices(whole, "text", 4 << 20):
                hashes, edges = shingle_hashes(rows.column("text").cast(pa.string()), width)
                sets = [np.unique(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                offsets = bounds(np.array([len(s) for s in sets])).astype(np.int32)
                values = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column("fp"), rows.column("label"), rows.column("pairs"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["fp", "label", "pairs", "shingles"])

    def compare(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy()
        counts = pc.list_value_length(table.column("shingles")).to_numpy()
        values = np.concatenate([c.flatten().to_numpy() for c in table.column("shingles").chunks])
        label = similar(values, bounds(counts), similarity)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"u": fps[linked], "v": fps[label[linked]]})

    sets = arrow_map(texts, shingles, "fp long, label long, pairs array<struct<i: int, j: int>>, shingles array<long>")
    links = arrow_groups(sets.select("fp", "label", "shingles", F.explode("pairs").alias("pair")).groupBy("label", "pair.i", "pair.j"), compare, "u long, v long")
    return component_of(ws, signed.select("doc_id", "fp"), classes.select("fp", "least"), links).select("doc_id", "component_id")
