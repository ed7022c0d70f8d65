"""Mixing sources to target weights, in fixed-length blocks of words."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelode.llm.common import WORD, Workspace, arrow_map, named, rest_of, running_start, schema_of

WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3
BLOCK = 64
SHARD = 16384
SEED = 20
#: Sources are set by configuration, each with its weight; their totals are held by the driver.
MOST_SOURCES = 1_000_000


def word_count(column: Column) -> Column:
    """Words of a text, by DataFrame functions."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], times: float = MOST_TIMES) -> list[float]:
    """Share out the total of ``sizes`` by ``weights``; a target stops at ``times`` its size and the excess is shared again."""
    out, open_, left = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s}, float(sum(sizes))
    while open_:
        whole = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / whole > times * sizes[i]}
        for i in full or open_:
            out[i] = float(times * sizes[i]) if full else left * weights[i] / whole
        left -= sum(out[i] for i in full)
        open_ = open_ - full if full else set()
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1 for each key, at the given places.

    A Feistel network of four rounds over the next even power of two; what falls
    outside is sent through again, so the walk stays a bijection of the range.
    """
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2), np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64).copy()
    limit = size.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            mix = (right + k + np.uint64(r * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mix ^= mix >> np.uint64(27)
            mix *= np.uint64(0x94D049BB133111EB)
            mix ^= mix >> np.uint64(31)
            left, right = right, (left ^ mix) & m
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("/".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


class Mix:
    """A mixture: its documents with their places, the blocks taken, and each document's taken words."""

    def __init__(self, docs: DataFrame, taken_blocks: DataFrame, block: int, columns: list[str]) -> None:
        self.docs, self.slots, self.block, self.columns = docs, taken_blocks, block, columns

    def _spans(self) -> DataFrame:
        """A row per document and block that it reaches into."""
        blocks = F.sequence(F.floor(F.col("start") / self.block), F.floor((F.col("start") + F.col("size") - 1) / self.block))
        return self.docs.where("size > 0").withColumn("block", F.explode(blocks))

    def pieces(self) -> DataFrame:
        """A row per slot and document of its block: _row, shard, slot, first (the document's words before the piece), length."""
        spans = self._spans().select("_row", "number", "start", "size", "block")
        begin = F.greatest("start", F.col("block") * self.block)
        length = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * self.block) - begin
        # Slots are made from a few rows of counts, so their number can't be seen in advance: never broadcast them.
        return spans.hint("merge").join(self.slots, ["number", "block"]).select("_row", "shard", "slot", (begin - F.col("start")).alias("first"), length.alias("length"))

    def taken(self) -> DataFrame:
        """Each document's row key and the words that the mixture takes of it, repeats counted."""
        return self.pieces().groupBy("_row").agg(F.sum("length").alias("taken"))


def plan_mix(spark: SparkSession, df: DataFrame, size: Column, weights: Sequence[float] = WEIGHTS, times: int = MOST_TIMES, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, doc_id: str = "doc_id", source: str = "source", tie: Column | None = None, then: Column | None = None, weight_of: dict | None = None, key: Column | None = None) -> Mix:
    """Draw a mixture of sources near their target weights.

    Within a source, documents in order of doc_id are one stream of words, cut into
    blocks of ``block`` words (prefix sums over range partitions, so a source with any
    share of the rows is many tasks).  The mixture's slots come in output shards of
    ``shard``; each shard draws its sources' counts from a multinomial of the target
    weights.  What the draws miss of a source's quota is settled at the end: a
    source's slots beyond its quota pass to the sources that lack some.  The j-th slot
    of a source takes the (j mod n)-th place of a pseudorandom permutation of its n
    blocks, a new one for each pass, so no block is taken more than ``times`` times and
    all blocks once before any is taken again.  Slots and blocks meet by block index.

    The draws depend on the seed, the sources and their sizes alone: reruns agree.
    Sources by code point, null last, weigh ``weights`` in turn, or as ``weight_of``
    says.  A document without words is in no block.  Rows that repeat a doc_id follow
    one another; ``tie`` and ``then`` order them.  ``key`` is carried along as each row's ``key``.
    An empty table gives an empty mixture.
    """
    ws = Workspace(spark, "mixing")
    nothing = F.lit(0).cast("long")
    keep = df.select(named(df, doc_id).alias("doc_id"), named(df, source).cast("string").alias("source"), size.alias("size"), (nothing if tie is None else tie).alias("tie"), (nothing if then is None else then).alias("then"), *([key.alias("key")] if key is not None else []))
    sized = ws.cut(keep, "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources; mix by a coarser column")
    sums = sorted(sums, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [r["size"] for r in sums]
    weigh = [weight_of[r["source"]] if weight_of else weights[i % len(weights)] for i, r in enumerate(sums)]
    aims = targets(sizes, weigh, times)
    n_blocks = [-(-s // block) for s in sizes]
    quota = [min(round(t * n / s), times * n) if s else 0 for t, n, s in zip(aims, n_blocks, sizes, strict=True)]
    known = spark.createDataFrame(
        [(i, r["source"], s, t, n) for i, (r, s, t, n) in enumerate(zip(sums, sizes, aims, n_blocks, strict=True))],
        "number int, _source string, source_size long, target double, n_blocks long",
    )  # a row per source
    numbered = sized.join(known, sized["source"].eqNullSafe(known["_source"])).drop("_source")
    placed = running_start(ws, numbered, ["doc_id", "tie", "size", "then"], "size", group=["number"], rows=sum(r["rows"] for r in sums))
    docs = ws.cut(placed.withColumn("_row", F.monotonically_increasing_id()), "places")

    total = sum(quota)
    n_shards = max(1, -(-total // shard))
    rate = np.array(quota, np.float64) / max(total, 1)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = batch.column(0).to_numpy()
            counts = [np.random.default_rng([seed, int(s)]).multinomial(min(shard, total - int(s) * shard), rate) for s in shards]
            flat = np.stack(counts) if counts else np.zeros((0, len(rate)), np.int64)
            at, number = np.nonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(shards[at]), pa.array(number.astype(np.int32)), pa.array(flat[at, number])], names=["shard", "number", "n"])

    if not total:
        slots = spark.createDataFrame([], "number int, block long, shard long, slot long")
        return Mix(docs, slots, block, docs.columns)
    draws = ws.cut(arrow_map(spark.range(n_shards).withColumnRenamed("id", "shard"), draw, "shard long, number int, n long"), "draws")
    in_shard = Window.partitionBy("shard").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed_draws = draws.withColumn("place", F.coalesce(F.sum("n").over(in_shard), F.lit(0)))
    runs = running_start(ws, placed_draws, ["shard"], "n", out="first", group=["number"], rows=n_shards * len(sums))
    drawn = {r["number"]: r["n"] for r in draws.groupBy("number").agg(F.sum("n").alias("n")).collect()}
    # Slots that a source was dealt beyond its quota, in order of source, pass to the sources that lack some, in order.
    spare = np.cumsum([0, *(max(drawn.get(i, 0) - q, 0) for i, q in enumerate(quota))])
    lacking = np.cumsum([0, *(max(q - drawn.get(i, 0), 0) for i, q in enumerate(quota))])
    quotas, had = np.array(quota, np.int64), np.array([min(drawn.get(i, 0), q) for i, q in enumerate(quota)], np.int64)
    blocks = np.array(n_blocks, np.int64)
    names = [r["source"] for r in sums]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[tuple[int, int], int] = {}
        for batch in batches:
            sh, num, n, first, at = (c.to_numpy() for c in batch.columns)
            for lo in range(0, len(n), 256):
                part = slice(lo, lo + 256)
                run = np.repeat(np.arange(len(n))[part], n[part])
                if not len(run):
                    continue
                nth = np.arange(len(run)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                source_of, j = num[run].astype(np.int64), first[run] + nth
                extra = j >= quotas[source_of]
                q = spare[source_of[extra]] + j[extra] - quotas[source_of[extra]]
                heir = np.searchsorted(lacking, q, side="right") - 1
                source_of[extra], j[extra] = heir, had[heir] + q - lacking[heir]
                size = blocks[source_of]
                turn = j // size
                for pair in set(zip(source_of.tolist(), turn.tolist(), strict=True)) - keys.keys():
                    keys[pair] = _seed(seed, names[pair[0]], pair[1])
                key = np.fromiter((keys[p] for p in zip(source_of.tolist(), turn.tolist(), strict=True)), np.uint64, len(run))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(source_of.astype(np.int32)), pa.array(permuted(j % size, size, key)), pa.array(sh[run]), pa.array(at[run] + nth)],
                    names=["number", "block", "shard", "slot"],
                )

    slots = arrow_map(runs.select("shard", "number", "n", "first", "place"), place, "number int, block long, shard long, slot long")
    return Mix(docs, slots, block, docs.columns)


def mix_sizes(spark: SparkSession, df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its source's) and taken (words the mixture takes); see ``plan_mix``.

    A null text has size 0; null sources are a source of their own.
    """
    whole = df.select(named(df, doc_id).alias("doc_id"), named(df, source).alias("source"), named(df, text).cast("string").alias("text"))
    mix = plan_mix(spark, whole, word_count(whole["text"]), tie=F.xxhash64("text"), **options)
    found = mix.docs.hint("merge").join(mix.taken(), "_row", "left")
    return found.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


_WORD = re.compile(WORD)


def mixed_documents(spark: SparkSession, df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mixture itself: the input's columns with a row for each run of blocks of a document that one pass takes.

    A row's text runs from its first word to the last before the next piece's, so
    whole documents come back as they are.  Rows are cut where a block that was not
    taken in that pass lies between.  Documents without words are left out, null texts
    among them.  Rows are numbered once, with their texts, so those that repeat a doc_id
    and text each get the blocks drawn for them; their other columns order them.
    Columns may have any name.  An empty table gives no rows.
    """
    own = F.struct(*(named(df, c) for c in df.columns))
    whole = df.select(F.monotonically_increasing_id().alias("key"), named(df, doc_id).alias("doc_id"), named(df, source).alias("source"), named(df, text).cast("string").alias("text"), rest_of(df, text).alias("rest"), F.xxhash64(F.to_json(own)).alias("then"))
    whole = Workspace(spark, "mixed").cut(whole, "texts")
    mix = plan_mix(spark, whole, word_count(whole["text"]), tie=F.xxhash64("text"), then=F.col("then"), key=F.col("key"), **options)
    copies = mix.pieces().groupBy("_row", "first", "length").agg(F.count("*").alias("copies"))
    by_row = copies.groupBy("_row").agg(F.collect_list(F.struct("first", "length", "copies")).alias("pieces"))
    wanted = mix.docs.hint("merge").join(by_row, "_row").select("key", "pieces")
    joined = whole.join(wanted.hint("shuffle_hash"), "key").select("text", "rest", "pieces")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            source_rows, texts = [], []
            for i, (value, pieces) in enumerate(zip(rows.column("text").to_pylist(), rows.column("pieces").to_pylist(), strict=True)):
                starts = [m.start() for m in _WORD.finditer(value)]
                order = sorted((p["first"], p["length"], p["copies"]) for p in pieces)
                for turn in range(max(p[2] for p in order)):
                    run = None
                    for first, length, copies_ in [*order, (math.inf, 0, math.inf)]:
                        if copies_ <= turn:
                            continue
                        if run and run[1] == first:
                            run[1] += length
                            continue
                        if run:
                            a = 0 if run[0] == 0 else starts[run[0]]
                            b = len(value) if run[1] == len(starts) else starts[run[1]]
                            source_rows.append(i)
                            texts.append(value[a:b])
                        run = [first, first + length] if length else None
                if len(texts) > 4096:
                    yield _batch(rows, source_rows, texts)
                    source_rows, texts = [], []
            yield _batch(rows, source_rows, texts)

    def _batch(rows: pa.RecordBatch, source_rows: list[int], texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), rows.column("rest").take(pa.array(source_rows, pa.int64()))], names=["text", "rest"])

    found = arrow_map(joined, cut, schema_of(("text", "string"), ("rest", joined.schema["rest"].dataType)))
    return found.select(*(F.col("text").alias(c) if c == text else F.col("rest")[c].alias(c) for c in df.columns))
