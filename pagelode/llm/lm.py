"""Language-model scoring: an interpolated modified Kneser-Ney model of any order over sorted hash arrays."""

from __future__ import annotations

import mmap
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.common import Workspace, arrow_map, bounds, byte_slices, named, open_fs, runs, schema_of, split_words, text_column, write_file

#: The model's order; see ``score`` for what a higher one costs.
ORDER = 5
#: No word holds white space, so this stands for nothing else.
END = b"\nend"
SLICE = 16 << 20
#: Buckets of the hash range for each partition of the input; a bucket is merged, sorted and answered by one task.
BUCKETS_EACH, LEAST_BUCKETS, MOST_BUCKETS = 2, 16, 1 << 16
#: Of an n-gram: its count, the sum of its followers' counts, and how many of these are one, two, more.
COLUMNS = 5
#: A slice's row: its texts' ids, whether they are held out and their numbers of tokens; the hashes of its words, and the words as places there.
CODED = ["doc_id", "held_out", "n_tokens", "hashes", "index"]
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def unmix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    return x ^ (x >> np.uint64(32))


def longer_keys(context: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """64-bit keys of k-grams from those of their first k - 1 words and the last ones' numbers: of pairs a bijection, of longer ones a hash."""
    if k == 2:
        return mix((unmix(context) << np.uint64(32)) | words)
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + words + np.uint64(k << 56))


def pack_columns(columns: list[np.ndarray]) -> bytes:
    """Columns of one length of whole numbers from 0 on, in the bytes that each needs, byte planes first, compressed."""
    n = len(columns[0])
    widths = [next(w for w in (1, 2, 4, 8) if w == 8 or not n or int(c.max()) >> (8 * w) == 0) for c in columns]
    planes = [np.ascontiguousarray(c.astype(f"<u{w}").view(np.uint8).reshape(-1, w).T).tobytes() for c, w in zip(columns, widths, strict=True)]
    return bytes(widths) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack_columns(data: bytes, columns: int) -> list[np.ndarray]:
    """The columns, unsigned and as wide as they were packed."""
    widths = data[:columns]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[columns:]), np.uint8)
    n = len(raw) // sum(widths)
    at = bounds(np.array([*widths])) * n
    return [np.ascontiguousarray(raw[at[i] : at[i + 1]].reshape(w, n).T).view(f"<u{w}").ravel() for i, w in enumerate(widths)]


def pack_block(keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Sorted keys, as steps, and columns beside them."""
    return pack_columns([np.diff(keys, prepend=np.uint64(0)), *columns])


def unpack_block(data: bytes, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    steps, *rest = unpack_columns(data, columns + 1)
    return np.cumsum(steps, dtype=np.uint64), [c.astype(np.int64) for c in rest]


def merge_blocks(blocks: list[bytes], columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys of sorted blocks, in order, with the sums of their columns."""
    parts = [unpack_block(b, columns) for b in blocks]
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], [np.add.reduceat(np.concatenate([p[1][i] for p in parts])[order], first) for i in range(columns)]


BLOCKS = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("data", pa.binary())])
FIELDS = "bucket int, slice long, data binary"


def _by_bucket(keys: np.ndarray, bucket: np.ndarray, columns: list[np.ndarray], of: int = 0) -> pa.RecordBatch:
    """A packed block for each bucket; buckets rise with the keys."""
    spans = runs(bucket)
    data = [pack_block(keys[a:b], [c[a:b] for c in columns]) for a, b in spans]
    return pa.RecordBatch.from_arrays([pa.array([bucket[a] for a, _ in spans], pa.int32()), pa.array(np.full(len(spans), of)), pa.array(data, pa.binary())], schema=BLOCKS)


class Shelf:
    """Files in the shared folder as a worker sees them: memory-mapped on a mounted folder, else read piece by piece."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.maps: dict[str, memoryview] = {}

    def read(self, name: str, start: int, length: int) -> memoryview:
        if name not in self.maps:
            store, path = open_fs(f"{self.folder}/{name}")
            if not isinstance(store, pafs.LocalFileSystem):
                with store.open_input_file(path) as source:
                    return memoryview(source.read_at(length, start))
            with open(path, "rb") as f:
                self.maps[name] = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False))
        return self.maps[name][start : start + length]

    def part(self, name: str, of: int) -> bytes:
        """The part of a file that ``write_parts`` wrote for a slice."""
        n = int(np.frombuffer(self.read(name, 0, 8), "<i8")[0])
        slices, at = np.split(np.frombuffer(self.read(name, 8, 16 * n + 8), "<i8"), [n])
        i = int(np.searchsorted(slices, of))
        return bytes(self.read(name, 16 * n + 16 + int(at[i]), int(at[i + 1] - at[i])))


def write_parts(uri: str, slices: np.ndarray, parts: list[bytes]) -> None:
    """A file of a part for each slice, with their places before them; slices rise."""
    write_file(uri, [np.array([len(parts)], "<i8").tobytes(), slices.astype("<i8").tobytes(), bounds(np.array([len(p) for p in parts])).astype("<i8").tobytes(), *parts])


_shelves: dict[str, Shelf] = {}


def _shelf(folder: str) -> Shelf:
    """This worker's view of a folder, kept between tasks."""
    if folder not in _shelves:
        _shelves.clear()
        _shelves[folder] = Shelf(folder)
    return _shelves[folder]


class Tokens:
    """The words of some texts: the hashes of distinct ones in order, and each text's run of them with an end."""

    def __init__(self, texts: pa.Array) -> None:
        words, counts = split_words(pc.ascii_lower(texts.fill_null("")))
        coded = words.dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        hashes = np.array([*map(word_hash, distinct), word_hash(END)], np.uint64)
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.hashes = hashes[order]
        self.index = place[np.insert(coded.indices.to_numpy().astype(np.int64), bounds(counts)[1:], len(distinct))]
        self.counts = counts + 1


class Grams:
    """The n-grams of a slice's texts, a begin put before each: level by level their keys and what is known of them."""

    def __init__(self, folder: str, meta: dict, of: int, hashes: np.ndarray, index: np.ndarray, n: np.ndarray, train: np.ndarray) -> None:
        self.folder, self.meta, self.of = folder, meta, of
        self.hashes, self.index, self.n, self.train = hashes, index, n, train

    def number(self) -> None:
        """Number the words, by bucket and place in it, and lay the texts out in a line."""
        n_words = self.meta["n_words"]
        self.counts, place = self.answers(0, self.hashes)
        bucket = (self.hashes >> np.uint64(64 - self.meta["bits"])).astype(np.int64)
        base = np.array([self.meta["word_base"][k] for k in bucket.tolist()], np.int64)
        numbers = np.append(np.where(self.counts > 0, base + place.astype(np.int64), n_words + 1), n_words).astype(np.uint64)
        self.line = np.insert(self.index, bounds(self.n)[:-1], len(self.hashes))
        self.numbers, self.words = numbers, numbers[self.line]
        edges = bounds(self.n + 1)
        self.place = np.arange(edges[-1]) - np.repeat(edges[:-1], self.n + 1)
        self.trains = np.repeat(self.train, self.n + 1)

    def keys(self, upto: int) -> Iterator[np.ndarray]:
        """The keys of the n-grams that end at each place, for 1 to ``upto`` words."""
        key = mix(self.words)
        for k in range(1, upto + 1):
            if k > 1:
                key = np.concatenate([key[:1], longer_keys(key[:-1], self.words[1:], k)])
            yield key

    def level(self, k: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of k words in order, and each place's (0 where its text has not so many words before it)."""
        if k == 1:
            distinct, inverse = np.unique(mix(self.numbers), return_inverse=True)
            return distinct, inverse[self.line]
        use = self.place >= k - 1
        distinct, inverse = np.unique(key[use], return_inverse=True)
        at = np.zeros(len(key), np.int64)
        at[use] = inverse
        return distinct, at

    def answers(self, k: int, distinct: np.ndarray) -> list[np.ndarray]:
        """The whole table's columns of the distinct n-grams, and whether this slice is the one that stands for each (of words, their places in their buckets)."""
        bucket = (distinct >> np.uint64(64 - self.meta["bits"])).astype(np.int64)
        kept = 1 + sent(k, self.meta["order"])
        parts = [unpack_columns(_shelf(self.folder).part(f"grams{k}-{int(bucket[a]):05d}", self.of), kept) for a, _ in runs(bucket)]
        return [np.concatenate([np.zeros(0, np.uint8), *(p[i] for p in parts)]) for i in range(kept)]

    def asked(self, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The distinct n-grams of k words, and what this slice adds to their columns.

        At the model's order the counts are those of the training texts.  Below, an
        n-gram counts once for each word before it, in the slice that stands for the
        longer n-gram; one that begins a text counts as often as it stands.  The same
        longer n-grams give their contexts' columns.  Words (k is 0) are counted as they stand.
        """
        if not k:
            return self.hashes, [np.bincount(self.index[np.repeat(self.train, self.n)], minlength=len(self.hashes))]
        self.number()
        highest = k == self.meta["order"]
        *_, own, above = [*self.keys(k), None] if highest else self.keys(k + 1)
        distinct, at = self.level(k, own)
        if highest:
            return distinct, [np.bincount(at[(self.place >= k - 1) & self.trains], minlength=len(distinct))]
        longer, which = self.level(k + 1, above)
        use = np.flatnonzero(self.place >= k)
        one = np.zeros(len(longer), np.int64)
        one[which[use]] = use
        counts, *_, stands = self.answers(k + 1, longer)
        one, counts = one[stands > 0], counts[stands > 0]
        own_counts = np.bincount(at[one], minlength=len(distinct))
        if k > 1:
            own_counts += np.bincount(at[(self.place == k - 1) & self.trains], minlength=len(distinct))
        context = at[one - 1]
        sums = np.bincount(context, counts, len(distinct)).astype(np.int64)
        return distinct, [own_counts, sums, *(np.bincount(context[c], minlength=len(distinct)) for c in (counts == 1, counts == 2, counts > 2))]

    def log10(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word, text by text: whether it is known, its base and its model log10 probability."""
        self.number()
        m = self.meta
        for k, key in enumerate(self.keys(m["order"]), 1):
            distinct, at = self.level(k, key)
            if not len(distinct):
                break
            seen, *followers, _ = self.answers(k, distinct)
            left = seen - np.array([0.0, *m["discounts"][k]])[np.minimum(seen, 3)]
            if k > 1:
                inside = self.place[1:] >= k - 1
                p[1:] = np.where(inside, left[at[1:]] * share[before[:-1]] + free[before[:-1]] * p[1:], p[1:])
            elif m["n_pairs"]:
                p = ((left + m["low_rest"] / (m["n_words"] + 1)) / m["n_pairs"])[at]
            else:
                p = np.ones(len(at))
            if k < m["order"]:  # of the n-grams as contexts: what a follower's count is worth, and the share of the lower order
                total = followers[0]
                divide = np.maximum(total, 1)
                share, before = 1 / divide, at
                free = np.where(total > 0, sum(d * c for d, c in zip(m["discounts"][k + 1], followers[1:], strict=True)) / divide, 1.0)
        base = np.log10((self.counts.astype(np.int64) + 1) / (m["tokens"] + m["n_words"] + 1))
        return (self.counts > 0).astype(np.int64)[self.index], base[self.index], np.log10(p[self.place > 0])


def sent(k: int, order: int) -> int:
    """The columns of a level's blocks: of words and of the longest n-grams the count alone."""
    return COLUMNS if 0 < k < order else 1


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts one, two and more, from the numbers of counts one to four."""
    if not n[0]:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return [min(max(r, 0.05), k - 0.05) for r, k in zip(raw, (1, 2, 3), strict=True)]


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run here leave no shuffle files behind; none of them is run twice."""
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANED)
        else:
            spark.conf.set(_CLEANED, before)


def train(ws: Workspace, docs: DataFrame, buckets: int, order: int = ORDER) -> tuple[DataFrame, str, dict]:
    """Count, discount and store a model of the texts that are not held out, as far as any text asks for it.

    Returns the texts as words of a slice's own list, a row a slice of about ``SLICE``
    bytes; the model's folder; and what a reader needs to know.  Each level, words first
    and then from the longest n-grams down, is one exchange: a slice sends its distinct
    n-grams on as packed, sorted blocks by bucket of the hash range; a bucket's blocks
    meet in one task, whatever the skew of the words (an n-gram is one entry a slice),
    and the sums go back as a file of a part for each slice, aligned with what it sent,
    so no keys are stored.  The first slice of those that hold an n-gram stands for it:
    it alone counts it for the next level.  An exchange's shuffle files are removed
    before the next one.
    """
    folder = ws.mkdir("model")
    bits = buckets.bit_length() - 1
    shift = np.uint64(64 - bits)
    bucket_of = lambda keys: (keys >> shift).astype(np.int64)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in byte_slices(whole, "text", SLICE):
                t = Tokens(rows.column("text").cast(pa.string()))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), c) for c in (rows.column("doc_id"), rows.column("held_out"), pa.array(t.counts))]
                packed = [pa.array([b], pa.binary()) for b in (pack_block(t.hashes, []), pack_columns([t.index]))]
                yield pa.RecordBatch.from_arrays([*lists, *packed], names=CODED)

    coded = arrow_map(docs, code, schema_of(*zip(CODED, [T.ArrayType(docs.schema["doc_id"].dataType), "array<boolean>", "array<long>", "binary", "binary"], strict=True)))
    coded = ws.cut(coded.withColumn("slice", F.monotonically_increasing_id()), "coded")
    meta = {"order": order, "bits": bits, "discounts": {}}

    def ask(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for grams, _ in slices(batches, folder, meta):
                keys, columns = grams.asked(k)
                yield _by_bucket(keys, bucket_of(keys), columns, grams.of)

        return run

    def answer(k: int):
        columns = sent(k, order)

        def run(table: pa.Table) -> pa.Table:
            bucket = table.column("bucket")[0].as_py()
            table = table.sort_by("slice")
            parts = [unpack_block(b.as_py(), columns) for b in table.column("data")]
            at = bounds(np.array([len(p[0]) for p in parts]))
            keys = np.concatenate([p[0] for p in parts])
            by = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(keys[by]) != 0]))
            sums = [np.add.reduceat(np.concatenate([p[1][i] for p in parts])[by], first) for i in range(columns)]
            del parts
            of = np.empty(len(keys), np.int64)
            of[by] = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))
            found = sums[0] > 0
            if k:
                last = np.zeros(len(keys), np.int64)
                last[by[first]] = found
            else:
                last = np.maximum(np.cumsum(found) - 1, 0)[of]
            back = [pack_columns([*(s[of[a:b]] for s in sums), last[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
            write_parts(f"{folder}/grams{k}-{bucket:05d}", table.column("slice").to_numpy(), back)
            return pa.table({"bucket": pa.array([bucket], pa.int32()), "counts": pa.array([[int(x) for x in (found.sum(), *((sums[0] == c).sum() for c in (1, 2, 3, 4)), (sums[0] > 2).sum(), sums[0].sum())]], pa.list_(pa.int64()))})

        return run

    for k in (0, *range(order, 0, -1)):
        with shuffles_removed(ws.spark):
            rows = sorted(arrow_map(coded, ask(k), FIELDS).groupBy("bucket").applyInArrow(answer(k), "bucket int, counts array<long>").collect())  # a row a bucket
        distinct, *n, more, total = (sum(r.counts[i] for r in rows) for i in range(7))
        if not k:
            if distinct >= (1 << 32) - 2:
                raise ValueError("over 2^32 distinct words")
            meta |= {"n_words": distinct, "tokens": total, "word_base": dict(zip((r.bucket for r in rows), accumulate((r.counts[0] for r in rows), initial=0), strict=False))}
            continue
        meta["discounts"][k] = discounts(n)
        if k == 2:
            meta["n_pairs"] = distinct
        if k == 1:
            meta["low_rest"] = sum(d * c for d, c in zip(meta["discounts"][1], (n[0], n[1], more), strict=True))
    return coded, folder, meta


def slices(batches: Iterator[pa.RecordBatch], folder: str, meta: dict) -> Iterator[tuple[Grams, dict[str, pa.Array]]]:
    """The coded slices, and their texts' ids and numbers of tokens."""
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1)
            texts = {c: row.column(c).flatten() for c in CODED[:3]}
            held = texts["held_out"].to_numpy(zero_copy_only=False).astype(np.bool_)
            index = unpack_columns(row.column("index")[0].as_py(), 1)[0].astype(np.int64)
            yield Grams(folder, meta, row.column("slice")[0].as_py(), unpack_block(row.column("hashes")[0].as_py(), 0)[0], index, texts["n_tokens"].to_numpy(), ~held), texts


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 7, is 2."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 7 == 2


def score(spark: SparkSession, df: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the documents that are not held out and score all.

    Tokens are words (A-Z lower-cased) and an end per document.  The model's ``order``
    is two or more: an n-gram's discounted count over its context's, and what the
    discounts set free spread by the next lower order, down to the discounted number of
    distinct words before a word, and that by a uniform share over all known words and
    one for the unknown; so the probabilities after any words sum to one.  A context
    never seen leaves all to the lower order.  Each order adds an exchange of the
    slices' distinct n-grams and a byte or two for each of them on disk.  Words are known
    by 64 bits of hash, and n-grams of three words or more too: two that agree in all
    bits count as one.

    Returns doc_id (of any type, as it was), held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10), and perplexity.  Null and empty texts are an end alone.
    A text of any length is scored whole.  A null doc_id counts as the empty text in the
    choice of training documents.  Rows that repeat a doc_id are each used.  Without
    training documents every word is as unknown as any.  An empty table gives no rows.
    Further columns are not read.
    """
    if order < 2:
        raise ValueError("the model's order is two or more")
    ws = Workspace(spark, "lm")
    docs = df.select(named(df, doc_id).alias("doc_id"), text_column(df, text).alias("text"), held_out(named(df, doc_id)).alias("held_out"))
    buckets = 1 << (min(max(BUCKETS_EACH * docs.rdd.getNumPartitions(), LEAST_BUCKETS), MOST_BUCKETS) - 1).bit_length()
    coded, folder, meta = train(ws, docs, buckets, order)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, texts in slices(batches, folder, meta):
            known, base, own = (np.add.reduceat(x, bounds(grams.n)[:-1]) for x in grams.log10())
            yield pa.RecordBatch.from_arrays([texts["doc_id"], texts["held_out"], texts["n_tokens"], pa.array(known), pa.array(np.full(len(own), meta["tokens"])), pa.array(base), pa.array(own), pa.array(10.0 ** (-own / grams.n))], names=names)

    kinds = [docs.schema["doc_id"].dataType, "boolean", "long", "long", "long", "double", "double", "double"]
    return arrow_map(coded, run, schema_of(*zip(names, kinds, strict=True)))
