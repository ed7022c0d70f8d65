"""Approximate nearest neighbours: learned binary codes under multi-index hashing, reranked by exact cosine."""

from __future__ import annotations

import math
from itertools import combinations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm.common import Workspace, arrow_map, gather_ranges, named, schema_of, whole_number

#: Bits of a code, and of one substring of it.
BITS, SUBSTRING = 128, 16
#: Vectors that the rotations and the reach are learned on: the first by hash of the vector.
SAMPLE, SAMPLE_QUERIES, ROUNDS = 8192, 256, 25
#: Share of the sample's neighbours that a search's last radius takes in.
AIM = 0.99
#: Vectors of the index and queries that meet in one task.
INDEX_BLOCK, QUERY_BLOCK, LEAST_QUERIES = 1 << 18, 16384, 128
SEED = 5


class Codes:
    """Binary codes: signs after rotations that fit the data to the corners of a cube.

    Each of the ``BITS / d`` rotations is learned by iterative quantization from its
    own random start, in the coordinates of the sample's principal axes.
    """

    def __init__(self, sample: np.ndarray, bits: int = BITS, seed: int = SEED) -> None:
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = unit.mean(0) if len(unit) else np.zeros(sample.shape[1])
        centred = unit - self.mean
        d = sample.shape[1]
        axes = np.linalg.svd(centred.T @ centred)[0] if len(unit) else np.eye(d)
        low = centred @ axes
        turns = []
        for k in range(-(-bits // d)):
            turn = np.linalg.qr(np.random.default_rng([seed, k]).normal(size=(d, d)))[0]
            for _ in range(ROUNDS):
                u, _, vt = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
                turn = (u @ vt).T
            turns.append(axes @ turn)
        self.matrix = np.concatenate(turns, axis=1)[:, :bits]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        signs = (unit - self.mean) @ self.matrix > 0
        return np.ascontiguousarray(np.packbits(signs, axis=1, bitorder="little")).view("<u2")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of code rows, pair by pair (with broadcasting)."""
    return np.bitwise_count(a.view("<u8") ^ b.view("<u8")).sum(-1, dtype=np.int64)


class Reach:
    """The radius within which rows of at least a given cosine lie, but for the share that ``learn`` leaves out."""

    def __init__(self, at: float, slope: float, spread: float, bits: int) -> None:
        self.at, self.slope, self.spread, self.bits = at, slope, spread, bits

    def __call__(self, cosine: float) -> int:
        angle = math.acos(min(max(cosine, -1.0), 1.0))
        return min(math.ceil(self.at + self.slope * angle + self.spread * math.sqrt(max(angle, 0.0))), self.bits)


def learn(sample: np.ndarray, k: int, aim: float = AIM, bits: int = BITS) -> tuple[Codes, Reach]:
    """Codes, and how far in bits a row may be at a given cosine.

    A sample query's k nearest in the sample give pairs of angle and differing bits;
    bits rise in proportion to the angle, their spread with its root.  The line is
    fitted and the spread set so that ``aim`` of the pairs are within reach.
    """
    codes = Codes(sample, bits)
    if len(sample) < 2 * k:
        return codes, Reach(bits, 0.0, 0.0, bits)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    picked = np.unique(np.linspace(0, len(sample) - 1, min(SAMPLE_QUERIES, len(sample))).astype(int))
    near = unit[picked] @ unit.T
    near[np.arange(len(picked)), picked] = -np.inf
    best = np.argsort(-near, axis=1)[:, :k]
    code = codes.encode(sample)
    far = hamming(code[picked][:, None, :], code[best]).ravel().astype(float)
    angle = np.arccos(np.clip(np.take_along_axis(near, best, 1).ravel(), -1, 1))
    root = np.sqrt(np.maximum(angle, 1e-9))
    slope = float((far @ angle) / max(angle @ angle, 1e-9))  # through the origin: equal vectors have equal codes
    spread = float(np.quantile((far - slope * angle) / root, aim))
    return codes, Reach(0.0, slope, max(spread, 0.0), bits)


#: The ball around a substring, shell by shell: ``SHELLS[p]`` holds the values that differ from it in p bits, as masks.
SHELLS = [np.array([sum(1 << i for i in bits) for bits in combinations(range(SUBSTRING), p)], np.uint16) for p in range(SUBSTRING + 1)]


#: Substrings that are looked up between two looks at the radius.
TOGETHER = 4
_UNMET = 32767


class MultiIndex:
    """A block's codes with an inverted list for each value of each substring."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.m = codes, codes.shape[1]
        self.rows = [np.argsort(codes[:, i], kind="stable").astype(np.int32) for i in range(self.m)]
        # Where the list of each value begins, by substring.
        self.begins = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, i], minlength=1 << SUBSTRING))]).astype(np.int32) for i in range(self.m)]
        self.looked_up = self.probed = 0

    def bucket_rows(self, a: int, values: np.ndarray) -> np.ndarray:
        """The rows in the lists of a substring's values."""
        start = self.begins[a][values]
        count = self.begins[a][values + 1] - start
        out = []
        while True:  # lists are short: the first row of each, then the second of those that have one, ...
            some = np.flatnonzero(count > len(out))
            if not len(some):
                return np.concatenate(out) if out else start[:0]
            if len(some) < 64:
                return np.concatenate([*out, gather_ranges(self.rows[a], (start[some] + len(out)).astype(np.int64), (count[some] - len(out)).astype(np.int64))])
            out.append(self.rows[a][start[some] + len(out)])

    def grow(self, query: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each radius that is complete, from the smallest up: the radius and the rows first within it.

        With m substrings, a code within radius m * p + a differs by at most p bits in
        one of the first a + 1 substrings, or by at most p - 1 in one of the others.  So
        after the shell p of substring a is looked up, all codes within m * p + a have
        been met.  Rows met beyond the radius wait for theirs.  Ends when all rows are met.
        """
        far = np.full(len(self.codes), _UNMET, np.int16)
        codes, own = self.codes.view("<u8"), query.view("<u8")
        met, before = 0, -1
        for p, masks in enumerate(SHELLS):
            for first in range(0, self.m, TOGETHER):
                for a in range(first, min(first + TOGETHER, self.m)):
                    found = self.bucket_rows(a, (masks ^ query[a]).astype(np.int32))
                    new = found[far[found] == _UNMET]
                    far[new] = np.bitwise_count(codes[new] ^ own).sum(-1, dtype=np.int16)
                    met += len(new)
                    self.looked_up += len(masks)
                    self.probed += len(new)
                radius = self.m * p + a
                whole = met == len(self.codes)
                radius = self.m * SUBSTRING if whole else radius
                yield radius, np.flatnonzero((far > before) & (far <= radius))
                if whole:
                    return
                before = radius

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, row) of all codes within ``radius``, query by query."""
        for q, query in enumerate(queries):
            for upto, rows in self.grow(query):
                near = rows[hamming(self.codes[rows], query[None]) <= radius]
                yield np.full(len(near), q), near
                if upto >= radius:
                    break


def search(index: MultiIndex, unit: np.ndarray, queries: np.ndarray, query_codes: np.ndarray, most: int, reach: Reach, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows retrieved and their cosines.

    The radius grows until ``most`` answers (a row counts ``weights`` times) are so near that no row beyond it is
    within reach of the last of them, as far as ``reach`` goes; rows within the radius are reranked by their floats.
    """
    for query, code in zip(queries, query_codes, strict=True):
        rows, scores, need = np.zeros(0, np.int64), np.zeros(0), math.inf
        for radius, found in index.grow(code):
            if len(found):
                rows, scores = np.concatenate([rows, found]), np.concatenate([scores, unit[found] @ query])
                best = np.argpartition(-scores, most)[: most + 1] if len(scores) > most + 1 else np.arange(len(scores))
                best = best[np.argsort(-scores[best], kind="stable")]  # enough rows for so many answers, and one that may be the query itself
                enough = np.searchsorted(np.cumsum(weights[rows[best]]), most)
                need = reach(float(scores[best[enough]])) if enough < len(best) else math.inf
            if radius >= need:
                break
        yield rows, scores


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def nearest(spark: SparkSession, df: DataFrame, every: int = 50, k: int = 5, aim: float = AIM, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest rows found, by cosine, of every row whose id is divisible by ``every``, among all other rows.

    Equal vectors are one entry of the index with their k + 1 smallest ids, enough for
    any answer, so copies cost nothing.  Codes and reach are learned on a bounded
    sample (``SAMPLE`` vectors); every vector is indexed.  The stated queries meet the
    index in blocks, bounded on both sides: a task builds the inverted lists of its
    block's substrings, looks up the ball around each of a query's substrings from the
    smallest radius on, reranks what lies within the radius by the cosine of the original
    vectors in double precision, and stops where nothing beyond can be nearer than what
    it has, as far as the reach learned goes.  It hands on its best k + 1; those of all
    blocks are merged.

    Returns query_id, rank (from 1; ties to the smaller id), vec_id and score.  Vectors
    that are null, zero, hold null or non-finite components or have another length
    than most take no part, as do rows without an id.  Ids may be of any type that
    sorts; those that are no whole number are no query.  Rows that repeat an id and
    vector are one.  An empty table gives no rows.  Further columns are not read.
    """
    ws = Workspace(spark, "ann")
    kind = df.schema[vec_id].dataType
    own = named(df, vec_id)
    own = own if whole_number(kind) else own.cast("string")
    kind_read = "long" if whole_number(kind) else "string"
    rows = df.select(own.cast(kind_read).alias("id"), named(df, embedding).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))) & F.exists("v", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = lengths[0]["d"] if lengths else 1
    result = schema_of(("query_id", kind), ("rank", "int"), ("vec_id", kind), ("score", "double"))
    if not lengths:
        return spark.createDataFrame([], result)
    id_type = pa.int64() if kind_read == "long" else pa.string()

    def asks(i: int | str) -> bool:
        try:
            return int(i) % every == 0
        except ValueError:
            return False

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % 32
        for batch in batches:
            if not len(batch):
                continue
            vectors = batch.column(1).flatten().to_numpy().reshape(-1, dim) + 0.0  # no negative zeros
            members: dict[bytes, list] = {}
            for i, v in zip(batch.column(0).to_pylist(), vectors, strict=True):
                members.setdefault(v.tobytes(), []).append(i)
            kept = [sorted(set(m))[: k + 1] for m in members.values()]
            asked = [[i for i in m if asks(i)] for m in members.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(members), pa.binary()), pa.array(np.full(len(members), salt, np.int32)), pa.array(kept, pa.list_(id_type)), pa.array(asked, pa.list_(id_type))], names=["vec", "salt", "ids", "asked"]
            )

    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    parts = ws.cut(arrow_map(rows.where(F.size("v") == dim), collapse, f"vec binary, salt int, ids array<{kind_read}>, asked array<{kind_read}>"), "rows")
    index = parts.groupBy("vec", "salt").agg(least).groupBy("vec").agg(least)
    index = ws.cut(index.withColumn("hash", F.xxhash64("vec")), "index")
    asked = ws.cut(parts.select("vec", F.explode("asked").alias("query_id")).distinct(), "asked")
    queries = ws.cut(asked.groupBy("vec").agg(F.count("*").alias("n")).select("vec", F.monotonically_increasing_id().alias("qid"), F.xxhash64("vec").alias("hash")), "queries")

    n, n_queries = index.count(), queries.count()
    codes, reach = learn(_matrix(pa.array([r["vec"] for r in index.orderBy("hash", "vec").select("vec").limit(SAMPLE).collect()]), dim), k, aim)
    blocks = -(-n // INDEX_BLOCK)
    q_blocks = max(1, -(-n_queries // QUERY_BLOCK), min(8, -(-n_queries // LEAST_QUERIES)))
    found_type = pa.list_(pa.struct([("far", pa.float64()), ("id", id_type)]))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"qid": [], "found": []}
        if left.num_rows and right.num_rows:
            query, vectors = _matrix(left.column("vec"), dim), _matrix(right.column("vec"), dim)
            qids, members = left.column("qid").to_pylist(), right.column("ids").to_pylist()
            weights = np.fromiter(map(len, members), np.int64, len(members))
            norm_q, norm = np.sqrt(np.einsum("ij,ij->i", query, query)), np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            unit = vectors / norm[:, None]
            multi = MultiIndex(codes.encode(vectors))
            for q, (row, near) in enumerate(search(multi, unit, query / norm_q[:, None], codes.encode(query), k + 1, reach, weights)):
                order = np.argsort(-near, kind="stable")
                edge = near[order[min(k, len(order) - 1)]] - 1e-9 if len(order) else 0.0
                row = row[near >= edge]  # the best, and all that tie with the last of them
                score = np.einsum("ij,j->i", vectors[row], query[q]) / (norm[row] * norm_q[q])
                best = sorted((-s, i) for s, r in zip(score.tolist(), row.tolist(), strict=True) for i in members[r])[: k + 1]
                out["qid"].append(qids[q])
                out["found"].append([{"far": s, "id": i} for s, i in best])
        return pa.table(out, schema=pa.schema([("qid", pa.int64()), ("found", found_type)]))

    grid = lambda d, own, other, m, others: d.withColumn(own, F.pmod("hash", F.lit(m)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    left = grid(queries.select("vec", "qid", "hash"), "qb", "ib", q_blocks, blocks).groupBy("qb", "ib")
    right = grid(index, "ib", "qb", blocks, q_blocks).groupBy("qb", "ib")
    found = left.cogroup(right).applyInArrow(meet, f"qid long, found array<struct<far: double, id: {kind_read}>>")
    best = ws.cut(found.groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found")), "found")
    answers = asked.join(queries.join(best, "qid").select("vec", "found"), "vec")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    ranked = answers.select("query_id", F.posexplode(others).alias("at", "x"))
    return ranked.select(F.col("query_id").cast(kind).alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").cast(kind).alias("vec_id"), (-F.col("x.far")).alias("score"))
