"""Shared plumbing: the cluster's shared folder, cut points, Arrow text helpers and prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six ASCII white-space characters; everything else belongs to a word.
WHITE = " \t\n\x0b\x0c\r"
#: Java and RE2 pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share.

    Read from ``spark.checkpoint.dir``.  Where that is unset a temporary folder
    is used, but only on a local master, where there is one machine.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder if "://" in folder else (f"file://{folder}" if folder.startswith("/") else folder)
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='pagelode-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    _made.append(folder)
    return folder


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system that holds a URI, and the path there."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


def delete_folder(uri: str) -> None:
    store, path = open_fs(uri)
    if store.get_file_info(path).type == pafs.FileType.Directory:
        store.delete_dir(path)


@atexit.register
def _clean() -> None:
    for uri in _made:
        try:
            delete_folder(uri)
        except Exception:  # noqa: BLE001  the process ends; a folder that cannot be removed is left
            pass


class Workspace:
    """A folder of one run in the shared folder, removed when the driver ends.

    Results are lazy DataFrames over its tables, so it lives as long as they may.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.uri = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        _made.append(self.uri)
        self.count = 0

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def cut(self, df: DataFrame, name: str = "cut", codec: str = "zstd") -> DataFrame:
        """Write a table and read it back: a cut in the lineage that outlives executors."""
        self.count += 1
        at = self.path(f"{name}-{self.count}")
        df.write.option("compression", codec).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, df_or_path: DataFrame | str) -> None:
        """Remove a table that no later result reads."""
        if isinstance(df_or_path, str):
            delete_folder(df_or_path)
            return
        for folder in {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}:
            delete_folder(folder)

    def mkdir(self, name: str) -> str:
        store, path = open_fs(self.path(name))
        store.create_dir(path, recursive=True)
        return self.path(name)


def write_file(uri: str, parts: list[bytes]) -> None:
    """Write under a temporary name, then rename: a reader never sees half a file."""
    store, path = open_fs(uri)
    temporary = f"{path}.tmp-{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
    store.move(temporary, path)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)


def named(df: DataFrame, name: str) -> Column:
    """A column by its whole name, dots included."""
    return df["`" + name.replace("`", "``") + "`"]


def text_column(df: DataFrame, column: str = "text") -> Column:
    """The column as a string, null as the empty text."""
    return F.coalesce(named(df, column).cast("string"), F.lit(""))


def rest_of(df: DataFrame, *left_out: str) -> Column:
    """All other columns as one struct: whatever their names, they clash with none of an operator's own."""
    names = [c for c in df.columns if c not in left_out]
    return F.struct(*(named(df, c).alias(c) for c in names)) if names else F.struct(F.lit(0).alias("none"))


def schema_of(*fields: tuple[str, str | T.DataType]) -> T.StructType:
    out = T.StructType()
    for name, kind in fields:
        out.add(name, T.DataType.fromDDL(kind) if isinstance(kind, str) else kind)
    return out


def whole_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def order_key(df: DataFrame, name: str) -> Column:
    """A column to order rows by: whole numbers as they are, anything else by its text."""
    return named(df, name).cast("long" if whole_number(df.schema[name].dataType) else "string")


#: Keys that cut points are taken from: all, or beyond this number (or sixteen a range) about as many, by their hash.
KEYS_TAKEN = 10_000
#: Bytes of a range partition: a 1024th of the input, within these bounds.
LEAST_RANGE, MOST_RANGE = 16 << 20, 512 << 20


def cut_points(keys: DataFrame, least: int = LEAST_RANGE, most: int = MOST_RANGE) -> list[tuple]:
    """Points (key, tie) that cut rows (key, tie, bytes) into ranges of about equal bytes.

    Their number follows from the bytes alone and the points from the rows alone, so
    every run deals a table's rows alike, however they are partitioned.  A key in a
    large share of the rows is cut by its ties.
    """
    whole = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    parts = -(-whole["bytes"] // min(max(whole["bytes"] >> 10, least), most))
    if parts < 2:
        return []
    taken = keys.where(F.pmod(F.xxhash64("key", "tie"), F.lit(max(whole["n"] // max(KEYS_TAKEN, 16 * parts), 1))) == 0)
    rows = taken.groupBy("key", "tie").agg(F.sum("bytes").alias("bytes")).collect()
    rows.sort(key=lambda r: (r["key"] is not None, r["key"].encode() if isinstance(r["key"], str) else r["key"], r["tie"]))
    if not rows:
        return []
    upto = np.cumsum([r["bytes"] for r in rows])
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts, side="right"))
    return [(rows[i]["key"], rows[i]["tie"]) for i in at if 0 < i < len(rows)]


def range_of(key: Column, tie: Column, points: list[tuple], kind: str) -> Column:
    """How many points are at or below (key, tie): a binary search in an array that is a constant of the plan."""
    if not points:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([{"key": k, "tie": t} for k, t in points])), f"array<struct<key:{kind},tie:bigint>>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(points).bit_length()))))
    at = F.struct(key.alias("key"), tie.alias("tie"))
    return F.aggregate(steps, F.lit(0), lambda i, s: F.when((i + s <= len(points)) & (F.get(table, i + s - 1) <= at), i + s).otherwise(i))


def deal(rows: DataFrame, points: list[tuple], kind: str) -> DataFrame:
    """Rows (key, tie, ...) in the ranges between the points, a partition each."""
    return rows.repartitionById(len(points) + 1, range_of(F.col("key"), F.col("tie"), points, kind))


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` text bytes, at least a row each: bounds memory whatever the row count."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at] - sizes[at]
        upto = max(int(np.searchsorted(ends, base + limit, side="right")), at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and each text's number of words.  Null is an empty text."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    offsets = lists.offsets.to_numpy()
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets.astype(np.int64) - offsets[0]
    full = pc.greater(pc.binary_length(words), 0)
    if pc.all(full, min_count=0).as_py():
        return words, np.diff(offsets)
    run = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), np.diff(run[offsets])


def bounds(counts: np.ndarray) -> np.ndarray:
    """0 and the running totals: where each row's items begin and end."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def row_sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between successive edges, empty rows included."""
    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return run[edges[1:]] - run[edges[:-1]]


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal, non-negative keys."""
    cuts = np.flatnonzero(np.diff(keys, prepend=-1))
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=False))


def gather_ranges(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start : start + length] over all pairs."""
    ends = np.cumsum(lengths)
    if not len(ends) or ends[-1] == 0:
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]


#: Narrow rows of a range partition.
RANGE_ROWS = 2_000_000


def running_start(ws: Workspace, df: DataFrame, order: list[str], value: str, out: str = "start", group: list[str] | None = None, rows: int = 0) -> DataFrame:
    """Add the exclusive running total of ``value`` in ``order`` (within ``group``).

    Two passes: rows are range-partitioned and written with their partition's
    number; partition totals are prefix-summed (as many rows as partitions and
    groups); each partition then sums on from its base.  No task sees more than a
    partition.  ``order`` should be a total order; rows that tie in all its columns
    take places in an order that a rerun may change.  ``rows``, about how many there
    are, bounds a partition where the session's number of partitions would not.
    """
    group = group or []
    placed = ws.cut(df.repartitionByRange(max(parallelism(ws.spark), -(-rows // RANGE_ROWS)), *group, *order).withColumn("_pid", F.spark_partition_id()), "ranged")
    totals = placed.groupBy(*group, "_pid").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group or [F.lit(0)]).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*group, "_pid", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    keyed = placed
    on = ["_pid", *group]
    if group:  # null groups meet too
        bases = bases.select(F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_base")
        same = keyed["_pid"] == bases["_p"]
        for i, g in enumerate(group):
            same = same & keyed[g].eqNullSafe(bases[f"_g{i}"])
        joined = keyed.join(bases, same, "left").drop("_p", *[f"_g{i}" for i in range(len(group))])
    else:
        joined = keyed.join(bases, on, "left")
    inside = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_pid", "_base")


#: Bytes of an Arrow batch between Spark and its Python workers: bounds both sides whatever the length of texts.
BATCH_BYTES = 12 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


#: Bytes of a group beyond which what its comparison held is given back.
_GROUP_HELD = 1 << 20


def give_back() -> None:
    """Give the system what this process's allocators hold free, Arrow's and, where the C library can, its own.

    Workers outlive tasks, and an executor has several for each core (a stage with two
    Python steps runs two a task), so what idle ones hold stands beside those at work.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes (a session setting, left alone where it is set); what a task held is given back at its end."""
    if df.sparkSession.conf.get(_BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def arrow_groups(groups: GroupedData, function: Callable[[pa.Table], pa.Table], schema: str | T.StructType) -> DataFrame:
    """``applyInArrow``; what a group that is not small held is given back after it."""

    def run(table: pa.Table) -> pa.Table:
        found = function(table)
        if table.nbytes > _GROUP_HELD:
            give_back()
        return found

    return groups.applyInArrow(run, schema)
