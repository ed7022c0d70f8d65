"""Sharding by a k-d tree over document metadata, with DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelode.llm.common import Workspace, named, text_column

#: A cut is placed to 2^-32 of a node's range, a digit of eight bits a pass: no task gathers over 256 sums of a node.
DIGIT, DIGITS = 8, 4
STEPS = 1 << (DIGIT * DIGITS)
#: Rows that one task numbers within a shard.
ROWS_EACH = 4096
OVERHEAD = 16
#: Categories and ids that are no numbers lie along a line of so many places, by their hash.
PLACES = 1 << 20


def _position(dims: list[str]) -> Column:
    """Where a row lies along its node's dimension, from 0 to STEPS - 1."""
    x = F.element_at(F.array(*dims), F.col("dim"))
    return F.least(F.floor((x - F.col("low")) / F.col("span") * F.lit(float(STEPS))), F.lit(STEPS - 1)).cast("long")


def _extents(placed: DataFrame, dims: list[str], scale: list[float]) -> DataFrame:
    """For each node that is to be split its widest dimension, that dimension's range, and the size that goes left."""
    found = placed.groupBy("first", "leaves").agg(F.sum("size").alias("size"), *(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))))
    width = F.array(*(F.col(f"max_{d}") - F.col(f"min_{d}") for d in dims))
    relative = F.array(*((F.col(f"max_{d}") - F.col(f"min_{d}")) / F.lit(s) for d, s in zip(dims, scale, strict=True)))
    widest = found.withColumn("dim", F.array_position(relative, F.array_max(relative)).cast("int"))
    low = F.element_at(F.array(*(F.col(f"min_{d}") for d in dims)), F.col("dim"))
    left = (F.floor(F.col("leaves") / 2) / F.col("leaves")) * F.col("size")
    return widest.select("first", "leaves", "dim", low.alias("low"), F.element_at(width, F.col("dim")).alias("span"), left.alias("rest"), F.lit(0).cast("long").alias("prefix")).where("span > 0")


def _next_digit(placed: DataFrame, dims: list[str], state: DataFrame, nth: int) -> DataFrame:
    """The state with one more digit of each node's cut: of the rows that share its digits so far, the one in which the running size passes what is left of the aim."""
    shift = DIGIT * (DIGITS - 1 - nth)
    along = placed.join(state.drop("leaves"), "first").withColumn("position", _position(dims)).where(F.shiftright("position", shift + DIGIT) == F.col("prefix"))
    keys = ["first", "dim", "low", "span", "rest", "prefix"]
    sums = along.groupBy(*keys, F.shiftright("position", shift).alias("at")).agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("first").orderBy("at"))
    passed = sums.withColumn("before", upto - F.col("size")).where(F.col("before") + F.col("size") >= F.col("rest"))
    found = passed.groupBy(*keys).agg(F.min(F.struct("at", "before", "size")).alias("m")).withColumn("left_over", F.col("rest") - F.col("m.before"))
    if nth < DIGITS - 1:
        return found.select("first", F.lit(0).alias("leaves"), "dim", "low", "span", F.col("left_over").alias("rest"), F.col("m.at").alias("prefix"))
    nearer = (F.col("left_over") > F.col("m.size") - F.col("left_over")).cast("long")  # the nearer side of the step
    return found.select("first", "dim", "low", "span", (F.col("m.at") + nearer).alias("cut"))


def kd_split(ws: Workspace, rows: DataFrame, dims: list[str], leaves: int, scale: list[float]) -> DataFrame:
    """Split until every leaf holds 1 / ``leaves`` of the size; rows with their leaf as ``shard``.

    ``rows`` has ``size`` and the double columns ``dims``.  A node is the run of leaves
    that it will become: ``first`` and how many.  All nodes of a level are split
    together: their extents, then the weighted median along each one's widest dimension
    (in units of ``scale``), a digit of eight bits a pass.  Rows, nodes and cuts are
    tables; each level and each pass is written and the one before removed, so no plan
    holds more than a level.  Nothing is collected.  Rows meet nodes by a join that Spark
    plans from the nodes table's size on disk: broadcast while it is small, sorted beyond.
    """
    placed = rows.withColumn("first", F.lit(0)).withColumn("leaves", F.lit(leaves))
    for _ in range(math.ceil(math.log2(leaves)) if leaves > 1 else 0):
        active = placed.where("leaves > 1")
        state = ws.cut(_extents(active, dims, scale), "extents")
        for nth in range(DIGITS):
            state = ws.cut(_next_digit(active, dims, state, nth), "cuts")
        known = placed.join(state, "first", "left")
        half = F.floor(F.col("leaves") / 2).cast("int")
        goes_left = F.col("cut").isNull() | (_position(dims) < F.col("cut"))  # a node of one point all goes left
        split = F.col("leaves") > 1
        moved = known.select(
            *[c for c in placed.columns if c not in ("first", "leaves")],
            F.when(split & ~goes_left, F.col("first") + half).otherwise(F.col("first")).alias("first"),
            F.when(~split, F.col("leaves")).when(goes_left, half).otherwise(F.col("leaves") - half).alias("leaves"),
        )
        level = ws.cut(moved, "level")
        if placed is not rows and placed.inputFiles() != rows.inputFiles():
            ws.drop(placed)
        placed = level
    return placed.withColumn("shard", F.col("first")).drop("first", "leaves")


def kd_shards(spark: SparkSession, df: DataFrame, shards: int | None = None, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text", categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Deal documents to shards of near equal bytes: leaves of a k-d tree over metadata.

    Dimensions are doc_id, the document's size (UTF-8 bytes plus 16) and the given
    ``categories`` (by hash; a column the table lacks is passed over).  A node is cut
    at the weighted median of its widest dimension, measured against the whole
    table's extent, or at the weighted quantile that suits an odd number of leaves,
    until leaves reach ``target_bytes`` (or there are ``shards``).  Each coordinate
    has a fraction that depends on the document, so that even one source with all
    rows is cut where the median asks; a shard is off by about a document a level.

    Returns doc_id (as it was), size, text_crc32, law ('bytes'), shard and slot (gapless
    from 0 in each shard).  Texts are read once; the passes read a narrow table of numbers.
    Null text: size 16, crc32 0.  An id that is no number, a null one and a category
    have their place by hash.  Rows equal in doc_id and text are told apart by their
    place in the table as read, so copies of one row spread over shards like any other
    rows; which copy goes where may change with the input's partitions.  A text of any
    length is one row of numbers.  An empty table gives no rows.  Further columns are not read.
    """
    ws = Workspace(spark, "sharding")
    own_text = text_column(df, text)
    size = (F.octet_length(own_text) + F.lit(OVERHEAD)).cast("long")
    hashed = lambda c: F.pmod(F.xxhash64(c.cast("string")), F.lit(PLACES)).cast("double")
    number = named(df, doc_id).cast("string").try_cast("double")
    dims = {"d_doc": F.when(number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(math.inf)), hashed(named(df, doc_id))).otherwise(number), "d_size": size.cast("double")}
    for i, c in enumerate(c for c in categories if c in df.columns):
        dims[f"d_{i}"] = hashed(named(df, c))
    crc, key = F.crc32(F.encode(own_text, "UTF-8")), F.xxhash64(named(df, doc_id).cast("string"), own_text)
    base = ws.cut(df.select(named(df, doc_id).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), key.alias("key"), F.monotonically_increasing_id().alias("row"), *(v.alias(k) for k, v in dims.items())), "rows")
    repeated = ws.cut(base.groupBy("key", "size").agg(F.count("*").alias("copies")).where("copies > 1").drop("copies"), "repeated")
    own = F.col("key") if repeated.isEmpty() else F.when(F.col("again").isNull(), F.col("key")).otherwise(F.xxhash64("key", "row"))
    told = base if repeated.isEmpty() else base.join(repeated.withColumn("again", F.lit(1)), ["key", "size"], "left")
    part = F.pmod(own, F.lit(1 << 31)) / F.lit(float(1 << 31))
    rows = ws.cut(told.select("doc_id", "size", "text_crc32", "row", *((F.col(d) + part).alias(d) for d in dims)), "points")
    whole = rows.agg(F.count("*").alias("n"), F.sum("size").alias("size"), *(F.max(d) - F.min(d) for d in dims)).first()
    if shards is None:
        shards = max(1, math.ceil((whole["size"] or 0) / (target_bytes or 128 << 20)))
    scale = [(whole[2 + i] or 0.0) or 1.0 for i in range(len(dims))]
    leaves = kd_split(ws, rows, list(dims), shards if whole["n"] else 1, scale)
    groups = max(1, math.ceil(whole["n"] / shards / ROWS_EACH))
    dealt = leaves.select("doc_id", "size", "text_crc32", "shard", "row", F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.lit(groups)).alias("group"))
    before = Window.partitionBy("shard").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "group").agg(F.count("*").alias("n"))
    bases = counts.select("shard", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "group").orderBy("doc_id", "text_crc32", "size", "row")
    return dealt.withColumn("place", F.row_number().over(inside)).join(bases, ["shard", "group"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place") - 1).cast("long").alias("slot")
    )
