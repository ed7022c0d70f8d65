"""Comparing two versions of a document: blocks by content hash, message and field sets, impact and the rebuild decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions import impact
from pagelode.functions.hashing import content_hash


def hashed(blocks: DataFrame) -> DataFrame:
    """A row for each content hash, the last block that has it; blocks without content are left out."""
    content = F.coalesce("content", "markdown_table")
    with_hash = blocks.withColumn("content", content).withColumn("content_hash", content_hash(content)).where(F.col("content_hash").isNotNull())
    last = F.max_by(F.struct("page", "ord", "type", "content"), F.struct("page", "ord")).alias("_last")
    return with_hash.groupBy("content_hash").agg(last).select("content_hash", "_last.*")


def block_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Blocks of one version only, with their impact: side, page, type, content, level, change_type, reasoning."""
    before, after = hashed(old), hashed(new)
    gone = before.join(after.select("content_hash"), "content_hash", "left_anti").select(F.lit("removed").alias("side"), "content_hash", "page", "type", F.col("content").alias("old"), F.lit(None).cast("string").alias("new"))
    come = after.join(before.select("content_hash"), "content_hash", "left_anti").select(F.lit("added").alias("side"), "content_hash", "page", "type", F.lit(None).cast("string").alias("old"), F.col("content").alias("new"))
    return gone.unionByName(come).withColumn("_impact", impact.change(F.col("old"), F.col("new"), F.col("type"))).select("side", "content_hash", "page", "type", "old", "new", "_impact.*")


def set_changes(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column with where they stand: added, removed or unchanged."""
    marked = old.select(column, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(column, F.lit(0).alias("o"), F.lit(1).alias("n")))
    both = marked.groupBy(column).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return both.select(column, F.when(F.col("o") + F.col("n") == 2, "unchanged").when(F.col("n") == 1, "added").otherwise("removed").alias("status"))


def impact_counts(changes: DataFrame) -> DataFrame:
    """One row: changes of each level, zeros included."""
    return changes.agg(*(F.count_if(F.col("level") == n).alias(n.lower()) for n in ("HIGH", "MEDIUM", "LOW")), F.count("*").alias("total"))


def rebuild_decision(changes: DataFrame) -> DataFrame:
    """One row: the counts, whether an index must be rebuilt (any HIGH or MEDIUM), and why."""
    part = lambda n, label: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {label} impact changes")))
    reason = F.concat_ws(", ", part("high", "HIGH"), part("medium", "MEDIUM"))
    rebuild = (F.col("high") > 0) | (F.col("medium") > 0)
    return impact_counts(changes).select("high", "medium", "low", "total", rebuild.alias("requires_rebuild"), F.when(rebuild, reason).otherwise("Only LOW impact changes").alias("reason"))


def compare(old: DataFrame | None, new: DataFrame, old_hash: str | None, new_hash: str) -> tuple[str, DataFrame | None]:
    """baseline (no old version), no_change (equal files) or changed, and the changes."""
    if old is None:
        return "baseline", None
    if old_hash is not None and old_hash.lower() == new_hash.lower():
        return "no_change", None
    return "changed", block_changes(old, new)


def changed_value(old: Column) -> Column:
    return impact.old_value(old)
