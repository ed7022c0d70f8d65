"""Content, block, extraction and prompt hashes (SHA-256, lower-case hex)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def block_hash(content: Column, page: Column, box: Column | None = None, source: Column | None = None) -> Column:
    """Over content, page, box (left out where null) and source, with defaults for what is missing.

    Coordinates are written with two decimals, halves rounded away from zero.
    """
    parts = [F.concat(F.lit("content:"), F.coalesce(content, F.lit(""))), F.concat(F.lit("page:"), F.coalesce(page, F.lit(0)).cast("string"))]
    if box is not None:
        parts.append(F.when(box.isNotNull(), F.format_string("bbox:%.2f,%.2f,%.2f,%.2f", box["x0"], box["y0"], box["x1"], box["y1"])))
    parts.append(F.concat(F.lit("source:"), F.coalesce(source, F.lit("unknown")) if source is not None else F.lit("unknown")))
    return F.sha2(F.concat_ws("|", *parts), 256)


def extraction_hash(hashes: Column) -> Column:
    """Aggregate: over all block hashes, in sorted order; of none, the hash of 'empty_extraction'."""
    joined = F.array_join(F.array_sort(F.collect_list(hashes)), "|")
    return F.sha2(F.coalesce(F.nullif(joined, F.lit("")), F.lit("empty_extraction")), 256)


def prompt_hash(model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("::"), prompt), 256)


def same_file(content: Column, expected: Column) -> Column:
    return F.lower(F.sha2(content, 256)) == F.lower(expected)
