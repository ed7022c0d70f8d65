"""Markdown reports, each a row of text put together from ordered parts; times are given, so equal inputs give equal reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions.text import preview, title_case


def _listed(df: DataFrame, order: list[Column], line: Column, keys: tuple[str, ...] = ("doc_id",), name: str = "lines", by: str = "\n") -> DataFrame:
    entry = F.struct(*(o.alias(f"_{i}") for i, o in enumerate(order)), line.alias("t"))
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), by).alias(name))


def _head(title: Column, device: Column, at: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n**Device:** "), device, F.lit("\n**Generated:** "), at, F.lit("\n\n"))


def analyte_section(analytes: DataFrame) -> DataFrame:
    """Per document the analytes in order of name with test type, page and source."""
    part = lambda before, c, after: F.when(c.isNotNull(), F.concat(F.lit(before), c.cast("string"), F.lit(after))).otherwise("")
    line = F.concat(F.lit("- "), "name", part(" (", F.col("test_type"), ")"), part(" - Page ", F.col("page"), ""), F.when(F.col("source") != "unknown", F.concat(F.lit(" ["), "source", F.lit("]"))).otherwise(""))
    listed = _listed(analytes, [F.lower("name"), F.col("name")], line).join(analytes.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    return listed.select("doc_id", F.concat(F.lit("## Supported Analytes ("), F.col("n").cast("string"), F.lit(" total)\n\n"), "lines").alias("analytes"))


def enum_section(enums: DataFrame) -> DataFrame:
    """Per document the code fields by message and name with their values."""
    value = lambda v: F.concat(F.lit("  - `"), v["value"], F.lit("`"), F.when(v["is_default"], " *(default)*").otherwise(""))
    block = F.concat(F.lit("**`"), "field_name", F.lit("`** (Page "), F.col("page").cast("string"), F.lit("):\n"), F.array_join(F.transform("values", value), "\n"), F.lit("\n"))
    by_message = _listed(enums, [F.col("field_name"), F.col("page"), F.col("ord"), F.col("row")], block, ("doc_id", "message_id"), "fields")
    listed = _listed(by_message, [F.col("message_id")], F.concat(F.lit("### "), "message_id", F.lit("\n\n"), "fields"))
    return listed.select("doc_id", F.concat(F.lit("## Enumeration Values\n\n"), "lines").alias("enums"))


def schema_section(schemas: DataFrame) -> DataFrame:
    """Per document every message with its place and its fields as a table."""
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    row = lambda f: F.concat(F.lit("| `"), f["name"], F.lit("` | "), f["data_type"], F.lit(" | "), dash(f["optionality"]), F.lit(" | "), dash(preview(f["description"], 50)), F.lit(" | - |"))
    line = F.concat(
        F.lit("\n#### "), "message_id", F.lit(": "), "description", F.lit("\n**Location:** Page "), F.col("page").cast("string"), F.lit(", Citation "), "citation",
        F.lit("\n\n**Fields ("), F.size("fields").cast("string"), F.lit("):**\n\n| Field | Type | Opt | Description | Example |\n|-------|------|-----|-------------|---------|\n"), F.array_join(F.transform("fields", row), "\n"),
    )
    listed = _listed(schemas, [F.col("message_id")], line)
    return listed.select("doc_id", F.concat(F.lit("### Detailed Message Schemas\n"), "lines").alias("schemas"))


def message_section(messages: DataFrame) -> DataFrame:
    """Per document the messages by category, and the unrecognised with their citations."""
    first = F.min(F.struct("page", "ord")).alias("first")
    label = F.concat("message_id", "direction")
    by_category = messages.groupBy("doc_id", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "pattern", "position", label.alias("t")))), lambda x: x["t"]), ", ").alias("ids"), first)
    listed = _listed(by_category, [F.col("category") == "unrecognized", F.col("first")], F.concat(F.lit("\n### "), title_case(F.col("category")), F.lit("\n"), "ids"))
    unknown = messages.where(~F.col("recognized"))
    note = F.concat(F.lit("- **"), "message_id", F.lit("** "), "direction", F.lit(" - Page "), F.col("page").cast("string"), F.lit(", Citation "), F.coalesce("citation", F.lit("")))
    notes = _listed(unknown, [F.col("page"), F.col("ord"), F.col("message_id")], note, name="notes")
    total = messages.groupBy("doc_id").agg(F.count("*").alias("total"))
    tail = F.when(F.col("notes").isNotNull(), F.concat(F.lit("\n\n### Unrecognized Messages (Auto-Accepted for Review)\n"), "notes")).otherwise("")
    return listed.join(total, "doc_id").join(notes, "doc_id", "left").select("doc_id", "total", F.concat(F.lit("## Message Inventory\n"), "lines", tail).alias("messages"))


def baseline_report(messages: DataFrame, specs: DataFrame, schemas: DataFrame, analytes: DataFrame, enums: DataFrame, version: Column, device: Column, at: Column) -> DataFrame:
    """The report of a first version: doc_id, report."""
    parts = message_section(messages).join(specs.groupBy("doc_id").agg(F.count("*").alias("n_specs")), "doc_id", "left")
    for section in (schema_section(schemas), analyte_section(analytes), enum_section(enums)):
        parts = parts.join(section, "doc_id", "left")
    count = F.coalesce("n_specs", F.lit(0)).cast("string")
    body = F.concat_ws(
        "\n\n",
        F.concat(F.lit("## Extraction Summary\n**Total Messages:** "), F.col("total").cast("string"), F.lit("\n**Total Fields:** "), count),
        "analytes", "messages", F.concat(F.lit("## Field Specifications\n**Total:** "), count, F.lit(" legacy fields")), "schemas",
        F.lit("## No Comparison\nThis is the initial onboarding - no previous version to compare."), "enums",
    )
    return parts.select("doc_id", F.concat(_head(F.concat(F.lit("Baseline Report v"), version), device, at), body).alias("report"))


def change_report(changes: DataFrame, decision: DataFrame, old: str, new: str, device: str, at: str) -> DataFrame:
    """The report of a changed version, one row; ``changes`` and ``decision`` as the diff operators give them."""
    line = F.concat(F.lit("\n**Impact:** "), "level", F.lit("\n**Change:** "), "change_type", F.when(F.col("side") == "removed", "\n**Old:** Page ").otherwise("\n**New:** Page "), F.col("page").cast("string"), F.lit("\n**Reasoning:** "), "reasoning")
    sections = changes.agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == n, F.struct("page", "content_hash", line.alias("t"))))), lambda x: x["t"]), "\n").alias(n.lower() + "_text") for n in ("HIGH", "MEDIUM")))
    section = lambda n: F.when(F.col(n.lower() + "_text") != "", F.concat(F.lit(f"\n\n## {n} Impact Changes\n"), n.lower() + "_text")).otherwise("")
    counts = F.concat(*(x for n in ("HIGH", "MEDIUM", "LOW") for x in (F.lit(f"\n- {n}: "), F.col(n.lower()).cast("string"))))
    body = F.concat(F.lit("## Rebuild Decision\n**Required:** "), F.when(F.col("requires_rebuild"), "YES").otherwise("NO"), F.lit("\n**Reason:** "), "reason", F.lit("\n\n## Impact Summary"), counts, section("HIGH"), section("MEDIUM"))
    head = _head(F.lit(f"Change Report v{old} → v{new}"), F.lit(device), F.lit(at))
    return decision.crossJoin(F.broadcast(sections)).select(F.concat(head, body).alias("report"))  # a row each


def no_change_report(old: str, new: str, device: str, at: str) -> str:
    return f"# No Changes Detected\n\n**Device:** {device}\n**Versions:** v{old} → v{new}\n**Generated:** {at}\n\n## Status\nNo changes detected - spec identical to v{old}.\n\nPDF hash comparison shows no modifications.\n"


def pending_report(pending: DataFrame, at: str) -> DataFrame:
    """All devices' messages that wait for review (device, message_id, page): one row; nothing waiting gives a total of 0."""
    line = F.concat(F.lit("- **"), "message_id", F.lit("** (Page "), F.col("page").cast("string"), F.lit(")"))
    by_device = _listed(pending, [F.col("message_id")], line, ("device",)).join(pending.groupBy("device").agg(F.count("*").alias("n")), "device")
    section = F.struct("device", F.concat(F.lit("\n## "), "device", F.lit("\n"), "lines").alias("t"))
    guide = "\n\n## What to answer\n\n* `approve`: the device speaks this message\n* `reject`: this is no message, but a field or a slip of the reader\n* `defer`: not decided yet; it stays on this list\n"
    whole = by_device.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(section)), lambda x: x["t"]), "\n").alias("t"))
    return whole.select("total", F.concat(F.lit(f"# Pending Message Review\n**Generated:** {at}\n\n## Summary\n**Total Pending:** "), F.col("total").cast("string"), F.lit(" messages\n"), "t", F.lit(guide)).alias("report"))
