"""Message types, directions, categories and legacy field ids, from blocks of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelode.functions import tables as md
from pagelode.functions import text as T

# The standard prefixes by category; where a prefix stands twice the earlier category wins.
STANDARDS = (
    ("observation", ("OBS", "ORU", "ORR", "ORL")),
    ("config", ("QCN", "OPL", "OSL", "OML", "OUL")),
    ("qc", ("QCN", "QRY")),
    ("common", ("ACK", "MSH", "PID", "OBR", "OBX", "NTE", "ORC", "SPM", "SAC", "TQ1", "TCD", "SFT", "ERR")),
    ("query", ("QRY", "QBP", "RSP")),
)
TO_HOST, TO_DEVICE, BOTH = "→Host", "←Device", "↔Both"
FIRST_IN_DOC = ("page", "ord", "pattern", "position")


def message_id(match: Column) -> Column:
    """A^B_C becomes A.C, ids of dotted segments stay, and other separators become dots."""
    caret = F.split(match, r"\^")
    last = F.element_at(F.split(F.get(caret, F.lit(1)), "_"), -1)
    return (
        F.when(F.contains(match, F.lit("^")) & (F.size(caret) == 2), F.concat(F.get(caret, F.lit(0)), F.lit("."), last))
        .when(F.contains(match, F.lit("^")), F.lit(None))
        .when(match.rlike("^" + T.MESSAGE_SEGMENTS), match)
        .otherwise(F.replace(match, F.lit("_"), F.lit(".")))
    )


def direction(content: Column, id_: Column) -> Column:
    """From phrases in the content, else from the kind of message."""
    c, prefix = F.lower(content), F.split_part(id_, F.lit("."), F.lit(1))
    return (
        F.when(T.contains_any(c, ("device to", "analyzer to", "send to", "transmit to")), TO_HOST)
        .when(T.contains_any(c, ("to device", "to analyzer", "query", "request")), TO_DEVICE)
        .when(T.contains_any(c, ("bidirectional", "both directions")), BOTH)
        .when(prefix.isin("OBS", "ORU"), TO_HOST)
        .when(prefix.isin("QCN", "QRY"), TO_DEVICE)
        .otherwise(TO_HOST)
    )


def standards_table(spark: SparkSession) -> DataFrame:
    """The built-in dictionary as a table, to be replaced or extended: prefix, category, priority."""
    rows = [(p, c, i) for i, (c, prefixes) in enumerate(STANDARDS) for p in prefixes]
    return spark.createDataFrame(rows, "prefix string, category string, priority int")


def first_seen(df: DataFrame, keys: list[str], order: tuple[str, ...] = FIRST_IN_DOC) -> DataFrame:
    """The earliest row of each key.  An aggregate, combined before the shuffle, rather than a sort of every key's rows."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def _hits(patterns: tuple[str, ...]) -> Column:
    """All matches of all patterns in ``content``, with the pattern's and the match's number."""

    def of(number: int, pattern: str) -> Column:
        found = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
        return F.transform(found, lambda m, i: F.struct(F.lit(number).alias("pattern"), i.alias("position"), m.alias("match")))

    return F.flatten(F.array(*(of(k, p) for k, p in enumerate(patterns))))


def extract_messages(blocks: DataFrame) -> DataFrame:
    """Messages named in blocks with content (doc_id, page, ord, content, citation), each at its first place in a document.

    All patterns run on every block in one projection; ties are settled by page,
    block, pattern and place.  Table text is not scanned.
    """
    found = blocks.where(F.col("content").isNotNull()).select("doc_id", "page", "ord", "content", "citation", F.explode(_hits(T.MESSAGE_PATTERNS)).alias("hit"))
    found = found.select("doc_id", "page", "ord", "content", "citation", "hit.pattern", "hit.position", message_id(F.col("hit.match")).alias("message_id"))
    found = found.where(F.col("message_id").isNotNull() & (F.col("message_id") != ""))
    first = first_seen(found, ["doc_id", "message_id"])
    return first.select("doc_id", "message_id", direction(F.col("content"), F.col("message_id")).alias("direction"), "page", "ord", "pattern", "position", "citation")


def categorise(messages: DataFrame, standards: DataFrame | None = None) -> DataFrame:
    """Add category and recognised: the dictionary first, then Z segments, then ids of three segments or more.

    The dictionary is reduced to a row a prefix and is configuration of bounded size.
    """
    standards = standards if standards is not None else standards_table(messages.sparkSession)
    by_prefix = standards.groupBy("prefix").agg(F.min_by("category", "priority").alias("standard"))
    prefix = F.regexp_extract("message_id", r"^[^.^_]*", 0)
    joined = messages.withColumn("prefix", prefix).join(by_prefix, "prefix", "left")
    vendor = F.col("prefix").rlike("^" + T.VENDOR_LONG) | F.col("prefix").rlike("^" + T.VENDOR)
    segments = F.size(F.split("message_id", r"\.")) >= 3
    category = F.coalesce("standard", F.when(vendor | segments, "vendor_specific"), F.lit("unrecognized"))
    return joined.withColumn("category", category).withColumn("recognized", F.col("category") != "unrecognized").drop("prefix", "standard")


def category_summary(messages: DataFrame) -> DataFrame:
    """Per document and category the ids with their directions, recognised first, in order of appearance."""
    entry = F.struct((~F.col("recognized")).alias("late"), *FIRST_IN_DOC, F.concat("message_id", "direction").alias("label"))
    listed = messages.groupBy("doc_id", "category").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return listed.select("doc_id", "category", F.transform("entries", lambda e: e["label"]).alias("messages"))


def summary_counts(messages: DataFrame) -> DataFrame:
    """Per document: messages in all and by the categories that reports count."""
    named = ("observation", "config", "qc", "vendor_specific", "unrecognized")
    return messages.groupBy("doc_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("category") == c).alias(c) for c in named))


def auto_accept(messages: DataFrame, custom: DataFrame, device: Column, at: Column) -> DataFrame:
    """Rows to append to the custom messages (device, message_id, ...): unrecognised ids the device does not have yet."""
    new = messages.where(~F.col("recognized")).withColumn("device", device).join(custom.select("device", "message_id"), ["device", "message_id"], "left_anti")
    note = F.concat(F.lit("Auto-accepted during spec parsing - Direction: "), "direction")
    return new.select("device", "message_id", F.lit("vendor_specific").alias("category"), "page", "citation", F.lit(True).alias("auto_accepted"), at.alias("timestamp"), F.lit("pending").alias("review_status"), note.alias("notes"))


def review_message(reviews: DataFrame) -> DataFrame:
    """The latest review of each device's message, from an append-only log (device, message_id, review_status, notes, reviewed_at)."""
    return reviews.groupBy("device", "message_id").agg(F.max_by(F.struct("review_status", "notes", "reviewed_at"), "reviewed_at").alias("_last")).select("device", "message_id", "_last.*")


FIELD_PATTERNS = (T.FIELD, T.FIELD_DOT, T.FIELD_ANY)


def _field_id(match: Column) -> Column:
    return F.regexp_replace(match, r"[._]", "-")


def field_specs(blocks: DataFrame) -> DataFrame:
    """Legacy field ids (MSH-9) from tables and from text, each at its first place in a document.

    In a table the first cell names the field, and the last column whose header has
    name, type, opt, card or desc in it (in that order of precedence) gives the
    attribute.  Outer bars alone are stripped, so empty cells keep their place.
    """
    cells_of = lambda s: F.transform(F.split(F.regexp_replace(F.trim(s), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    lines = F.filter(F.split("markdown_table", "\n"), lambda s: F.trim(s) != "")
    tables = blocks.where((F.col("type") == "table") & (F.size(lines) >= 2)).select("doc_id", "page", "ord", "citation", lines.alias("lines"))
    headers = F.transform(cells_of(F.get("lines", F.lit(0))), lambda h: F.lower(h))
    first_row = F.when(F.get("lines", F.lit(1)).rlike(r"^[-|: ]+$"), 2).otherwise(1)
    kind = lambda h: F.when(F.contains(h, F.lit("name")), "name").when(F.contains(h, F.lit("type")), "type").when(F.contains(h, F.lit("opt")), "opt").when(F.contains(h, F.lit("card")), "card").when(F.contains(h, F.lit("desc")), "desc")
    rows = tables.select("doc_id", "page", "ord", "citation", F.transform(headers, kind).alias("kinds"), F.posexplode(F.slice("lines", first_row + 1, F.size("lines"))).alias("position", "line")).withColumn("cells", cells_of(F.col("line")))

    def attribute(name: str) -> Column:
        at = F.array_max(F.transform("kinds", lambda k, i: F.when(k == name, i)))
        return F.nullif(F.get("cells", at), F.lit("")).alias({"name": "name", "type": "data_type", "opt": "optionality", "card": "cardinality", "desc": "description"}[name])

    cell = F.get("cells", F.lit(0))
    named = F.coalesce(*(T.first_match(cell, p, 0) for p in FIELD_PATTERNS))
    attributes = [attribute(k) for k in ("name", "type", "opt", "card", "desc")]
    from_tables = rows.where(named.isNotNull()).select("doc_id", _field_id(named).alias("field_id"), "page", "ord", F.lit(0).alias("pattern"), "position", "citation", F.lit(0).alias("late"), *attributes)
    text = blocks.where((F.col("type") == "text") & F.col("content").isNotNull()).select("doc_id", "page", "ord", "citation", F.explode(_hits(FIELD_PATTERNS)).alias("hit"))
    empty = [F.lit(None).cast("string").alias(n) for n in ("name", "data_type", "optionality", "cardinality", "description")]
    from_text = text.select("doc_id", _field_id(F.col("hit.match")).alias("field_id"), "page", "ord", "hit.pattern", "hit.position", "citation", F.lit(0).alias("late"), *empty)
    return first_seen(from_tables.unionByName(from_text), ["doc_id", "field_id"]).drop("late", "pattern", "position")


def table_cells(blocks: DataFrame) -> DataFrame:
    """Every cell of every table: doc_id, page, ord, row, col, header, value."""
    parsed = blocks.select("doc_id", "page", "ord", md.parse_table(F.coalesce("markdown_table", "content")).alias("t")).where(F.col("t").isNotNull())
    rows = parsed.select("doc_id", "page", "ord", "t.headers", F.posexplode("t.cells").alias("row", "cells"))
    return rows.select("doc_id", "page", "ord", "row", F.posexplode(F.arrays_zip("headers", "cells")).alias("col", "c")).select("doc_id", "page", "ord", "row", "col", F.col("c.headers").alias("header"), F.col("c.cells").alias("value"))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
