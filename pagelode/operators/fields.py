"""Field definitions from tables, their types and values, message schemas, and analytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions import infer
from pagelode.functions import tables as md
from pagelode.functions.text import let

# What names a message, a column or a message's purpose.
MESSAGE = r"([A-Z]{3,4}\.[A-Z]\d+)"
COLUMNS = {
    "field": ("field", r"field\s+name", "name", "segment"),
    "description": ("description", "meaning", "definition"),
    "example": ("example", "sample", "value"),
    "optionality": ("r/o/n", "use", "usage", "req"),
    "cardinality": ("cardinality", "rep", "repetition", "occurs"),
}
DESCRIPTIONS = {
    "HEL.R01": "Hello Message - Device introduction",
    "ACK.R01": "Acknowledgement Message",
    "DST.R01": "Device Status Message",
    "DTV.R01": "Basic Directive Message",
    "DTV.R02": "Complex Directive Message",
    "OBS.R01": "Observation Message - Patient Results",
    "OBS.R02": "Observation Message - Non-Patient Results",
    "OPL.R01": "Operator List Message",
    "EOT.R01": "End Of Topic Message",
    "END.R01": "End Conversation Message",
    "QCN.R01": "Quality Control Message",
}
ANALYTE_HEADERS = ("test type", "analyte", "assay", "test name", "supported test", "available test", "result", "observation", "measurement")


def _field_rows(markdown: Column) -> Column:
    """The data rows of a field table as structs: row, and a value for each family of headers; none of another table.

    One expression that splits each line and places each header once; as columns of
    their own the cells would be split again wherever a later filter names a value.
    """

    def values(cells: Column, at: Column, row: Column) -> Column:
        whole = F.size(cells) > F.greatest(*(F.coalesce(at[k], F.lit(-1)) for k in COLUMNS))
        named = ~F.lower(F.get(cells, at["field"])).isin("field", "name", "")
        return F.when(whole & named, F.struct(row.alias("row"), *(F.get(cells, at[k]).alias(k) for k in COLUMNS)))

    def rows(lines: Column, at: Column) -> Column:
        data = F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))
        found = F.transform(data, lambda line, i: let(md.line_cells(line), lambda cells: values(cells, at, i)))
        return F.when(at["field"].isNotNull(), F.filter(found, lambda r: r.isNotNull()))

    def placed(lines: Column) -> Column:
        at = lambda headers: F.struct(*(md.header_like(headers, p).alias(k) for k, p in COLUMNS.items()))
        return F.when(F.size(lines) >= 3, let(let(md.line_cells(F.get(lines, F.lit(0))), at), lambda a: rows(lines, a)))

    return let(md.table_lines(markdown), placed)


def field_definitions(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Fields defined in the tables of pages that name a message; the page's first message is the parent.

    pages: doc_id, page, markdown.  blocks: doc_id, page, ord, type, markdown_table,
    citation.  Where a page names several messages the first by position is taken.
    Tables are read after the join, which is shuffled whatever sizes are estimated, so
    that all tasks share the work however few files or row groups there are.
    """
    message = F.regexp_extract("markdown", MESSAGE, 1)
    parents = pages.select("doc_id", "page", F.explode(F.filter(F.array(message), lambda m: m != "")).alias("message_id"))
    tables = blocks.where(F.col("type") == "table").select("doc_id", "page", "ord", "citation", "markdown_table")
    joined = tables.hint("merge").join(parents, ["doc_id", "page"]).select("doc_id", "page", "message_id", "ord", "citation", F.inline(_field_rows(F.col("markdown_table"))))
    type_ = infer.field_type(F.col("field"), F.col("description"), F.col("example"))
    return joined.select(
        "doc_id", "page", "message_id", "ord", "row", F.col("field").alias("field_name"), type_.alias("field_type"), "optionality", "cardinality",
        F.coalesce("description", F.lit("")).alias("description"), "example", F.col("citation").alias("citation_id"),
    )


def enum_definitions(fields: DataFrame) -> DataFrame:
    """Code fields with their values (defaults first).  Values that are none are left out as they are made: a filter would make them again."""
    values = infer.enum_values(F.col("field_type"), F.col("description"), F.col("example"))
    return fields.select("doc_id", "message_id", "page", "ord", "row", "field_name", F.explode(F.filter(F.array(values), lambda v: v.isNotNull())).alias("values"))


def message_schemas(fields: DataFrame) -> DataFrame:
    """Per message its fields in order, trigger, description, and the page and citation of its first field."""
    order = ("page", "ord", "row")
    entry = F.struct(*order, F.col("field_name").alias("name"), F.col("field_type").alias("data_type"), "optionality", "description", F.coalesce("citation_id", F.concat("field_name", F.lit("_unknown"))).alias("citation"))
    grouped = fields.groupBy("doc_id", "message_id").agg(F.array_sort(F.collect_list(entry)).alias("fields"), F.min_by(F.struct("page", "citation_id"), F.struct(*order)).alias("first"))
    known = F.create_map(*(F.lit(x) for pair in DESCRIPTIONS.items() for x in pair))
    return grouped.select(
        "doc_id", "message_id", F.get(F.split("message_id", r"\."), F.lit(1)).alias("trigger_event"), F.coalesce(F.try_element_at(known, "message_id"), F.concat("message_id", F.lit(" Message"))).alias("description"),
        F.col("first.page").alias("page"), F.coalesce("first.citation_id", F.concat("message_id", F.lit("_unknown"))).alias("citation"), "fields",
    )


def text_analytes(texts: DataFrame, text: str = "content", source: str = "text_mention") -> DataFrame:
    """Analytes named in texts (doc_id, page, and the text)."""
    return texts.select("doc_id", "page", F.explode(infer.analytes_in(F.col(text))).alias("name")).select("doc_id", "name", F.lit(None).cast("string").alias("test_type"), "page", F.lit(source).alias("source"))


def table_analytes(blocks: DataFrame) -> DataFrame:
    """Analytes from tables whose header names some; the last fitting column counts, and a test type of '-' is none."""
    lines = md.table_lines(F.coalesce("markdown_table", F.lit("")))
    fits = F.lit(False)
    for h in ANALYTE_HEADERS:
        fits = fits | F.contains(F.lower(F.get(lines, F.lit(0))), F.lit(h))
    tables = blocks.where((F.col("type") == "table") & (F.size(lines) >= 3) & fits).select("doc_id", "page", lines.alias("lines"))
    headers = F.transform(md.line_cells(F.get("lines", F.lit(0))), lambda h: F.lower(h))
    is_name = lambda h: F.contains(h, F.lit("analyte")) | F.contains(h, F.lit("observation")) | F.contains(h, F.lit("result")) | F.contains(h, F.lit("test name"))
    is_type = lambda h: ~is_name(h) & (F.contains(h, F.lit("test type")) | F.contains(h, F.lit("assay")))
    name_at = F.array_max(F.transform("headers", lambda h, i: F.when(is_name(h), i)))
    type_at = F.array_max(F.transform("headers", lambda h, i: F.when(is_type(h), i)))
    placed = tables.withColumn("headers", headers).select("doc_id", "page", name_at.alias("name_at"), type_at.alias("type_at"), F.explode(F.slice("lines", 3, F.size("lines"))).alias("line"))
    cells = placed.where(F.col("name_at").isNotNull()).withColumn("cells", md.line_cells(F.col("line")))
    test_type = F.nullif(F.nullif(F.get("cells", F.col("type_at")), F.lit("")), F.lit("-"))
    found = cells.select("doc_id", infer.analyte_name(F.get("cells", F.col("name_at"))).alias("name"), test_type.alias("test_type"), "page", F.lit("table").alias("source"))
    return found.where(F.col("name").isNotNull())


def field_analytes(fields: DataFrame) -> DataFrame:
    """Analytes in the examples and descriptions of observation-id and analyte fields."""
    named = fields.where(F.lower("field_name").contains("observation_id") | F.lower("field_name").contains("analyte"))
    examples = named.select("doc_id", infer.analyte_name(F.col("example")).alias("name"), F.lit(None).cast("string").alias("test_type"), "page", F.lit("field_example").alias("source")).where(F.col("name").isNotNull())
    return examples.unionByName(text_analytes(named, "description"))


def unique_analytes(analytes: DataFrame, exact: bool = False) -> DataFrame:
    """One row a name and document (case-blind, or ``exact`` as reports list them), tables and fields before mentions, in order of name."""
    key = F.col("name") if exact else F.lower("name")
    late = (F.col("source") == "text_mention").cast("int")
    best = Window.partitionBy("doc_id", key).orderBy(late, "page", "name", "source", "test_type")
    return analytes.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
