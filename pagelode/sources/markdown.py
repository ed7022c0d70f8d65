"""Markdown sinks: pages, documents, and the master document with its citation index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions import text as T


def _joined(df: DataFrame, keys: list[str], order: list[str], column: Column, by: str, name: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(*order, column.alias("_t"))))
    return df.groupBy(*keys).agg(listed.alias("_l")).select(*keys, F.array_join(F.transform("_l", lambda x: x["_t"]), by).alias(name))


def simple_pages(blocks: DataFrame) -> DataFrame:
    """Per page: a heading, then each block's text, table or image link."""
    body = F.when(F.col("type") == "text", F.col("content")).when(F.col("type") == "table", F.col("markdown_table")).when(F.col("type") == "picture", F.format_string("![%s](%s)", "image_ref", "image_ref"))
    pages = _joined(blocks.where(body.isNotNull()), ["doc_id", "page"], ["ord"], F.concat(body, F.lit("\n")), "\n", "body")
    return pages.select("doc_id", "page", F.concat(F.lit("\n# Page "), F.col("page").cast("string"), F.lit("\n\n"), "body").alias("markdown"))


def simple_document(blocks: DataFrame) -> DataFrame:
    return _joined(simple_pages(blocks), ["doc_id"], ["page"], F.col("markdown"), "\n", "markdown")


def with_ocr_notes(pages: DataFrame, blocks: DataFrame, ocr: DataFrame) -> DataFrame:
    """Page markdown with ` [^citation]` after each image link whose picture has OCR text, and an index of those citations.

    The text is split at its image links and put together again, all in the JVM.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    pictures = blocks.where(F.col("type") == "picture").select("doc_id", "page", F.col("citation").alias("associated_block"), base(F.col("image_ref")).alias("image"))
    noted = ocr.join(pictures, ["doc_id", "page", "associated_block"])
    by_page = noted.groupBy("doc_id", "page").agg(
        F.map_from_entries(F.array_distinct(F.array_sort(F.collect_list(F.struct("image", F.concat(F.lit(" [^"), "citation", F.lit("]"))))))).alias("notes"),
        F.array_sort(F.collect_list(F.struct("citation", F.concat(F.lit("[^"), "citation", F.lit("]: "), T.preview(F.col("text"), 100)).alias("line")))).alias("index"),
    )
    parts, links = F.split("markdown", T.IMAGE, -1), F.regexp_extract_all("markdown", F.lit(T.IMAGE), F.lit(0))
    noted_link = lambda link: F.concat(link, F.coalesce(F.try_element_at("notes", base(F.regexp_extract(link, T.IMAGE, 2))), F.lit("")))
    text = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(noted_link(F.get(links, i)), F.lit("")))), "")
    index = F.concat(F.lit("\n\n## Citations\n\n"), F.array_join(F.transform("index", lambda x: x["line"]), "\n"))
    return pages.join(by_page, ["doc_id", "page"], "left").select("doc_id", "page", F.when(F.col("notes").isNull(), F.col("markdown")).otherwise(F.concat(text, index)).alias("markdown"))


def master_document(pages: DataFrame, ocr: DataFrame, title: Column) -> DataFrame:
    """Per document: title, number of pages, pages without their citation sections set apart by rules, and one citation index."""
    body = F.trim(F.get(F.split("markdown", "## Citations"), F.lit(0)))
    texts = _joined(pages, ["doc_id"], ["page"], body, "\n\n---\n\n", "body").join(pages.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    line = F.concat(F.lit("[^"), "citation", F.lit("]: Page "), F.col("page").cast("string"), F.lit(" - "), T.preview(F.col("text"), 80))
    index = _joined(ocr, ["doc_id"], ["page", "citation"], line, "\n", "index")
    head = F.concat(F.lit("# "), title, F.lit("\n\n**Total pages:** "), F.col("n").cast("string"), F.lit("\n\n---\n\n"))
    tail = F.when(F.col("index").isNotNull(), F.concat(F.lit("\n\n---\n\n## Master Citation Index\n\n"), "index")).otherwise("")
    return texts.join(index, "doc_id", "left").select("doc_id", F.concat(head, "body", tail).alias("markdown"))


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)))).where("_n = 1").drop("_n")
