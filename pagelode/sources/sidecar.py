"""Document sidecars: nested JSON in either layout, and the normalised tables that everything else works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelode.functions.geometry import bbox
from pagelode.schemas import SIDECAR, SIDECAR_PAGE

#: Characters, about, from which on a document's further pages go to a file of their own.
PIECE = 4 << 20


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Pages of all sidecars under a path: doc_id (of the folder a writer made for it, else the file's stem) and page struct.

    Both an object with ``pages`` and a bare list of pages are read, each file once as
    text and parsed with a fixed schema; a file that is neither gives no rows here and
    one in ``unreadable``.
    """
    read = spark.read.text(path, wholetext=True)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.json)?$", 1)
    files = read.select((F.col("doc_id").cast("string") if "doc_id" in read.columns else stem).alias("doc_id"), F.col("value"))
    return files.select("doc_id", F.explode(_pages()).alias("p"))


def _pages() -> Column:
    listed = F.startswith(F.ltrim("value"), F.lit("["))
    return F.when(listed, F.from_json("value", f"array<{SIDECAR_PAGE}>")).otherwise(F.from_json("value", SIDECAR)["pages"])


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold no pages, as error rows."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return files.where(_pages().isNull()).select("file", F.lit("error").alias("severity"), F.lit("no pages").alias("message"))


def _box(b: Column) -> Column:
    return F.when(F.size(b) == 4, bbox(*(F.get(b, F.lit(i)) for i in range(4))))


def pages(sidecars: DataFrame) -> DataFrame:
    return sidecars.select("doc_id", "p.page", F.coalesce("p.markdown", F.lit("")).alias("markdown"), "p.metadata")


def _with_sources(sidecars: DataFrame) -> DataFrame:
    """Blocks and the source of their citation: doc_id, page, ord, b, cited.

    A map is searched from its start, so that looking up each block of a page would take
    the square of their number; but on streams blocks and citations meet by key instead.
    """
    key = lambda b: F.coalesce(b["citation"], F.lit(""))
    if sidecars.isStreaming:
        found = F.transform("p.blocks", lambda b, i: F.struct((i + 1).alias("ord"), b.alias("b"), F.try_element_at("p.citations", key(b))["source"].alias("cited")))
        return sidecars.select("doc_id", "p.page", F.inline(found))
    held = F.transform("p.blocks", lambda b, i: F.struct((i + 1).alias("ord"), key(b).alias("key"), b.alias("b"), F.lit(None).cast("struct<i: int, source: string>").alias("c")))
    named = F.transform(F.map_entries("p.citations"), lambda e, i: F.struct(F.lit(None).cast("int").alias("ord"), e["key"].alias("key"), F.get("p.blocks", F.lit(-1)).alias("b"), F.struct(i.alias("i"), e["value"]["source"].alias("source")).alias("c")))
    met = F.when(F.col("p.citations").isNull(), held).otherwise(F.concat(held, named))
    flat = sidecars.select("doc_id", "p.page", F.monotonically_increasing_id().alias("n"), met.alias("met")).select("doc_id", "page", "n", F.inline("met"))
    return flat.withColumn("cited", F.min("c").over(Window.partitionBy("n", "key"))["source"]).where(F.col("ord").isNotNull())


def blocks(sidecars: DataFrame, keep_graphics: bool = True) -> DataFrame:
    """Blocks with defaults for missing keys: content or markdown, table markdown or markdown, md_slice the whole content, source by the citation."""
    flat = _with_sources(sidecars)
    content = F.when(F.col("b.type") != "table", F.coalesce("b.content", "b.markdown"))
    table = F.when(F.col("b.type") == "table", F.coalesce("b.markdown_table", "b.markdown", "b.content"))
    found = flat.select(
        "doc_id", "page", "ord", "b.type", _box(F.col("b.bbox")).alias("bbox"), "b.citation",
        F.coalesce(F.get("b.md_slice", F.lit(0)), F.lit(0)).alias("md_start"), F.coalesce(F.get("b.md_slice", F.lit(1)), F.length(content)).alias("md_end"),
        content.alias("content"), F.coalesce("b.image_ref", "b.image").alias("image_ref"), "b.table_ref", table.alias("markdown_table"), F.coalesce("b.source", "cited").alias("source"),
    )
    return found if keep_graphics else found.where(F.col("type") != "graphics")


def citations(sidecars: DataFrame) -> DataFrame:
    flat = sidecars.select("doc_id", "p.page", "p.citations").select("doc_id", "page", F.explode("citations").alias("citation_id", "c"))  # else the page is copied for each
    return flat.select("doc_id", "page", "citation_id", _box(F.col("c.bbox")).alias("bbox"), "c.source", "c.confidence", "c.content_type")


def ocr(sidecars: DataFrame) -> DataFrame:
    flat = sidecars.select("doc_id", "p.page", "p.ocr").select("doc_id", "page", F.explode("ocr").alias("o"))
    return flat.select("doc_id", "page", _box(F.col("o.bbox")).alias("bbox"), "o.text", "o.confidence", "o.source", "o.citation", "o.associated_block", F.coalesce("o.language", F.lit("eng")).alias("language"))


def _pieces(page_rows: DataFrame, counted: list[tuple[DataFrame, Column]]) -> DataFrame:
    """Pages with the number of the document's pages, ``total``, and of the file, ``piece``, they go to: a new one from each ``PIECE`` characters on."""
    on = ["doc_id", "page"]
    sizes = page_rows.select(*on, F.lit(1).alias("pages"), (100 + F.coalesce(F.length("markdown"), F.lit(0))).cast("long").alias("size"))
    for rows, size in counted:
        sizes = sizes.unionByName(rows.select(*on, F.lit(0).alias("pages"), size.cast("long").alias("size")))
    w = Window.partitionBy("doc_id")
    before = F.sum("size").over(w.orderBy("page").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = sizes.groupBy(*on).agg(F.sum("pages").alias("pages"), F.sum("size").alias("size"))
    placed = placed.select(*(F.col(c).alias(f"_{c}") for c in on), F.floor(before / PIECE).alias("piece"), F.sum("pages").over(w).cast("int").alias("total"))
    return page_rows.join(placed, [page_rows[c].eqNullSafe(placed[f"_{c}"]) for c in on]).drop(*(f"_{c}" for c in on))


def to_sidecars(page_rows: DataFrame, block_rows: DataFrame, citation_rows: DataFrame | None = None, ocr_rows: DataFrame | None = None) -> DataFrame:
    """One JSON object a document: doc_id, value; of a document beyond ``PIECE`` characters several, each with some of its pages and the number of all.

    Pages may have ``metadata``; citations and OCR results are those that ``citations``
    and ``ocr`` give, and are left out where there are none.  Pages are not cut, so a task
    holds a page and what its file holds besides.
    """
    box = F.when(F.col("bbox").isNotNull(), F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1"))
    slice_ = F.when(F.col("type") == "text", F.array("md_start", "md_end"))
    block = F.struct("ord", F.struct("type", box.alias("bbox"), "citation", slice_.alias("md_slice"), F.when(F.col("type") == "text", F.col("content")).alias("content"), "image_ref", "table_ref", "markdown_table", "source").alias("b"))
    on = ["doc_id", "page"]
    pages = page_rows.select(*on, "markdown", *(["metadata"] if "metadata" in page_rows.columns else []))
    shown = pages.columns[1:]
    chars = lambda *texts: sum((F.coalesce(F.length(t), F.lit(0)) for t in texts), F.lit(200))
    counted = [(block_rows, chars("content", "markdown_table"))]
    parts = [block_rows.groupBy(*on).agg(F.array_sort(F.collect_list(block)).alias("bs")).select(*on, F.transform("bs", lambda x: x["b"]).alias("blocks"))]
    if citation_rows is not None:
        counted.append((citation_rows, chars()))
        cited = F.struct("citation_id", F.struct("citation_id", "page", box.alias("bbox"), "source", "confidence", "content_type").alias("c"))
        parts.append(citation_rows.groupBy(*on).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("citation_id", cited["c"].alias("c"))))).alias("citations")))
    if ocr_rows is not None:
        counted.append((ocr_rows, chars("text")))
        seen = F.struct(box.alias("bbox"), "text", "confidence", "source", "citation", "associated_block", "language")
        parts.append(ocr_rows.groupBy(*on).agg(F.array_sort(F.collect_list(seen), lambda x, y: F.when(x["citation"] < y["citation"], -1).when(x["citation"] > y["citation"], 1).otherwise(0)).alias("ocr")))
    pages = _pieces(pages, counted)
    for part in parts:
        pages = pages.join(part, on, "left")
        shown.append(part.columns[-1])
    page = F.struct("page", F.to_json(F.struct(*shown)).alias("p"))
    whole = pages.groupBy("doc_id", "piece", "total").agg(F.array_sort(F.collect_list(page)).alias("ps"))
    head = F.to_json(F.struct(F.col("doc_id").alias("pdf_name"), F.col("total").alias("total_pages")))
    return whole.select("doc_id", F.concat(F.left(head, F.length(head) - 1), F.lit(',"pages":['), F.array_join(F.transform("ps", lambda x: x["p"]), ","), F.lit("]}")).alias("value"))


def write_sidecars(sidecars: DataFrame, path: str) -> None:
    """Text files of one JSON object each, in folders by document."""
    sidecars.write.partitionBy("doc_id").mode("overwrite").option("maxRecordsPerFile", 1).text(path)
