"""Blocks of pages: filters, spatial joins, table reconstruction from text spans, layout and reading order.

Spatial joins are equi-joins on document and page; the geometry is a residual on
the few boxes of one page, so no pair of boxes of different pages is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions import geometry as G
from pagelode.functions import text as T

ON_PAGE = ["doc_id", "page"]
Y_TOLERANCE, COLUMN_GAP, REGION_GAP, LEAST_ROWS, LEAST_COLUMNS = 5.0, 20.0, 30.0, 2, 2
HEADER_ABOVE, FOOTER_BELOW, SIDE_WIDTH, SIDE_EDGE = 100.0, 700.0, 0.2, 0.1
LEAST_GRAPHIC, LEAST_OCR_CONFIDENCE, TABLE_MARGIN = 20.0, 0.7, 20.0


def of_type(blocks: DataFrame, kind: str) -> DataFrame:
    return blocks.where(F.col("type") == kind)


def by_citation(blocks: DataFrame, citation: Column | str) -> DataFrame:
    """The first block with a citation."""
    return blocks.where(F.col("citation") == citation).orderBy("doc_id", "page", "ord").limit(1)


def text_near(blocks: DataFrame, citations: DataFrame, box: Column, tolerance: float = 10.0) -> DataFrame:
    """Text blocks whose citation's box has its centre within ``tolerance`` of that of ``box``."""
    cited = citations.select(*ON_PAGE, F.col("citation_id").alias("citation"), F.col("bbox").alias("cited"))
    return of_type(blocks, "text").join(cited, [*ON_PAGE, "citation"]).where(G.near(F.col("cited"), box, tolerance)).drop("cited")


def with_citations(blocks: DataFrame, citations: DataFrame) -> DataFrame:
    """Blocks with their citations' box, source and confidence; null where the page has none."""
    cited = citations.select(*ON_PAGE, F.col("citation_id").alias("citation"), F.struct("bbox", "source", "confidence").alias("cited"))
    return blocks.join(cited, [*ON_PAGE, "citation"], "left")


def _boxes(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).alias(f"_{c}") for c in ON_PAGE), F.col("bbox").alias("_bbox"))


def overlapping(left: DataFrame, right: DataFrame, how: str = "left_semi", edges: bool = False) -> DataFrame:
    """Rows of ``left`` with (left_semi) or without (left_anti) a box of ``right`` on their page that overlaps theirs."""
    other = _boxes(right)
    meets = (G.touch if edges else G.overlap)(left["bbox"], other["_bbox"])
    return left.join(other, (left["doc_id"] == other["_doc_id"]) & (left["page"] == other["_page"]) & meets, how)


def new_tables(candidates: DataFrame, tables: DataFrame) -> DataFrame:
    """Text tables that touch no table already found."""
    return overlapping(candidates, tables, "left_anti", edges=True)


def ocr_candidates(regions: DataFrame, words: DataFrame) -> DataFrame:
    """Picture and graphics regions without selectable text."""
    return overlapping(regions.where(F.col("type").isin("picture", "graphics")), words, "left_anti")


def ocr_results(words: DataFrame, least: float = LEAST_OCR_CONFIDENCE) -> DataFrame:
    """Recognised words (doc_id, page, region, position, text, conf in 0-100) joined per region, kept from a mean confidence of ``least``."""
    kept = words.where((F.col("conf") > 0) & (F.trim("text") != ""))
    joined = kept.groupBy(*ON_PAGE, "region").agg(F.array_sort(F.collect_list(F.struct("position", F.trim("text").alias("text")))).alias("w"), (F.avg("conf") / 100).alias("confidence"))
    return joined.select(*ON_PAGE, "region", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), "confidence").where(F.col("confidence") >= least)


def attach_ocr(ocr: DataFrame) -> DataFrame:
    """OCR results with citation ids p{page}_ocr{n} in order of region."""
    n = F.row_number().over(Window.partitionBy(*ON_PAGE).orderBy("region"))
    return ocr.withColumn("citation", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_ocr"), n.cast("string")))


def text_blocks(spans: DataFrame) -> DataFrame:
    """Blocks from their lines' spans (lines: array of struct(spans: array of struct(text))): texts joined by a blank, blank blocks dropped."""
    content = F.array_join(F.transform(F.flatten(F.transform("lines", lambda line: line["spans"])), lambda s: s["text"]), " ")
    return spans.withColumn("content", content).where(F.trim("content") != "").drop("lines")


def graphics(drawings: DataFrame, least: float = LEAST_GRAPHIC) -> DataFrame:
    """Drawings that are not narrower or lower than ``least``."""
    return drawings.where((F.col("bbox.x1") - F.col("bbox.x0") >= least) & (F.col("bbox.y1") - F.col("bbox.y0") >= least))


def captions(blocks: DataFrame) -> DataFrame:
    """For each picture its nearest caption on the page (Manhattan, between centres), if the page has one."""
    texts = blocks.where((F.col("type") == "text") & F.col("content").rlike(T.CAPTION)).select(*ON_PAGE, F.col("content").alias("caption"), F.col("bbox").alias("at"), F.col("ord").alias("near"))
    pictures = of_type(blocks, "picture").select(*ON_PAGE, "ord", "bbox")
    far = pictures.join(texts, ON_PAGE, "left").withColumn("distance", G.manhattan(F.col("bbox"), F.col("at")))
    return far.groupBy(*ON_PAGE, "ord").agg(F.min_by("caption", F.struct("distance", "near")).alias("caption"), F.min("distance").alias("distance"))


# --- layout ---------------------------------------------------------------------------------------------------------


def columns(blocks: DataFrame, gap: float = REGION_GAP) -> DataFrame:
    """Text columns of each page: blocks' centres more than ``gap`` apart are parted halfway; the first begins at 0, the last ends at page_width."""
    centred = of_type(blocks, "text").select(*ON_PAGE, "page_width", ((F.col("bbox.x0") + F.col("bbox.x1")) / 2).alias("x"))
    w = Window.partitionBy(*ON_PAGE).orderBy("x")
    edge = centred.withColumn("before", F.lag("x").over(w)).where(F.col("before").isNull() | (F.col("x") - F.col("before") > gap))
    begin = edge.select(*ON_PAGE, "page_width", F.coalesce((F.col("before") + F.col("x")) / 2, F.lit(0.0)).alias("x_start"))
    order = Window.partitionBy(*ON_PAGE).orderBy("x_start")
    return begin.select(*ON_PAGE, (F.row_number().over(order) - 1).alias("column"), "x_start", F.coalesce(F.lead("x_start").over(order), "page_width").alias("x_end"))


def region(box: Column, page_width: Column) -> Column:
    """header, footer or sidebar by where a text block stands; null for the body."""
    side = ((box["x1"] - box["x0"]) < page_width * SIDE_WIDTH) & ((box["x0"] < page_width * SIDE_EDGE) | (box["x1"] > page_width * (1 - SIDE_EDGE)))
    return F.when(box["y0"] < HEADER_ABOVE, "header").when(box["y0"] > FOOTER_BELOW, "footer").when(side, "sidebar")


def reading_order(blocks: DataFrame, compat: bool = False) -> DataFrame:
    """Blocks with ``reading_order``: headers 0, body from 100 by column and top, sidebars after the body, footers 9000.

    A block that lies by over half of its area in a special region goes with it.  With
    ``compat`` every special block counts as a header where a page has one, as some
    readers of such layouts have it.
    """
    special = of_type(blocks, "text").withColumn("region", region(F.col("bbox"), F.col("page_width"))).where(F.col("region").isNotNull())
    rank = F.when(F.col("region") == "header", 0).when(F.col("region") == "footer", 1).otherwise(2)
    boxes = special.groupBy(*ON_PAGE).agg(F.collect_list(F.struct(F.col("bbox"), rank.alias("rank"))).alias("special"))
    inside = F.array_min(F.transform(F.filter("special", lambda s: G.mostly_inside(F.col("bbox"), s["bbox"])), lambda s: s["rank"]))
    if compat:
        lowest = F.array_min(F.transform("special", lambda s: s["rank"]))
        inside = F.when(inside.isNotNull(), lowest)
    placed = blocks.join(boxes, ON_PAGE, "left").withColumn("in_region", inside).drop("special")
    cols = columns(blocks).groupBy(*ON_PAGE).agg(F.array_sort(F.collect_list("x_end")).alias("ends"))
    x = (F.col("bbox.x0") + F.col("bbox.x1")) / 2
    column = F.coalesce(F.array_position(F.transform("ends", lambda e: x <= e), F.lit(True)), F.lit(1))
    placed = placed.join(cols, ON_PAGE, "left").withColumn("column", column).drop("ends")
    late = F.col("in_region").isNotNull().cast("int")
    flow = Window.partitionBy(*ON_PAGE, (F.coalesce("in_region", F.lit(2)) == 2)).orderBy(late, F.when(late == 0, F.col("column")), F.when(late == 0, F.col("bbox.y0")), "ord")
    order = F.when(F.col("in_region") == 0, 0).when(F.col("in_region") == 1, 9000).otherwise(99 + F.row_number().over(flow))
    return placed.withColumn("reading_order", order).drop("in_region", "column")


def cite(blocks: DataFrame) -> DataFrame:
    """Blocks in reading order with new ordinals (from 1), citation ids and citation sources; blocks without an order come last."""
    order = Window.partitionBy(*ON_PAGE).orderBy(F.coalesce("reading_order", F.lit(9999)), "ord")
    numbered = blocks.withColumn("ord", F.row_number().over(order))
    return numbered.withColumn("citation", T.citation_id(F.col("page"), F.col("type"), F.col("ord"))).withColumn("citation_source", T.citation_source(F.col("type")))


# --- tables from text spans -----------------------------------------------------------------------------------------


def span_rows(spans: DataFrame, tolerance: float = Y_TOLERANCE) -> DataFrame:
    """Spans (doc_id, page, text, x, y, width, height) grouped to rows: doc_id, page, row, y, cells (by x).

    A row takes spans whose y is within ``tolerance`` of its *first*, so the grouping
    depends on where a row began: a fold over the page's spans in order of y, in the
    JVM; a page holds few enough.
    """
    kept = spans.where((F.trim("text") != ""))
    cells = kept.groupBy(*ON_PAGE).agg(F.array_sort(F.collect_list(F.struct("y", "x", F.trim("text").alias("text"), "width", "height"))).alias("spans"))
    start = F.struct(F.lit(-1).alias("row"), F.lit(None).cast("double").alias("first"), F.array().cast("array<int>").alias("rows"))

    def step(a: Column, s: Column) -> Column:
        new = a["first"].isNull() | (F.abs(s["y"] - a["first"]) > tolerance)
        row = a["row"] + new.cast("int")
        return F.struct(row.alias("row"), F.when(new, s["y"]).otherwise(a["first"]).alias("first"), F.concat(a["rows"], F.array(row)).alias("rows"))

    rows = cells.withColumn("rows", F.aggregate("spans", start, step)["rows"])
    flat = rows.select(*ON_PAGE, F.explode(F.arrays_zip("rows", "spans")).alias("c"))
    cell = F.struct(F.col("c.spans.x").alias("x"), F.col("c.spans.y").alias("y"), F.col("c.spans.text").alias("text"), F.col("c.spans.width").alias("width"), F.col("c.spans.height").alias("height"))
    return flat.groupBy(*ON_PAGE, F.col("c.rows").alias("row")).agg(F.min("c.spans.y").alias("y"), F.array_sort(F.collect_list(cell)).alias("cells"))


def rows_compatible(a: Column, b: Column, gap: float = COLUMN_GAP) -> Column:
    """Whether two rows fit one table: about as many cells, and at least half of those in common aligned."""
    both = F.zip_with(F.transform(a, lambda c: c["x"]), F.transform(b, lambda c: c["x"]), lambda x, y: F.when(F.abs(x - y) <= gap, 1).otherwise(0))
    aligned = F.aggregate(both, F.lit(0), lambda s, x: s + x)
    few = F.least(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & ((few < 2) | (aligned >= few / 2))


def text_tables(spans: DataFrame, regions: bool = True) -> DataFrame:
    """Tables rebuilt from text spans: doc_id, page, table, bbox, markdown.  Without ``regions`` a page's rows are one table."""
    rows = span_rows(spans)
    w = Window.partitionBy(*ON_PAGE).orderBy("row")
    new = ~rows_compatible(F.lag("cells").over(w), F.col("cells")) if regions else F.lit(False)
    marked = rows.withColumn("new", F.coalesce(new.cast("int"), F.lit(0)))
    parted = marked.withColumn("table", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sized = parted.groupBy(*ON_PAGE, "table").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"), F.max(F.size("cells")).alias("width"), F.count("*").alias("n"))
    line = lambda texts, width: F.concat(F.lit("| "), F.array_join(F.concat(texts, F.array_repeat(F.lit(""), width - F.size(texts))), " | "), F.lit(" |"))
    text = F.transform("rows", lambda r: line(F.transform(r["cells"], lambda c: c["text"]), F.col("width")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    flat = F.flatten(F.transform("rows", lambda r: r["cells"]))
    side = lambda f, v: f(F.transform(flat, v))
    box = G.bbox(side(F.array_min, lambda c: c["x"]), side(F.array_min, lambda c: c["y"]), side(F.array_max, lambda c: c["x"] + c["width"]), side(F.array_max, lambda c: c["y"] + c["height"]))
    markdown = F.array_join(F.concat(F.slice(text, 1, 1), F.array(rule), F.slice(text, 2, F.col("n").cast("int"))), "\n")
    return sized.where((F.col("n") >= LEAST_ROWS) & (F.col("width") >= LEAST_COLUMNS)).select(*ON_PAGE, "table", box.alias("bbox"), markdown.alias("markdown"))


def enhance_tables(tables: DataFrame, spans: DataFrame, margin: float = TABLE_MARGIN) -> DataFrame:
    """Native tables with two lines or less rebuilt from the spans in their box and a margin around it."""
    lines = F.size(F.filter(F.split("markdown_table", "\n"), lambda s: F.trim(s) != ""))
    empty = tables.where(lines <= 2).select(*ON_PAGE, "table_ref", F.col("bbox").alias("at"))
    box = F.struct((F.col("at.x0") - margin).alias("x0"), (F.col("at.y0") - margin).alias("y0"), (F.col("at.x1") + margin).alias("x1"), (F.col("at.y1") + margin).alias("y1"))
    inside = spans.join(empty, ON_PAGE).where(G.contains_point(box, F.col("x"), F.col("y")))
    keyed = inside.select(F.concat_ws("\u0001", "doc_id", "table_ref").alias("doc_id"), "page", "text", "x", "y", "width", "height")
    rebuilt = text_tables(keyed, regions=False).select(F.split_part("doc_id", F.lit("\u0001"), F.lit(1)).alias("doc_id"), "page", F.split_part("doc_id", F.lit("\u0001"), F.lit(2)).alias("table_ref"), F.col("markdown").alias("rebuilt"))
    return tables.join(rebuilt, [*ON_PAGE, "table_ref"], "left").withColumn("markdown_table", F.coalesce("rebuilt", "markdown_table")).drop("rebuilt")
