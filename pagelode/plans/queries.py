"""Queries over the test tables, one for each operator or group of operators, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import confidence as C
from pagelode.functions import geometry as G
from pagelode.functions import hashing as H
from pagelode.functions import infer as I  # noqa: E741
from pagelode.functions import tables as M
from pagelode.functions import text as T
from pagelode.operators import blocks as B
from pagelode.operators import diff as D
from pagelode.operators import fields as FD
from pagelode.operators import integrity as IN
from pagelode.operators import messages as MS
from pagelode.operators import navigator as N
from pagelode.operators import registry as R
from pagelode.operators import search as S
from pagelode.plans.base import frame, frame_sql, scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


# --- search -----------------------------------------------------------------------------------------------------------

QUERY_TEXTS = ((1, "the and of to"), (2, "la les une la"), (3, "der die und"), (4, "Widget"))
TOKENS = r"unnest(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> ''))"
Q_TEXTS = "SELECT * FROM (VALUES (1, 'the and of to'), (2, 'la les une la'), (3, 'der die und'), (4, 'Widget')) v(query_id, text)"
BM25_OF = rf"""
tok AS (SELECT doc_id AS doc, {TOKENS.format("text")} AS term FROM documents),
tf AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT d.doc_id AS doc, coalesce(n, 0) AS dl FROM documents d LEFT JOIN (SELECT doc, count(*) AS n FROM tok GROUP BY 1) t ON d.doc_id = t.doc),
stats AS (SELECT count(*) AS n, CAST(sum(dl) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf0 FROM df, stats),
idf AS (SELECT term, CASE WHEN idf0 < 0 THEN 0.25 * avg(idf0) OVER () ELSE idf0 END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, {TOKENS.format("text")} AS term FROM q) GROUP BY ALL),
scored AS (
  SELECT query_id, tf.doc, sum(times * idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.doc = tf.doc, stats GROUP BY ALL
),
keyword AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM scored WHERE score > 0)
"""
BM25 = f"WITH q AS ({Q_TEXTS}), {BM25_OF}"


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERY_TEXTS, "query_id int, text string")


@query(BM25 + "SELECT query_id, doc, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM keyword WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = S.bm25_texts(_queries(spark), docs, 10)
    return found.select("query_id", "doc", r6("score").alias("score"), "rank")


@query(BM25 + "SELECT term, df, CAST(cf AS BIGINT) AS cf FROM df")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vocabulary(table(spark, sf_dir, "documents")).where(F.col("term").isNotNull())


@query(BM25 + "SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.corpus_stats(S.lengths(table(spark, sf_dir, "documents"))).select("n", r6("avgdl").alias("avgdl"))


@query(BM25 + "SELECT term, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return S.idf(S.postings(docs), S.corpus_stats(S.lengths(docs))).select("term", r6("idf").alias("idf"))


VECTORS = """
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
d AS (SELECT q.id AS query_id, v.id, v.label, list_sum(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM v q, v WHERE q.id % 20 = 0{0})
"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), vectors


@query("WITH " + VECTORS.format("") + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) SELECT query_id, id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def vector_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.vector_search(*_vectors(spark, sf_dir), k=5)
    return found.select("query_id", "id", r6("distance").alias("distance"), r6("score").alias("score"), "rank")


@query("WITH " + VECTORS.format(" AND v.label < 3") + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, 1 / (1 + distance) AS score FROM r) WHERE rank <= 5")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.vector_search(*_vectors(spark, sf_dir), k=5, where=F.col("label") < 3)
    return found.select("query_id", "id", r6("score").alias("score"), "rank")


@query("WITH " + VECTORS.format("") + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS n FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM r WHERE n <= 25 AND label < 3) SELECT query_id, id, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5")
def vector_topk_post_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vector_search(*_vectors(spark, sf_dir), k=5, where=F.col("label") < 3, post_filter=True).select("query_id", "id", "rank")


@query(
    f"WITH t AS ({Q_TEXTS}), q AS (SELECT vec_id AS query_id, t.text FROM embeddings JOIN t ON t.query_id = (vec_id // 20) % 4 + 1 WHERE vec_id % 20 = 0), {BM25_OF}, "
    + VECTORS.format("")
    + """, semantic AS (SELECT query_id, id AS doc, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d),
keys AS (SELECT doc_id AS doc, left(text, 50) AS key FROM documents),
parts AS (
  SELECT query_id, key, 'semantic' AS source, 0 AS late, min(rank) AS r, 0.6::DOUBLE / (min(rank) + 60) AS part FROM semantic JOIN keys USING (doc) WHERE rank <= 15 GROUP BY ALL
  UNION ALL SELECT query_id, key, 'keyword', 1, min(rank), 0.4::DOUBLE / (min(rank) + 60) FROM keyword JOIN keys USING (doc) WHERE rank <= 15 GROUP BY ALL
),
fused AS (SELECT query_id, key, sum(part) AS rrf, min(late * 1000000 + r) AS seen, string_agg(source, '+' ORDER BY source DESC) AS sources FROM parts GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen, key) AS n FROM fused)
SELECT query_id, key, round(rrf, 6) AS rrf, sources, CAST(n AS INT) AS rank FROM ranked WHERE n <= 5"""
)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked, vectors = _vectors(spark, sf_dir)
    texts = _queries(spark).withColumnRenamed("query_id", "n")
    queries = asked.join(texts, F.floor(asked["query_id"] / 20) % 4 + 1 == texts["n"]).drop("n")
    keys = docs.select(F.col("doc_id").alias("id"), S.dedupe_key(F.lit(None).cast("string"), F.col("text")).alias("key"))
    found = S.hybrid_search(queries, vectors, docs, None, keys)
    return found.select("query_id", "key", r6("rrf").alias("rrf"), "sources", "rank")


@query(BM25 + "SELECT query_id, keyword.doc, round(score, 6) AS score, CAST(n AS INT) AS rank FROM (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS n FROM keyword JOIN documents ON doc_id = doc WHERE lang = 'en') keyword WHERE n <= 10")
def bm25_index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a stored index, among the documents that a condition on their metadata holds of."""
    index = S.KeywordIndex.build(table(spark, sf_dir, "documents"), scratch(spark, "bm25"))
    return index.search(_queries(spark), 10, F.col("lang") == "en").select("query_id", "doc", r6("score").alias("score"), "rank")


@query(frame_sql("spec_pages") + " SELECT doc_id, page, 'markdown' AS kind, trim(split_part(markdown, '## Citations', 1)) AS chunk FROM spec_pages WHERE length(trim(split_part(markdown, '## Citations', 1))) > 50 UNION ALL SELECT 'd', 1, 'text', text FROM documents WHERE length(text) > 10 UNION ALL SELECT 'd', 1, 'ocr', text FROM documents WHERE length(text) > 20 AND doc_id % 2 = 0")
def master_index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = frame(spark, sf_dir, "spec_pages")
    blocks = table(spark, sf_dir, "documents").select(F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.lit("text").alias("type"), F.col("text").alias("content"), F.lit(None).cast("string").alias("citation"))
    ocr = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.lit("d").alias("doc_id"), F.lit(1).alias("page"), "text", F.lit(None).cast("string").alias("citation"))  # every other text as recognised
    return S.chunks(pages, blocks, ocr).select("doc_id", "page", "kind", "chunk")


@query("SELECT url AS pdf_name FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def manifest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("pdf_name"), "page_id")
    return S.not_indexed(pages.select("pdf_name"), pages.where("page_id % 3 = 0"))


@query("SELECT source AS doc_id, count(*) AS hits FROM documents GROUP BY 1")
def provenance_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.provenance(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("source")))


# --- reading ----------------------------------------------------------------------------------------------------------


@query(
    r"""
WITH RECURSIVE p AS (SELECT doc_id, lower(text) AS t FROM documents),
hit AS (
  SELECT doc_id, t, strpos(t, 'tion') AS spot FROM p WHERE strpos(t, 'tion') > 0
  UNION ALL SELECT doc_id, t, spot + 3 + strpos(substr(t, spot + 4), 'tion') FROM hit WHERE strpos(substr(t, spot + 4), 'tion') > 0
),
n AS (SELECT doc_id, spot - 1 AS start, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS rank, count(*) OVER (PARTITION BY doc_id) AS total_results FROM hit)
SELECT CAST(doc_id AS STRING) AS doc_id, CAST(start AS INT) AS start, CAST(start + 4 AS INT) AS "end", CAST(rank AS INT) AS rank, total_results FROM n WHERE rank <= 5"""
)
def keyword_span_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.col("text").alias("markdown"))
    return N.search_spans(pages, "tion").select("doc_id", "start", "end", "rank", "total_results")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?i)th[a-z]+')) AS n, list_sum(list_transform(regexp_extract_all(text, '(?i)th[a-z]+'), lambda x: length(x)))::BIGINT AS matched FROM documents WHERE regexp_matches(text, '(?i)th[a-z]+')")
def regex_span_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("(?i)th[a-z]+"), F.lit(0))
    counted = table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.aggregate(F.transform(found, lambda m: F.length(m).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("matched"))
    return counted.where("n > 0")


@query(
    frame_sql("spec_pages")
    + """, w AS (SELECT doc_id, page, markdown, CAST(page % 40 AS INT) AS start, CAST(page % 40 + 60 AS INT) AS "end" FROM spec_pages)
SELECT doc_id, page, start, "end", CASE WHEN length(markdown) >= "end" THEN substring(markdown, start + 1, 60) END AS text,
       'p' || page || CASE WHEN start < 15 THEN '_txt1' WHEN start < 30 THEN '_txt2' END AS citation, CASE WHEN length(markdown) < "end" THEN 'span beyond the page' END AS error FROM w"""
)
def get_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three spans in four lie in a block and are cited by the first that holds their start; the others by none."""
    pages = frame(spark, sf_dir, "spec_pages")
    slices = F.array(*(F.struct(F.lit(a).alias("md_start"), F.lit(b).alias("md_end"), F.lit(n).alias("ord")) for n, (a, b) in enumerate(((0, 15), (10, 30)), 1)))
    blocks = pages.select("doc_id", "page", F.inline(slices)).withColumn("citation", F.format_string("p%d_txt%d", "page", "ord"))
    wanted = pages.select("doc_id", "page", (F.col("page") % 40).alias("start"), (F.col("page") % 40 + 60).alias("end"))
    return N.get_span(pages, blocks, wanted).select("doc_id", "page", "start", "end", "text", "citation", "error")


@query(
    """WITH d AS (SELECT CAST(doc_id AS STRING) AS doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, CAST(least(50, n) AS INT) AS window_start, CAST(least(170, n) AS INT) AS window_end, substring(text, 51, 50) AS before,
       CASE WHEN n > 120 THEN substring(text, 121, least(170, n) - 120) ELSE '' END AS after, CASE WHEN n < 120 THEN 'span beyond the page' END AS error FROM d"""
)
def neighbors_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.col("text").alias("markdown"))
    spans = pages.select("doc_id", "page", F.lit(100).alias("start"), F.lit(120).alias("end"))
    return N.neighbors(spans, pages, 50).select("doc_id", "window_start", "window_end", "before", "after", "error")


HEADINGS = r"""
l AS (SELECT doc_id, page, generate_subscripts(string_split(markdown, chr(10)), 1) AS n, unnest(string_split(markdown, chr(10))) AS line FROM spec_pages),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, page ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM l),
h AS (SELECT doc_id, page, CAST(position AS INT) AS position, CAST(length(regexp_extract(line, '^(#{1,6})\s+(.+)$', 1)) AS INT) AS level, trim(regexp_extract(line, '^(#{1,6})\s+(.+)$', 2)) AS text FROM o WHERE regexp_matches(line, '^(#{1,6})\s+(.+)$'))
"""


@query(frame_sql("spec_pages") + ", " + HEADINGS + " SELECT * FROM h")
def headings_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.headings(frame(spark, sf_dir, "spec_pages")).select("doc_id", "page", "position", "level", "text")


@query(frame_sql("spec_pages") + ", " + HEADINGS + " SELECT doc_id, page, text FROM h WHERE contains(lower(text), 'gear')")
def section_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.find_sections(N.headings(frame(spark, sf_dir, "spec_pages")), "GEAR").select("doc_id", "page", "text")


@query(
    frame_sql("spec_pages")
    + ", "
    + HEADINGS
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, position) AS n FROM h)
SELECT a.doc_id, a.page, a.level, CAST(a.n AS INT) AS n, CAST(max(b.n) AS INT) AS parent FROM n a LEFT JOIN n b ON a.doc_id = b.doc_id AND b.n < a.n AND b.level < a.level AND a.n - b.n < 10 GROUP BY ALL"""
)
def toc_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.toc(N.headings(frame(spark, sf_dir, "spec_pages"))).select("doc_id", "page", "level", "n", "parent")


@query(r"SELECT page_id, len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS n_headings, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS title FROM pages")
def html_heading_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>"), F.lit(0))).cast("long").alias("n_headings"), F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1).alias("title"))


@query(
    r"""
WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
c AS (
  SELECT doc_id, text, n, 0 AS pos, 0 AS upto, 0 AS k FROM d WHERE n > 512
  UNION ALL
  SELECT doc_id, text, n, start, start + CASE WHEN start + 512 >= n THEN 512 WHEN a > 256 THEN a + 2 WHEN b > 256 THEN b + 2 WHEN e > 256 THEN e + 2 WHEN f > 256 THEN f + 2 ELSE 512 END, k + 1
  FROM (SELECT *, CASE k WHEN 0 THEN 0 ELSE upto - 50 END AS start FROM c) s,
  LATERAL (SELECT substring(text, start + 1, 512) AS piece) p,
  LATERAL (SELECT list_max(list_transform(range(1, 512), lambda i: CASE WHEN substring(piece, i, 2) = '. ' THEN i - 1 ELSE -1 END)) AS a,
                  list_max(list_transform(range(1, 512), lambda i: CASE WHEN substring(piece, i, 2) = '.' || chr(10) THEN i - 1 ELSE -1 END)) AS b,
                  list_max(list_transform(range(1, 512), lambda i: CASE WHEN substring(piece, i, 2) = '! ' THEN i - 1 ELSE -1 END)) AS e,
                  list_max(list_transform(range(1, 512), lambda i: CASE WHEN substring(piece, i, 2) = '?' || chr(10) THEN i - 1 ELSE -1 END)) AS f) m
  WHERE start < n
),
t AS (SELECT doc_id, k, trim(substring(text, pos + 1, upto - pos), ' ') AS chunk FROM c WHERE k > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS n, chunk FROM t WHERE chunk <> ''
UNION ALL SELECT doc_id, 0, text FROM d WHERE n <= 512"""
)
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(N.chunk_text(F.col("text"))).alias("n", "chunk"))


# --- tables -----------------------------------------------------------------------------------------------------------

CELLS = r"""
t AS (SELECT doc_id, page, list_filter(list_transform(string_split(markdown_table, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM spec_tables),
r AS (SELECT doc_id, page, list_filter(list_transform(string_split(lines[1], '|'), lambda x: trim(x)), lambda x: x <> '') AS headers, unnest(lines[3:]) AS line, generate_subscripts(lines[3:], 1) - 1 AS row FROM t),
c AS (SELECT doc_id, page, row, headers, list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> '') AS cells FROM r)
"""


@query(frame_sql("spec_tables") + ", " + CELLS + " SELECT doc_id, page, CAST(row AS INT) AS row, CAST(i AS INT) AS col, headers[i + 1] AS header, coalesce(cells[i + 1], '') AS value FROM c, (SELECT unnest(range(4)) AS i)")
def md_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MS.table_cells(frame(spark, sf_dir, "spec_tables")).select("doc_id", "page", "row", "col", "header", "value")


@query(frame_sql("spec_tables") + ", " + CELLS + " SELECT doc_id, page, CAST(count(*) AS INT) AS n FROM c WHERE contains(lower(cells[2]), 'measured') GROUP BY ALL")
def md_table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = frame(spark, sf_dir, "spec_tables").select("doc_id", "page", M.parse_table(F.col("markdown_table")).alias("t"))
    rows = M.filter_rows(F.col("t.headers"), F.col("t.cells"), F.lit("desc"), F.lit("Measured"))
    return parsed.select("doc_id", "page", F.size(rows).alias("n"))


@query(frame_sql("spec_tables") + ", " + CELLS + " SELECT doc_id, page, true AS has_both, false AS has_exact, max(CASE WHEN row = 0 THEN cells[3] END) AS example, NULL::STRING AS beyond FROM c GROUP BY ALL")
def md_table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = frame(spark, sf_dir, "spec_tables").select("doc_id", "page", "markdown_table", M.parse_table(F.col("markdown_table")).alias("t"))
    headers, cells = F.col("t.headers"), F.col("t.cells")
    required = F.array(F.lit("field"), F.lit("exam"))
    return parsed.select(
        "doc_id", "page", M.has_columns(headers, required).alias("has_both"), M.has_columns(headers, required, exact=True).alias("has_exact"),
        F.get(M.get_column(headers, cells, F.lit("example")), F.lit(0)).alias("example"), M.get_cell(F.col("markdown_table"), F.lit(9), F.lit(0)).alias("beyond"),
    )


TYPES = (
    "CASE WHEN contains(lower({1}), 'string') OR contains(lower({1}), 'text') THEN 'string' WHEN (contains(lower({1}), 'code') OR contains(lower({1}), 'cd') OR contains(lower({1}), 'identifier')) AND (contains(lower({1}), 'values are') OR contains(lower({1}), 'either') OR contains(lower({1}), 'one of')) THEN 'code' "
    "WHEN regexp_matches(lower({1}), 'number|integer|count|quantity|qty') THEN 'int' WHEN regexp_matches(lower({1}), 'float|decimal|percent') THEN 'float' WHEN regexp_matches(lower({1}), 'flag|boolean|true/false') THEN 'bool' "
    "WHEN regexp_matches(lower({0}), '_cd$|_code') THEN 'code' WHEN contains(lower({0}), 'id') AND contains(lower({1}), 'identify') THEN 'string' WHEN regexp_matches(lower({0}), 'date|time|dttm') THEN 'datetime' "
    r"WHEN regexp_matches(regexp_replace({2}, '[-:T]', '', 'g'), '^\d{{14}}') THEN 'datetime' WHEN regexp_matches({2}, '^-?\d+$') THEN 'int' WHEN regexp_matches({2}, '^-?\d+\.\d+$') THEN 'float' WHEN lower({2}) IN ('true', 'false', 'yes', 'no') THEN 'bool' ELSE 'string' END"
)
FIELDS = frame_sql("spec_tables", "spec_pages") + ", " + CELLS + ", f AS (SELECT c.doc_id, c.page, regexp_extract(p.markdown, '([A-Z]{3,4}\\.[A-Z]\\d+)', 1) AS message_id, CAST(row AS INT) AS row, cells[1] AS field_name, " + TYPES.format("cells[1]", "cells[2]", "cells[3]") + " AS field_type, cells[4] AS optionality, cells[2] AS description, cells[3] AS example FROM c JOIN spec_pages p ON c.doc_id = p.doc_id AND c.page = p.page WHERE len(cells) > 3)"


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FD.field_definitions(frame(spark, sf_dir, "spec_pages"), frame(spark, sf_dir, "spec_tables"))


@query(FIELDS + " SELECT * FROM f")
def field_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("doc_id", "page", "message_id", "row", "field_name", "field_type", "optionality", "description", "example")


@query(
    r"WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'HDR.' || event_type || '_cd' WHEN 1 THEN 'made_time' WHEN 2 THEN 'patient_id' ELSE event_type END AS name, CASE event_id % 7 WHEN 0 THEN 'A text' WHEN 1 THEN 'Code, one of: A, B' WHEN 2 THEN 'Number of items' WHEN 3 THEN 'Percent done' WHEN 4 THEN 'Flag' WHEN 5 THEN 'To identify it' ELSE '' END AS descr, CASE event_id % 5 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN CAST(event_id AS STRING) || '.5' WHEN 2 THEN 'yes' WHEN 3 THEN '2024-01-01T10:00:00' ELSE 'abc' END AS example FROM events) SELECT event_id, "
    + TYPES.format("name", "descr", "example")
    + " AS field_type FROM e"
)
def field_type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    pick = lambda k, *values: F.get(F.array(*values), (n % k).cast("int"))
    kind = F.col("event_type")
    name = pick(6, F.concat(F.lit("HDR."), kind, F.lit("_cd")), F.lit("made_time"), F.lit("patient_id"), kind, kind, kind)
    described = pick(7, *map(F.lit, ("A text", "Code, one of: A, B", "Number of items", "Percent done", "Flag", "To identify it", "")))
    example = pick(5, n.cast("string"), F.concat(n.cast("string"), F.lit(".5")), F.lit("yes"), F.lit("2024-01-01T10:00:00"), F.lit("abc"))
    return e.select("event_id", I.field_type(name, described, example).alias("field_type"))


@query(FIELDS + " SELECT doc_id, page, field_name, list_sort(['ON', 'OFF', regexp_extract(description, 'N[0-9]+', 0)]) AS \"values\" FROM f WHERE field_type = 'code'")
def enum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FD.enum_definitions(_fields(spark, sf_dir)).select("doc_id", "page", "field_name", F.transform("values", lambda v: v["value"]).alias("values"))


@query(FIELDS + ", g AS (SELECT doc_id, message_id, count(*) AS n_fields, min(page) AS page, string_agg(field_name, ',' ORDER BY page, row) AS names FROM f GROUP BY ALL) SELECT doc_id, message_id, split_part(message_id, '.', 2) AS trigger_event, CASE message_id WHEN 'OBS.R01' THEN 'Observation Message - Patient Results' WHEN 'OBS.R02' THEN 'Observation Message - Non-Patient Results' ELSE message_id || ' Message' END AS description, page, 'p' || page || '_tbl1' AS citation, CAST(n_fields AS INT) AS n_fields, names FROM g")
def message_schema_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = FD.message_schemas(_fields(spark, sf_dir))
    return schemas.select("doc_id", "message_id", "trigger_event", "description", "page", "citation", F.size("fields").alias("n_fields"), F.array_join(F.transform("fields", lambda f: f["name"]), ",").alias("names"))


@query(frame_sql("spec_pages") + " SELECT doc_id, lower(name) AS name, min(page) AS page FROM (SELECT doc_id, page, unnest([trim(string_split(regexp_extract(markdown, 'Analytes: ([^\\n]+)', 1), ',')[1]), 'glucose']) AS name FROM spec_pages) GROUP BY ALL")
def analyte_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = FD.unique_analytes(FD.text_analytes(frame(spark, sf_dir, "spec_pages"), "markdown"))
    return found.select("doc_id", F.lower("name").alias("name"), "page")


# --- messages ---------------------------------------------------------------------------------------------------------

MESSAGES = (
    frame_sql("blocks")
    + r""", one AS (
  SELECT doc_id, page, ord, content, citation, unnest(list_concat(
    list_transform(regexp_extract_all(content, '\b([A-Z]{3})\.[A-Z]\d{2}\b'), lambda m: m),
    list_transform(regexp_extract_all(content, '\b([A-Z]{3})\^([A-Z]{3}_[A-Z]\d{2})\b'), lambda m: split_part(m, '^', 1) || '.' || split_part(split_part(m, '^', 2), '_', 2)),
    list_transform(regexp_extract_all(content, '\b([A-Z]{3,})[.^_]([A-Z]+\d+)\b'), lambda m: CASE WHEN contains(m, '^') THEN split_part(m, '^', 1) || '.' || split_part(m, '^', 2) ELSE replace(m, '_', '.') END),
    regexp_extract_all(content, '\b[A-Z][a-zA-Z0-9]+(?:\.[a-zA-Z0-9]+)+\b'),
    regexp_extract_all(content, '\bZ[A-Z]{2}'), regexp_extract_all(content, '\bZ[A-Z0-9]{2,}'))) AS message_id FROM blocks),
first AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY doc_id, message_id ORDER BY page, ord) = 1),
m AS (
  SELECT doc_id, message_id, page, ord,
    CASE WHEN contains(lower(content), 'device to') THEN '→Host' WHEN contains(lower(content), 'to device') OR contains(lower(content), 'request') THEN '←Device' WHEN contains(lower(content), 'both directions') THEN '↔Both' WHEN regexp_matches(message_id, '^(OBS|ORU)(\.|$)') THEN '→Host' WHEN regexp_matches(message_id, '^(QCN|QRY)(\.|$)') THEN '←Device' ELSE '→Host' END AS direction,
    CASE WHEN regexp_matches(message_id, '^OBS') THEN 'observation' WHEN regexp_matches(message_id, '^QCN') THEN 'config' WHEN message_id LIKE 'Z%' OR len(string_split(message_id, '.')) >= 3 THEN 'vendor_specific' ELSE 'unrecognized' END AS category
  FROM first)
"""
)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MS.categorise(MS.extract_messages(frame(spark, sf_dir, "blocks")))


@query(MESSAGES + "SELECT doc_id, message_id, direction, category, page, ord FROM m")
def message_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("doc_id", "message_id", "direction", "category", "page", "ord")


@query(MESSAGES + "SELECT doc_id, category, CAST(count(*) AS INT) AS n, list_sort(list(message_id || direction)) AS messages FROM m GROUP BY ALL")
def message_category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MS.category_summary(_messages(spark, sf_dir)).select("doc_id", "category", F.size("messages").alias("n"), F.array_sort("messages").alias("messages"))


@query(MESSAGES + "SELECT doc_id, count(*) AS total, count(*) FILTER (category = 'observation') AS observation, count(*) FILTER (category = 'config') AS config, count(*) FILTER (category = 'qc') AS qc, count(*) FILTER (category = 'vendor_specific') AS vendor_specific, count(*) FILTER (category = 'unrecognized') AS unrecognized FROM m GROUP BY 1")
def message_summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MS.summary_counts(_messages(spark, sf_dir))


@query(MESSAGES + "SELECT doc_id AS device, message_id, 'pending' AS review_status FROM m WHERE category = 'unrecognized' AND NOT (doc_id = 'spec_1' AND message_id = 'XYZ.R99')")
def message_auto_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    custom = spark.createDataFrame([("spec_1", "XYZ.R99")], "device string, message_id string")
    new = MS.auto_accept(_messages(spark, sf_dir), custom, F.col("doc_id"), F.lit("2024-01-01"))
    return new.select("device", "message_id", "review_status")


@query(frame_sql("blocks") + r", h AS (SELECT doc_id, page, ord, regexp_extract(content, '\b([A-Z]{3})-(\d+)\b', 0) AS id FROM blocks WHERE regexp_matches(content, '\b[A-Z]{3}-\d+\b')) SELECT doc_id, id AS field_id, page, ord FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY page, ord) = 1")
def field_ids_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MS.field_specs(frame(spark, sf_dir, "blocks")).select("doc_id", "field_id", "page", "ord")


# --- comparing --------------------------------------------------------------------------------------------------------

CHANGES = (
    frame_sql("version1", "version2")
    + r""", o AS (SELECT DISTINCT ON (content) * FROM version1 ORDER BY content, page DESC, ord DESC), n AS (SELECT DISTINCT ON (content) * FROM version2 ORDER BY content, page DESC, ord DESC),
ch AS (
  SELECT 'removed' AS side, page, type, content, CASE WHEN regexp_matches(content, '\b[A-Z]{3}\.[A-Z]\d{2}\b') THEN 'HIGH:MESSAGE_REMOVED' WHEN type = 'table' AND regexp_matches(content, '\b[A-Z]{3}-\d+\b') THEN 'HIGH:BLOCK_REMOVED' ELSE 'LOW:BLOCK_REMOVED' END AS impact FROM o WHERE content NOT IN (SELECT content FROM n)
  UNION ALL
  SELECT 'added', page, type, content, CASE WHEN regexp_matches(content, '\b[A-Z]{3}\.[A-Z]\d{2}\b') THEN 'HIGH:MESSAGE_ADDED' WHEN type = 'table' AND regexp_matches(content, '\b[A-Z]{3}-\d+\b') THEN CASE WHEN regexp_extract(content, '\b([ROC])(?:\[\d+\.\.\d+\])?\b', 1) = 'R' THEN 'HIGH:FIELD_ADDED' ELSE 'MEDIUM:FIELD_ADDED' END WHEN regexp_matches(content, '\bZ[A-Z]{2}\b') THEN 'MEDIUM:VENDOR_EXTENSION_MODIFIED' ELSE 'LOW:BLOCK_ADDED' END FROM n WHERE content NOT IN (SELECT content FROM o)),
cnt AS (SELECT count(*) FILTER (impact LIKE 'HIGH%') AS high, count(*) FILTER (impact LIKE 'MEDIUM%') AS medium, count(*) FILTER (impact LIKE 'LOW%') AS low, count(*) AS total FROM ch)
"""
)


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.block_changes(frame(spark, sf_dir, "version1"), frame(spark, sf_dir, "version2"))


@query(CHANGES + "SELECT side, sha256(content) AS content_hash, page, type, split_part(impact, ':', 1) AS level, split_part(impact, ':', 2) AS change_type FROM ch")
def block_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("side", "content_hash", "page", "type", "level", "change_type")


@query(CHANGES + "SELECT high, medium, low, total FROM cnt")
def impact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.impact_counts(_changes(spark, sf_dir))


@query(CHANGES + "SELECT *, high + medium > 0 AS requires_rebuild, concat_ws(', ', CASE WHEN high > 0 THEN high || ' HIGH impact changes' END, CASE WHEN medium > 0 THEN medium || ' MEDIUM impact changes' END) AS reason FROM cnt")
def rebuild_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rebuild_decision(_changes(spark, sf_dir))


@query(frame_sql("version1", "version2") + " SELECT coalesce(o.content, n.content) AS content, CASE WHEN o.content IS NULL THEN 'added' WHEN n.content IS NULL THEN 'removed' ELSE 'unchanged' END AS status FROM (SELECT DISTINCT content FROM version1) o FULL JOIN (SELECT DISTINCT content FROM version2) n ON o.content = n.content")
def message_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.set_changes(frame(spark, sf_dir, "version1"), frame(spark, sf_dir, "version2"), "content")


@query(
    r"""WITH p AS (SELECT p_partkey, 'Field: ' || split_part(p_name, ' ', 1) || ' ' || CASE WHEN p_size % 2 = 0 THEN 'ST' ELSE 'NM' END AS a, CASE p_size % 5 WHEN 0 THEN 'Field: ' || split_part(p_name, ' ', 1) || ' CX' WHEN 1 THEN '  Field: ' || split_part(p_name, ' ', 1) || ' NM ' WHEN 2 THEN 'Field: ' || upper(split_part(p_name, ' ', 1)) || ' ST' WHEN 3 THEN 'gone' END AS b, CASE WHEN p_size % 3 = 0 THEN 'table' ELSE 'text' END AS kind FROM part),
x AS (SELECT *, regexp_extract(a, '(?i)(?:Field|Name):\s*([A-Za-z_][A-Za-z0-9_]*)', 1) AS fa, regexp_extract(b, '(?i)(?:Field|Name):\s*([A-Za-z_][A-Za-z0-9_]*)', 1) AS fb, regexp_extract(a, '\b(ST|NM|CX)\b', 1) AS ta, regexp_extract(b, '\b(ST|NM|CX)\b', 1) AS tb FROM p)
SELECT p_partkey, CASE WHEN b IS NULL THEN 'LOW' WHEN fb <> '' AND fa <> fb THEN 'HIGH' WHEN tb <> '' AND ta <> tb THEN 'HIGH' WHEN trim(a) = trim(b) THEN 'LOW' WHEN kind = 'table' THEN 'MEDIUM' ELSE 'LOW' END AS level,
CASE WHEN b IS NULL THEN 'BLOCK_REMOVED' WHEN fb <> '' AND fa <> fb THEN 'FIELD_RENAMED' WHEN tb <> '' AND ta <> tb THEN 'FIELD_TYPE_CHANGED' WHEN trim(a) = trim(b) THEN 'WHITESPACE_CHANGED' WHEN kind = 'table' THEN 'TABLE_STRUCTURE_CHANGED' ELSE 'DOCUMENTATION_UPDATED' END AS change_type FROM x"""
)
def modification_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelode.functions import impact

    size, word = F.col("p_size"), F.split_part("p_name", F.lit(" "), F.lit(1))
    a = F.concat(F.lit("Field: "), word, F.lit(" "), F.when(size % 2 == 0, "ST").otherwise("NM"))
    b = F.when(size % 5 == 0, F.concat(F.lit("Field: "), word, F.lit(" CX"))).when(size % 5 == 1, F.concat(F.lit("  Field: "), word, F.lit(" NM "))).when(size % 5 == 2, F.concat(F.lit("Field: "), F.upper(word), F.lit(" ST"))).when(size % 5 == 3, "gone")
    kind = F.when(size % 3 == 0, "table").otherwise("text")
    return table(spark, sf_dir, "part").select("p_partkey", impact.change(a, b, kind).alias("i")).select("p_partkey", "i.level", "i.change_type")


# --- boxes ------------------------------------------------------------------------------------------------------------

BOXES = frame_sql("boxes")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "boxes").withColumn("bbox", G.bbox(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))).withColumn("page_width", F.lit(600.0))


@query(BOXES + " SELECT ord FROM boxes a WHERE type = 'text' AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.type <> 'text' AND a.doc_id = b.doc_id AND a.page = b.page AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)")
def bbox_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return B.new_tables(boxes.where("type = 'text'"), boxes.where("type <> 'text'")).select("ord")


@query(BOXES + " SELECT ord FROM boxes a WHERE type = 'picture' AND EXISTS (SELECT 1 FROM boxes b WHERE b.type = 'text' AND a.doc_id = b.doc_id AND a.page = b.page AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)")
def bbox_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return B.overlapping(boxes.where("type = 'picture'"), boxes.where("type = 'text'")).select("ord")


@query(
    BOXES
    + """, p AS (SELECT a.ord AS a, b.ord AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS s, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab,
abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) AS dx, abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) AS dy, a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 AS holds FROM boxes a JOIN boxes b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber)
SELECT a, b, round(s / (aa + ab - s), 6) AS iou, round(s / aa, 6) AS share, round(dx + dy, 6) AS manhattan, round(sqrt(dx * dx + dy * dy), 6) AS euclidean, holds FROM p"""
)
def bbox_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    a, b = boxes.select("l_orderkey", "l_linenumber", F.col("ord").alias("a"), F.col("bbox").alias("ba")), boxes.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("ord").alias("b"), F.col("bbox").alias("bb"))
    x, y = F.col("ba"), F.col("bb")
    return a.join(b, ["l_orderkey", "l_linenumber"]).select("a", "b", r6(G.iou(x, y)).alias("iou"), r6(G.share_of_first(x, y)).alias("share"), r6(G.manhattan(x, y)).alias("manhattan"), r6(G.euclidean(x, y)).alias("euclidean"), G.contains(x, y).alias("holds"))


@query(BOXES + " SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(greatest(min(x0) - 50, 0), 6) AS left_edge FROM boxes GROUP BY ALL")
def bbox_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _boxes(spark, sf_dir).groupBy("doc_id", "page").agg(G.merge(F.col("bbox")).alias("m"))
    return merged.select("doc_id", "page", "m.*", r6(G.clip(F.col("m"), F.lit(600.0), F.lit(900.0), 50.0)["x0"]).alias("left_edge"))


REGION = "CASE WHEN y0 < 100 THEN 'header' WHEN y0 > 700 THEN 'footer' WHEN x1 - x0 < 120 AND (x0 < 60 OR x1 > 540) THEN 'sidebar' END"


@query(BOXES + f" SELECT ord, {REGION} AS region FROM boxes WHERE type = 'text'")
def region_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).where("type = 'text'").select("ord", B.region(F.col("bbox"), F.col("page_width")).alias("region"))


COLUMNS = """, c AS (SELECT doc_id, page, (x0 + x1) / 2 AS x FROM boxes WHERE type = 'text'),
g AS (SELECT *, lag(x) OVER (PARTITION BY doc_id, page ORDER BY x) AS b FROM c), s AS (SELECT doc_id, page, coalesce((b + x) / 2, 0) AS x_start FROM g WHERE b IS NULL OR x - b > 30),
cols AS (SELECT doc_id, page, CAST(row_number() OVER w - 1 AS INT) AS "column", x_start, coalesce(lead(x_start) OVER w, 600.0) AS x_end FROM s WINDOW w AS (PARTITION BY doc_id, page ORDER BY x_start))
"""


@query(BOXES + COLUMNS + 'SELECT doc_id, page, "column", round(x_start, 6) AS x_start, round(x_end, 6) AS x_end FROM cols')
def column_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.columns(_boxes(spark, sf_dir)).select("doc_id", "page", "column", r6("x_start").alias("x_start"), r6("x_end").alias("x_end"))


@query(
    BOXES
    + COLUMNS
    + f""", sp AS (SELECT doc_id, page, x0, y0, x1, y1, CASE {REGION} WHEN 'header' THEN 0 WHEN 'footer' THEN 1 ELSE 2 END AS rank FROM boxes WHERE type = 'text' AND {REGION} IS NOT NULL),
i AS (SELECT b.ord, min(s.rank) AS r FROM boxes b JOIN sp s ON b.doc_id = s.doc_id AND b.page = s.page AND greatest(0, least(b.x1, s.x1) - greatest(b.x0, s.x0)) * greatest(0, least(b.y1, s.y1) - greatest(b.y0, s.y0)) > 0.5 * (b.x1 - b.x0) * (b.y1 - b.y0) GROUP BY 1),
p AS (SELECT b.*, i.r, coalesce((SELECT min("column") + 1 FROM cols c WHERE c.doc_id = b.doc_id AND c.page = b.page AND (b.x0 + b.x1) / 2 <= c.x_end), 0) AS col FROM boxes b LEFT JOIN i USING (ord))
SELECT ord, CASE WHEN r = 0 THEN 0 WHEN r = 1 THEN 9000 ELSE CAST(99 + row_number() OVER (PARTITION BY doc_id, page, coalesce(r, 2) = 2 ORDER BY CASE WHEN r IS NULL THEN 0 ELSE 1 END, CASE WHEN r IS NULL THEN col END NULLS FIRST, CASE WHEN r IS NULL THEN y0 END NULLS FIRST, ord) AS INT) END AS reading_order FROM p"""
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.reading_order(_boxes(spark, sf_dir)).select("ord", "reading_order")


@query()
def text_table_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = frame(spark, sf_dir, "boxes").select("doc_id", "page", F.col("content").alias("text"), (F.floor(F.col("x0") / 100) * 100).alias("x"), (F.col("l_orderkey") % 500 * 12 + F.col("l_linenumber") % 2).cast("double").alias("y"), F.lit(40.0).alias("width"), F.lit(10.0).alias("height"))
    return B.text_tables(spans).select("doc_id", "page", "table", "bbox.*", "markdown")


# --- integrity, confidence and feedback -------------------------------------------------------------------------------

LEVEL = "CASE WHEN confidence < 0.5 THEN 'rejected' WHEN confidence < 0.8 THEN 'review' ELSE 'accepted' END"


@query(frame_sql("cited") + f" SELECT event_id, {LEVEL} AS level, confidence < 0.8 AS refine FROM cited")
def confidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "cited").select("event_id", C.level(F.col("confidence")).alias("level"), C.needs_refinement(F.col("confidence")).alias("refine"))


@query(frame_sql("cited") + f" SELECT doc_id, count(*) AS total, count(*) FILTER ({LEVEL} = 'accepted') AS accepted, count(*) FILTER ({LEVEL} = 'review') AS review, count(*) FILTER ({LEVEL} = 'rejected') AS rejected, round(avg(confidence), 6) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM cited GROUP BY 1")
def ocr_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IN.ocr_stats(frame(spark, sf_dir, "cited"), ["doc_id"]).withColumn("avg_confidence", r6("avg_confidence"))


@query(
    frame_sql("cited")
    + f""", s AS (SELECT doc_id, count(*) AS total_blocks, count(*) FILTER (citation IS NOT NULL) AS cited, avg(confidence) AS c, count(*) FILTER ({LEVEL} = 'review') AS review_count, count(*) FILTER ({LEVEL} = 'rejected') AS rejected_count, count(*) FILTER (source IS NULL) AS no_source, count(*) FILTER (event_type = 'error') AS critical_errors FROM cited GROUP BY 1),
t AS (SELECT *, cited::DOUBLE / total_blocks AS cov, CASE WHEN critical_errors = 0 THEN 1.0::DOUBLE ELSE greatest(0, 1 - critical_errors::DOUBLE / 10) END AS e, CASE WHEN no_source = 0 THEN 1.0::DOUBLE ELSE 0 END AS k FROM s)
SELECT doc_id, total_blocks, round(cov, 6) AS provenance_coverage, review_count, rejected_count, critical_errors, round(cov * 0.4 + c * 0.3 + e * 0.2 + k * 0.1, 6) AS compliance_score, (cov * 0.4 + c * 0.3 + e * 0.2 + k * 0.1 >= 0.8 AND critical_errors = 0 AND cov >= 0.95) AS is_compliant, (review_count > 0 OR rejected_count > 0 OR critical_errors > 0) AS review_required FROM t"""
)
def compliance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = frame(spark, sf_dir, "cited").withColumn("bbox", F.lit(1))
    errors = blocks.where("event_type = 'error'").select("doc_id", F.lit("fatal").alias("severity"))
    return IN.compliance(blocks, errors).select("doc_id", "total_blocks", r6("provenance_coverage").alias("provenance_coverage"), "review_count", "rejected_count", "critical_errors", r6("compliance_score").alias("compliance_score"), "is_compliant", "review_required")


@query(frame_sql("cited") + " SELECT d.doc_id, CAST(p.page AS INT) AS page FROM (SELECT DISTINCT doc_id FROM cited) d, (SELECT unnest(range(1, 41)) AS page) p WHERE NOT EXISTS (SELECT 1 FROM cited c WHERE c.doc_id = d.doc_id AND c.page = p.page)")
def completeness_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IN.missing_pages(frame(spark, sf_dir, "cited"), 40)


@query(frame_sql("feedback") + " SELECT k.feedback_type, count(f.feedback_id) AS n, count(*) FILTER (f.include_in_training) AS n_training, round(avg(f.original_confidence), 6) AS avg_confidence FROM (VALUES ('correction'), ('confirmation'), ('rejection'), ('classification')) k(feedback_type) LEFT JOIN feedback f ON f.feedback_type = k.feedback_type GROUP BY 1")
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IN.feedback_stats(frame(spark, sf_dir, "feedback")).withColumn("avg_confidence", r6("avg_confidence"))


@query(frame_sql("feedback") + " SELECT feedback_id, feedback_type, sha256(original_content) AS input_hash, sha256(CASE WHEN feedback_type = 'confirmation' THEN original_content ELSE corrected_content END) AS output_hash, CASE WHEN feedback_type = 'confirmation' THEN 1.0::DOUBLE ELSE original_confidence END AS confidence FROM feedback WHERE include_in_training AND (feedback_type = 'confirmation' OR (feedback_type = 'correction' AND corrected_content <> ''))")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = IN.training_pairs(frame(spark, sf_dir, "feedback"))
    return pairs.select("feedback_id", "feedback_type", H.content_hash(F.col("input")).alias("input_hash"), H.content_hash(F.col("output")).alias("output_hash"), "confidence")


@query("WITH s AS (SELECT user_id, list(s ORDER BY s DESC)[1:5] AS v FROM (SELECT user_id, CAST(event_id % 100 AS DOUBLE) / 100 AS s FROM events) GROUP BY 1) SELECT user_id, round(greatest(0, least(1, list_avg(v) * 0.7 + CASE WHEN len(v) = 1 THEN 0.5 ELSE greatest(0, 1 - list_var_pop(v)) END * 0.3)), 6) AS score FROM s")
def search_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "events").select("user_id", ((F.col("event_id") % 100).cast("double") / 100).alias("score"), "event_id")
    best = S.top(scores, ["user_id"], [F.desc("score"), F.asc("event_id")], 5).groupBy("user_id").agg(F.array_sort(F.collect_list("score")).alias("v"))
    return best.select("user_id", r6(C.search(F.col("v"))).alias("score"))


@query("WITH a AS (SELECT user_id, event_type, count(DISTINCT CAST(event_id % 3 AS STRING)) AS n FROM events GROUP BY ALL) SELECT user_id, round(avg(1.0::DOUBLE / n), 6) AS agreement FROM a GROUP BY 1")
def ensemble_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_field = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.countDistinct((F.col("event_id") % 3).cast("string")).alias("n"), F.count("*").alias("answers"))
    return per_field.groupBy("user_id").agg(r6(F.avg(C.agreement(F.col("n"), F.col("answers")))).alias("agreement"))


@query("SELECT event_id, round(0.4::DOUBLE * v + 0.6::DOUBLE * w, 6) AS discovery, round((v * 2 + w) / 3, 6) AS weighted, round(greatest(0, 1 - 0.1::DOUBLE * (event_id % 15)), 6) AS schema_score FROM (SELECT event_id, CAST(event_id % 10 AS DOUBLE) / 10 AS v, CAST(event_id % 7 AS DOUBLE) / 7 AS w FROM events)")
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    v, w = (n % 10).cast("double") / 10, (n % 7).cast("double") / 7
    return table(spark, sf_dir, "events").select("event_id", r6(C.discovery(v, w)).alias("discovery"), r6(C.weighted({"a": (v, 2.0), "b": (w, 1.0)})).alias("weighted"), r6(C.schema_errors(n % 15)).alias("schema_score"))


@query("SELECT event_id, list_sort(list_filter(['a', 'b', 'c'], lambda x: (CASE x WHEN 'a' THEN event_id % 10 WHEN 'b' THEN event_id % 8 ELSE event_id % 6 END) < 7)) AS low FROM events")
def low_confidence_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = lambda k: ((F.col("event_id") % k).cast("double") / 10).alias("v")
    return table(spark, sf_dir, "events").select("event_id", C.low_fields(F.create_map(F.lit("a"), score(10), F.lit("b"), score(8), F.lit("c"), score(6))).alias("low"))


# --- hashes, names, registry and cache --------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS content_hash, sha256('content:' || text || '|page:' || (doc_id % 40) || '|source:' || source) AS block_hash, sha256('m::' || text) AS prompt_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", H.content_hash(F.col("text")).alias("content_hash"), H.block_hash(F.col("text"), F.col("doc_id") % 40, source=F.col("source")).alias("block_hash"), H.prompt_hash(F.lit("m"), F.col("text")).alias("prompt_hash"))


@query("SELECT source, sha256(string_agg(sha256(text), '|' ORDER BY sha256(text))) AS extraction_hash FROM documents GROUP BY 1")
def extraction_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(H.extraction_hash(H.content_hash(F.col("text"))).alias("extraction_hash"))


@query(r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '. '), ''), 'unnamed') AS safe, CASE WHEN length(html) > 80 THEN left(html, 80) || '...' ELSE html END AS preview FROM pages""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.safe_filename(F.col("url")).alias("safe"), T.preview(F.col("html"), 80).alias("preview"))


@query(frame_sql("blocks") + " SELECT ord, printf('[^%s]: Page %d, bbox [%.1f, %.1f, %.1f, %.1f], source: %s, confidence: %.2f', citation, page, 1.5::DOUBLE, 2.0::DOUBLE, page + 0.5::DOUBLE, 4.0::DOUBLE, 'text', 0.25::DOUBLE) AS footnote FROM blocks")
def footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = G.bbox(F.lit(1.5), F.lit(2.0), F.col("page") + F.lit(0.5), F.lit(4.0))
    return frame(spark, sf_dir, "blocks").select("ord", T.footnote(F.col("citation"), F.col("page"), box, F.lit("text"), F.lit(0.25)).alias("footnote"))


@query(frame_sql("versions") + " SELECT DISTINCT ON (device_id) device_id, version, device_name, registered_at FROM versions ORDER BY device_id, registered_at DESC, version DESC")
def registry_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_versions(frame(spark, sf_dir, "versions")).select("device_id", "version", "device_name", "registered_at")


@query(frame_sql("versions") + " SELECT device_id, version FROM versions WHERE price > 200000 AND device_id IN (SELECT device_id FROM versions WHERE price <= 200000)")
def registry_new_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = frame(spark, sf_dir, "versions")
    return R.new_versions(versions.where("price <= 200000"), versions.where("price > 200000"))[0].select("device_id", "version")


CACHE = (
    frame_sql("prompts")
    + """, put AS (SELECT sha256('m::' || prompt_text) AS prompt_hash, conv_id, turn, prompt_text, response, row_number() OVER (PARTITION BY prompt_text ORDER BY conv_id DESC, turn DESC) AS n FROM prompts),
cache AS (SELECT prompt_hash, prompt_text, response AS original_response, conv_id % 2 = 0 AS is_verified, CASE WHEN conv_id % 4 = 0 THEN 'fixed' END AS corrected_response, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 0 END AS hit_count, conv_id * 100 + turn AS put_at FROM put WHERE n = 1)
"""
)


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = frame(spark, sf_dir, "prompts").withColumn("at", F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn")))
    puts = prompts.select(H.prompt_hash(F.lit("m"), F.col("prompt_text")).alias("prompt_hash"), "prompt_text", F.col("response").alias("original_response"), F.lit("m").alias("model"), "conv_id", F.col("at").alias("created_at"))
    last = puts.groupBy("prompt_hash").agg(F.max_by(F.struct("conv_id", "created_at"), "created_at").alias("l")).select("prompt_hash", "l.*")
    checks = last.where("conv_id % 2 = 0").select("prompt_hash", F.when(F.col("conv_id") % 4 == 0, "fixed").alias("corrected_response"), F.col("created_at").alias("reviewed_at"))
    hits = last.where("conv_id % 3 = 0").select("prompt_hash", F.explode(F.array("created_at", "created_at")).alias("at"))
    return R.cache_view(puts, checks, hits)


@query(CACHE + "SELECT count(*) AS total, count(*) FILTER (is_verified) AS verified, CAST(sum(hit_count) AS BIGINT) AS hits, round(avg(hit_count), 2) AS avg_hits FROM cache")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cache_stats(_cache(spark, sf_dir))


@query(CACHE + "SELECT p.conv_id, p.turn, CASE WHEN c.is_verified THEN coalesce(c.corrected_response, c.original_response) END AS response FROM prompts p JOIN cache c ON c.prompt_text = p.prompt_text")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = frame(spark, sf_dir, "prompts").select("conv_id", "turn", "prompt_text")
    return R.lookup(prompts, _cache(spark, sf_dir), "m").select("conv_id", "turn", "response")


@query(CACHE + "SELECT prompt_hash, CAST(hit_count AS BIGINT) AS hit_count FROM cache WHERE is_verified ORDER BY hit_count DESC, put_at DESC, prompt_hash LIMIT 5")
def cache_few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.few_shot(_cache(spark, sf_dir)).select("prompt_hash", "hit_count")


# --- images, sidecars, documents and flows ----------------------------------------------------------------------------


@query(
    """WITH h AS (SELECT user_id, event_id % 17 * 15 AS value, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT user_id, value, sum(n) OVER w AS w0, sum(n * value) OVER w AS s0, sum(n) OVER (PARTITION BY user_id) AS w, sum(n * value) OVER (PARTITION BY user_id) AS s FROM h WINDOW w AS (PARTITION BY user_id ORDER BY value)),
b AS (SELECT user_id, value, round(CASE WHEN w > w0 THEN w0::DOUBLE * (w - w0) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (w - w0)) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (w - w0)) ELSE 0 END, 6) AS v FROM s)
SELECT user_id, value AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, value) = 1"""
)
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelode.operators import images

    pixels = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 17 * 15).alias("value"))
    return images.otsu_threshold(images.histogram(pixels, ["user_id"]), ["user_id"])


def _sidecar_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "blocks").select(
        "doc_id", "page", "ord", "type", G.bbox(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("bbox"), "citation", F.lit(0).alias("md_start"), F.length("content").alias("md_end"), "content",
        *(F.lit(None).cast("string").alias(c) for c in ("image_ref", "table_ref")), "markdown_table", F.lit("text").alias("source"),
    )


@query(frame_sql("blocks") + " SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS INT) AS ord, type, content, citation, 0 AS md_start, CAST(length(content) AS INT) AS md_end, 'text' AS source FROM blocks")
def sidecar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelode.schemas import SIDECAR
    from pagelode.sources import sidecar

    blocks = _sidecar_blocks(spark, sf_dir)
    pages = blocks.groupBy("doc_id", "page").agg(F.lit("").alias("markdown"))
    text = sidecar.to_sidecars(pages, blocks)
    parsed = text.select("doc_id", F.explode(F.from_json("value", SIDECAR)["pages"]).alias("p"))
    return sidecar.blocks(parsed).select("doc_id", "page", "ord", "type", "content", "citation", "md_start", "md_end", "source")


@query(frame_sql("blocks") + ", p AS (SELECT doc_id, page, chr(10) || '# Page ' || page || chr(10) || chr(10) || string_agg(content || chr(10), chr(10) ORDER BY ord) AS md FROM blocks GROUP BY doc_id, page) SELECT doc_id, sha256(string_agg(md, chr(10) ORDER BY page)) AS hash, CAST(sum(length(md)) + count(*) - 1 AS INT) AS length FROM p GROUP BY 1")
def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelode.sources import markdown

    whole = markdown.simple_document(_sidecar_blocks(spark, sf_dir))
    return whole.select("doc_id", F.sha2("markdown", 256).alias("hash"), F.length("markdown").alias("length"))


@query(MESSAGES + "SELECT doc_id, count(*) AS total FROM m GROUP BY 1")
def baseline_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelode.plans import flows

    blocks = frame(spark, sf_dir, "blocks")
    pages = blocks.groupBy("doc_id", "page").agg(F.lit("").alias("markdown"))
    _, report = flows.onboard(pages, blocks, "1", "Device", "now")
    return report.select("doc_id", F.regexp_extract("report", r"Total Messages:\*\* (\d+)", 1).cast("long").alias("total"))


@query(CHANGES + "SELECT high, CASE WHEN high + medium > 0 THEN 'YES' ELSE 'NO' END AS required FROM cnt")
def change_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelode.operators import reports

    changes = _changes(spark, sf_dir)
    report = reports.change_report(changes, D.rebuild_decision(changes), "1", "2", "Device", "now")
    return report.select(F.regexp_extract("report", r"- HIGH: (\d+)", 1).cast("long").alias("high"), F.regexp_extract("report", r"Required:\*\* (\w+)", 1).alias("required"))


@query("SELECT conv_id, turn, 'A' || conv_id AS id FROM conversations")
def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.concat(F.lit('[{"id": "A'), F.col("conv_id").cast("string"), F.lit('"}]'))
    fenced = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), a, F.lit("\n```\nDone."))).when(F.col("turn") % 3 == 1, F.concat(F.lit("```\n"), a, F.lit("\n```"))).otherwise(F.concat(F.lit("I found "), a, F.lit(" there")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.from_json(T.json_payload(fenced), "array<struct<id: string>>")[0]["id"].alias("id"))


# --- further operators, a query each ----------------------------------------------------------------------------------


@query(BOXES + " SELECT ord FROM boxes WHERE type = 'text' AND sqrt(power((x0 + x1) / 2 - 300, 2) + power((y0 + y1) / 2 - 400, 2)) <= 60")
def text_near_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir).withColumn("citation", F.col("ord").cast("string"))
    cited = boxes.select("doc_id", "page", F.col("citation").alias("citation_id"), "bbox").distinct()
    return B.text_near(boxes, cited, G.bbox(*map(F.lit, (280.0, 380.0, 320.0, 420.0))), 60.0).select("ord")


@query(
    BOXES
    + """, t AS (SELECT * FROM boxes WHERE type = 'text' AND content = 'AF'),
p AS (SELECT p.doc_id, p.page, p.ord, t.ord AS near, abs((p.x0 + p.x1) / 2 - (t.x0 + t.x1) / 2) + abs((p.y0 + p.y1) / 2 - (t.y0 + t.y1) / 2) AS distance FROM boxes p LEFT JOIN t ON p.doc_id = t.doc_id AND p.page = t.page WHERE p.type = 'picture')
SELECT doc_id, page, ord, arg_min('Figure ' || (near % 10), row(distance, near)) AS caption, min(distance) AS distance FROM p GROUP BY ALL"""
)
def nearest_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    captioned = F.when(F.col("content") == "AF", F.concat(F.lit("Figure "), (F.col("ord") % 10).cast("string"))).otherwise(F.col("content"))
    return B.captions(_boxes(spark, sf_dir).withColumn("content", captioned)).select("doc_id", "page", "ord", "caption", "distance")


@query(BOXES + " SELECT ord FROM boxes WHERE x1 - x0 >= 20 AND y1 - y0 >= 15")
def graphics_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _boxes(spark, sf_dir)
    return B.graphics(wide.withColumn("bbox", G.bbox(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1") + 5))).select("ord")


@query("SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ' ' ORDER BY l_linenumber, l_partkey, l_returnflag || l_linestatus) AS content FROM lineitem GROUP BY 1")
def span_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("text"))
    spans = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("s"))
    lines = F.array(F.struct(F.transform("s", lambda x: F.struct(x["text"].alias("text"))).alias("spans")))
    return B.text_blocks(spans.select("l_orderkey", lines.alias("lines"))).select("l_orderkey", "content")


@query("SELECT l_orderkey AS region, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_partkey, l_returnflag) AS text, round(avg(l_quantity * 2) / 100, 6) AS confidence FROM lineitem WHERE l_quantity > 1 GROUP BY 1 HAVING avg(l_quantity * 2) / 100 >= 0.7")
def ocr_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "lineitem").select(
        F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.col("l_orderkey").alias("region"), F.struct("l_linenumber", "l_partkey").alias("position"), F.col("l_returnflag").alias("text"),
        F.when(F.col("l_quantity") > 1, F.col("l_quantity") * 2).otherwise(-1.0).alias("conf"),
    )
    return B.ocr_results(words).select("region", "text", r6("confidence").alias("confidence"))


@query(BOXES + " SELECT ord, list_filter(['bbox', 'page'], lambda x: CASE x WHEN 'bbox' THEN x1 - 60 < x0 ELSE page < 1 END) AS violations FROM boxes")
def citation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = _boxes(spark, sf_dir).withColumn("bbox", G.bbox(F.col("x0"), F.col("y0"), F.col("x1") - 60, F.col("y1"))).withColumn("source", F.lit("text")).withColumn("confidence", F.lit(0.5))
    return IN.citation_violations(broken).select("ord", "violations")


@query(r"SELECT page_id, '20240102_030405_' || left(regexp_replace(regexp_replace('spec_v' || page_id || '-20240101 Device' || page_id, '[_-](v\d+|version\d+|\d{4,8})', '', 'gi'), '[^A-Za-z0-9]', '', 'g'), 20) AS session FROM pages")
def session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("spec_v"), F.col("page_id").cast("string"), F.lit("-20240101 Device"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", T.session_name(name, F.to_timestamp(F.lit("2024-01-02 03:04:05"))).alias("session"))


@query("SELECT doc_id, upper(sha256(text)) = upper(sha256(text)) AND doc_id % 2 = 0 AS intact FROM documents")
def file_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode("text", "UTF-8")
    expected = F.when(F.col("doc_id") % 2 == 0, F.upper(F.sha2(content, 256))).otherwise("none")
    return table(spark, sf_dir, "documents").select("doc_id", H.same_file(content, expected).alias("intact"))


@query(
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '' END AS a, CASE WHEN event_id % 3 = 0 THEN event_type END AS b FROM events)
SELECT event_id, list_filter(['a', 'b', 'c'], lambda k: CASE k WHEN 'a' THEN a = '' WHEN 'b' THEN b IS NULL ELSE true END) AS missing, CASE WHEN a = '' THEN 'n' ELSE a END AS a, coalesce(b, 'm') AS b FROM e"""
)
def schema_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelode.plans import flows

    n = F.col("event_id")
    data = F.create_map(F.lit("a"), F.when(n % 2 == 0, "x").otherwise(""), F.lit("b"), F.when(n % 3 == 0, F.col("event_type")))
    merged = flows.merge_missing(data, F.create_map(F.lit("a"), F.lit("n"), F.lit("b"), F.lit("m")))
    return table(spark, sf_dir, "events").select("event_id", flows.missing_keys(data, ("a", "b", "c")).alias("missing"), merged["a"].alias("a"), merged["b"].alias("b"))


@query(MESSAGES + "SELECT doc_id AS device, count(*) AS n_pending, list_sort(list(message_id)) AS messages FROM m WHERE category = 'unrecognized' GROUP BY 1")
def pending_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _messages(spark, sf_dir)
    log = found.select(F.col("doc_id").alias("device"), "message_id", F.when(F.col("recognized"), "approved").otherwise("pending").alias("review_status"))
    return R.pending_reviews(log)


@query(FIELDS + " SELECT doc_id, page, 'field' AS kind, 'Field: ' || field_name || ' | Type: ' || field_type || ' | Message: ' || message_id || ' | Description: ' || description || ' | Example: ' || example AS chunk FROM f UNION ALL SELECT doc_id, page, 'table', markdown_table FROM spec_tables")
def device_index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.device_chunks(frame(spark, sf_dir, "spec_tables"), _fields(spark, sf_dir)).select("doc_id", "page", "kind", "chunk")


@query(frame_sql("spec_tables") + ", " + CELLS + """ SELECT doc_id, 'p' || page || '_table_' || page || '_1' AS key, CAST(count(*) AS INT) AS row_count, 4 AS col_count FROM c GROUP BY doc_id, page""")
def table_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = frame(spark, sf_dir, "spec_tables").withColumn("table_ref", T.table_ref(F.col("page"), F.lit(1)))
    return N.table_index(tables).select("doc_id", "key", "row_count", "col_count")


@query("SELECT source AS doc_id, CAST(doc_id % 5 AS INT) AS page, list(CAST(doc_id AS INT) ORDER BY doc_id) AS starts FROM documents GROUP BY ALL")
def spans_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), (F.col("doc_id") % 5).cast("int").alias("page"), F.col("doc_id").cast("int").alias("start"), F.lit(0).alias("end"), "text")
    return N.by_page(spans).select("doc_id", "page", F.transform("spans", lambda s: s["start"]).alias("starts"))


@query("SELECT doc_id, CAST(doc_id % 7 AS INT) AS page FROM documents ORDER BY coalesce(CASE WHEN doc_id % 3 > 0 THEN doc_id % 10 / 10.0 END, 0) DESC, doc_id % 7, doc_id LIMIT 20")
def spans_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7).cast("int").alias("page"), F.col("doc_id").alias("start"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 10 / 10).alias("score"))
    return N.top_k(spans, 20).select("doc_id", "page")


@query(FIELDS + ", n AS (SELECT doc_id, page, unnest([trim(string_split(regexp_extract(markdown, 'Analytes: ([^\\n]+)', 1), ',')[1]), 'glucose']) AS name FROM spec_pages), a AS (SELECT doc_id, name, page, 'text_mention' AS source FROM n UNION ALL SELECT doc_id, 'glucose', page, 'table' FROM f WHERE row = 0 AND page % 3 = 0) SELECT DISTINCT ON (doc_id, name) doc_id, name, source, page FROM a ORDER BY doc_id, name, CASE WHEN source = 'text_mention' THEN 1 ELSE 0 END, page")
def analyte_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = FD.text_analytes(frame(spark, sf_dir, "spec_pages"), "markdown")
    tables = _fields(spark, sf_dir).where("row = 0 AND page % 3 = 0").select("doc_id", F.lit("glucose").alias("name"), F.lit(None).cast("string").alias("test_type"), "page", F.lit("table").alias("source"))
    return FD.unique_analytes(mentions.unionByName(tables), exact=True).select("doc_id", "name", "source", "page")


@query("WITH d AS (SELECT text, min(row(doc_id % 10, doc_id)) AS seen FROM documents GROUP BY 1) SELECT text FROM d ORDER BY seen LIMIT 20")
def discovery_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelode.plans import flows

    hits = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("query_id"), F.col("doc_id").alias("rank"), "text")
    return flows.discovery_context(hits).select("text")


@query(MESSAGES + "SELECT count(*) AS total_messages, count(*) FILTER (message_id IN ('OBS.R01', 'QCN.R01')) AS core_messages, count(*) FILTER (message_id LIKE 'Z%') AS vendor_messages, CAST(sum(page) AS BIGINT) AS field_count FROM m")
def blueprint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelode.plans import flows

    found = _messages(spark, sf_dir).select(F.col("message_id").alias("message_type"), F.sequence(F.lit(1), F.col("page")).alias("fields"))
    return flows.blueprint_summary(found)


@query("WITH a AS (SELECT doc_id, text FROM documents) SELECT 'Merge these messages of the device d' || doc_id || ' into one JSON object with a key a message; keep every field once.' || chr(10) || chr(10) || text AS prompt FROM a")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelode.plans import prompts as P

    return table(spark, sf_dir, "documents").select(P.consolidation(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("text")).alias("prompt"))
