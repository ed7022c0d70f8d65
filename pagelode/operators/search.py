"""Keyword, vector and hybrid search, and the master index they run on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelode.functions.text import UNICODE_SPACES, preview, tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, SEMANTIC_WEIGHT, KEYWORD_WEIGHT, OVERFETCH = 60, 0.6, 0.4, 3
LEAST_TEXT, LEAST_OCR, LEAST_MARKDOWN = 10, 20, 50


#: Bytes of text that are counted at a time.
_SLICE = 4 << 20


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of lower-cased texts in order, and each text's number of words."""
    if pc.any(pc.match_substring_regex(texts, UNICODE_SPACES)).as_py():
        texts = pc.replace_substring_regex(texts, UNICODE_SPACES, " ")
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.greater(pc.binary_length(words), 0)
    if pc.all(full, min_count=0).as_py():
        return words, np.diff(offsets)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return words.filter(full), np.diff(before[offsets - offsets[0]])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        upto = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, side="right")), at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def _counted(texts: DataFrame, id_: str, text: str, count: Callable[[pa.RecordBatch], pa.RecordBatch], fields: str) -> DataFrame:
    """A count of each text's words, in Arrow batches where the texts are: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in _slices(whole):
                yield count(rows)

    return texts.select(F.col(id_).alias("doc"), F.lower(F.coalesce(text, F.lit(""))).alias("text")).mapInArrow(run, fields)


def _frequencies(rows: pa.RecordBatch, only: pa.Array | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """For each text and term (of ``only``) in it: the text's place, the term, its count; and the texts' numbers of words."""
    words, n = _words(rows.column("text").cast(pa.string()))
    row = np.repeat(np.arange(len(n)), n)
    if only is None:
        coded = words.dictionary_encode()
        terms, code = coded.dictionary, coded.indices.to_numpy()
    else:
        terms, place = only, pc.index_in(words, value_set=only)
        row, code = row[place.is_valid().to_numpy(zero_copy_only=False)], place.drop_null().to_numpy()
    size = max(len(terms), 1)
    pairs, tf = np.unique(row * size + code, return_counts=True)
    return pairs // size, terms.take(pa.array(pairs % size)), tf.astype(np.int64), n


def postings(texts: DataFrame, id_: str = "doc_id", text: str = "text", only: list[str] | None = None) -> DataFrame:
    """Term frequencies: doc, term, tf, dl (the document's number of tokens), of all terms or ``only`` some.  Each row of ``texts`` is a document and is counted where it lies."""

    def count(rows: pa.RecordBatch) -> pa.RecordBatch:
        at, terms, tf, n = _frequencies(rows, None if only is None else pa.array(only, pa.string()))
        return pa.RecordBatch.from_arrays([rows.column("doc").take(pa.array(at)), terms, pa.array(tf), pa.array(n[at])], names=["doc", "term", "tf", "dl"])

    return _counted(texts, id_, text, count, f"doc {texts.schema[id_].dataType.simpleString()}, term string, tf long, dl long")


def lengths(texts: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of each document, blank ones included: doc, dl."""

    def count(rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column("doc"), pa.array(_words(rows.column("text").cast(pa.string()))[1])], names=["doc", "dl"])

    return _counted(texts, id_, text, count, f"doc {texts.schema[id_].dataType.simpleString()}, dl long")


def vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    """Each term's documents and occurrences: term, df, cf; the row without a term has the number of documents and of tokens.  A slice of texts is one row a term before the shuffle."""

    def count(rows: pa.RecordBatch) -> pa.RecordBatch:
        _, terms, tf, n = _frequencies(rows)
        coded = terms.dictionary_encode()
        code = coded.indices.to_numpy()
        df, cf = np.bincount(code, minlength=len(coded.dictionary)), np.bincount(code, tf, len(coded.dictionary))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([coded.dictionary, pa.nulls(1, pa.string())]), pa.array(np.append(df, len(n)).astype(np.int64)), pa.array(np.append(cf, n.sum()).astype(np.int64))], names=["term", "df", "cf"])

    found = _counted(texts.withColumn("doc", F.lit(None)), "doc", text, count, "term string, df long, cf long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def corpus_stats(doc_lengths: DataFrame) -> DataFrame:
    """One row: n documents and their mean length."""
    return doc_lengths.agg(F.count("*").alias("n"), (F.sum("dl").cast("double") / F.count("*").cast("double")).alias("avgdl"))


def _raw_idf() -> Column:
    return F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def idf(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """Weight of each term; one in over half of the documents gets a small part of the mean weight of all terms.

    ``stats`` and the mean are a row each, so their joins are broadcasts of one row.
    """
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(stats)).select("term", "df", _raw_idf().alias("idf0"))
    mean = raw.agg(F.avg("idf0").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("idf0") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf0")).alias("idf"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, term and how often it stands in the query's text."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def _score(hits: DataFrame, avgdl: Column, k: int) -> DataFrame:
    """The k best of hits (query_id, doc, times, tf, dl, idf)."""
    part = F.col("times") * F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    scores = hits.groupBy("query_id", "doc").agg(F.sum(part).alias("score")).where("score > 0")
    return top(scores, ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc")], k)


def bm25(queries: DataFrame, terms: DataFrame, doc_lengths: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each query (query_id, text): query_id, doc, score, rank from 1; ties to the smaller doc, none at or below 0.

    ``terms`` is a table of postings.  A query's repeated tokens count as often as they
    stand.  Scores that agree to nine places are ties: a sum's last digits depend on the
    order of its terms.  Only postings of the queries' terms are scored; the weights
    need every term's count once.  For more than one search build a ``KeywordIndex``.
    """
    stats = corpus_stats(doc_lengths)
    asked = asked_terms(queries)
    weights = idf(terms, stats).join(asked.select("term").distinct(), "term", "left_semi").select("term", "idf")
    hits = terms.join(asked.join(weights, "term"), "term").crossJoin(F.broadcast(stats))  # stats is one row
    return _score(hits, F.col("avgdl"), k)


#: Terms of queries up to this number are taken to the tasks that count; beyond it they are joined.
MOST_TERMS = 10_000


def bm25_texts(queries: DataFrame, texts: DataFrame, k: int = 10, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``bm25``, from the texts: one pass counts the vocabulary, one the queries' terms alone; neither shuffles texts or postings.

    The queries' distinct terms, up to ``MOST_TERMS``, and their weights are held by the
    driver; for more the postings are joined.
    """
    spark = texts.sparkSession
    asked = asked_terms(queries)
    terms = [r["term"] for r in asked.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(terms) > MOST_TERMS:
        return bm25(queries, postings(texts, id_, text), lengths(texts, id_, text), k)
    counts = vocabulary(texts, text)
    whole = counts.where(F.col("term").isNull()).select(F.col("df").alias("n"), (F.col("cf").cast("double") / F.col("df").cast("double")).alias("avgdl"))
    raw = counts.where(F.col("term").isNotNull()).crossJoin(F.broadcast(whole)).withColumn("idf0", _raw_idf())  # whole is one row
    wanted = F.collect_list(F.when(F.col("term").isin(terms), F.struct("term", "idf0")))
    row = raw.agg(F.max("avgdl").alias("avgdl"), F.avg("idf0").alias("mean"), wanted.alias("asked")).first()
    weights = spark.createDataFrame([(r["term"], r["idf0"] if r["idf0"] >= 0 else EPSILON * row["mean"]) for r in row["asked"]], "term string, idf double")
    hits = postings(texts, id_, text, terms).join(F.broadcast(asked.join(weights, "term")), "term")  # a row a query and term of at most MOST_TERMS
    return _score(hits, F.lit(row["avgdl"]).cast("double"), k)


class KeywordIndex:
    """Postings, weights and documents stored as tables in a folder.

    Postings are sorted by (bucket, term, doc) into ranges, so that a term in every
    document is many files, and kept in a folder a bucket of the term's hash: a search
    reads the files of its terms alone.
    """

    BUCKETS = 64
    #: Terms up to this number are written into the scan's filter; beyond it they are joined.
    LITERAL_TERMS = 1000

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        stats = spark.read.parquet(f"{self.path}/stats").first()
        self.n, self.avgdl = stats["n"], stats["avgdl"]

    @staticmethod
    def bucket(term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(KeywordIndex.BUCKETS)).cast("int")

    @classmethod
    def build(cls, texts: DataFrame, path: str, id_: str = "doc_id", text: str = "text") -> KeywordIndex:
        """Index texts with their other columns as metadata.  Texts are tokenized once; ``stats`` is written last, so a folder with it is whole."""
        spark, path = texts.sparkSession, path.rstrip("/")
        texts.withColumnRenamed(id_, "doc").write.mode("overwrite").parquet(f"{path}/documents")
        documents = spark.read.schema(texts.withColumnRenamed(id_, "doc").schema).parquet(f"{path}/documents")
        found = postings(documents, "doc", text).withColumn("bucket", cls.bucket(F.col("term")))
        found.repartitionByRange("bucket", "term", "doc").sortWithinPartitions("bucket", "term", "doc").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        stats = corpus_stats(lengths(documents, "doc", text))
        row = stats.first()
        known = spark.createDataFrame([(row["n"], row["avgdl"])], "n long, avgdl double")
        terms = spark.read.schema(f"doc {documents.schema['doc'].dataType.simpleString()}, term string, tf long, dl long, bucket int").parquet(f"{path}/postings")
        idf(terms, known).write.mode("overwrite").parquet(f"{path}/terms")
        known.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        return cls(spark, path)

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    def search(self, queries: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
        """As ``bm25``; with ``where``, a condition on the documents' columns, among those it holds of (weights stay the whole corpus's)."""
        asked = asked_terms(queries)
        terms = [r["term"] for r in asked.select("term").distinct().limit(self.LITERAL_TERMS + 1).collect()]
        found, weights = self.spark.read.parquet(f"{self.path}/postings"), self.spark.read.parquet(f"{self.path}/terms").select("term", "idf")
        if len(terms) <= self.LITERAL_TERMS:
            buckets = [r[0] for r in asked.select(self.bucket(F.col("term"))).distinct().collect()]
            found = found.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
            weights = weights.where(F.col("term").isin(terms))
        hits = found.join(asked.join(weights, "term"), "term")
        if where is not None:
            hits = hits.join(self.documents().where(where).select("doc"), "doc", "left_semi")
        return _score(hits, F.lit(self.avgdl), k)


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, numbered; Spark keeps k rows a key and task before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


#: Queries and vectors that meet in one task.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 16384

#: Distances that a task holds at a time.
_DISTANCES = 1 << 20


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 5, where: Column | None = None, post_filter: bool = False, overfetch: int = 5, most_queries: int = QUERY_BLOCK, most_vectors: int = VECTOR_BLOCK) -> DataFrame:
    """Exact nearest vectors by squared L2: query_id, id, distance, score = 1 / (1 + distance), rank; ties to the smaller id.

    queries: query_id, query (array); vectors: id, embedding and what ``where`` tests.
    The filter applies before ranking; with ``post_filter`` it is applied to the nearest
    ``k * overfetch`` instead.  Both sides are counted and dealt by hash to blocks of
    about ``most_queries`` and ``most_vectors``; each two blocks meet in a task, which
    takes one matrix product and hands on its nearest, measured anew by differences.
    Memory is that of two blocks, the work the product of both tables.  Vectors that are
    null or of another length than a query are not compared with it.
    """
    if most_queries < 1 or most_vectors < 1:
        raise ValueError("a block holds one row or more")
    passed = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    pool = vectors.select("id", F.col("embedding").cast("array<double>").alias("v"), passed.alias("passed")).where(F.col("v").isNotNull())
    pool = pool if where is None or post_filter else pool.where("passed")
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    q_blocks, v_blocks = max(1, -(-asked.count() // most_queries)), max(1, -(-pool.count() // most_vectors))
    fetch = k * overfetch if where is not None and post_filter else k
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        qid, vid, far = [], [], []
        if left.num_rows and right.num_rows:
            q_sizes, v_sizes = pc.list_value_length(left.column("v")).to_numpy(), pc.list_value_length(right.column("v")).to_numpy()
            for size in np.unique(q_sizes):
                q_at, v_at = np.flatnonzero(q_sizes == size), np.flatnonzero(v_sizes == size)
                if not len(v_at):
                    continue
                flat = lambda t, at: pc.list_flatten(t.column("v").take(pa.array(at))).to_numpy().reshape(-1, size)  # noqa: B023, E731
                q, v = flat(left, q_at), flat(right, v_at)
                ids = right.column("id").take(pa.array(v_at))
                rank = np.empty(len(v_at), np.int64)
                rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(v_at))
                square = (v * v).sum(1)
                for a in range(0, len(q), max(1, _DISTANCES // len(v))):
                    part = q[a : a + max(1, _DISTANCES // len(v))]
                    rough = square[None] - 2 * (part @ v.T) + (part * part).sum(1)[:, None]
                    slack = 1e-9 * (1 + square.max() + (part * part).sum(1))
                    for i, row in enumerate(rough):
                        edge = np.partition(row, fetch - 1)[fetch - 1] if fetch < len(row) else np.inf
                        near = np.flatnonzero(row <= edge + 2 * slack[i])
                        exact = ((v[near] - part[i]) ** 2).sum(1)
                        best = np.lexsort((rank[near], exact))[:fetch]
                        qid.append(np.full(len(best), q_at[a + i], np.int32))
                        vid.append(v_at[near[best]].astype(np.int32))
                        far.append(exact[best])
        q_rows, v_rows = (pa.array(np.concatenate([np.empty(0, np.int32), *at])) for at in (qid, vid))
        columns = {"query_id": left.column("query_id").take(q_rows), "id": right.column("id").take(v_rows), "passed": right.column("passed").take(v_rows), "distance": pa.array(np.concatenate([np.empty(0), *far]))}
        return pa.table(columns)

    grid = lambda d, key, own, other, m, others: d.withColumn(own, F.pmod(F.xxhash64(key), F.lit(m)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    left = grid(asked, "query_id", "qb", "vb", q_blocks, v_blocks).groupBy("qb", "vb")
    right = grid(pool, "id", "vb", "qb", v_blocks, q_blocks).groupBy("qb", "vb")
    scored = left.cogroup(right).applyInArrow(meet, f"query_id {kinds[0]}, id {kinds[1]}, passed boolean, distance double")
    order = [F.asc("distance"), F.asc("id")]
    if where is not None and post_filter:
        scored = top(scored, ["query_id"], order, fetch).where("passed").drop("rank")
    return top(scored, ["query_id"], order, k).select("query_id", "id", "distance", (1 / (1 + F.col("distance"))).alias("score"), "rank")


def fuse(semantic: DataFrame, keyword: DataFrame, k: int = 5, weights: tuple[float, float] = (SEMANTIC_WEIGHT, KEYWORD_WEIGHT), rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, key, rank): query_id, key, rrf, sources, rank.

    A key counts once a ranking, at its best rank.  Ties go to the first seen: semantic
    hits by rank, then keyword hits.
    """
    part = lambda d, name, w, late: d.groupBy("query_id", "key").agg(F.min("rank").alias("r")).select("query_id", "key", F.lit(name).alias("source"), (F.lit(w) / (F.col("r") + rrf_k)).alias("part"), F.struct(F.lit(late).alias("late"), "r").alias("seen"))
    both = part(semantic, "semantic", weights[0], 0).unionByName(part(keyword, "keyword", weights[1], 1))
    fused = both.groupBy("query_id", "key").agg(F.sum("part").alias("rrf"), F.min("seen").alias("seen"), F.array_join(F.reverse(F.array_sort(F.collect_set("source"))), "+").alias("sources"))
    return top(fused, ["query_id"], [F.desc("rrf"), F.asc("seen"), F.asc("key")], k).drop("seen")


def hybrid_search(queries: DataFrame, vectors: DataFrame, terms: DataFrame | KeywordIndex, doc_lengths: DataFrame | None, keys: DataFrame, k: int = 5, mode: str = "hybrid") -> DataFrame:
    """Search by ``mode``: semantic, keyword or hybrid.  queries: query_id, text, query; keys: id, key (see ``dedupe_key``).

    ``terms`` is a stored index, a table of postings with ``doc_lengths`` beside it, or, without them, the texts (doc_id, text).
    Documents are scored by keyword once for each distinct text; its queries share the ranking.
    """
    if mode not in ("semantic", "keyword", "hybrid"):
        raise ValueError(f"unknown mode: {mode}")
    fetch = OVERFETCH * k if mode == "hybrid" else k
    semantic = vector_search(queries.select("query_id", "query"), vectors, fetch).join(keys, "id") if mode != "keyword" else None
    asked = queries.select(F.col("text").alias("query_id"), "text").distinct()
    by_words = lambda: terms.search(asked, fetch) if isinstance(terms, KeywordIndex) else bm25_texts(asked, terms, fetch) if doc_lengths is None else bm25(asked, terms, doc_lengths, fetch)
    keyword = None
    if mode != "semantic":
        ranked = by_words().withColumnRenamed("doc", "id").join(keys, "id").withColumnRenamed("query_id", "text")
        keyword = queries.select("query_id", "text").join(ranked, "text").drop("text")
    if mode == "hybrid":
        return fuse(semantic, keyword, k)
    return (semantic if mode == "semantic" else keyword).select("query_id", "id", "key", "score", "rank")


def dedupe_key(citation: Column, text: Column) -> Column:
    """The citation, else the first fifty characters: rows without a citation do not fall together."""
    return F.coalesce(citation, F.left(text, F.lit(50)))


def format_result(rank: Column, source: Column, score: Column, text: Column) -> Column:
    return F.format_string("%d. [%s] (score: %.4f) %s", rank, source, score, preview(text, 200))


def chunks(pages: DataFrame, blocks: DataFrame, ocr: DataFrame) -> DataFrame:
    """What the index takes in of a document: text, OCR results and page markdown before its citations, each over its least length."""
    text = blocks.where((F.col("type") == "text") & (F.length("content") > LEAST_TEXT)).select("doc_id", "page", F.lit("text").alias("kind"), F.col("content").alias("chunk"), "citation")
    seen = ocr.where(F.length("text") > LEAST_OCR).select("doc_id", "page", F.lit("ocr").alias("kind"), F.col("text").alias("chunk"), "citation")
    body = F.trim(F.get(F.split("markdown", "## Citations"), F.lit(0)))
    whole = pages.select("doc_id", "page", F.lit("markdown").alias("kind"), body.alias("chunk"), F.lit(None).cast("string").alias("citation")).where(F.length("chunk") > LEAST_MARKDOWN)
    return text.unionByName(seen).unionByName(whole)


def not_indexed(candidates: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Documents to index: those the manifest does not list, or all."""
    return candidates if force else candidates.join(manifest.select("pdf_name"), "pdf_name", "left_anti")


def merge_index(index: DataFrame, added: DataFrame) -> DataFrame:
    """The index with the added documents' chunks in place of any it had of them."""
    return index.join(added.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(added)


def device_chunks(blocks: DataFrame, fields: DataFrame) -> DataFrame:
    """What a device's index takes in: text, table markdown and a line for each field."""
    kept = blocks.select("doc_id", "page", F.col("type").alias("kind"), F.when(F.col("type") == "text", F.col("content")).when(F.col("type") == "table", F.col("markdown_table")).alias("chunk"), "citation").where(F.col("chunk").isNotNull())
    return kept.unionByName(fields.select("doc_id", "page", F.lit("field").alias("kind"), field_text().alias("chunk"), F.col("citation_id").alias("citation")))


def field_text() -> Column:
    """A field as a searchable line."""
    return F.concat(
        F.lit("Field: "), "field_name", F.lit(" | Type: "), "field_type", F.lit(" | Message: "), "message_id", F.lit(" | Description: "), "description",
        F.when(F.col("example").isNotNull() & (F.col("example") != ""), F.concat(F.lit(" | Example: "), "example")).otherwise(""),
    )


def provenance(hits: DataFrame) -> DataFrame:
    """Hits by document, most first."""
    return hits.groupBy("doc_id").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "doc_id")


def index_stats(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"))
