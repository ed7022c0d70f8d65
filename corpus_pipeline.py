"""A training-data pipeline: quality rules, line dedup, near-duplicates, source mixing and packing, over whole texts.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``documents``; further columns
of their input are not carried on.  A stage without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm import linededup, mixing, packing, quality, shingles
from pagelode.llm.common import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars brought up to date with the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go.

    Null, empty and short texts fail the base rules.  Rows that repeat are judged alike.
    """
    return quality.compression_bands(docs.select(*COLUMNS), only_kept=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the one with the largest doc_id.

    A null text becomes the empty one, as does a text that loses all its lines.  Rows
    that repeat a doc_id are one document; a null doc_id is one too, smaller than any.
    """
    return _as_documents(linededup.dedup_lines(spark, docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingles of five words (Jaccard 0.8 or more), the one with the smallest doc_id stays.

    All rows that repeat that id stay with it.  Null and empty texts are one group.  A
    null doc_id stays only where its group has no other.
    """
    found = shingles.near_duplicates(spark, docs)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture near the sources' target weights: a row for each run of blocks taken of a document, repeats included.

    Documents without words are left out.  Null sources are a source.  Rows that repeat
    each have their own blocks.
    """
    return _as_documents(mixing.mixed_documents(spark, docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids.

    The mixture holds several rows of a document, so ``fragment`` numbers the rows;
    start and doc_tokens count within one.  Null and empty texts are the end id alone.
    """
    rows = docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("fragment")).alias("doc_id"), "text")
    pieces = packing.pack(spark, rows)
    return pieces.select("doc_id.doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "doc_id.fragment")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Compression, fingerprints and tokenizers are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.cut(stage(spark, docs, sf_dir), name)
    return docs
