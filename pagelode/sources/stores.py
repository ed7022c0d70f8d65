"""State kept as tables in a folder: registry, manifest, feedback, compliance reports, and the vector index."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.operators.search import vector_search


class Tables:
    """Append-only tables in a folder, read by a given schema.  A writer's files are committed together, so a reader sees all of an append or none."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, name: str, schema: str | T.StructType) -> DataFrame:
        """A table; one that was never written, or that holds no readable table, is empty."""
        try:
            found = self.spark.read.schema(schema).parquet(self.path(name))
            found.limit(1).count()
            return found
        except Exception as e:  # noqa: BLE001  told apart by what Spark says
            if not any(word in str(e) for word in ("PATH_NOT_FOUND", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "FAILED_READ_FILE")):
                raise
            return self.spark.createDataFrame([], schema)

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path(name))

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Replace a table.  It is written under a new name first, so that it may be made from what it replaces."""
        staged = self.path(f"{name}.new-{uuid.uuid4().hex[:8]}")
        df.write.parquet(staged)
        self.spark.read.schema(df.schema).parquet(staged).write.mode("overwrite").parquet(self.path(name))
        self._drop(staged)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def save_compliance(store: Tables, report: DataFrame, at: Column) -> str:
    """Append a compliance report under an id of its own; reports are never written over.  Returns the id."""
    key = uuid.uuid4().hex[:8]
    store.append("compliance", report.withColumn("report_id", F.concat(F.lit("compliance_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(f"_{key}"))).withColumn("reported_at", at))
    return key


def indexed(store: Tables, chunks: DataFrame, at: Column) -> DataFrame:
    """Rows for the manifest of documents (pdf_name, json_path) whose chunks were indexed, appended to it."""
    rows = chunks.groupBy("pdf_name", "json_path").agg(F.count("*").alias("chunk_count")).select("pdf_name", "json_path", "chunk_count", at.alias("indexed_at"), F.lit("indexed").alias("status"))
    store.append("manifest", rows)
    return rows


def manifest(store: Tables) -> DataFrame:
    """The last entry of each document."""
    rows = store.table("manifest", "pdf_name string, json_path string, chunk_count long, indexed_at timestamp, status string")
    return rows.groupBy("pdf_name").agg(F.max_by(F.struct("json_path", "chunk_count", "indexed_at", "status"), "indexed_at").alias("m")).select("pdf_name", "m.*")


class VectorIndex:
    """Vectors with their metadata as a Parquet table: rows (id, embedding, and any other columns), appended as they come."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, rows: DataFrame) -> VectorIndex:
        rows.write.mode("append").parquet(self.path)
        return self

    def add_texts(self, texts: DataFrame, embedder: Callable[[pd.Series], pd.Series] | None = None) -> VectorIndex:
        """Embed texts (id, text, and any metadata) and add them with their text."""
        from pagelode.sources.boundary import embed

        return self.add(texts.withColumn("embedding", embed(F.col("text"), embedder)))

    def rows(self) -> DataFrame:
        """The stored rows; raises where there is no index."""
        return self.spark.read.parquet(self.path)

    def search(self, queries: DataFrame, k: int = 5, where: Column | None = None, post_filter: bool = False) -> DataFrame:
        """As ``vector_search``, with the metadata of what is found."""
        found = vector_search(queries, self.rows(), k, where, post_filter)
        return found.join(self.rows().drop("embedding"), "id")
