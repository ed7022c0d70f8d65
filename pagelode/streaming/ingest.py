"""Incremental ingest: sidecar files as they arrive, indexed once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelode.schemas import SIDECAR
from pagelode.sources import sidecar


def stream_sidecars(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """A stream of pages (doc_id, p) from object-layout sidecars, one JSON object a line."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", max_files).text(folder)
    parsed = lines.select(F.from_json("value", SIDECAR).alias("s"))
    return parsed.select(F.col("s.pdf_name").alias("doc_id"), F.explode("s.pages").alias("p"))


def ingest(pages: DataFrame, blocks_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the blocks of arriving pages to a table, each file once; with ``once`` stop when all that is there is in."""
    writer = sidecar.blocks(pages).writeStream.format("parquet").option("path", blocks_path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def feedback_counts(feedback: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Feedback by type in windows of event time; records later than ``late`` are left out."""
    return feedback.withWatermark("created_at", late).groupBy(F.window("created_at", window).alias("w"), "feedback_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "feedback_type", "n")
