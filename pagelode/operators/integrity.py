"""Completeness, violations, OCR statistics, compliance, and human feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions import confidence, geometry
from pagelode.schemas import CITATION_SOURCES, FEEDBACK_TYPES

WEIGHTS = {"provenance": 0.4, "confidence": 0.3, "errors": 0.2, "completeness": 0.1}
COMPLIANT_FROM, COVERED_FROM = 0.8, 0.95


def citation_violations(citations: DataFrame) -> DataFrame:
    """Citations with the rules that they break, as rows rather than exceptions."""
    rules = {"bbox": ~geometry.ordered(F.col("bbox")), "page": F.col("page") < 1, "source": ~F.col("source").isin(*CITATION_SOURCES), "confidence": ~F.col("confidence").between(0, 1)}
    broken = F.filter(F.array(*(F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items())), lambda x: x.isNotNull())
    return citations.withColumn("violations", broken)


def missing_pages(blocks: DataFrame, expected: int, first_page: int = 1) -> DataFrame:
    """Expected pages, per document, that no block stands on."""
    pages = blocks.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(first_page), F.lit(first_page + expected - 1))).alias("page"))
    return pages.join(blocks.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


def completeness(blocks: DataFrame, expected: int, first_page: int = 1) -> DataFrame:
    """Per document: missing pages, blocks without box or source, and whether all is there; up to ten missing pages are named."""
    gaps = missing_pages(blocks, expected, first_page).groupBy("doc_id").agg(F.count("*").alias("n_missing"), F.slice(F.array_sort(F.collect_list("page")), 1, 10).alias("first_missing"))
    counts = blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("bbox").isNull()).alias("no_bbox"), F.count_if(F.col("source").isNull()).alias("no_source"))
    joined = counts.join(gaps, "doc_id", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))
    return joined.withColumn("complete", (F.col("n_missing") + F.col("no_bbox") + F.col("no_source")) == 0)


def ocr_stats(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Results by confidence level, with mean, least and most."""
    level = confidence.level(F.col("confidence"))
    return results.groupBy(*(keys or [])).agg(
        F.count("*").alias("total"), *(F.count_if(level == n).alias(n) for n in ("accepted", "review", "rejected")),
        F.avg("confidence").alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"),
    )


def compliance(blocks: DataFrame, errors: DataFrame, complete: Column | None = None) -> DataFrame:
    """Per document: coverage, confidence, error and completeness scores, their weighted sum, and what follows from it.

    blocks: doc_id, bbox, source, citation, confidence.  errors: doc_id, severity.
    ``complete`` is a column of the aggregate (default: all blocks have a source).
    """
    level = confidence.level(F.col("confidence"))
    stats = blocks.groupBy("doc_id").agg(
        F.count("*").alias("total_blocks"), F.count_if(F.col("bbox").isNotNull() & F.col("citation").isNotNull()).alias("cited"),
        F.coalesce(F.avg("confidence"), F.lit(1.0)).alias("avg_confidence"), F.count_if(level == "review").alias("review_count"), F.count_if(level == "rejected").alias("rejected_count"),
        F.count_if(F.col("source").isNull()).alias("no_source"),
    )
    bad = errors.groupBy("doc_id").agg(F.count_if(F.col("severity").isin("error", "fatal")).alias("critical_errors"))
    joined = stats.join(bad, "doc_id", "left").withColumn("critical_errors", F.coalesce("critical_errors", F.lit(0)))
    coverage = F.col("cited").cast("double") / F.nullif(F.col("total_blocks"), F.lit(0))
    error_score = F.when(F.col("critical_errors") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("critical_errors") / 10))
    done = (complete if complete is not None else F.col("no_source") == 0).cast("double")
    scored = joined.withColumns({"provenance_coverage": F.coalesce(coverage, F.lit(0.0)), "error_score": error_score, "completeness_score": done})
    score = sum((F.col(c) * WEIGHTS[n] for n, c in (("provenance", "provenance_coverage"), ("confidence", "avg_confidence"), ("errors", "error_score"), ("completeness", "completeness_score"))), F.lit(0.0))
    scored = scored.withColumn("compliance_score", score)
    issues = {
        "Low provenance coverage": F.col("provenance_coverage") < COVERED_FROM, "Blocks need review": F.col("review_count") > 0, "Blocks were rejected": F.col("rejected_count") > 0,
        "Critical errors": F.col("critical_errors") > 0, "Incomplete extraction": F.col("completeness_score") < 1,
    }
    return scored.withColumns(
        {
            "is_compliant": (F.col("compliance_score") >= COMPLIANT_FROM) & (F.col("critical_errors") == 0) & (F.col("provenance_coverage") >= COVERED_FROM),
            "review_required": (F.col("review_count") > 0) | (F.col("rejected_count") > 0) | (F.col("critical_errors") > 0),
            "issues": F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in issues.items())), lambda x: x.isNotNull()),
        }
    )


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """A row for each type, zeros included: its records, those for training, and their mean confidence."""
    kinds = feedback.sparkSession.createDataFrame([(k,) for k in FEEDBACK_TYPES], "feedback_type string")
    stats = feedback.groupBy("feedback_type").agg(F.count("*").alias("n"), F.count_if("include_in_training").alias("n_training"), F.avg("original_confidence").alias("avg_confidence"))
    return kinds.join(stats, "feedback_type", "left").select("feedback_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_training", F.lit(0)).alias("n_training"), "avg_confidence")


def training_pairs(feedback: DataFrame) -> DataFrame:
    """Corrections with a corrected text, and confirmations as they stand at confidence 1; only records meant for training."""
    correction = (F.col("feedback_type") == "correction") & (F.coalesce("corrected_content", F.lit("")) != "")
    confirmed = F.col("feedback_type") == "confirmation"
    kept = feedback.where(F.col("include_in_training") & (correction | confirmed))
    return kept.select(
        "feedback_id", "feedback_type", F.col("original_content").alias("input"), F.when(confirmed, F.col("original_content")).otherwise(F.col("corrected_content")).alias("output"),
        F.when(confirmed, F.lit(1.0)).otherwise(F.col("original_confidence")).alias("confidence"),
    )


def feedback_by(feedback: DataFrame, kind: str | None = None, extraction: str | None = None) -> DataFrame:
    if kind is not None:
        feedback = feedback.where(F.col("feedback_type") == kind)
    return feedback if extraction is None else feedback.where(F.col("extraction_id") == extraction)
