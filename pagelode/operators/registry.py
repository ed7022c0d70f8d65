"""Device versions, index manifests and the response cache, as append-only tables with views of their latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions.hashing import prompt_hash


def device_id(vendor: Column, model: Column) -> Column:
    return F.concat_ws("_", vendor, model)


def latest_versions(versions: DataFrame, at: str = "registered_at") -> DataFrame:
    """The last version registered of each device."""
    rest = [c for c in versions.columns if c != "device_id"]
    last = versions.groupBy("device_id").agg(F.max_by(F.struct(*rest), F.struct(at, "version")).alias("_last"))
    return last.select("device_id", "_last.*")


def history(versions: DataFrame, device: str) -> DataFrame:
    return versions.where(F.col("device_id") == device).orderBy("registered_at", "version")


def find_devices(versions: DataFrame, name: str) -> DataFrame:
    return latest_versions(versions).where(F.lower("device_name") == name.lower()).orderBy("device_id")


def new_devices(versions: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Devices to register, and those refused because they are registered."""
    known = versions.select("device_id").distinct()
    return wanted.join(known, "device_id", "left_anti"), wanted.join(known, "device_id", "left_semi")


def new_versions(versions: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions to append: of a known device, and not registered before; and the refused."""
    marked = wanted.join(versions.select("device_id").distinct().withColumn("known", F.lit(True)), "device_id", "left")
    marked = marked.join(versions.select("device_id", "version").distinct().withColumn("taken", F.lit(True)), ["device_id", "version"], "left")
    ok = F.col("known").isNotNull() & F.col("taken").isNull()
    return marked.where(ok).drop("known", "taken"), marked.where(~ok).drop("known", "taken")


# --- the response cache -----------------------------------------------------------------------------------------------


def cache_view(puts: DataFrame, verifications: DataFrame, hits: DataFrame) -> DataFrame:
    """The cache from its logs: the last response put for each prompt, what a reviewer made of it since, and its hits since.

    puts: prompt_hash, model, prompt_text, original_response, device_id, message_type,
    created_at.  verifications: prompt_hash, corrected_response, reviewed_at.  hits:
    prompt_hash, at.  Putting a response again starts it anew, unverified and without hits.
    """
    rest = [c for c in puts.columns if c != "prompt_hash"]
    last = puts.groupBy("prompt_hash").agg(F.max_by(F.struct(*rest), "created_at").alias("_put_row")).select("prompt_hash", "_put_row.*")
    since = last.select("prompt_hash", F.col("created_at").alias("_put"))
    checked = verifications.join(since, "prompt_hash").where(F.col("reviewed_at") >= F.col("_put")).groupBy("prompt_hash").agg(F.max_by(F.struct("corrected_response", "reviewed_at"), "reviewed_at").alias("_review"))
    used = hits.join(since, "prompt_hash").where(F.col("at") >= F.col("_put")).groupBy("prompt_hash").agg(F.count("*").alias("hit_count"))
    view = last.join(checked, "prompt_hash", "left").join(used, "prompt_hash", "left")
    return view.select(*last.columns, F.col("_review").isNotNull().alias("is_verified"), F.col("_review.corrected_response").alias("corrected_response"), F.col("_review.reviewed_at").alias("reviewed_at"), F.coalesce("hit_count", F.lit(0)).alias("hit_count"))


def lookup(prompts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Prompts (prompt_text) with their hash and, where a verified answer is cached, the corrected or original response."""
    keyed = prompts.withColumn("prompt_hash", prompt_hash(F.lit(model), F.col("prompt_text")))
    served = cache.where("is_verified").select("prompt_hash", F.coalesce("corrected_response", "original_response").alias("response"))
    return keyed.join(served, "prompt_hash", "left")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("total"), F.count_if("is_verified").alias("verified"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"), F.round(F.avg("hit_count"), 2).alias("avg_hits"))


def few_shot(cache: DataFrame, device: str | None = None, message_type: str | None = None, limit: int = 5) -> DataFrame:
    """Verified answers as examples, the most used and newest first."""
    kept = cache.where("is_verified")
    for column, value in (("device_id", device), ("message_type", message_type)):
        if value is not None:
            kept = kept.where(F.col(column) == value)
    return kept.orderBy(F.desc("hit_count"), F.desc("created_at"), "prompt_hash").limit(limit)


def pending_reviews(reviews: DataFrame) -> DataFrame:
    """Per device the messages that wait for review."""
    waiting = reviews.where(F.col("review_status") == "pending")
    return waiting.groupBy("device").agg(F.count("*").alias("n_pending"), F.array_sort(F.collect_set("message_id")).alias("messages"))
