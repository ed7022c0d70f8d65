"""End-to-end flows: onboarding a document, updating it, and extracting a blueprint with a language model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import confidence as C
from pagelode.functions.text import json_payload, let
from pagelode.operators import diff, fields, messages, registry, reports, search
from pagelode.plans import prompts
from pagelode.sources import boundary

#: What the discovery step searches for.
DISCOVERY_QUERIES = (
    "message type structure supported communication",
    "table of contents messages message structure",
    "bidirectional communication host analyzer device interface",
    "message definition field structure data type",
    "vendor specific extension custom message namespace",
    "message flow diagram sequence bidirectional request response",
    "supported messages implemented protocol specification",
    "message trigger event query response acknowledgment",
    "communication pattern host device analyzer bidirectional",
    "message structure component segment field cardinality optionality",
)
DISCOVERY_K, DISCOVERY_CHUNKS = 5, 20
CORE_MESSAGES = ("HEL.R01", "ACK.R01", "DST.R01", "OBS.R01", "OBS.R02", "OPL.R01", "EOT.R01", "END.R01", "QCN.R01")
THRESHOLD, MOST_ROUNDS = 0.8, 3
FIELD_KEYS = ("field_name", "data_type", "cardinality", "description")


@dataclass
class Inventory:
    """What is extracted from one or many documents; each a lazy table keyed by doc_id."""

    messages: DataFrame
    field_specs: DataFrame
    fields: DataFrame
    schemas: DataFrame
    analytes: DataFrame
    enums: DataFrame
    chunks: DataFrame


def inventory(pages: DataFrame, blocks: DataFrame, standards: DataFrame | None = None) -> Inventory:
    """All extraction over normalised pages and blocks.  Blocks feed several outputs: store them as Parquet first, so that each reads its columns only."""
    found = fields.field_definitions(pages, blocks)
    mentions = fields.text_analytes(blocks.where("type = 'text'").select("doc_id", "page", "content")).unionByName(fields.text_analytes(pages, "markdown"))
    analytes = fields.unique_analytes(mentions.unionByName(fields.table_analytes(blocks)).unionByName(fields.field_analytes(found)))
    return Inventory(
        messages.categorise(messages.extract_messages(blocks), standards), messages.field_specs(blocks), found, fields.message_schemas(found), analytes,
        fields.enum_definitions(found), search.device_chunks(blocks, found),
    )


def onboard(pages: DataFrame, blocks: DataFrame, version: str, device: str, at: str) -> tuple[Inventory, DataFrame]:
    """A first version: its inventory and its baseline report."""
    found = inventory(pages, blocks)
    return found, reports.baseline_report(found.messages, found.field_specs, found.schemas, found.analytes, found.enums, F.lit(version), F.lit(device), F.lit(at))


@dataclass
class Update:
    """The outcome of an update: its status, changes, decision, report, and whether it waits for approval."""

    status: str
    changes: DataFrame | None
    decision: DataFrame | None
    report: DataFrame | str | None
    needs_approval: bool


def update(old_blocks: DataFrame | None, new_blocks: DataFrame, old_hash: str | None, new_hash: str, old: str, new: str, device: str, at: str) -> Update:
    """Compare a new version with the old: equal files short-circuit, HIGH or MEDIUM changes wait for approval."""
    status, changes = diff.compare(old_blocks, new_blocks, old_hash, new_hash)
    if status == "no_change":
        return Update(status, None, None, reports.no_change_report(old, new, device, at), False)
    if changes is None:
        return Update(status, None, None, None, False)
    decision = diff.rebuild_decision(changes)
    waits = bool(decision.first()["requires_rebuild"])
    return Update(status, changes, decision, reports.change_report(changes, decision, old, new, device, at), waits)


def register(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows to append for versions of known devices; raises if any is refused."""
    accepted, refused = registry.new_versions(versions, wanted)
    bad = [f"{r['device_id']} {r['version']}" for r in refused.select("device_id", "version").limit(20).collect()]
    if bad:
        raise ValueError("unknown device or version already registered: " + ", ".join(bad))
    return accepted


def merge_missing(original: Column, refined: Column) -> Column:
    """A map with keys that are missing or empty filled from another."""
    held = F.map_filter(original, lambda _, v: v.isNotNull() & (v != ""))
    return F.map_concat(held, F.map_filter(refined, lambda k, _: ~F.map_contains_key(held, k)))


def missing_keys(data: Column, required: tuple[str, ...]) -> Column:
    """Required keys that a map lacks or has empty."""
    return F.filter(F.array(*map(F.lit, required)), lambda k: F.coalesce(F.try_element_at(data, k), F.lit("")) == "")


#: What a JSON value is called, by the beginning of its variant type.
_KINDS = (("STRING", "str"), ("BOOLEAN", "bool"), ("BIGINT", "int"), ("DECIMAL", "float"), ("DOUBLE", "float"), ("ARRAY", "list"), ("OBJECT", "dict"), ("VOID", "NoneType"))
_WANTED = {"string": ("str",), "number": ("int", "float"), "array": ("list",), "object": ("dict",), "boolean": ("bool",)}


def type_errors(data: Column, properties: dict[str, str]) -> Column:
    """What is wrong with the types of a JSON object's values (a text), property by property; a missing one is no error."""

    def named(shown: Column) -> Column:
        kind = F.lit(None).cast("string")
        for begin, python in reversed(_KINDS):
            kind = F.when(F.startswith(shown, F.lit(begin)), python).otherwise(kind)
        return F.coalesce(kind, F.lit("NoneType"))

    def error(values: Column, name: str, wanted: str) -> Column:
        kind = let(F.schema_of_variant(F.try_element_at(values, F.lit(name))), named)
        said = lambda k: F.when(~k.isin(*_WANTED.get(wanted, (wanted,))), F.concat(F.lit(f"Field '{name}': expected {wanted}, got "), k))
        return F.when(F.map_contains_key(values, F.lit(name)), let(kind, said))

    return let(F.from_json(data, "map<string, variant>"), lambda values: F.array_compact(F.array(*(error(values, n, w) for n, w in properties.items()))))


def discovery_context(hits: DataFrame) -> DataFrame:
    """The first chunks of all discovery queries (query_id, rank, text) in order, each text once."""
    first = hits.groupBy("text").agg(F.min(F.struct("query_id", "rank")).alias("seen"))
    return first.orderBy("seen").limit(DISCOVERY_CHUNKS)


def discover(spark: SparkSession, chunks: DataFrame, cache: DataFrame, model: boundary.Provider, device: str) -> DataFrame:
    """Messages that a model finds in the chunks that keyword search retrieves: data (a map of strings each), confidence.

    chunks: doc, text.  An answer that is no JSON list gives no rows.
    """
    queries = spark.createDataFrame(list(enumerate(DISCOVERY_QUERIES)), "query_id int, text string")
    hits = search.bm25_texts(queries, chunks, DISCOVERY_K, "doc").join(chunks, "doc")
    context = discovery_context(hits.select("query_id", "rank", "text"))
    scores = hits.agg(F.array_sort(F.collect_list("score")).alias("scores"))  # at most fifty
    prompt = F.concat(F.lit(f"List as JSON the messages of the {device} specification, each with message_type, direction and description.\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seen", "text"))), lambda x: x["text"]), "\n---\n"))
    answers = boundary.generate(context.agg(prompt.alias("prompt_text")), cache, model)
    parsed = answers.where(F.col("error").isNull()).select(F.explode(F.from_json(json_payload(F.col("response")), "array<map<string, string>>")).alias("data"))
    required = ("message_type", "direction", "description")
    complete = 1 - F.size(missing_keys(F.col("data"), required)) / len(required)
    return parsed.crossJoin(F.broadcast(scores)).select("data", C.discovery(C.search(F.col("scores")), complete).alias("confidence"))


def message_fields(spark: SparkSession, found: DataFrame, chunks: DataFrame, cache: DataFrame, model: boundary.Provider, device: str, k: int = DISCOVERY_K) -> DataFrame:
    """The fields that a model finds of each message (message_type): message_type, fields (maps of strings), confidence and error.

    All messages are steps of one plan: a search a message over the chunks (doc, text),
    a prompt a message, and the answers parsed together.  An answer that is no JSON list
    has no fields, confidence 0 and an error.
    """
    wanted = found.select("message_type").distinct()
    queries = wanted.select(F.col("message_type").alias("query_id"), F.concat("message_type", F.lit(" field definitions structure")).alias("text"))
    hits = search.bm25_texts(queries, chunks, k, "doc").join(chunks, "doc")
    listed = hits.groupBy(F.col("query_id").alias("message_type")).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("hits"), F.sort_array(F.collect_list("score"), False).alias("scores"))
    none = F.array().cast("array<string>")
    asked = wanted.join(listed, "message_type", "left").select(
        "message_type", F.coalesce("scores", F.array().cast("array<double>")).alias("scores"),
        prompts.message_fields(F.lit(device), F.col("message_type"), F.coalesce(F.transform("hits", lambda h: h["text"]), none)).alias("prompt_text"),
    )
    answers = boundary.generate(asked.select("prompt_text"), cache, model, system_prompt=prompts.SYSTEM).dropDuplicates(["prompt_text"])
    parsed = asked.join(answers, "prompt_text").withColumn("fields", F.from_json(json_payload(F.col("response")), "array<map<string, string>>"))
    share = lambda keys: F.aggregate(F.transform("fields", lambda f: 1 - F.size(missing_keys(f, keys)) / len(keys)), F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("fields"), F.lit(1))
    read = F.col("fields").isNotNull()
    score = F.when(read, C.fields(C.search(F.col("scores")), share(FIELD_KEYS[:2]), share(FIELD_KEYS))).otherwise(0.0)
    return parsed.select("message_type", F.coalesce("fields", F.array().cast("array<map<string, string>>")).alias("fields"), score.alias("confidence"), F.coalesce("error", F.when(~read, "the answer is no JSON list")).alias("error"), "prompt_hash", "prompt_text", "response", "cached")


def blueprint(spark: SparkSession, chunks: DataFrame, cache: DataFrame, model: boundary.Provider, device: str, on_step: Callable[[str], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Discovery, then the fields of each message found: messages (message_type, direction, description, fields, confidence) and the answers to put in the cache.

    ``on_step`` hears the name of each step as it begins.
    """
    tell = on_step or (lambda step: None)
    tell("discovery")
    found = discover(spark, chunks, cache, model, device).select(F.col("data")["message_type"].alias("message_type"), F.col("data")["direction"].alias("direction"), F.col("data")["description"].alias("description"), "confidence").where(F.coalesce("message_type", F.lit("")) != "")
    found = found.groupBy("message_type").agg(F.max_by(F.struct("direction", "description", "confidence"), "confidence").alias("m")).select("message_type", "m.*").persist()
    tell("fields")
    fields_ = message_fields(spark, found, chunks, cache, model, device).persist()
    tell("summary")
    joined = found.join(fields_.select("message_type", "fields", F.col("confidence").alias("field_confidence"), "error"), "message_type", "left")
    return joined, fields_.where(~F.col("cached") & F.col("response").isNotNull()).select("prompt_hash", "prompt_text", "response", "message_type")


def refine(rows: DataFrame, required: tuple[str, ...], again, most_rounds: int = MOST_ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, data, confidence) whose gaps ``again`` (rows to a table of id, data) fills, round by round.

    A row is done when its confidence reaches the threshold or nothing required is
    missing; the score is the share of required keys, weighed with the score before.
    """
    for _ in range(most_rounds):
        open_ = (F.col("confidence") < threshold) & (F.size(missing_keys(F.col("data"), required)) > 0)
        answers = again(rows.where(open_)).select("id", F.col("data").alias("_more"))
        joined = rows.join(answers, "id", "left")
        merged = F.when(F.col("_more").isNotNull(), merge_missing(F.col("data"), F.col("_more"))).otherwise(F.col("data"))
        filled = 1 - F.size(missing_keys(merged, required)) / len(required)
        score = F.when(F.col("_more").isNotNull(), C.weighted({"now": (filled, 1.0), "before": (F.col("confidence"), 0.5)})).otherwise(F.col("confidence"))
        rows = joined.select("id", merged.alias("data"), score.alias("confidence"))
    return rows


def blueprint_summary(found: DataFrame) -> DataFrame:
    """One row: messages in all, of the core protocol, of vendors, and fields (message_type, fields array)."""
    return found.agg(
        F.count("*").alias("total_messages"), F.count_if(F.col("message_type").isin(*CORE_MESSAGES)).alias("core_messages"),
        F.count_if(F.startswith("message_type", F.lit("Z"))).alias("vendor_messages"), F.coalesce(F.sum(F.size("fields")), F.lit(0)).alias("field_count"),
    )
