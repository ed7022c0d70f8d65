"""Commands over a store of Parquet tables: onboard, update, extract-blueprint, review-message, list.

    python -m pagelode onboard --store DIR --vendor V --model M --version 1 --file SPEC.txt
"""

from __future__ import annotations

import argparse
import hashlib
import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.config import merged_options
from pagelode.operators import messages, registry, search
from pagelode.plans import flows
from pagelode.schemas import SIDECAR_BLOCK
from pagelode.sources import boundary
from pagelode.sources.stores import Tables

VERSIONS = "device_id string, vendor string, model string, device_name string, version string, file_hash string, is_baseline boolean, registered_at timestamp"
REVIEWS = "device string, message_id string, review_status string, notes string, reviewed_at timestamp"


CACHE = "prompt_hash string, model string, prompt_text string, original_response string, corrected_response string, is_verified boolean, device_id string, message_type string, created_at timestamp"


def _extract(store: Tables, file: str, device: str, version: str) -> tuple[DataFrame, DataFrame, str]:
    files = boundary.read_files(store.spark, file)
    hashes = [r["file_hash"] for r in files.select("path", "file_hash").orderBy("path").limit(1000).collect()]
    digest = hashes[0] if len(hashes) == 1 else hashlib.sha256("|".join(hashes).encode()).hexdigest()  # of several files, one over all
    decoder = boundary.pdf_decoder(device) if file.lower().endswith(".pdf") else boundary.TextDecoder()
    raw = boundary.extract_pages(files, decoder).withColumn("doc_id", F.lit(device))
    raw = store.put(f"pages/{device}/{version}", raw)
    parsed = raw.where(F.col("error").isNull()).select("doc_id", "page", "markdown", F.posexplode(F.from_json("blocks", f"array<{SIDECAR_BLOCK}>")).alias("n", "b"))
    blocks = parsed.select(
        "doc_id", "page", (F.col("n") + 1).alias("ord"), "b.type", F.col("b.content").alias("content"), F.col("b.markdown_table").alias("markdown_table"),
        F.format_string("p%d_txt%d", "page", F.col("n") + 1).alias("citation"),
    )
    return raw.select("doc_id", "page", F.coalesce("markdown", F.lit("")).alias("markdown")), store.put(f"blocks/{device}/{version}", blocks), digest


def _blueprint(spark: SparkSession, store: Tables, args: dict, now: datetime) -> int:
    """Ask a model for the messages and fields of a device that was onboarded; answers go to the cache, the blueprint to a file."""
    options = {k: args[a] for k, a in (("model", "model"), ("base_url", "base_url"), ("key", "key")) if args.get(a)}
    model = boundary.provider(args["provider"] or "stub", **options)
    chunks = spark.read.parquet(store.path(f"chunks/{args['device_id']}")).select(F.monotonically_increasing_id().alias("doc"), F.col("chunk").alias("text"))
    chunks = store.put(f"prompts/{args['device_id']}/chunks", chunks)  # numbered once
    found, answers = flows.blueprint(spark, chunks, store.table("cache", CACHE), model, args["device_name"], on_step=lambda step: print(f"[{step}]"))
    rows = [r.asDict(recursive=True) for r in found.orderBy("message_type").collect()]  # a row a message of one device
    store.append("cache", answers.select("prompt_hash", F.lit(model.model).alias("model"), "prompt_text", F.col("response").alias("original_response"), F.lit(None).cast("string").alias("corrected_response"), F.lit(False).alias("is_verified"), F.lit(args["device_id"]).alias("device_id"), "message_type", F.lit(now).alias("created_at")))
    summary = flows.blueprint_summary(found).first().asDict()
    text = json.dumps({"device_id": args["device_id"], "device_name": args["device_name"], "messages": rows, "summary": summary}, indent=2)
    if args["output"]:
        Path(args["output"]).write_text(text)
    print(text if not args["output"] else f"{args['output']}: {summary}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagelode", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("onboard", "update"):
        c = commands.add_parser(name)
        for option in ("config", "store", "vendor", "model", "version", "file", "output-dir"):
            c.add_argument(f"--{option}")
    commands.choices["update"].add_argument("--approve", help="why changes of HIGH or MEDIUM impact are accepted")
    blue = commands.add_parser("extract-blueprint")
    for option, needed in (("store", True), ("device-id", True), ("device-name", True), ("provider", False), ("model", False), ("base-url", False), ("key", False), ("output", False)):
        blue.add_argument(f"--{option}", required=needed)
    review = commands.add_parser("review-message")
    for option in ("store", "device-type", "message", "notes"):
        review.add_argument(f"--{option}", required=option != "notes")
    review.add_argument("--action", choices=("approve", "reject", "defer"), required=True)
    commands.add_parser("list").add_argument("--store", required=True)
    args = vars(parser.parse_args(argv))
    if args.get("config"):
        args = merged_options(json.loads(Path(args["config"]).read_text()), args)
    spark = SparkSession.builder.appName("pagelode").getOrCreate()
    store = Tables(spark, args["store"])
    now = datetime.now(timezone.utc)
    versions = store.table("versions", VERSIONS)
    if args["command"] == "list":
        for r in registry.latest_versions(versions).orderBy("device_id").toLocalIterator():
            print(r["device_id"], r["version"], r["file_hash"])
        return 0
    if args["command"] == "review-message":
        status = {"approve": "approved", "reject": "rejected", "defer": "pending"}[args["action"]]
        store.append("reviews", spark.createDataFrame([(args["device_type"], args["message"], status, args["notes"], now)], REVIEWS))
        return 0
    if args["command"] == "extract-blueprint":
        return _blueprint(spark, store, args, now)
    missing = [k for k in ("vendor", "model", "version", "file") if not args.get(k)]
    if missing:
        parser.error("missing: " + ", ".join(missing))
    device = f"{args['vendor']}_{args['model']}"
    known = versions.where(F.col("device_id") == device)
    row = (device, args["vendor"], args["model"], f"{args['vendor']} {args['model']}", args["version"])
    if args["command"] == "onboard":
        if known.limit(1).count():
            parser.error(f"{device} is registered; use update")
        pages, blocks, digest = _extract(store, args["file"], device, args["version"])
        found, report = flows.onboard(pages, blocks, args["version"], row[3], now.isoformat())
        store.put(f"chunks/{device}", found.chunks)
        store.append("reviews", messages.auto_accept(found.messages, store.table("reviews", REVIEWS), F.col("doc_id"), F.lit(now.isoformat())).select("device", "message_id", "review_status", "notes", F.lit(now).alias("reviewed_at")))
        text = report.first()
        print(text["report"] if text else f"# Baseline Report v{args['version']}\n**Device:** {row[3]}\n\nNo messages found.")
    else:
        last = registry.latest_versions(known).first()
        if last is None:
            parser.error(f"{device} is not registered; use onboard")
        pages, blocks, digest = _extract(store, args["file"], device, args["version"])
        old = spark.read.parquet(f"{store.folder}/blocks/{device}/{last['version']}")
        done = flows.update(old, blocks, last["file_hash"], digest, last["version"], args["version"], row[3], now.isoformat())
        print(done.report if isinstance(done.report, str) else done.report.first()["report"])
        if done.needs_approval and not args.get("approve"):
            print("\nHIGH or MEDIUM changes: nothing is registered; give the reason for accepting them with --approve.")
            return 1
        if done.needs_approval:
            print(f"\nApproved: {args['approve']}. The index is rebuilt with this version.")
        store.put(f"chunks/{device}", search.device_chunks(blocks, flows.inventory(pages, blocks).fields))
    store.append("versions", spark.createDataFrame([(*row, digest, args["command"] == "onboard", now)], VERSIONS))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
