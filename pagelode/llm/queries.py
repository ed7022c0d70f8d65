"""The operators bound to the test tables: ``QUERIES`` and, where SQL can express one, ``ORACLE_SQL``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm import ann, linededup, lm, mixing, packing, quality, sharding, simhash, tokenfiles, warc


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_warc(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM q
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = linededup.dedup_lines(spark, docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, pos, line, translate(trim(line, E' \t\n\x0B\x0C\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) AS pos FROM d)
),
common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
marked AS (
  SELECT l.doc_id, l.pos, l.line, c.key IS NOT NULL AND l.doc_id <> c.keeper AS dropped FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_sizes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfiles.write_token_files(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return tokenfiles.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.kd_shards(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=40)
    return dealt.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.compression_bands(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_columns=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_chunks_outside")


QUERIES = {f.__name__: f for f in (op1_warc, op2_simhash, op3_line_dedup, op4_packing, op5_multi_index_hashing, op6_mixing, op7_kneser_ney, op8_token_files, op9_kd_tree, op10_compression_bands)}
ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op3_line_dedup": OP3_SQL}
