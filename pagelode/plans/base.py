"""Test frames: the star schema's tables read as pages, blocks, tables and versions of specifications.

Each is one SQL text that both Spark and the oracle run, so a query and its oracle
start from the same rows.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MESSAGE = "CASE o_orderkey % 8 WHEN 0 THEN 'OBS.R01' WHEN 1 THEN 'QCN.R01' WHEN 2 THEN 'ZXA.R02' WHEN 3 THEN 'XYZ.R99' WHEN 4 THEN 'OBS^OBS_R01' WHEN 5 THEN 'ABC_R07' WHEN 6 THEN 'Mes.custom.v2' ELSE 'MSH-' || CAST(o_orderkey % 20 AS STRING) END"
_PHRASE = "CASE o_orderkey % 5 WHEN 0 THEN 'sent from device to host' WHEN 1 THEN 'sent by the host to device' WHEN 2 THEN 'goes in both directions' WHEN 3 THEN 'is a request' ELSE 'ends the exchange' END"
_DOC = "'spec_' || CAST(o_custkey % 20 AS STRING)"
_PAGE = "CAST(o_orderkey % 40 + 1 AS INT)"

FRAMES = {
    "blocks": f"SELECT {_DOC} AS doc_id, {_PAGE} AS page, o_orderkey AS ord, 'text' AS type, o_orderstatus || ' message ' || {_MESSAGE} || ' ' || {_PHRASE} AS content, CAST(NULL AS STRING) AS markdown_table, 'p' || CAST({_PAGE} AS STRING) || '_txt' || CAST(o_orderkey AS STRING) AS citation FROM {{orders}}",
    "boxes": "SELECT 'doc_' || CAST(l_orderkey % 50 AS STRING) AS doc_id, CAST(floor(l_orderkey / 400) AS INT) AS page, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS ord, CASE WHEN l_linenumber = 7 THEN 'picture' WHEN l_linenumber = 6 THEN 'table' ELSE 'text' END AS type, l_returnflag || l_linestatus AS content, CAST(l_quantity AS DOUBLE) * 10 AS x0, CAST(l_partkey % 800 AS DOUBLE) AS y0, CAST(l_quantity AS DOUBLE) * 10 + 40 + CAST(l_suppkey % 60 AS DOUBLE) AS x1, CAST(l_partkey % 800 AS DOUBLE) + 10 + CAST(l_linenumber AS DOUBLE) AS y1, l_orderkey, l_linenumber FROM {lineitem}",
    "spec_pages": "SELECT 'part_' || p_brand AS doc_id, CAST(p_partkey AS INT) AS page, '# ' || p_type || chr(10) || 'Message OBS.R' || CASE WHEN p_size < 10 THEN '0' ELSE '' END || CAST(p_size AS STRING) || ' about ' || p_name || chr(10) || '## ' || p_name || chr(10) || 'Analytes: ' || p_brand || ', none, glucose' || chr(10) || '### Size ' || CAST(p_size AS STRING) AS markdown FROM {part}",
    "spec_tables": "SELECT 'part_' || p_brand AS doc_id, CAST(p_partkey AS INT) AS page, CAST(1 AS INT) AS ord, 'table' AS type, CAST(NULL AS STRING) AS content, '| Field | Description | Example | Use |' || chr(10) || '|---|---|---|---|' || chr(10) || '| ' || p_name || '_cd | Code. Possible values are ON, OFF or N' || CAST(p_size AS STRING) || ' | ' || p_brand || ' | R |' || chr(10) || '| HDR.time_' || CAST(p_size AS STRING) || ' | When it was made | 20240101120000 | O |' || chr(10) || '| size' || CAST(p_partkey AS STRING) || ' | Measured | ' || CAST(p_size AS STRING) || CASE WHEN p_size % 2 = 0 THEN '.5' ELSE '' END || ' | O |' || chr(10) || '| short |' AS markdown_table, 'p' || CAST(p_partkey AS STRING) || '_tbl1' AS citation FROM {part}",
    "version1": "SELECT CAST(p_partkey % 40 + 1 AS INT) AS page, p_partkey AS ord, CASE WHEN p_size % 3 = 0 THEN 'table' ELSE 'text' END AS type, CASE p_size % 6 WHEN 0 THEN 'OBS.R' || CASE WHEN p_partkey % 90 < 10 THEN '0' ELSE '' END || CAST(p_partkey % 90 AS STRING) || ' ' WHEN 3 THEN 'MSH-' || CAST(p_size AS STRING) || ' ' || CASE WHEN p_partkey % 2 = 0 THEN 'R ' ELSE 'O ' END WHEN 4 THEN 'ZPX ' ELSE '' END || p_name AS content, CAST(NULL AS STRING) AS markdown_table FROM {part} WHERE p_partkey % 7 <> 0",
    "version2": "SELECT CAST(p_partkey % 40 + 1 AS INT) AS page, p_partkey AS ord, CASE WHEN p_size % 3 = 0 THEN 'table' ELSE 'text' END AS type, CASE p_size % 6 WHEN 0 THEN 'OBS.R' || CASE WHEN p_partkey % 90 < 10 THEN '0' ELSE '' END || CAST(p_partkey % 90 AS STRING) || ' ' WHEN 3 THEN 'MSH-' || CAST(p_size AS STRING) || ' ' || CASE WHEN p_partkey % 2 = 0 THEN 'R ' ELSE 'O ' END WHEN 4 THEN 'ZPX ' ELSE '' END || p_name || CASE WHEN p_partkey % 11 = 0 THEN ' revised' ELSE '' END AS content, CAST(NULL AS STRING) AS markdown_table FROM {part} WHERE p_partkey % 5 <> 0",
    "cited": "SELECT 'doc_' || CAST(user_id % 20 AS STRING) AS doc_id, event_id, event_type, CAST(event_id % 100 AS DOUBLE) / 100.0 AS confidence, CASE WHEN event_type = 'view' THEN CAST(NULL AS STRING) ELSE 'text' END AS source, CASE WHEN event_id % 50 = 0 THEN CAST(NULL AS STRING) ELSE 'c' || CAST(event_id AS STRING) END AS citation, CAST(event_id % 30 + 1 AS INT) AS page FROM {events}",
    "versions": "SELECT 'dev_' || CAST(o_custkey AS STRING) AS device_id, 'v' || CAST(o_orderkey AS STRING) AS version, 'Device ' || CAST(o_custkey AS STRING) AS device_name, o_totalprice AS price, o_orderdate AS registered_at FROM {orders}",
    "feedback": "SELECT CAST(l.doc_id AS STRING) AS feedback_id, CASE WHEN l.quality = 1 THEN 'confirmation' WHEN l.toxic = 1 THEN 'rejection' ELSE 'correction' END AS feedback_type, d.text AS original_content, CASE WHEN l.doc_id % 3 = 0 THEN '' ELSE d.source || ':' || d.lang END AS corrected_content, CAST(l.doc_id % 100 AS DOUBLE) / 100.0 AS original_confidence, l.doc_id % 4 <> 0 AS include_in_training FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id",
    "prompts": "SELECT a.conv_id, a.turn, a.text AS prompt_text, b.text AS response FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FRAMES[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def frame_sql(*names: str) -> str:
    """The frames as common table expressions for the oracle."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', FRAMES[n])})" for n in names)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see: under ``spark.checkpoint.dir``, or on a local master without it in a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = tempfile.mkdtemp(prefix="pagelode-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
