"""Queries of the general corpus problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.operators.compaction import Compaction, compact
from joinlens.session import load


def _compacted(spark: SparkSession, d: str) -> Compaction:
    cluster = F.regexp_replace(F.lower("template_name"), "[^a-z0-9]", "")
    return compact(load(spark, d, "qrep_files"), "file_id", "payload", ["sql", "subset_graph"], ["name", "template_name"], cluster, keep=["file_path", "written_at"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The copies that the compaction left out, each beside the record kept."""
    return _compacted(spark, d).copies


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """What the consolidated files hold."""
    return _compacted(spark, d).records.select("file_id", "name", "template_name", "sql", "subset_graph")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """The account: files in, records, copies and rejected files, files out and their bytes."""
    report = _compacted(spark, d).report
    return spark.createDataFrame([tuple(report.values())], ", ".join(f"{k} long" for k in report))


QUERIES = {"p4_found": p4_found, "p4_records": p4_records, "p4_report": p4_report}

_CLASSES = r"""
WITH r AS (SELECT file_id, payload ->> '$.sql' AS s, payload ->> '$.subset_graph' AS g, payload FROM qrep_files
           WHERE json_valid(payload) AND regexp_matches(payload, '^[ \t\r\n]*\{')),
     c AS (SELECT *, min(file_id) OVER (PARTITION BY s, g) AS first_id FROM r)
"""

ORACLES = {
    "p4_report": _CLASSES + """, t AS (SELECT count(*) FILTER (file_id = first_id) AS records, count(*) FILTER (file_id <> first_id) AS copies,
     coalesce(sum(16 + sum_bytes) FILTER (file_id = first_id), 0)::BIGINT AS text_bytes
     FROM (SELECT *, coalesce(strlen(s), 0) + coalesce(strlen(g), 0) + coalesce(strlen(payload ->> '$.name'), 0)
           + coalesce(strlen(payload ->> '$.template_name'), 0) AS sum_bytes FROM c))
SELECT (SELECT count(*) FROM qrep_files) AS input, records, copies, (SELECT count(*) FROM qrep_files) - records - copies AS rejected,
       greatest(1, ceil(text_bytes / 536870912))::BIGINT AS files, text_bytes, 536870912 AS target_bytes FROM t""",
    "p4_found": _CLASSES + "SELECT first_id AS file_id, file_id AS copy_file_id FROM c WHERE file_id <> first_id",
    "p4_records": _CLASSES
    + "SELECT file_id, payload ->> '$.name' AS name, payload ->> '$.template_name' AS template_name, s AS sql, g AS subset_graph FROM c WHERE file_id = first_id",
}
