"""Queries of problem 6 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.operators import references as op
from lamina.sources import table


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = op.law_references(table(spark, d, "relationships"), table(spark, d, "doc_relations"))
    return refs, op.law_parents(table(spark, d, "law_metadata"), table(spark, d, "entities"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return op.orphans(*_inputs(spark, d)).select("table_name", "ref_field", "row_id").distinct()


def p6_status(spark: SparkSession, d: str) -> DataFrame:
    return op.orphans(*_inputs(spark, d)).select("table_name", "ref_field", "row_id", "status")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return op.orphan_report(*_inputs(spark, d))


QUERIES = {"p6_found": p6_found, "p6_status": p6_status, "p6_report": p6_report}

_REFS = """
refs AS (
  SELECT 'relationships' AS table_name, 'source' AS ref_field, rel_id AS row_id, 'law_number' AS kind, source AS key, loaded_at AS seen_at FROM relationships
  UNION ALL
  SELECT 'relationships', 'target', rel_id,
    CASE WHEN relationship_type IN ('THAM_CHIEU','SUA_DOI_BO_SUNG','THAY_THE_BOI') THEN 'law_number'
         WHEN relationship_type = 'BAN_HANH_BOI' THEN 'CoQuan' WHEN relationship_type = 'KY_BOI' THEN 'NguoiKy'
         WHEN relationship_type = 'AP_DUNG_CHO' THEN 'DoiTuongApDung' WHEN relationship_type = 'THUOC_LINH_VUC' THEN 'LinhVuc' END,
    target, loaded_at FROM relationships
  UNION ALL
  SELECT 'doc_relations', 'other_doc_id', link_id, 'law_id', other_doc_id, loaded_at FROM doc_relations
),
parents AS (
  SELECT 'law_id' AS kind, id AS key, loaded_at, deleted_at, TRUE AS timed FROM law_metadata
  UNION ALL SELECT 'law_number', so_ky_hieu, loaded_at, deleted_at, TRUE FROM law_metadata
  UNION ALL SELECT entity_type, canonical_name, NULL, NULL, FALSE FROM entities
),
known AS (
  SELECT kind, key, min(CASE WHEN timed AND deleted_at IS NULL THEN loaded_at END) AS live_from,
    bool_or(NOT timed) AS always, bool_or(deleted_at IS NULL) AS ever_live
  FROM parents WHERE key IS NOT NULL GROUP BY kind, key
),
resolved AS (
  SELECT r.table_name, r.ref_field, r.row_id, r.seen_at,
    CASE WHEN k.ever_live IS NULL THEN 'missing' WHEN NOT k.ever_live THEN 'deleted'
         WHEN k.always OR coalesce(k.live_from <= r.seen_at, FALSE) THEN 'found' ELSE 'late' END AS status
  FROM refs r LEFT JOIN known k ON r.kind = k.kind AND r.key = k.key
  WHERE r.kind IS NOT NULL AND r.key IS NOT NULL AND r.key <> ''
)
"""
SQL = {
    "p6_found": f"WITH {_REFS} SELECT DISTINCT table_name, ref_field, row_id FROM resolved WHERE status <> 'found'",
    "p6_status": f"WITH {_REFS} SELECT DISTINCT table_name, ref_field, row_id, status FROM resolved WHERE status <> 'found'",
    "p6_report": f"WITH {_REFS} SELECT table_name, ref_field, strftime(seen_at, '%Y-%m') AS month, status, count(*) AS n FROM (SELECT DISTINCT * FROM resolved) GROUP BY ALL",
}
