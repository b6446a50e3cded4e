"""Queries of problem 3 over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.operators.orphans import Entity, Reference, orphan_cascade, orphan_report
from quern.tables import table

REFERENCES = (
    Reference("document_chunks", "document_id", "documents", "id"),
    Reference("document_chunks", "chromadb_id", "chroma_entries", "chromadb_id", as_uuid=False),
    Reference("documents", "source_id", "watched_folders", "id"),
)


def _entities(spark: SparkSession, d: str) -> dict[str, Entity]:
    return {
        "document_chunks": Entity(table(spark, d, "document_chunks"), "id", "created_at"),
        "documents": Entity(table(spark, d, "documents"), "id", "indexed_at", "deleted_at"),
        "chroma_entries": Entity(table(spark, d, "chroma_entries"), "chromadb_id", "indexed_at", "deleted_at"),
        "watched_folders": Entity(table(spark, d, "watched_folders"), "id", "created_at", "deleted_at"),
    }


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The direct orphans of the cascade; the inherited ones drop out of the plan."""
    return orphan_cascade(_entities(spark, d), REFERENCES, keep=False).where("kind = 'direct'").select("ref_table", "ref_field", "row_id", "ref_month")


def p3_cascade(spark: SparkSession, d: str) -> DataFrame:
    return orphan_cascade(_entities(spark, d), REFERENCES)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p3_cascade(spark, d))


QUERIES = {"p3_found": p3_found, "p3_cascade": p3_cascade, "p3_report": p3_report}

_KEY = (
    "CASE WHEN regexp_full_match({c}, '\\{{[0-9a-fA-F]{{4}}(-?[0-9a-fA-F]{{4}}){{7}}\\}}|[0-9a-fA-F]{{4}}(-?[0-9a-fA-F]{{4}}){{7}}') "
    "THEN lower(replace(replace(replace({c}, '{{', ''), '}}', ''), '-', '')) ELSE '=' || {c} END"
)


def _direct(ref_table: str, field: str, time: str, target: str, key: str, ttime: str, uuid: bool) -> str:
    k = (lambda c: _KEY.format(c=c)) if uuid else (lambda c: c)
    return f"""
  SELECT '{ref_table}' AS ref_table, '{field}' AS ref_field, r.id AS row_id, strftime(min(r.{time}), '%Y-%m') AS ref_month
  FROM {ref_table} r LEFT JOIN (
    SELECT {k(key)} AS k, min({ttime}) AS there FROM {target} WHERE deleted_at IS NULL GROUP BY 1) t ON {k("r." + field)} = t.k
  WHERE r.{field} IS NOT NULL AND (t.there IS NULL OR t.there > r.{time})
  GROUP BY r.id"""


_FOUND = " UNION ALL ".join(
    (
        _direct("document_chunks", "document_id", "created_at", "documents", "id", "indexed_at", True),
        _direct("document_chunks", "chromadb_id", "created_at", "chroma_entries", "chromadb_id", "indexed_at", False),
        _direct("documents", "source_id", "indexed_at", "watched_folders", "id", "created_at", True),
    )
)

_CASCADE = f"""
WITH direct AS ({_FOUND}),
inherited AS (
  SELECT 'document_chunks' AS ref_table, 'document_id' AS ref_field, c.id AS row_id, strftime(min(c.created_at), '%Y-%m') AS ref_month
  FROM document_chunks c JOIN documents d ON {_KEY.format(c="c.document_id")} = {_KEY.format(c="d.id")}
  WHERE d.deleted_at IS NULL
    AND d.id IN (SELECT row_id FROM direct WHERE ref_table = 'documents')
    AND c.id NOT IN (SELECT row_id FROM direct WHERE ref_table = 'document_chunks' AND ref_field = 'document_id')
  GROUP BY c.id)
SELECT ref_table, ref_field, row_id, ref_month, 'direct' AS kind, CAST(0 AS INTEGER) AS depth FROM direct
UNION ALL
SELECT ref_table, ref_field, row_id, ref_month, 'inherited' AS kind, CAST(1 AS INTEGER) AS depth FROM inherited"""

SQL = {
    "p3_found": _FOUND,
    "p3_cascade": _CASCADE,
    "p3_report": f"""SELECT ref_table, ref_field, ref_month, count(*) FILTER (WHERE kind = 'direct') AS n_direct,
  count(*) FILTER (WHERE kind = 'inherited') AS n_inherited, count(*) AS n_orphans
FROM ({_CASCADE}) GROUP BY ref_table, ref_field, ref_month""",
}
