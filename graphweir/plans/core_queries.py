"""Core queries over this project's tables, and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphweir.operators import packed, references
from graphweir.sources.tables import load

PACKED_FIELDS = {"keywords": "terms", "source_id": "ids", "description": "prose"}


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    chunk = references.chunk_references(load(spark, d, "edge_data"), load(spark, d, "chunk_info"))
    schema = references.schema_references(load(spark, d, "schema_columns"), load(spark, d, "schema_tables"))
    return references.orphans(*chunk, *schema)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "record_id", "ref_key").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.unpack(load(spark, d, "edge_data").select("edge_id", *PACKED_FIELDS).distinct(), ["edge_id"], PACKED_FIELDS, least=2)


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    return packed.unpack(load(spark, d, "edge_data"), ["edge_id", "created_at"], PACKED_FIELDS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p5_found, p5_report, p6_found, p6_values)}

_REFERENCES = r"""
WITH refs AS (
  SELECT DISTINCT edge_id, created_at, unnest(regexp_extract_all(lower(source_id), '[^\s,;|"''`\[\]<>&]+')) AS k FROM edge_data WHERE source_id IS NOT NULL),
ids AS (SELECT edge_id, created_at, k FROM refs WHERE k NOT IN ('', 'unknown', 'schema_extraction', 'sep', 'lt', 'gt')),
ch AS (SELECT lower(trim(chunk_id)) AS k, ingested_at, deleted_at FROM chunk_info),
cols AS (
  SELECT DISTINCT column_id, extracted_at, db_id,
    nullif(trim(regexp_extract(regexp_replace(lower(trim(references_table)), '["''`\[\]]', '', 'g'), '([^.]*)$', 1)), '') AS rt,
    nullif(trim(regexp_extract(regexp_replace(lower(trim(references_column)), '["''`\[\]]', '', 'g'), '([^.]*)$', 1)), '') AS rc
  FROM schema_columns)
"""
_NO_TABLE = "NOT EXISTS (SELECT 1 FROM schema_tables t WHERE t.db_id = c.db_id AND lower(trim(t.table_name)) = c.rt AND t.first_seen_at <= c.extracted_at AND (t.dropped_at IS NULL OR t.dropped_at > c.extracted_at))"
_NO_COLUMN = "(rc IS NOT NULL AND NOT EXISTS (SELECT 1 FROM schema_columns s WHERE s.db_id = c.db_id AND lower(trim(s.table_name)) = c.rt AND lower(trim(s.name)) = c.rc))"
_NO_CHUNK = "NOT EXISTS (SELECT 1 FROM ch WHERE ch.k = i.k AND ch.ingested_at <= i.created_at AND (ch.deleted_at IS NULL OR ch.deleted_at > i.created_at))"

ORACLES: dict[str, str] = {
    "p5_found": f"""{_REFERENCES}SELECT DISTINCT 'edge_data' AS src_table, edge_id AS record_id, k AS ref_key FROM ids i WHERE {_NO_CHUNK}
UNION SELECT DISTINCT 'schema_columns', column_id, rt FROM cols c WHERE rt IS NOT NULL AND db_id IS NOT NULL AND ({_NO_TABLE} OR {_NO_COLUMN})""",
    "p5_report": f"""{_REFERENCES}, o AS (
  SELECT DISTINCT 'edge_data' AS src_table, 'chunk_info' AS parent_table, date_trunc('month', created_at) AS period, edge_id AS record_id, k AS ref_key FROM ids i WHERE {_NO_CHUNK}
  UNION SELECT 'schema_columns', 'schema_tables', date_trunc('month', extracted_at), column_id, rt FROM cols c WHERE rt IS NOT NULL AND db_id IS NOT NULL AND {_NO_TABLE}
  UNION SELECT 'schema_columns', 'schema_columns', date_trunc('month', extracted_at), column_id, rt FROM cols c WHERE rt IS NOT NULL AND db_id IS NOT NULL AND {_NO_COLUMN})
SELECT src_table, parent_table, period, count(*) AS orphan_references, count(DISTINCT record_id) AS orphan_records FROM o GROUP BY ALL""",
}
