"""Retrieval, context, schema-graph and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweir.operators import graph as gr
from graphweir.operators import retrieval as rt
from graphweir.operators import schema_graph as sg
from graphweir.plans.graph_queries import edges, nodes
from graphweir.providers import keywords
from graphweir.session import checkpoint_dir
from graphweir.sources.tables import load
from graphweir.streaming import ingest

BUDGET = 2000


def retrieve_token_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each document, in order, that fit a token budget."""
    c = load(spark, d, "chunk_info").where("full_doc_id is not null").groupBy("full_doc_id", "chunk_order_index", "chunk_id").agg(F.max(F.length("content")).alias("tokens"))
    return rt.token_prefix(c, ["full_doc_id"], [F.col("chunk_order_index"), F.col("chunk_id")], "tokens", BUDGET)


def retrieve_passages(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of each query with their sources."""
    q = load(spark, d, "query_solution").select("query_id", F.explode(F.arrays_zip("docs", "doc_scores")).alias("x")).select("query_id", F.col("x.docs").alias("doc"), F.col("x.doc_scores").alias("score"))
    one = q.where("doc is not null and score is not null and not isnan(score)").groupBy("query_id", "doc").agg(F.max("score").alias("score"))
    docs = load(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc"), "source")
    return rt.best(one, ["query_id"], "score", "doc", 10).join(docs, "doc", "left")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """The five strongest nodes of each cluster stand for the seed entities of a query."""
    c = load(spark, d, "cluster_node_data").where("name is not null and flow_value is not null and not isnan(flow_value)").groupBy(F.col("cluster_id").alias("query_id"), "name").agg(F.max("flow_value").alias("score"))
    return rt.best(c, ["query_id"], "score", "name", 5).select("query_id", (F.col("rank") - 1).alias("position"), "name")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "entity_nodes").where("source_id is not null").select(F.col("entity_name").alias("name"), F.col("source_id").alias("chunk")).distinct()


def retrieve_text_units(spark: SparkSession, d: str) -> DataFrame:
    return rt.text_units(_entities(spark, d), _sources(spark, d), edges(spark, d))


def _context(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "entity_nodes").groupBy(F.col("entity_name").alias("name")).agg(F.max("entity_type").alias("entity_type"), F.max("description").alias("description"))
    return rt.entity_context(_entities(spark, d), n, gr.degrees(edges(spark, d)))


def retrieve_entity_context(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d)


def retrieve_csv_context(spark: SparkSession, d: str) -> DataFrame:
    return rt.csv_context(_context(spark, d), "query_id", "id", ["id", "entity", "entity_type", "rank"])


def retrieve_combined(spark: SparkSession, d: str) -> DataFrame:
    """Strongest nodes before well-connected ones, repeats dropped, numbered anew."""
    c = _context(spark, d)
    high = c.where("id < 3").select("query_id", "id", "entity")
    low = c.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rank").desc(), "entity")).alias("id"), "entity")
    return rt.combine_contexts(high, low, "query_id", ["entity"])


def retrieve_cluster_summaries(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "cluster_node_data").where("name is not null and flow_value is not null and not isnan(flow_value)")
    x = c.groupBy(F.col("cluster_id").alias("query_id"), F.col("source_node").alias("source"), F.col("name").alias("node")).agg(F.max("flow_value").alias("x"))
    return rt.cluster_summary(x)


def retrieve_keywords(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "query_solution").where("question is not null").select("query_id", "question").distinct()
    return q.select("query_id", F.array_join(keywords(F.col("question")), " ").alias("keywords"))


def schema_nodes(spark: SparkSession, d: str) -> DataFrame:
    return sg.nodes(load(spark, d, "schema_tables"), load(spark, d, "schema_columns")).select("db_id", "name", "entity_type")


def schema_edges(spark: SparkSession, d: str) -> DataFrame:
    return sg.edges(load(spark, d, "schema_columns"))


def schema_inferred(spark: SparkSession, d: str) -> DataFrame:
    return sg.inferred_edges(load(spark, d, "schema_columns"))


def schema_guessed_keys(spark: SparkSession, d: str) -> DataFrame:
    return sg.guessed_keys(load(spark, d, "schema_columns"))


def schema_simple(spark: SparkSession, d: str) -> DataFrame:
    return sg.render_simple(load(spark, d, "schema_columns"))


def schema_ddl(spark: SparkSession, d: str) -> DataFrame:
    return sg.render_tables(load(spark, d, "schema_columns"))


def schema_parts(spark: SparkSession, d: str) -> DataFrame:
    return sg.pack_by_tokens(load(spark, d, "schema_columns"), 60)


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.windowed(ingest.table_stream(spark, d, "events"), "1 day")
    return ingest.run_to_table(s).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.windowed(ingest.table_stream(spark, d, "events"), "12 hours", "6 hours")
    return ingest.run_to_table(s).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ingest.run_to_table(ingest.sessions(ingest.table_stream(spark, d, "events"), "2 hours"))


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that an ingest of the documents as a stream has stored."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    ingest.ingest_stream(ingest.table_stream(spark, d, "documents"), folder).awaitTermination()
    return spark.read.parquet(f"{folder}/chunks").select("chunk_id", F.length("content").alias("length"))


QUERIES = {f.__name__: f for f in (retrieve_token_prefix, retrieve_passages, retrieve_text_units, retrieve_entity_context, retrieve_csv_context, retrieve_combined, retrieve_cluster_summaries, retrieve_keywords, schema_nodes, schema_edges, schema_inferred, schema_guessed_keys, schema_simple, schema_ddl, schema_parts, stream_tumbling, stream_sliding, stream_sessions, stream_ingest)}

_ENTITIES = """c AS (SELECT cluster_id AS query_id, name, max(flow_value) AS score FROM cluster_node_data WHERE name IS NOT NULL AND flow_value IS NOT NULL AND NOT isnan(flow_value) GROUP BY ALL),
ent AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) - 1 AS position, name FROM c QUALIFY position < 5),
e AS (SELECT DISTINCT src_id AS src, tgt_id AS tgt FROM edge_data WHERE src_id IS NOT NULL AND tgt_id IS NOT NULL),
deg AS (SELECT name, count(*) AS degree FROM (SELECT src AS name FROM e UNION ALL SELECT tgt FROM e) GROUP BY name),
nodes AS (SELECT entity_name AS name, max(entity_type) AS entity_type, max(description) AS description FROM entity_nodes GROUP BY 1),
ctx AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY position) - 1)::INT AS id, ent.name AS entity, coalesce(entity_type, 'UNKNOWN') AS entity_type, coalesce(description, 'UNKNOWN') AS description, coalesce(degree, 0) AS rank
  FROM ent LEFT JOIN nodes ON ent.name = nodes.name LEFT JOIN deg ON ent.name = deg.name)"""
_BARE = r"""nullif(trim(regexp_extract(regexp_replace(lower(trim({0})), '["''`\[\]]', '', 'g'), '([^.]*)$', 1)), '')"""
_COLUMNS = f"""cols AS (
  SELECT db_id, t AS table_name, c AS column_name, coalesce(type, 'TEXT') AS data_type, coalesce(is_primary_key, false) AS pk, coalesce(is_foreign_key, false) AS fk, rt, rc FROM (
    SELECT *, {_BARE.format('table_name')} AS t, {_BARE.format('name')} AS c, {_BARE.format('references_table')} AS rt, {_BARE.format('references_column')} AS rc FROM schema_columns)
  WHERE db_id IS NOT NULL AND t IS NOT NULL AND c IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY db_id, t, c ORDER BY extracted_at DESC, column_id DESC, coalesce(type, 'TEXT') DESC) = 1)"""
_CELL = """(CASE WHEN regexp_matches({0}, '[",\\r\\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END)"""

ORACLES = {
    "retrieve_token_prefix": f"""
WITH c AS (SELECT full_doc_id, chunk_order_index, chunk_id, max(length(content))::INT AS tokens FROM chunk_info WHERE full_doc_id IS NOT NULL GROUP BY ALL)
SELECT *, sum(tokens) OVER (PARTITION BY full_doc_id ORDER BY chunk_order_index, chunk_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM c QUALIFY used <= {BUDGET}""",
    "retrieve_passages": """
WITH a AS (SELECT query_id, unnest(docs[1:least(len(docs), len(doc_scores))]) AS doc, unnest(doc_scores[1:least(len(docs), len(doc_scores))]) AS score FROM query_solution),
b AS (SELECT query_id, doc, max(score) AS score FROM a WHERE doc IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc)::INT AS rank FROM b QUALIFY rank <= 10)
SELECT r.query_id, r.doc, r.score, r.rank, d.source FROM r LEFT JOIN documents d ON r.doc = 'doc-' || d.doc_id""",
    "retrieve_text_units": f"""
WITH {_ENTITIES}, s AS (SELECT DISTINCT entity_name AS name, source_id AS chunk FROM entity_nodes WHERE source_id IS NOT NULL),
own AS (SELECT query_id, position, ent.name, chunk FROM ent JOIN s ON ent.name = s.name),
sh AS (SELECT query_id, own.chunk, count(*) AS relations FROM own JOIN e ON e.src = own.name JOIN s ON s.name = e.tgt AND s.chunk = own.chunk GROUP BY ALL),
f AS (SELECT query_id, chunk, min(position)::INT AS "order" FROM own GROUP BY ALL)
SELECT f.query_id, f.chunk, f."order", coalesce(relations, 0) AS relations, row_number() OVER (PARTITION BY f.query_id ORDER BY f."order", coalesce(relations, 0) DESC, f.chunk)::INT AS rank FROM f LEFT JOIN sh ON f.query_id = sh.query_id AND f.chunk = sh.chunk""",
    "retrieve_entity_context": f"WITH {_ENTITIES} SELECT * FROM ctx",
    "retrieve_csv_context": f"""
WITH {_ENTITIES} SELECT query_id, 'id,entity,entity_type,rank' || chr(10) || string_agg(concat_ws(',', id, {_CELL.format('entity')}, {_CELL.format('entity_type')}, rank), chr(10) ORDER BY id) AS context FROM ctx GROUP BY query_id""",
    "retrieve_combined": f"""
WITH {_ENTITIES}, b AS (
  SELECT query_id, 0 AS level, id, entity FROM ctx WHERE id < 3
  UNION ALL SELECT query_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, entity), entity FROM ctx),
f AS (SELECT query_id, entity, min(level * 1000000 + id) AS place FROM b GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place, entity)::INT AS id, entity FROM f""",
    "retrieve_cluster_summaries": """
WITH x AS (SELECT cluster_id AS query_id, source_node AS source, name AS node, max(flow_value) AS x FROM cluster_node_data WHERE name IS NOT NULL AND flow_value IS NOT NULL AND NOT isnan(flow_value) GROUP BY ALL),
t AS (SELECT query_id, source, string_agg(node, ', ' ORDER BY r) AS names FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY x DESC, node) AS r FROM x) WHERE r <= 3 GROUP BY ALL)
SELECT query_id, source, 'Around ' || source || ' ' || count(*) || ' nodes, led by ' || any_value(names) || ', with flow from ' || format('{:.3f}', round(min(x), 3)) || ' to ' || format('{:.3f}', round(max(x), 3)) || '.' AS summary
FROM x JOIN t USING (query_id, source) GROUP BY query_id, source""",
    "schema_nodes": f"""
WITH {_COLUMNS} SELECT DISTINCT db_id, '"' || table_name || '"' AS name, 'complete_table' AS entity_type FROM cols UNION ALL SELECT db_id, '"' || table_name || '.' || column_name || '"', 'column' FROM cols""",
    "schema_edges": f"""
WITH {_COLUMNS}, x AS (
  SELECT db_id, '"' || table_name || '"' AS src, '"' || table_name || '.' || column_name || '"' AS tgt, 'contains' AS kind, 10.0::DOUBLE AS weight FROM cols
  UNION ALL SELECT db_id, '"' || table_name || '.' || column_name || '"', '"' || rt || coalesce('.' || rc, '') || '"', 'references', 15.0 FROM cols WHERE rt IS NOT NULL AND (db_id, rt) IN (SELECT db_id, table_name FROM cols))
SELECT *, 'rel-' || md5(src || '->' || tgt) AS rel_id FROM x""",
    "schema_inferred": f"""
WITH {_COLUMNS}, t AS (SELECT DISTINCT db_id, table_name FROM cols),
w AS (SELECT db_id, table_name, unnest(string_split(table_name, '_')) AS word, generate_subscripts(string_split(table_name, '_'), 1) AS at FROM t)
SELECT a.db_id, a.table_name AS a, b.table_name AS b, max(CASE WHEN a.at = 1 AND b.at = 1 THEN 6.0 ELSE 5.0 END)::DOUBLE AS weight
FROM w a JOIN w b ON a.db_id = b.db_id AND a.word = b.word AND a.table_name < b.table_name WHERE length(a.word) >= 4 GROUP BY ALL""",
    "schema_guessed_keys": f"""
WITH {_COLUMNS}, t AS (SELECT DISTINCT db_id, table_name AS target FROM cols),
o AS (SELECT db_id, table_name, column_name, regexp_extract(column_name, '^(.+)_id$', 1) AS stem, column_name = table_name || '_id' AS pk FROM cols),
h AS (SELECT o.db_id, o.table_name, o.column_name, min(target) AS references_table FROM o JOIN t ON o.db_id = t.db_id AND contains(target, stem) WHERE o.stem <> '' AND NOT pk AND target <> o.table_name GROUP BY ALL)
SELECT o.db_id, o.table_name, o.column_name, pk AS is_primary_key, references_table FROM o LEFT JOIN h USING (db_id, table_name, column_name) WHERE pk OR references_table IS NOT NULL""",
    "schema_simple": f"WITH {_COLUMNS} SELECT db_id, table_name, table_name || ': ' || string_agg(column_name, ', ' ORDER BY column_name) AS text FROM cols GROUP BY db_id, table_name",
    "schema_ddl": f"""
WITH {_COLUMNS} SELECT db_id, table_name, 'CREATE TABLE ' || table_name || ' (' || chr(10) || string_agg('  ' || column_name || ' ' || data_type || CASE WHEN pk THEN ' PRIMARY KEY' ELSE '' END || CASE WHEN fk AND rt IS NOT NULL THEN ' REFERENCES ' || rt || coalesce('(' || rc || ')', '') ELSE '' END, ',' || chr(10) ORDER BY pk DESC, column_name) || chr(10) || ');' AS ddl FROM cols GROUP BY db_id, table_name""",
    "stream_tumbling": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding": """
SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 6 HOURS * k AS window_start, event_type, value FROM events, range(2) r(k)) GROUP BY ALL""",
    "stream_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOURS AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
}
