"""Text, extraction and keyed-table queries over this project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweir.functions import identity
from graphweir.functions import text as tx
from graphweir.operators import kv
from graphweir.operators import text as ops
from graphweir.sources.tables import load

#: Rows taken in before this time make the stored table, the others the batch.
STORED_BEFORE = "2024-03-01 00:00:00"


def text_word_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ops.word_chunks(load(spark, d, "documents"), "doc_id", "text")


def text_token_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ops.token_chunks(load(spark, d, "documents"), "doc_id", "text")


def text_phrases(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").where("title is not null")
    return docs.select("doc_id", tx.phrase(F.col("title")).alias("phrase"), tx.slug(F.col("source")).alias("slug"), tx.is_float(F.col("title")).alias("is_number"))


def text_marker_split(spark: SparkSession, d: str) -> DataFrame:
    parts = tx.split_markers(F.col("keywords"), ["<SEP>", ";", ","])
    return load(spark, d, "edge_data").where("keywords is not null").select("edge_id", F.array_join(parts, "|").alias("parts"), F.size(parts).alias("n")).distinct()


def text_cleaned(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.select("doc_id", tx.clean(F.col("text")).alias("text"), identity.doc_id(F.col("text")).alias("hash_id"))


def text_records(spark: SparkSession, d: str) -> DataFrame:
    """Entities and relations rendered in the record notation; the entities parsed back."""
    e = load(spark, d, "entity_nodes").where("source_id is not null").select(F.col("source_id").alias("source"), F.col("entity_name").alias("name"), F.col("entity_type").alias("type"), "description").distinct()
    r = load(spark, d, "edge_data").where("src_id is not null and tgt_id is not null").select(F.concat_ws("-", "src_id", "tgt_id").alias("source"), F.col("src_id").alias("src"), F.col("tgt_id").alias("tgt"), F.lit("about").alias("description"), F.lit("key").alias("keywords"), F.lit(1.0).alias("weight")).distinct()
    return ops.parse_entities(ops.render_records(e, r)).select("source", "name", "type").distinct()


def text_merged_nodes(spark: SparkSession, d: str) -> DataFrame:
    return ops.merge_nodes(load(spark, d, "entity_nodes").distinct(), "entity_name", "entity_type", "description", "source_id")


def _merged_edges(spark: SparkSession, d: str) -> DataFrame:
    return ops.merge_edges(load(spark, d, "edge_data").distinct(), "src_id", "tgt_id", "weight", "description", "keywords", "source_id")


def text_merged_edges(spark: SparkSession, d: str) -> DataFrame:
    return _merged_edges(spark, d).withColumn("weight", F.round("weight", 6))


def text_stub_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = load(spark, d, "entity_nodes").select(F.col("entity_name").alias("name"))
    clusters = load(spark, d, "cluster_node_data").select(F.col("source_node").alias("src_id"), F.col("name").alias("tgt_id"))
    return ops.stub_nodes(clusters.where("src_id is not null and tgt_id is not null"), nodes)


def text_vector_ids(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "edge_data").select("edge_id", "src_id", "tgt_id", "keywords", "description").distinct()
    text = ops.relation_text(F.col("keywords"), F.col("src_id"), F.col("tgt_id"), F.col("description"))
    return e.select("edge_id", identity.relation_id(F.col("src_id"), F.col("tgt_id")).alias("rel_id"), identity.entity_id(F.col("src_id")).alias("src_ent"), F.md5(text).alias("text_hash"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return ops.facts(load(spark, d, "edge_data"), "source_id", "src_id", "keywords", "tgt_id")


def text_facts(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d)


def text_fact_entities(spark: SparkSession, d: str) -> DataFrame:
    return ops.triple_entities(_facts(spark, d))


def text_answer_parts(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "query_solution").select("query_id", "answer").where("answer is not null").distinct()
    return a.select("query_id", tx.after_last(F.col("answer"), "Answer:").alias("final"), tx.first_words(F.col("answer"), 14).alias("short"), tx.json_body(F.col("answer")).alias("body"), tx.to_bool(F.col("answer")).alias("truth"))


def kv_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Documents named by answers, in the order they are asked for; misses stay."""
    asked = load(spark, d, "query_solution").select("query_id", F.posexplode("docs").alias("pos", "doc")).distinct()
    docs = load(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc"), "source", "n_chars")
    return kv.get_many(docs, "doc", asked, "doc", ["query_id", "pos"], ["source", "n_chars"])


def _stored_and_batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = load(spark, d, "chunk_info").select("chunk_id", "content", "ingested_at")
    stored = chunks.where(F.col("ingested_at") < STORED_BEFORE).groupBy("chunk_id").agg(F.max_by("content", "ingested_at").alias("content"), F.max("ingested_at").alias("ingested_at"))
    return stored, chunks.where(F.col("ingested_at") >= STORED_BEFORE)


def kv_new_keys(spark: SparkSession, d: str) -> DataFrame:
    stored, batch = _stored_and_batch(spark, d)
    return kv.new_keys(batch, stored, "chunk_id").select("chunk_id").distinct()


def kv_upsert(spark: SparkSession, d: str) -> DataFrame:
    stored, batch = _stored_and_batch(spark, d)
    table, _ = kv.insert_absent(stored, batch, "chunk_id", F.col("ingested_at"))
    return table.select("chunk_id", F.md5("content").alias("content_hash"), "ingested_at")


def kv_insert_texts(spark: SparkSession, d: str) -> DataFrame:
    return kv.insert_texts(load(spark, d, "documents"), "text", "doc_id", "doc-").select("hash_id", F.length("content").alias("length"))


def kv_delete(spark: SparkSession, d: str) -> DataFrame:
    chunks = load(spark, d, "chunk_info")
    return kv.delete(chunks.select("chunk_id").distinct(), "chunk_id", chunks.where("deleted_at is not null"))


QUERIES = {f.__name__: f for f in (text_word_chunks, text_token_chunks, text_phrases, text_marker_split, text_cleaned, text_records, text_merged_nodes, text_merged_edges, text_stub_nodes, text_vector_ids, text_facts, text_fact_entities, text_answer_parts, kv_lookup, kv_new_keys, kv_upsert, kv_insert_texts, kv_delete)}

WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t\n\r\f]+'), lambda x: x <> '')"
STRIP = r"regexp_replace({0}, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"
PHRASE = r"trim(regexp_replace(lower({0}), '[^A-Za-z0-9 ]', ' ', 'g'))"
FACTS = f"""
SELECT DISTINCT source_id AS chunk, {PHRASE.format('src_id')} AS s, {PHRASE.format('keywords')} AS p, {PHRASE.format('tgt_id')} AS o FROM edge_data"""

ORACLES = {
    "text_word_chunks": f"""
WITH w AS (SELECT doc_id, text, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
many AS (SELECT doc_id, w, unnest(range(0, len(w), 450)) AS s FROM w WHERE len(w) > 500)
SELECT doc_id, 0 AS chunk_order_index, text AS content, 'chunk-' || md5(text) AS chunk_id FROM w WHERE len(w) BETWEEN 1 AND 500
UNION ALL
SELECT doc_id, (s // 450)::INT, array_to_string(w[s + 1:s + 500], ' '), 'chunk-' || md5(array_to_string(w[s + 1:s + 500], ' ')) FROM many""",
    "text_token_chunks": f"""
WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, w, unnest(range(0, len(w), 1100)) AS s FROM w),
part AS (SELECT doc_id, (s // 1100)::INT AS chunk_order_index, w[s + 1:s + 1200] AS p FROM cut)
SELECT doc_id, chunk_order_index, array_to_string(p, ' ') AS content, len(p)::INT AS tokens, 'chunk-' || md5(array_to_string(p, ' ')) AS chunk_id FROM part""",
    "text_phrases": f"""
SELECT doc_id, {PHRASE.format('title')} AS phrase,
  regexp_replace(regexp_replace(lower(regexp_extract(source, '([^/]*)/*$', 1)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
  regexp_full_match(title, '[-+]?[0-9]*\\.?[0-9]+') AS is_number
FROM documents WHERE title IS NOT NULL""",
    "text_marker_split": f"""
WITH p AS (SELECT DISTINCT edge_id, list_filter(list_transform(regexp_split_to_array(keywords, '<SEP>|;|,'), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS p FROM edge_data WHERE keywords IS NOT NULL)
SELECT DISTINCT edge_id, coalesce(array_to_string(p, '|'), '') AS parts, len(p)::INT AS n FROM p""",
    "text_cleaned": rf"""
SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace({STRIP.format('text')}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\x00-\x1f\x7f-\x{{9f}}]', '', 'g') AS text,
  'doc-' || md5({STRIP.format('text')}) AS hash_id FROM documents""",
    "text_records": """
SELECT DISTINCT source_id AS source, entity_name AS name, trim(coalesce(entity_type, '')) AS type FROM entity_nodes WHERE source_id IS NOT NULL AND entity_name <> ''""",
    "text_merged_nodes": """
WITH r AS (SELECT DISTINCT * FROM entity_nodes WHERE entity_name IS NOT NULL),
t AS (SELECT entity_name, coalesce(entity_type, 'UNKNOWN') AS type, count(*) AS n FROM r GROUP BY ALL),
best AS (SELECT entity_name, type FROM t QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY n DESC, type) = 1)
SELECT r.entity_name AS name, any_value(best.type) AS entity_type,
  coalesce(string_agg(DISTINCT description, '<SEP>' ORDER BY description), '') AS description,
  coalesce(string_agg(DISTINCT source_id, '<SEP>' ORDER BY source_id), '') AS source_id
FROM r JOIN best USING (entity_name) GROUP BY r.entity_name""",
    "text_merged_edges": """
SELECT src_id, tgt_id, round(sum(coalesce(weight, 1.0)), 6) AS weight,
  coalesce(string_agg(DISTINCT description, '<SEP>' ORDER BY description), '') AS description,
  coalesce(string_agg(DISTINCT keywords, '<SEP>' ORDER BY keywords), '') AS keywords,
  coalesce(string_agg(DISTINCT source_id, '<SEP>' ORDER BY source_id), '') AS source_id
FROM (SELECT DISTINCT * FROM edge_data) WHERE src_id IS NOT NULL AND tgt_id IS NOT NULL GROUP BY ALL""",
    "text_stub_nodes": """
SELECT DISTINCT name, 'UNKNOWN' AS entity_type FROM (
  SELECT source_node AS name FROM cluster_node_data WHERE source_node IS NOT NULL AND name IS NOT NULL
  UNION SELECT name FROM cluster_node_data WHERE source_node IS NOT NULL AND name IS NOT NULL)
WHERE name NOT IN (SELECT entity_name FROM entity_nodes WHERE entity_name IS NOT NULL)""",
    "text_vector_ids": """
SELECT DISTINCT edge_id, 'rel-' || md5(src_id || tgt_id) AS rel_id, 'ent-' || md5(src_id) AS src_ent,
  md5(coalesce(keywords, '') || src_id || tgt_id || coalesce(description, '')) AS text_hash FROM edge_data""",
    "text_facts": f"""
SELECT *, 'fact-' || md5(concat_ws(chr(31), s, p, o)) AS fact_id FROM ({FACTS}) WHERE s <> '' AND p <> '' AND o <> ''""",
    "text_fact_entities": f"""
WITH f AS (SELECT * FROM ({FACTS}) WHERE s <> '' AND p <> '' AND o <> '')
SELECT chunk, entity, 'entity-' || md5(entity) AS entity_id FROM (SELECT chunk, s AS entity FROM f UNION SELECT chunk, o FROM f)""",
    "text_answer_parts": f"""
SELECT DISTINCT query_id, {STRIP.format("regexp_extract(answer, '(?s)^(?:.*Answer:)?(.*)$', 1)")} AS final,
  coalesce(array_to_string(({WORDS.format('answer')})[1:14], ' '), '') AS short,
  CASE WHEN regexp_matches(answer, '(?s)\\{{.*\\}}') THEN regexp_replace(regexp_extract(answer, '(?s)(\\{{.*\\}})', 1), '[\\r\\n]+', ' ', 'g') END AS body,
  lower({STRIP.format('answer')}) IN ('1', 'true', 't', 'yes', 'y', 'on') AS truth
FROM query_solution WHERE answer IS NOT NULL""",
    "kv_lookup": """
WITH a AS (SELECT DISTINCT query_id, unnest(docs) AS doc, generate_subscripts(docs, 1) - 1 AS pos FROM query_solution)
SELECT a.query_id, a.pos::INT AS pos, a.doc, d.source, d.n_chars FROM a LEFT JOIN documents d ON a.doc = 'doc-' || d.doc_id""",
    "kv_new_keys": f"""
SELECT DISTINCT chunk_id FROM chunk_info WHERE ingested_at >= TIMESTAMPTZ '{STORED_BEFORE}+00' AND chunk_id IS NOT NULL
  AND chunk_id NOT IN (SELECT chunk_id FROM chunk_info WHERE ingested_at < TIMESTAMPTZ '{STORED_BEFORE}+00')""",
    "kv_upsert": f"""
WITH stored AS (SELECT chunk_id, md5(max_by(content, ingested_at)) AS content_hash, max(ingested_at) AS ingested_at FROM chunk_info WHERE ingested_at < TIMESTAMPTZ '{STORED_BEFORE}+00' GROUP BY chunk_id),
batch AS (SELECT chunk_id, md5(max_by(content, ingested_at)) AS content_hash, max(ingested_at) AS ingested_at FROM chunk_info WHERE ingested_at >= TIMESTAMPTZ '{STORED_BEFORE}+00' GROUP BY chunk_id)
SELECT * FROM stored UNION ALL SELECT * FROM batch WHERE chunk_id NOT IN (SELECT chunk_id FROM stored)""",
    "kv_insert_texts": f"""
SELECT 'doc-' || md5(text) AS hash_id, any_value(length(text))::INT AS length FROM documents WHERE {STRIP.format('text')} <> '' GROUP BY 1""",
    "kv_delete": """
SELECT DISTINCT chunk_id FROM chunk_info WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_info WHERE deleted_at IS NOT NULL)""",
}
