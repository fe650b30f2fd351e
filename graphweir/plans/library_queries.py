"""Queries over operators that retrieval pipelines call one by one: keyed tables, seeds, model output, deletion, file formats.

Model output is rendered from whole tables in the notation that models are asked for, and parsed back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweir import providers
from graphweir.functions import similarity as sim
from graphweir.functions import text as tx
from graphweir.operators import diffusion, graph, kv, parsing, profile, retrieval, schema_graph, vector
from graphweir.operators import text as ops
from graphweir.session import checkpoint_dir, remembered
from graphweir.sources import files
from graphweir.sources.tables import load


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """One edge per pair: src, tgt, weight."""
    return load(spark, d, "edge_data").where("src_id is not null and tgt_id is not null").groupBy(F.col("src_id").alias("src"), F.col("tgt_id").alias("tgt")).agg(F.coalesce(F.max("weight"), F.lit(1.0)).alias("weight"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "entity_nodes").where("entity_name is not null").groupBy(F.col("entity_name").alias("name")).agg(F.max("entity_type").alias("entity_type"), F.max("description").alias("description"))


def _odd(spark: SparkSession, d: str) -> DataFrame:
    """Entities to be deleted: those whose name has an odd number of characters."""
    return _nodes(spark, d).where("length(name) % 2 = 1").select("name")


# --- keyed tables ------------------------------------------------------------------


def kv_keys(spark: SparkSession, d: str) -> DataFrame:
    return kv.keys(load(spark, d, "nation"), "n_name")


def kv_get(spark: SparkSession, d: str) -> DataFrame:
    return kv.get(load(spark, d, "nation"), "n_nationkey", 7)


def kv_requested(spark: SparkSession, d: str) -> DataFrame:
    """Rows in the order of their requests, misses as nulls."""
    asked = load(spark, d, "orders").select((F.col("o_orderkey") * 2).alias("asked"), F.col("o_orderkey").alias("position"))
    return kv.get_many(load(spark, d, "orders"), "o_orderkey", asked, "asked", ["position"], ["o_orderstatus"])


# --- vectors -------------------------------------------------------------------------


def vector_without_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "node_embeddings").select("node_id", "entity_name").distinct()
    return vector.by_entity(rows, "entity_name", _odd(spark, d))


def vector_without_relations(spark: SparkSession, d: str) -> DataFrame:
    return vector.relations_without(load(spark, d, "edge_data").select("edge_id", "src_id", "tgt_id").distinct(), _odd(spark, d))


def vector_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against the next one: raw cosine and that mapped to [0, 1]."""
    v = load(spark, d, "embeddings")
    pairs = v.select("vec_id", F.col("embedding").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return pairs.select("vec_id", F.round(sim.cosine(F.col("a"), F.col("b")), 6).alias("cosine"), F.round(sim.cosine01(F.col("a"), F.col("b")), 6).alias("cosine01"))


def vector_node_texts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "entity_nodes").where("entity_name is not null").select("node_id", ops.node_text(F.col("entity_name"), F.col("description")).alias("text")).distinct()


def vector_models(spark: SparkSession, d: str) -> DataFrame:
    """The embedding model by explicit key, environment, model name, or default."""
    asked = [("nv-embed-v2", None, None), (None, "gritlm", "gpt-4o"), (None, None, "gpt-4o-mini"), ("unheard-of", None, None), (None, None, None)]
    return spark.createDataFrame([(k, *providers.embedding_model(*a)) for k, a in enumerate(asked)], "asked INT, model STRING, dims INT, most_tokens INT")


# --- graph -----------------------------------------------------------------------------


def graph_has(spark: SparkSession, d: str) -> DataFrame:
    """Of the reverses of all edges, those that are edges too."""
    e = _edges(spark, d)
    return graph.has_edges(e.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")), e)


def graph_has_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return graph.has_nodes(e.select(F.col("src").alias("name")).union(e.select("tgt")).distinct(), _nodes(spark, d))


def graph_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What is left in four stores after entities are deleted."""
    n, e = _nodes(spark, d), _edges(spark, d)
    vectors = load(spark, d, "node_embeddings").select(F.col("entity_name").alias("name")).distinct()
    left = graph.cascade_delete(n, e, vectors, load(spark, d, "edge_data").select("edge_id", "src_id", "tgt_id").distinct(), _odd(spark, d))
    counted = [x.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("store"), "rows") for k, x in zip(("nodes", "edges", "vectors", "relations"), left, strict=True)]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


def graph_incoming(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), _odd(spark, d), "in").distinct()


def graph_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size, edges inside and strongest node of every flow cluster's JSON."""
    members = load(spark, d, "cluster_node_data").where("name is not null and flow_value is not null and not isnan(flow_value)").groupBy(F.col("cluster_id").alias("cluster"), "name").agg(F.max("flow_value").alias("x"))
    found = graph.cluster_json(members, _edges(spark, d), _nodes(spark, d), "cluster")
    return found.select("cluster", F.get_json_object("json", "$.cluster_size").cast("bigint").alias("size"), F.get_json_object("json", "$.total_edges").cast("bigint").alias("edges"), F.round(F.get_json_object("json", "$.max_flow_value").cast("double"), 6).alias("flow"))


def flow_edge_weights(spark: SparkSession, d: str) -> DataFrame:
    """Query-aware weights of all edges by each scheme; similarities stand in as shares of the edge's number."""
    e = load(spark, d, "edge_data").select("edge_id", "weight").where("weight is not null").groupBy("edge_id").agg(F.max("weight").alias("w"))
    s1, s2 = (F.col("edge_id") % 7) / 7, F.when(F.col("edge_id") % 5 != 0, (F.col("edge_id") % 11) / 11)
    return e.select("edge_id", *[F.round(diffusion.edge_weight(F.col("w"), s1, s2, scheme), 6).alias(scheme) for scheme in ("multiply", "add", "original", "none")])


def flow_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seed weights of clusters scaled to sum 1."""
    seeds = load(spark, d, "cluster_node_data").where("name is not null and flow_value is not null and not isnan(flow_value)").groupBy(F.col("cluster_id").alias("query_id"), F.col("name").alias("node")).agg(F.max("flow_value").alias("weight"))
    return diffusion.seed_weights(seeds).withColumn("weight", F.round("weight", 9))


# --- retrieval -------------------------------------------------------------------------


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Scored facts per month, standing in for questions: query_id, s, o, score."""
    e = load(spark, d, "edge_data").where("src_id is not null and tgt_id is not null and weight is not null and created_at is not null")
    return e.groupBy(F.date_format("created_at", "yyyy-MM").alias("query_id"), F.col("src_id").alias("s"), F.col("tgt_id").alias("o")).agg(F.max("weight").alias("score"))


def _entity_seeds(spark: SparkSession, d: str) -> DataFrame:
    chunks = load(spark, d, "entity_nodes").where("entity_name is not null").groupBy(F.col("entity_name").alias("name")).agg(F.count_distinct("source_id").alias("chunks"))
    return retrieval.entity_seeds(_facts(spark, d), chunks, 20)


def retrieve_entity_seeds(spark: SparkSession, d: str) -> DataFrame:
    return _entity_seeds(spark, d).withColumn("weight", F.round("weight", 6))


def retrieve_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Entity seeds, and passages by scaled scores times a small weight."""
    passages = _facts(spark, d).groupBy("query_id", F.col("o").alias("node")).agg(F.max("score").alias("raw")).select("query_id", "node", sim.min_max(F.col("raw"), "query_id").alias("score"))
    return retrieval.combined_seeds(_entity_seeds(spark, d), passages).withColumn("weight", F.round("weight", 6))


def retrieve_or_first(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a filter kept, else the first of the question."""
    docs = load(spark, d, "query_solution").where("docs is not null").groupBy("query_id").agg(F.min(F.struct("docs", "gold_docs")).alias("r")).select("query_id", F.filter("r.docs", lambda x: x.isNotNull()).alias("docs"), "r.gold_docs")
    kept = docs.select("query_id", F.explode(F.array_intersect("docs", F.coalesce("gold_docs", F.array().cast("array<string>")))).alias("doc"))
    return retrieval.or_fallback(kept, docs.where("size(docs) > 0").select("query_id", F.array_min("docs").alias("doc")))


def retrieve_closest(spark: SparkSession, d: str) -> DataFrame:
    """Facts that a model gave back with a letter lost, met with their candidates."""
    facts = _facts(spark, d).select("query_id", F.concat_ws(" to ", "s", "o").alias("candidate")).withColumn("fact_id", F.md5("candidate"))
    first = facts.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("candidate")), 1, 3).alias("c"))
    returned = first.select("query_id", F.explode("c").alias("c")).select("query_id", F.concat(F.substring("c", 1, 3), F.expr("substring(c, 5)")).alias("fact"))
    return retrieval.closest_candidate(returned, facts)


def retrieve_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Local entities before global ones, repeats kept, numbered anew."""
    f = _facts(spark, d)
    rank = lambda c: retrieval.ranked(f.groupBy("query_id", F.col(c).alias("entity")).agg(F.max("score").alias("score")), ["query_id"], "score", "entity", "id").where("id <= 5").select("query_id", "id", "entity")
    return retrieval.hybrid(rank("s"), rank("o"), "query_id", ["entity"])


def retrieve_summaries_split(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a batch answer; one more is asked for than the answer has."""
    t = load(spark, d, "schema_tables").where("db_id is not null and table_name is not null").groupBy("db_id").agg(F.array_sort(F.collect_set("table_name")).alias("t"))
    body = F.array_join(F.transform("t", lambda x, k: F.concat(F.lit("Cluster "), (k + 1).cast("string"), F.lit(": about "), x)), "\n")
    return retrieval.split_summaries(t.select("db_id", body.alias("output"), (F.size("t") + 1).alias("expected")), "db_id", "output", "expected")


# --- model output ------------------------------------------------------------------------


def _names(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("name")


def text_facts_kept(spark: SparkSession, d: str) -> DataFrame:
    """Facts kept by a filter, from its sections; a row of two parts is no fact."""
    e = _edges(spark, d)
    said = F.concat(F.lit("thinking\n[[ ## fact_after_filter ## ]]\n"), F.to_json(F.struct(F.array(F.array("src", F.lit("knows"), "tgt"), F.array("src", "tgt")).alias("fact"))), F.lit("\n\n[[ ## completed ## ]]"))
    return e.select(F.explode(parsing.filtered_facts(said)).alias("f")).select(F.col("f")[0].alias("s"), F.col("f")[2].alias("o"))


def text_named_entities(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Here it is: "), F.to_json(F.struct(F.array("name", F.upper("name"), "name").alias("named_entities"))), F.lit(" done"))
    return _names(spark, d).select("name", F.explode(parsing.named_entities(said)).alias("entity"))


def text_triples(spark: SparkSession, d: str) -> DataFrame:
    said = F.to_json(F.struct(F.array(F.array("src", F.lit("knows"), "tgt"), F.array("src", "tgt"), F.array("src", F.lit("knows"), "tgt")).alias("triples")))
    return _edges(spark, d).select(F.explode(parsing.response_triples(said)).alias("t")).select(F.col("t")[0].alias("s"), F.col("t")[1].alias("p"), F.col("t")[2].alias("o"))


def text_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations rendered in the record notation and parsed back."""
    e = _nodes(spark, d).select(F.col("name").alias("source"), "name", F.coalesce("entity_type", F.lit("UNKNOWN")).alias("type"), F.lit("of it").alias("description"))
    r = _edges(spark, d).where("src rlike '^[A-Za-z ]+$' and tgt rlike '^[A-Za-z ]+$'").select(F.concat_ws("-", "src", "tgt").alias("source"), "src", "tgt", F.lit("about").alias("description"), F.lit("key").alias("keywords"), F.round("weight", 3).alias("weight"))
    return ops.parse_relations(ops.render_records(e, r)).select(F.trim("src").alias("src"), F.trim("tgt").alias("tgt"), "weight")


def text_unescaped(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("name", parsing.decode_unicode(F.concat(F.lit("\\u00e9t\\u00E9 \\ud83d\\ude00 "), "name")).alias("text"))


def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("so <Answer> "), "name", F.lit(" </Answer>\n```sql\nSELECT '"), "name", F.lit("'\n```\n<sql>b</sql>"))
    return _names(spark, d).select("name", F.element_at(tx.blocks(said, "Answer"), 1).alias("answer"), F.element_at(tx.fenced(said, "sql"), 1).alias("fenced"), F.element_at(tx.blocks(said, "sql"), 1).alias("sql"))


def text_repaired(spark: SparkSession, d: str) -> DataFrame:
    """JSON broken off in its last element."""
    broken = F.concat(F.lit('so {"name": '), F.to_json(F.struct(F.col("name").alias("n"))), F.lit(', "list": [1, 2, {"a": "b"}, "unfin'))
    return _names(spark, d).select("name", parsing.repair_json(broken).alias("j")).select("name", F.get_json_object("j", "$.name.n").alias("kept"), F.get_json_object("j", "$.list[2].a").alias("last"))


def text_without_prompt(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").where("title is not null")
    return docs.select("doc_id", tx.without(F.concat(F.lit("system user\n"), "title", F.lit(" <s>model ")), ["system", "user", "model", "<s>"]).alias("text"))


# --- profiles and schemas ------------------------------------------------------------------


def profile_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of orders by key (a sample is the feature)."""
    return profile.sample_rows(load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"], 5)


def profile_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "schema_columns").where("name is not null").select("name", profile.quoted(F.col("name")).alias("quoted")).distinct()


def schema_cluster_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables and columns of clusters: here one cluster per database."""
    c = load(spark, d, "schema_columns").where("db_id is not null and table_name is not null and name is not null").select(F.col("db_id").alias("query_id"), F.concat(F.lit('"'), F.lower("table_name"), F.lit("."), F.lower("name"), F.lit('"')).alias("name"))
    return schema_graph.cluster_tables(c).select("query_id", "table_name", F.array_join("columns", ",").alias("columns"))


def schema_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Tables asked for by full and by short names."""
    t = load(spark, d, "schema_tables").where("db_id is not null and table_name is not null").select(F.concat_ws(".", "db_id", "table_name").alias("table_name")).distinct()
    asked = t.select(F.col("table_name").alias("name")).union(t.select(F.upper(F.regexp_extract("table_name", "([^.]*)$", 1)))).union(t.select(F.concat("table_name", F.lit("x")))).distinct()
    return schema_graph.lookup(asked, t)


# --- files -----------------------------------------------------------------------------------


def _path(spark: SparkSession, name: str) -> str:
    return remembered(spark, f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")


def file_graphml(spark: SparkSession, d: str) -> DataFrame:
    """The graph written as GraphML and read back: its edges, and the types of their sources."""
    path = _path(spark, "graphml")
    files.write_graphml(_nodes(spark, d), _edges(spark, d), path)
    nodes, edges = files.graphml(spark, path)
    kinds = nodes.select(F.col("name").alias("src"), F.try_element_at("attributes", F.lit("d0")).alias("src_type"))
    return edges.join(kinds, "src", "left").select("src", "src_type", "tgt", "weight")


def file_objects(spark: SparkSession, d: str) -> DataFrame:
    """Keyed values written as JSON objects and read back."""
    path = _path(spark, "kv")
    files.write_json_kv(_nodes(spark, d).where("description is not null").select(F.col("name").alias("id"), F.col("description").alias("value")), path)
    return files.json_kv(spark, path, lines=True).unionByName(files.json_kv(spark, path + "-none"))


def file_corpus(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "corpus")
    load(spark, d, "documents").where("title is not null and text is not null").select("title", "text").distinct().write.json(path)
    return files.corpus(spark, path, lines=True).select(F.md5("content").alias("content_md5"), F.length("content").alias("size"))


def file_stories(spark: SparkSession, d: str) -> DataFrame:
    """Stories with their questions and reference answers, exploded; empty answers are dropped."""
    docs = load(spark, d, "documents").where("text is not null and title is not null")
    said = lambda c: F.struct(c.alias("response_text"))
    asked = F.array(F.struct(F.col("title").alias("question_text"), F.array(said(F.col("source")), said(F.lit("")), said(F.lit("other"))).alias("responses")), F.struct(F.lit("What else?").alias("question_text"), F.array(said(F.lit(""))).alias("responses")))
    path = _path(spark, "stories")
    docs.select(F.col("text").alias("document"), asked.alias("questions"), F.struct(F.col("doc_id").cast("string").alias("passage_id")).alias("metadata")).write.json(path)
    return files.story_questions(spark, path).select("passage_id", "question", "answer", F.size("all_answers").alias("answers"))


def file_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions in the paragraph shape: gold answers with aliases, gold documents from supporting paragraphs."""
    rows = load(spark, d, "query_solution").where("question is not null and docs is not null").groupBy("query_id").agg(F.min(F.struct("question", "docs", "gold_docs")).alias("r")).select("query_id", "r.*")
    told = F.transform(F.filter("docs", lambda x: x.isNotNull()), lambda x: F.struct(x.alias("title"), F.lit("body").alias("text"), F.coalesce(F.array_contains("gold_docs", x), F.lit(False)).alias("is_supporting")))
    path = _path(spark, "questions")
    rows.select("question", F.col("query_id").cast("string").alias("answer"), F.array(F.lit("alias"), F.lit("alias")).alias("answer_aliases"), told.alias("paragraphs")).write.json(path)
    found = files.questions(spark, path, lines=True)
    return found.select(F.col("gold_answers")[0].cast("bigint").alias("query_id"), "question", F.size("gold_answers").alias("golds"), F.size("gold_docs").alias("gold_docs"))


def file_instances(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "instances")
    load(spark, d, "query_solution").where("question is not null").select(F.col("query_id").cast("string").alias("instance_id"), F.col("dataset").alias("db"), "question").distinct().write.json(path)
    first = load(spark, d, "query_solution").agg(F.min("dataset")).first()[0]
    return files.instances(spark, path, db=first).select("instance_id", "db", "question")


def file_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Extraction results: entities by chunk; a chunk with any is done."""
    e = load(spark, d, "entity_nodes").where("source_id is not null and entity_name is not null").groupBy(F.col("source_id").alias("idx")).agg(F.collect_set("entity_name").alias("names"))
    c = load(spark, d, "chunk_info").where("chunk_id is not null").select(F.col("chunk_id").alias("idx")).distinct()
    doc = F.struct("idx", F.col("idx").alias("passage"), F.coalesce("names", F.array().cast("array<string>")).alias("extracted_entities"), F.array().cast("array<array<string>>").alias("extracted_triples"))
    path = _path(spark, "openie")
    c.join(e, "idx", "left").select(F.array(doc).alias("docs")).write.json(path)
    return files.openie(spark, path, lines=True).select(F.col("passage").alias("chunk_id"), F.size("entities").alias("entities"), "done")


def file_exports(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document per table in a folder per schema."""
    c = load(spark, d, "schema_columns").where("db_id is not null and table_name is not null and name is not null").groupBy("db_id", F.lower("table_name").alias("table_name"), F.lower("name").alias("n")).agg(F.min("type").alias("t"))
    per = c.groupBy("db_id", "table_name").agg(F.array_sort(F.collect_set(F.struct("n", F.coalesce("t", F.lit("TEXT")).alias("t")))).alias("c"))
    path = _path(spark, "exports")
    per.select("db_id", "table_name", F.transform("c", lambda x: x["n"]).alias("column_names"), F.transform("c", lambda x: x["t"]).alias("column_types")).write.partitionBy("db_id").json(path)
    return files.table_exports(spark, path, lines=True).select(F.regexp_replace("schema_name", "^db_id=", "").alias("db_id"), "table_name", "column_name", "type", "at")


def file_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Profile summaries, samples as maps of lists for one half of the tables and as lists of rows for the other."""
    c = load(spark, d, "schema_columns").where("db_id is not null and table_name is not null and name is not null").groupBy(F.concat_ws(".", "db_id", F.lower("table_name")).alias("t"), F.lower("name").alias("name")).agg(F.min("type").alias("type"), F.coalesce(F.max("is_primary_key"), F.lit(False)).alias("is_primary_key"))
    lists = F.to_json(F.map_from_entries(F.collect_list(F.struct("name", F.array(F.lit("a"), F.lit("b"))))))
    rows = F.to_json(F.array(F.map_from_entries(F.collect_list(F.struct("name", F.lit("a"))))))
    per = c.groupBy("t").agg(F.to_json(F.collect_list(F.struct("name", "type", "is_primary_key"))).alias("columns"), lists.alias("lists"), rows.alias("rows"))
    body = F.concat(F.lit('{"tables": {"'), "t", F.lit('": {"columns": '), "columns", F.lit(', "samples": '), F.when(F.length("t") % 2 == 0, F.col("lists")).otherwise(F.col("rows")), F.lit("}}}"))
    path = _path(spark, "summaries")
    per.select(body.alias("value")).write.text(path)
    return files.summary_columns(spark, path, lines=True).select("table_name", "column_name", "type", "is_primary_key", F.size("samples").alias("samples"))


def file_template(spark: SparkSession, d: str) -> DataFrame:
    """A few-shot template as messages: one of the system, two for each demonstration."""
    demos = [{"question": f"q{k}", "fact_before_filter": "b", "fact_after_filter": "a"} for k in range(2)]
    return spark.createDataFrame([(k, m["role"], len(m["content"])) for k, m in enumerate(files.template_messages({"system": "Keep what helps.", "demos": demos}))], "place INT, role STRING, size INT")


# --- counts, attributes, declared and sampled keys ---------------------------------------------


def kv_dropped(spark: SparkSession, d: str) -> DataFrame:
    """A table after it was dropped, and filled again with what was asked for but missing."""
    docs = load(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc"))
    asked = load(spark, d, "query_solution").select(F.explode("docs").alias("doc"))
    return kv.drop(docs).unionByName(kv.missing(asked, docs, "doc"))


def graph_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Types of both ends of all edges, unknown nodes included."""
    e = _edges(spark, d)
    return graph.attributes(e.select(F.col("src").alias("name")).union(e.select("tgt")), _nodes(spark, d).select("name", "entity_type"), ["name"])


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.summary(_nodes(spark, d), _edges(spark, d)).withColumn("samples", F.array_join("samples", "|"))


def graph_info(spark: SparkSession, d: str) -> DataFrame:
    """Entities, passages that name them, and edges of both kinds."""
    rows = load(spark, d, "entity_nodes").where("entity_name is not null and source_id is not null").select(F.col("source_id").alias("src"), F.col("entity_name").alias("tgt")).distinct()
    return graph.info(_nodes(spark, d), rows.select(F.col("src").alias("name")).distinct(), _edges(spark, d).select("src", "tgt").unionByName(rows))


def text_distinct(spark: SparkSession, d: str) -> DataFrame:
    return ops.distinct_texts(load(spark, d, "chunk_info"), "content").select(F.md5("text").alias("text_md5"))


def text_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Entities and triples of all chunks; chunks that none was taken from have empty ones."""
    e = load(spark, d, "entity_nodes").where("source_id is not null and entity_name is not null").groupBy(F.col("source_id").alias("chunk")).agg(F.collect_set("entity_name").alias("entities"))
    chunks = load(spark, d, "chunk_info").where("chunk_id is not null").select(F.col("chunk_id").alias("chunk"))
    found = ops.extraction_parts(chunks, e.withColumn("triples", F.lit(None).cast("array<array<string>>")))
    return found.select("chunk", F.size("entities").alias("entities"), F.size("triples").alias("triples"))


def _columns(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "schema_columns").where("db_id is not null and table_name is not null and name is not null")
    return c.groupBy("db_id", F.lower("table_name").alias("table_name"), F.lower("name").alias("column_name")).agg(F.coalesce(F.max("is_primary_key"), F.lit(False)).alias("pk"), F.max(F.lower("references_table")).alias("references_table"), F.max(F.lower("references_column")).alias("references_column"))


def profile_declared(spark: SparkSession, d: str) -> DataFrame:
    """Declared keys; tables without one take columns named id."""
    c = _columns(spark, d).select(F.concat_ws("/", "db_id", "table_name").alias("table_name"), "column_name", "pk")
    return profile.declared_first(c.where("pk").drop("pk"), c.where("column_name like '%id'").drop("pk"))


def profile_without_skipped(spark: SparkSession, d: str) -> DataFrame:
    c = _columns(spark, d).select("db_id", "table_name", "column_name")
    return profile.without_skipped(c, c.select("db_id", F.upper("column_name").alias("column_name")).where("column_name < 'F'"))


def profile_relationships(spark: SparkSession, d: str) -> DataFrame:
    found = profile.relationships(_columns(spark, d).drop("pk"))
    return found.withColumn("from_columns", F.array_join("from_columns", ",")).withColumn("to_columns", F.array_join("to_columns", ",", "-"))


def profile_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of two columns of customers as exported values."""
    c = load(spark, d, "customer")
    long = c.select(F.lit("customer").alias("table_name"), F.explode(F.create_map(F.lit("c_mktsegment"), F.col("c_mktsegment"), F.lit("c_nationkey"), F.col("c_nationkey").cast("string"))).alias("column_name", "value"))
    return profile.sampled_stats(long).withColumn("uniqueness", F.round("uniqueness", 6))


def schema_types(spark: SparkSession, d: str) -> DataFrame:
    return schema_graph.schema_type(load(spark, d, "schema_columns"))


def schema_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first three documents of each source as sample rows."""
    docs = load(spark, d, "documents").where("source is not null and text is not null").select(F.col("source").alias("table_name"), F.col("doc_id").alias("at"), F.create_map(F.lit("id"), F.col("doc_id").cast("string"), F.lit("size"), F.repeat(F.lit("x"), (F.col("doc_id") % 120).cast("int"))).alias("row"))
    return schema_graph.sample_json(docs)


def file_results(spark: SparkSession, d: str) -> DataFrame:
    """Answers written as results and read back, nulls kept."""
    path = _path(spark, "results")
    files.write_results(load(spark, d, "query_solution").select("query_id", "answer").distinct(), path)
    return spark.read.schema("query_id BIGINT, answer STRING").json(path)


QUERIES = {name: one for name, one in list(globals().items()) if name.split("_")[0] in ("kv", "vector", "graph", "flow", "retrieve", "text", "profile", "schema", "eval", "file") and callable(one)}

_E = "e AS (SELECT src_id AS src, tgt_id AS tgt, coalesce(max(weight), 1.0) AS weight FROM edge_data WHERE src_id IS NOT NULL AND tgt_id IS NOT NULL GROUP BY ALL)"
_N = "n AS (SELECT entity_name AS name, max(entity_type) AS entity_type, max(description) AS description FROM entity_nodes WHERE entity_name IS NOT NULL GROUP BY 1)"
_ODD = "odd AS (SELECT name FROM n WHERE length(name) % 2 = 1)"
_FACTS = "f AS (SELECT strftime(created_at, '%Y-%m') AS query_id, src_id AS s, tgt_id AS o, max(weight) AS score FROM edge_data WHERE src_id IS NOT NULL AND tgt_id IS NOT NULL AND weight IS NOT NULL AND created_at IS NOT NULL GROUP BY ALL)"
_SEEDS = f"""{_FACTS}, c AS (SELECT entity_name AS name, count(DISTINCT source_id) AS chunks FROM entity_nodes WHERE entity_name IS NOT NULL GROUP BY 1),
w AS (SELECT query_id, c.name AS node, avg(score / greatest(chunks, 1)) AS weight FROM (SELECT query_id, score, unnest([s, o]) AS name FROM f) x JOIN c ON x.name = c.name GROUP BY ALL),
seed AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, node) <= 20)"""
_FLOW = "SELECT cluster_id, name, max(flow_value) AS x FROM cluster_node_data WHERE name IS NOT NULL AND flow_value IS NOT NULL AND NOT isnan(flow_value) GROUP BY ALL"
_COLUMN = "schema_columns WHERE db_id IS NOT NULL AND table_name IS NOT NULL AND name IS NOT NULL"

_C = f"cols AS (SELECT db_id, lower(table_name) AS t, lower(name) AS c, coalesce(bool_or(is_primary_key), false) AS pk, max(lower(references_table)) AS rt, max(lower(references_column)) AS rc FROM {_COLUMN} GROUP BY ALL)"

ORACLES = {
    "kv_keys": "SELECT n_name FROM nation",
    "kv_get": "SELECT * FROM nation WHERE n_nationkey = 7",
    "kv_requested": "SELECT a.o_orderkey * 2 AS asked, a.o_orderkey AS position, b.o_orderstatus FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey * 2",
    "vector_without_entities": f"WITH {_N}, {_ODD} SELECT DISTINCT node_id, entity_name FROM node_embeddings WHERE NOT EXISTS (SELECT 1 FROM odd WHERE odd.name = entity_name)",
    "vector_without_relations": f"WITH {_N}, {_ODD} SELECT DISTINCT edge_id, src_id, tgt_id FROM edge_data WHERE NOT EXISTS (SELECT 1 FROM odd WHERE odd.name IN (src_id, tgt_id))",
    "vector_cosines": "SELECT a.vec_id, round(c, 6) AS cosine, round(greatest((c + 1) / 2, 0), 6) AS cosine01 FROM (SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a",
    "vector_node_texts": "SELECT DISTINCT node_id, CASE WHEN coalesce(description, '') <> '' THEN entity_name || ' ' || description ELSE entity_name END AS text FROM entity_nodes WHERE entity_name IS NOT NULL",
    "vector_models": "SELECT * FROM (VALUES (0, 'nv-embed-v2', 4096, 32768), (1, 'gritlm', 4096, 8192), (2, 'openai-small', 1536, 8191), (3, 'jina-v3', 1024, 8192), (4, 'jina-v3', 1024, 8192)) t(asked, model, dims, most_tokens)",
    "graph_has": f"WITH {_E} SELECT a.tgt AS src, a.src AS tgt FROM e a JOIN e b ON a.tgt = b.src AND a.src = b.tgt",
    "graph_has_nodes": f"WITH {_E}, {_N} SELECT name FROM n WHERE name IN (SELECT src FROM e UNION SELECT tgt FROM e)",
    "graph_cascade": f"""WITH {_E}, {_N}, {_ODD}
SELECT 'nodes' AS store, count(*) AS rows FROM n WHERE name NOT IN (FROM odd)
UNION ALL SELECT 'edges', count(*) FROM e WHERE src NOT IN (FROM odd) AND tgt NOT IN (FROM odd)
UNION ALL SELECT 'vectors', count(DISTINCT coalesce(entity_name, chr(1))) FROM node_embeddings WHERE entity_name IS NULL OR entity_name NOT IN (FROM odd)
UNION ALL SELECT 'relations', count(*) FROM (SELECT DISTINCT edge_id, src_id, tgt_id FROM edge_data) WHERE (src_id IS NULL OR src_id NOT IN (FROM odd)) AND (tgt_id IS NULL OR tgt_id NOT IN (FROM odd))""",
    "graph_incoming": f"WITH {_E}, {_N}, {_ODD} SELECT DISTINCT tgt AS name, src AS neighbour FROM e WHERE tgt IN (FROM odd)",
    "graph_clusters": f"""WITH {_E}, m AS ({_FLOW}), i AS (SELECT a.cluster_id, count(*) AS edges FROM e JOIN m a ON e.src = a.name JOIN m b ON e.tgt = b.name AND a.cluster_id = b.cluster_id GROUP BY 1)
SELECT m.cluster_id AS cluster, count(*) AS size, coalesce(any_value(edges), 0) AS edges, round(max(x), 6) AS flow FROM m LEFT JOIN i ON m.cluster_id = i.cluster_id GROUP BY 1""",
    "flow_edge_weights": """WITH e AS (SELECT edge_id, max(weight) AS w, (edge_id % 7) / 7.0::DOUBLE AS a, CASE WHEN edge_id % 5 <> 0 THEN (edge_id % 11) / 11.0::DOUBLE ELSE 0 END AS b FROM edge_data WHERE weight IS NOT NULL GROUP BY edge_id)
SELECT edge_id, round(CASE WHEN w <= 0 THEN 0 ELSE w * a * b END, 6) AS multiply, round(CASE WHEN w <= 0 THEN 0 ELSE (w + a + b) / 3 END, 6) AS add, round(CASE WHEN w <= 0 THEN 0 ELSE w * (1 + 0.5::DOUBLE * (a + b) / 2) END, 6) AS original, round(CASE WHEN w <= 0 THEN 0 ELSE w END, 6) AS "none" FROM e""",
    "flow_seeds": f"""WITH m AS ({_FLOW}), w AS (SELECT *, CASE WHEN x < 1e-5 THEN 0 ELSE x END AS v FROM m)
SELECT cluster_id AS query_id, name AS node, round(CASE WHEN sum(v) OVER c > 0 THEN v / sum(v) OVER c ELSE 1.0::DOUBLE / count(*) OVER c END, 9) AS weight FROM w WINDOW c AS (PARTITION BY cluster_id)""",
    "retrieve_entity_seeds": f"WITH {_SEEDS} SELECT query_id, node, round(weight, 6) AS weight FROM seed",
    "retrieve_seeds": f"""WITH {_SEEDS}, p AS (SELECT query_id, o AS node, max(score) AS raw FROM f GROUP BY ALL),
q AS (SELECT query_id, node, CASE WHEN max(raw) OVER c = min(raw) OVER c THEN 1.0 ELSE (raw - min(raw) OVER c) / (max(raw) OVER c - min(raw) OVER c) END * 0.05::DOUBLE AS weight FROM p WINDOW c AS (PARTITION BY query_id))
SELECT query_id, node, round(sum(weight), 6) AS weight FROM (FROM seed UNION ALL FROM q) GROUP BY ALL""",
    "retrieve_or_first": """WITH r AS (SELECT query_id, min({'d': docs, 'g': gold_docs}) AS r FROM query_solution WHERE docs IS NOT NULL GROUP BY 1), x AS (SELECT query_id, list_filter(r.d, lambda v: v IS NOT NULL) AS docs, coalesce(r.g, []) AS g FROM r),
k AS (SELECT DISTINCT query_id, unnest(list_filter(docs, lambda v: list_contains(g, v))) AS doc FROM x)
FROM k UNION ALL SELECT query_id, list_min(docs) FROM x WHERE len(docs) > 0 AND query_id NOT IN (SELECT query_id FROM k)""",
    "retrieve_closest": f"""WITH {_FACTS}, c AS (SELECT query_id, s || ' to ' || o AS candidate FROM f), r AS (SELECT query_id, candidate[1:3] || candidate[5:] AS fact FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY candidate) <= 3)
SELECT r.query_id, fact, min({{'d': levenshtein(fact, candidate), 'i': md5(candidate)}}).i AS fact_id FROM r JOIN c ON r.query_id = c.query_id GROUP BY ALL""",
    "retrieve_hybrid": f"""WITH {_FACTS}, a AS (SELECT 0 AS level, query_id, s AS entity, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, s) AS id FROM f GROUP BY query_id, s UNION ALL SELECT 1, query_id, o, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, o) FROM f GROUP BY query_id, o)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY level, id) - 1)::INT AS id, entity FROM a WHERE id <= 5""",
    "retrieve_summaries_split": """WITH t AS (SELECT DISTINCT db_id, table_name FROM schema_tables WHERE db_id IS NOT NULL AND table_name IS NOT NULL)
SELECT db_id, row_number() OVER (PARTITION BY db_id ORDER BY table_name)::INT AS cluster, 'about ' || table_name AS summary FROM t UNION ALL SELECT db_id, (count(*) + 1)::INT, '' FROM t GROUP BY 1""",
    "text_facts_kept": f"WITH {_E} SELECT src AS s, tgt AS o FROM e",
    "text_named_entities": f"WITH {_N} SELECT name, unnest(CASE WHEN upper(name) = name THEN [name] ELSE [name, upper(name)] END) AS entity FROM n",
    "text_triples": f"WITH {_E} SELECT src AS s, 'knows' AS p, tgt AS o FROM e",
    "text_relations": f"WITH {_E} SELECT trim(src) AS src, trim(tgt) AS tgt, round(weight, 3) AS weight FROM e WHERE regexp_matches(src, '^[A-Za-z ]+$') AND regexp_matches(tgt, '^[A-Za-z ]+$')",
    "text_unescaped": f"WITH {_N} SELECT name, 'été 😀 ' || name AS text FROM n",
    "text_blocks": f"WITH {_N} SELECT name, trim(name) AS answer, 'SELECT ''' || name || '''' AS fenced, 'b' AS sql FROM n",
    "text_repaired": f"WITH {_N} SELECT name, name AS kept, 'b' AS last FROM n",
    "text_without_prompt": r"SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(replace('system user' || chr(10) || title || ' <s>model ', 'system', ''), 'user', ''), 'model', ''), '<s>', ''), '^[ \t\n\r\f]+', ''), '[ \t\n\r\f]+$', '') AS text FROM documents WHERE title IS NOT NULL",
    "profile_samples": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 5",
    "profile_identifiers": "SELECT DISTINCT name, CASE WHEN regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') AND upper(name) NOT IN ('SELECT', 'FROM', 'WHERE', 'GROUP', 'ORDER', 'BY', 'TABLE', 'INDEX', 'KEY', 'JOIN', 'UNION', 'LIMIT', 'VALUES', 'DEFAULT', 'CHECK', 'REFERENCES', 'PRIMARY', 'FOREIGN') THEN name ELSE '`' || replace(name, '`', '``') || '`' END AS quoted FROM schema_columns WHERE name IS NOT NULL",
    "schema_cluster_tables": f"SELECT db_id AS query_id, split_part(replace(lower(table_name), '\"', ''), '.', 1) AS table_name, string_agg(DISTINCT lower(name), ',' ORDER BY lower(name)) AS columns FROM {_COLUMN} GROUP BY ALL",
    "schema_lookup": """WITH t AS (SELECT DISTINCT db_id || '.' || table_name AS n FROM schema_tables WHERE db_id IS NOT NULL AND table_name IS NOT NULL), f AS (SELECT DISTINCT lower(n) AS f FROM t), s AS (SELECT regexp_extract(f, '([^.]*)$', 1) AS s, min(f) AS f FROM f GROUP BY 1),
a AS (SELECT n AS name FROM t UNION SELECT upper(regexp_extract(n, '([^.]*)$', 1)) FROM t UNION SELECT n || 'x' FROM t)
SELECT name, coalesce(f.f, s.f) AS table_name FROM a LEFT JOIN f ON lower(name) = f.f LEFT JOIN s ON regexp_extract(lower(name), '([^.]*)$', 1) = s.s""",
    "kv_dropped": "SELECT DISTINCT doc FROM (SELECT unnest(docs) AS doc FROM query_solution) WHERE doc IS NOT NULL AND doc NOT IN (SELECT 'doc-' || doc_id FROM documents)",
    "graph_attributes": f"WITH {_E}, {_N}, a AS (SELECT src AS name FROM e UNION SELECT tgt FROM e) SELECT a.name, entity_type FROM a LEFT JOIN n ON a.name = n.name",
    "graph_summary": f"""WITH {_E}, {_N}, k AS (SELECT name, coalesce(entity_type, 'unknown') AS entity_type, row_number() OVER (PARTITION BY coalesce(entity_type, 'unknown') ORDER BY name) AS r FROM n)
SELECT entity_type, count(*) AS nodes, string_agg(name, '|' ORDER BY name) FILTER (r <= 5) AS samples, (SELECT count(*) FROM n) AS all_nodes, (SELECT count(*) FROM e) AS all_edges FROM k GROUP BY entity_type""",
    "graph_info": f"""WITH {_E}, {_N}, p AS (SELECT DISTINCT source_id AS src, entity_name AS tgt FROM entity_nodes WHERE entity_name IS NOT NULL AND source_id IS NOT NULL), x AS (SELECT src FROM e UNION ALL SELECT src FROM p)
SELECT count(*) AS edges, count(*) FILTER (src IN (SELECT src FROM p)) AS passage_edges, count(*) FILTER (src NOT IN (SELECT src FROM p)) AS entity_edges, (SELECT count(*) FROM n) AS entities, (SELECT count(DISTINCT src) FROM p) AS passages FROM x""",
    "text_distinct": "SELECT DISTINCT md5(content) AS text_md5 FROM chunk_info WHERE trim(content) <> ''",
    "text_extractions": """WITH e AS (SELECT source_id, count(DISTINCT entity_name)::INT AS n FROM entity_nodes WHERE source_id IS NOT NULL AND entity_name IS NOT NULL GROUP BY 1)
SELECT DISTINCT chunk_id AS chunk, coalesce(n, 0)::INT AS entities, 0 AS triples FROM chunk_info LEFT JOIN e ON chunk_id = source_id WHERE chunk_id IS NOT NULL""",
    "profile_declared": f"""WITH {_C}, k AS (SELECT db_id || '/' || t AS table_name, c AS column_name, pk FROM cols)
SELECT table_name, column_name, 'declared' AS origin FROM k WHERE pk UNION ALL SELECT table_name, column_name, 'inferred' FROM k WHERE column_name LIKE '%id' AND table_name NOT IN (SELECT table_name FROM k WHERE pk)""",
    "profile_without_skipped": f"WITH {_C} SELECT db_id, t AS table_name, c AS column_name FROM cols WHERE NOT upper(c) < 'F'",
    "profile_relationships": f"""WITH {_C} SELECT db_id, t AS from_table, string_agg(c, ',' ORDER BY c) AS from_columns, rt AS to_table, string_agg(coalesce(rc, '-'), ',' ORDER BY c) AS to_columns, CASE WHEN count(*) > 1 THEN 'composite' ELSE 'simple' END AS type FROM cols WHERE rt IS NOT NULL GROUP BY db_id, t, rt""",
    "profile_sampled": """WITH v AS (SELECT 'c_mktsegment' AS column_name, c_mktsegment AS value FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer)
SELECT 'customer' AS table_name, column_name, count(*) AS rows, count(*) - count(value) AS nulls, count(DISTINCT value) AS distinct_values, round(count(DISTINCT value) / count(value)::DOUBLE, 6) AS uniqueness FROM v GROUP BY column_name""",
    "schema_types": "SELECT db_id, CASE WHEN bool_or(coalesce(is_foreign_key, false) OR references_table IS NOT NULL) THEN 'db_summary' ELSE 'reconstruct' END AS schema_type FROM schema_columns WHERE db_id IS NOT NULL GROUP BY 1",
    "schema_samples": """WITH r AS (SELECT source, doc_id, doc_id % 120 AS n FROM documents WHERE source IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3)
SELECT source AS table_name, '[' || string_agg('{"id":"' || doc_id || '","size":"' || CASE WHEN n > 80 THEN repeat('x', 77) || '...' ELSE repeat('x', n) END || '"}', ',' ORDER BY doc_id) || ']' AS samples FROM r GROUP BY source""",
    "file_results": "SELECT DISTINCT query_id, answer FROM query_solution",
    "file_graphml": f"WITH {_E}, {_N} SELECT src, n.entity_type AS src_type, tgt, weight FROM e LEFT JOIN n ON e.src = n.name",
    "file_objects": f"WITH {_N} SELECT name AS id, description AS value FROM n WHERE description IS NOT NULL",
    "file_corpus": "SELECT md5(title || chr(10) || text) AS content_md5, length(title || chr(10) || text)::INT AS size FROM (SELECT DISTINCT title, text FROM documents WHERE title IS NOT NULL AND text IS NOT NULL)",
    "file_stories": "SELECT doc_id::VARCHAR AS passage_id, title AS question, CASE WHEN coalesce(source, '') = '' THEN 'other' ELSE source END AS answer, CASE WHEN coalesce(source, '') = '' THEN 1 ELSE 2 END AS answers FROM documents WHERE text IS NOT NULL AND title IS NOT NULL",
    "file_questions": """WITH r AS (SELECT query_id, min({'q': question, 'd': docs, 'g': gold_docs}) AS r FROM query_solution WHERE question IS NOT NULL AND docs IS NOT NULL GROUP BY 1)
SELECT query_id, r.q AS question, 2 AS golds, len(list_distinct(list_filter(r.d, lambda v: v IS NOT NULL AND list_contains(coalesce(r.g, []), v))))::INT AS gold_docs FROM r""",
    "file_instances": "SELECT DISTINCT query_id::VARCHAR AS instance_id, dataset AS db, question FROM query_solution WHERE question IS NOT NULL AND dataset = (SELECT min(dataset) FROM query_solution)",
    "file_extractions": """WITH e AS (SELECT source_id, count(DISTINCT entity_name) AS n FROM entity_nodes WHERE source_id IS NOT NULL AND entity_name IS NOT NULL GROUP BY 1)
SELECT c.chunk_id, coalesce(n, 0)::INT AS entities, n IS NOT NULL AS done FROM (SELECT DISTINCT chunk_id FROM chunk_info WHERE chunk_id IS NOT NULL) c LEFT JOIN e ON c.chunk_id = e.source_id""",
    "file_exports": f"SELECT db_id, t AS table_name, n AS column_name, coalesce(k, 'TEXT') AS type, (row_number() OVER (PARTITION BY db_id, t ORDER BY n) - 1)::INT AS at FROM (SELECT db_id, lower(table_name) AS t, lower(name) AS n, min(type) AS k FROM {_COLUMN} GROUP BY ALL)",
    "file_summaries": f"SELECT db_id || '.' || lower(table_name) AS table_name, lower(name) AS column_name, min(type) AS type, coalesce(bool_or(is_primary_key), false) AS is_primary_key, (CASE WHEN length(db_id || '.' || lower(table_name)) % 2 = 0 THEN 2 ELSE 1 END)::INT AS samples FROM {_COLUMN} GROUP BY ALL",
    "file_template": "SELECT * FROM (VALUES (0, 'system', 16), (1, 'user', 57), (2, 'assistant', 31), (3, 'user', 57), (4, 'assistant', 31)) t(place, role, size)",
}
