"""The three pipelines end to end, over batches of queries and offline providers.

* passages: documents become chunks, facts and a graph of entities and
  passages; questions are answered by ranked passages, through query-aware
  diffusion from the entities of the best facts.
* entities: a graph of merged entities and relations; questions give context
  rows under token budgets, from local, global or both levels.
* schemas: a graph of tables and columns; questions give the tables and
  columns that they need, as DDL.

A model-backed provider (extractor, embedder, reranker) takes the place of an
offline one by being registered; the plans stay the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweir.config import PassageSettings, QuerySettings
from graphweir.functions.similarity import cosine01, dot, min_max
from graphweir.operators import diffusion, graph, retrieval, text, vector
from graphweir.operators import schema_graph as sg
from graphweir.providers import HashedWords, capitalised_runs
from graphweir.session import checkpointed, written

#: Words that a greater share of passages hold are stop words of the passage index.
COMMON_SHARE = 0.05


def extract_facts(chunks: DataFrame) -> DataFrame:
    """Facts without a model: entities (runs of capitalised words) that follow each other in a sentence.

    Chunks (chunk_id, content); facts (chunk, s, p, o, fact_id).
    """
    sentences = chunks.select("chunk_id", F.explode(F.split("content", r"(?<=[.!?])\s+|\n+")).alias("sentence"))
    found = sentences.select("chunk_id", capitalised_runs(F.col("sentence")).alias("e")).where("size(e) > 1")
    pairs = found.select("chunk_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("e") - 1), lambda k: F.struct(F.element_at("e", k).alias("s"), F.element_at("e", k + 1).alias("o")))).alias("x"))
    return text.facts(pairs.select("chunk_id", "x.s", F.lit("next to").alias("p"), "x.o"), "chunk_id", "s", "p", "o").where("s != o")


def passage_graph(chunks: DataFrame, facts: DataFrame, settings: PassageSettings, dims: int = 64) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, kind) and undirected edges of entities and passages, similar entities joined too; entity names and chunk ids are told apart by prefix."""
    named = facts.select(F.concat(F.lit("chunk:"), "chunk").alias("chunk"), F.concat(F.lit("entity:"), "s").alias("s"), "p", F.concat(F.lit("entity:"), "o").alias("o"))
    fact, passage = graph.fact_edges(named), graph.passage_edges(named)
    entities = facts.select(F.explode(F.array("s", "o")).alias("name")).distinct().select(F.col("name").alias("id"), "name", HashedWords(dims).embed(F.col("name")).alias("v"))
    entities = written(entities.where(F.exists("v", lambda x: x != 0)), "entity-vectors")
    similar = vector.synonym_edges(entities.select("id", "v"), entities.select("id", "name"), settings.synonymy_threshold, settings.synonymy_most, settings.synonymy_top_k)
    synonym = similar.select(F.concat(F.lit("entity:"), "src").alias("src"), F.concat(F.lit("entity:"), "tgt").alias("tgt"), "weight")
    edges = graph.combine(synonym, passage, fact)
    nodes = named.select(F.explode(F.array("s", "o")).alias("name")).distinct().withColumn("kind", F.lit("entity")).unionByName(chunks.select(F.concat(F.lit("chunk:"), "chunk_id").alias("name")).distinct().withColumn("kind", F.lit("passage")))
    return nodes, graph.parallel(graph.guarded(edges, nodes)).groupBy("src", "tgt").agg(F.sum("weight").alias("weight"))


def retrieve_passages(questions: DataFrame, chunks: DataFrame, settings: PassageSettings | None = None, dims: int = 64) -> DataFrame:
    """Ranked passages for questions (query_id, question): query_id, rank, chunk_id, score.

    Facts and passages are scored where they share a telling word with the
    question, so that these meet by words and not by a product of tables; a
    question that has words, but no telling one, is met with all passages by an
    exact block search. A question whose facts lead to no passage falls back to
    passages scored alone.
    """
    settings = settings or PassageSettings()
    embedder = HashedWords(dims)
    chunks = written(chunks.select("chunk_id", "content").dropDuplicates(["chunk_id"]), "chunks")
    facts = written(extract_facts(chunks), "facts")
    nodes, edges = passage_graph(chunks, facts, settings, dims)
    edges = written(edges, "edges")
    q = written(questions.select("query_id", "question").distinct().withColumn("q", embedder.embed(F.col("question"))), "questions")
    words_of = lambda df, key, c: df.select(*key, F.explode(F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 3))).alias("w"))
    asked = words_of(q, ["query_id"], "question")
    # stored vectors are far smaller than in memory, so their joins are not left to size estimates
    # dense ranking of the passages that share a telling word; words of many passages tell nothing
    index = written(words_of(chunks, ["chunk_id"], "content"), "index")
    most = max(10, int(COMMON_SHARE * chunks.count()))
    common = index.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("w")
    telling = written(asked.join(common, "w", "left_anti"), "asked")
    met = telling.join(index, "w").select("query_id", "chunk_id").distinct()
    vectors = written(chunks.select("chunk_id", embedder.embed(F.col("content")).alias("v")), "chunk-vectors")
    dense = met.join(vectors.hint("merge"), "chunk_id").join(q.select("query_id", "q"), "query_id").select("query_id", F.concat(F.lit("chunk:"), "chunk_id").alias("node"), dot(F.col("q"), F.col("v")).alias("raw"))
    # questions of common words alone: all passages, the best that are retrieved at most
    plain = asked.join(index.select("w").distinct(), "w", "left_semi").select("query_id").distinct().join(met, "query_id", "left_anti").join(q, "query_id")
    plain = written(plain.where(F.exists("q", lambda x: x != 0)).select(F.concat(F.lit("question:"), F.col("query_id").cast("string")).alias("id"), "query_id", F.col("q").alias("v")), "plain")
    keys = vectors.where(F.exists("v", lambda x: x != 0)).select(F.concat(F.lit("chunk:"), "chunk_id").alias("id"), "v")
    close = vector.block_knn(plain.select("id", "v"), keys, settings.retrieval_top_k).select(F.col("query_id").alias("asker"), F.col("id").alias("node"))
    close = close.join(plain.select(F.col("id").alias("asker"), "query_id", F.col("v").alias("q")), "asker").join(keys.withColumnRenamed("id", "node").hint("merge"), "node")
    dense = dense.unionByName(close.select("query_id", "node", dot(F.col("q"), F.col("v")).alias("raw")))
    dense = written(dense.withColumn("score", min_max(F.col("raw"), "query_id")).select("query_id", "node", "score"), "dense")
    # facts, entity seeds
    label = F.concat_ws(" ", "s", "p", "o")
    one = written(facts.select("fact_id", "s", "p", "o").dropDuplicates(["fact_id"]).withColumn("fv", embedder.embed(label)), "fact-vectors")
    words_asked = telling.unionByName(asked.join(plain.select("query_id"), "query_id", "left_semi").select(*telling.columns))
    fact_met = words_asked.join(words_of(one.withColumn("t", label), ["fact_id"], "t"), "w").select("query_id", "fact_id").distinct()
    fact_scores = fact_met.join(one.hint("merge"), "fact_id").join(q.select("query_id", "q"), "query_id").select("query_id", "fact_id", "s", "o", dot(F.col("q"), F.col("fv")).alias("raw"))
    top = retrieval.best(fact_scores.withColumn("score", min_max(F.col("raw"), "query_id")), ["query_id"], "score", "fact_id", settings.linking_top_k)
    seeds = retrieval.entity_seeds(top, graph.entity_chunks(facts), settings.linking_top_k).select("query_id", F.concat(F.lit("entity:"), "node").alias("node"), "weight")
    all_seeds = diffusion.seed_weights(retrieval.combined_seeds(seeds, dense, settings.passage_node_weight))
    # similarity of the nodes that a question can reach in the rounds given; others are not touched
    near = written(all_seeds.select("query_id", "node").distinct(), "near")
    for _ in range(settings.rounds):
        step = near.join(edges.select(F.col("src").alias("node"), "tgt"), "node").select("query_id", F.col("tgt").alias("node"))
        near = written(near.unionByName(step).distinct(), "near")
    entities = nodes.where("kind = 'entity'").select(F.col("name").alias("node"), embedder.embed(F.substring_index("name", ":", -1)).alias("v"))
    node_vectors = written(entities.unionByName(vectors.select(F.concat(F.lit("chunk:"), "chunk_id").alias("node"), "v")), "node-vectors")
    sim = near.join(node_vectors.hint("merge"), "node").join(q.select("query_id", "q"), "query_id").select("query_id", "node", cosine01(F.col("q"), F.col("v")).alias("sim"))
    mass = diffusion.source_mass(all_seeds.withColumn("source", F.lit("")), settings.alpha)
    x = diffusion.diffuse(diffusion.query_edges(edges, written(sim, "similarity"), settings.edge_weight_scheme), diffusion.capacities(edges, nodes), mass, settings.rounds, settings.epsilon, settings.step)
    ranked = diffusion.passages(x, nodes.where("kind = 'passage'").select(F.col("name").alias("node"))).select("query_id", "node", "score")
    both = retrieval.or_fallback(ranked, dense)
    out = retrieval.best(both, ["query_id"], "score", "node", settings.retrieval_top_k)
    return out.select("query_id", "rank", F.substring_index("node", ":", -1).alias("chunk_id"), "score")


def entity_context(questions: DataFrame, nodes: DataFrame, edges: DataFrame, sources: DataFrame, chunks: DataFrame, settings: QuerySettings | None = None) -> DataFrame:
    """Context rows (query_id, section, position, text, tokens) of questions over a merged entity graph.

    ``nodes`` (name, entity_type, description), ``edges`` (src, tgt, weight),
    ``sources`` (name, chunk), ``chunks`` (chunk, content). Local mode gives
    entities and their text units, global mode relations, hybrid all, each
    section a prefix under its token budget.
    """
    s = settings or QuerySettings()
    words_of = lambda df, key, c: df.select(*key, F.explode(F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 3))).alias("w"))
    asked = words_of(questions, ["query_id"], "question")
    named = words_of(nodes, ["name"], "name")
    rare = named.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    scored = asked.join(named, "w").join(rare, "w").groupBy("query_id", "name").agg(F.sum(1.0 / F.col("n")).alias("score"))
    entities = retrieval.best(scored, ["query_id"], "score", "name", s.max_source_nodes).select("query_id", (F.col("rank") - 1).alias("position"), "name")
    entities = checkpointed(entities)
    parts = []
    if s.mode in ("local", "hybrid"):
        context = retrieval.entity_context(entities, nodes, graph.degrees(edges))
        parts.append(_section(context.select("query_id", F.lit("entities").alias("section"), F.col("id").alias("position"), retrieval.csv_line(F.col("id"), F.col("entity"), F.col("entity_type"), F.col("description"), F.col("rank")).alias("text")), s.max_token_for_local_context))
        units = retrieval.text_units(entities, sources, edges).join(chunks, "chunk")
        parts.append(_section(units.select("query_id", F.lit("sources").alias("section"), F.col("rank").alias("position"), F.col("content").alias("text")), s.max_token_for_text_unit))
    if s.mode in ("global", "hybrid"):
        touched = entities.join(edges, entities["name"] == edges["src"]).select("query_id", "position", "src", "tgt", "weight")
        order = F.row_number().over(Window.partitionBy("query_id").orderBy("position", F.col("weight").desc(), "tgt"))
        parts.append(_section(touched.select("query_id", F.lit("relations").alias("section"), order.alias("position"), retrieval.csv_line(F.col("src"), F.col("tgt"), F.round("weight", 3)).alias("text")), s.max_token_for_global_context))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _section(rows: DataFrame, budget: int) -> DataFrame:
    counted = rows.withColumn("tokens", F.size(F.split(F.trim("text"), r"\s+")))
    return retrieval.token_prefix(counted, ["query_id"], [F.col("position")], "tokens", budget).drop("used")


def schema_context(questions: DataFrame, columns: DataFrame, tables: int = 5) -> DataFrame:
    """The tables of its database that a question (query_id, db_id, question) shares most words with, as DDL."""
    words_of = lambda df, key, c: df.select(*key, F.explode(F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))).alias("w"))
    c = sg.columns_of(columns)
    named = words_of(c.withColumn("t", F.translate(F.concat_ws(" ", "table_name", "column_name"), "_", " ")), ["db_id", "table_name"], "t").distinct()
    scored = words_of(questions, ["query_id", "db_id"], "question").join(named, ["db_id", "w"]).groupBy("query_id", "db_id", "table_name").agg(F.count(F.lit(1)).cast("double").alias("score"))
    chosen = retrieval.best(scored, ["query_id"], "score", "table_name", tables)
    return chosen.join(sg.render_tables(columns), ["db_id", "table_name"]).select("query_id", "rank", "table_name", "ddl")
