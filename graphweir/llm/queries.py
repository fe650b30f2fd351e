"""Queries of this subpackage, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweir.llm import mixing, neighbours, packing, pairs, splitting, topn, unwanted
from graphweir.session import written
from graphweir.sources.tables import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_keys(p1_pieces(spark, d), "chunk_id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(load(spark, d, "chunk_info"), "chunk_id", "content")


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """Of every divided chunk: tokens that pieces hold without repetition, and pieces that break a rule."""
    pieces = p1_pieces(spark, d).where("chunk_id is not null")
    wrong = (F.col("num_tokens") > splitting.LIMIT) | (F.col("shared_tokens") != F.when(F.col("piece") > 0, splitting.OVERLAP).otherwise(0))
    return pieces.groupBy("chunk_id").agg(F.sum(F.col("num_tokens") - F.col("shared_tokens")).alias("tokens"), F.sum(wrong.cast("bigint")).alias("wrong"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(load(spark, d, "query_solution"), load(spark, d, "documents"))


def p3_items(spark: SparkSession, d: str) -> DataFrame:
    answers = load(spark, d, "query_solution").select(F.lit("query").alias("kind"), F.col("query_id").alias("group_id"), F.explode(F.arrays_zip("docs", "doc_scores")).alias("one"))
    scored = answers.select("kind", "group_id", F.col("one.docs").alias("item"), F.col("one.doc_scores").alias("score"))
    nodes = load(spark, d, "cluster_node_data").select(F.lit("cluster").alias("kind"), F.col("cluster_id").alias("group_id"), F.col("name").alias("item"), F.col("flow_value").alias("score"))
    return scored.unionByName(nodes)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(p3_items(spark, d), ["kind", "group_id"], "item", "score", 5).select("kind", "group_id", "item")


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(load(spark, d, "node_embeddings"), "node_id", "node_embeddings", "embedded_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(p4_nearest(spark, d), 0.8)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_texts(load(spark, d, "documents"))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """One row: texts, and those placed wrongly: missing, divided though they fit, with a piece lost or placed twice; and containers overfull."""
    packed = written(p7_containers(spark, d), "containers")  # read twice
    pieces = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("places"), F.sum("n_tokens").alias("tokens"), F.sum(F.when(F.col("n_tokens") == packing.CAPACITY, 1).otherwise(0)).alias("full"))
    texts = load(spark, d, "documents").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    wrong = F.col("n").isNull() | ((F.col("rows") == 1) & ((F.col("n") != F.col("places")) | (F.col("n") != F.greatest(F.ceil(F.col("tokens") / packing.CAPACITY), F.lit(1)))))
    over = packed.groupBy("container").agg(F.sum("n_tokens").alias("used")).agg(F.sum((F.col("used") > packing.CAPACITY).cast("bigint")).alias("overfull"))
    return texts.join(pieces, "doc_id", "left").agg(F.sum("rows").alias("texts"), F.sum(wrong.cast("bigint")).alias("wrong")).join(F.broadcast(over))  # one row each


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per target: whether its share of all tokens is reached to within two blocks, and ``max_repeats`` kept."""
    targets, documents = load(spark, d, "mix_targets"), load(spark, d, "documents")
    shares = p8_shares(spark, d)
    some = documents.where("length(trim(text)) > 0").select("source").distinct().withColumn("some", F.lit(True))
    marked = targets.join(some, "source", "left").select("source", F.when(F.col("some"), F.col("target_share")).otherwise(0.0).alias("own"))
    every = marked.agg(F.sum("own").alias("every"))
    total = shares.agg(F.sum("tokens").alias("total"))
    joined = shares.join(marked, "source").join(F.broadcast(every)).join(F.broadcast(total))  # one row each
    met = F.abs(F.col("actual_share") - F.col("own") / F.col("every")) <= 2 * mixing.BLOCK / F.col("total")
    return joined.select("source", "target_share", met.alias("met"), (F.col("most_uses") <= F.col("max_repeats")).alias("kept"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(p8_mix(spark, d), load(spark, d, "mix_targets"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return unwanted.score_documents(load(spark, d, "documents"), load(spark, d, "review_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).where("unwanted").select("doc_id").distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return unwanted.rates(p9_scores(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_pieces, p1_kept, p2_found, p3_found, p4_found, p4_nearest, p7_containers, p7_kept, p8_mix, p8_shares, p8_kept, p9_found, p9_scores, p9_rates)}

ORACLES: dict[str, str] = {
    "p1_kept": r"""
WITH texts AS (SELECT DISTINCT chunk_id, content FROM chunk_info WHERE chunk_id IS NOT NULL),
sized AS (SELECT chunk_id, len(list_filter(regexp_split_to_array(content, '[ \t\n\r]+'), lambda x: x <> '')) AS n FROM texts)
SELECT chunk_id, sum(n)::BIGINT AS tokens, 0 AS wrong FROM sized WHERE n > 500 GROUP BY chunk_id""",
    "p4_nearest": """
WITH usable AS (
  SELECT node_id, max({'t': embedded_at, 'v': node_embeddings}).v::DOUBLE[96] AS v FROM node_embeddings
  WHERE node_id IS NOT NULL AND len(node_embeddings) = 96
    AND len(list_filter(node_embeddings, lambda x: x IS NOT NULL AND isfinite(x))) = 96
    AND len(list_filter(node_embeddings, lambda x: x <> 0)) > 0
  GROUP BY node_id),
scored AS (SELECT a.node_id AS node, b.node_id AS neighbour, round(array_cosine_similarity(a.v, b.v), 6) AS cosine FROM usable a JOIN usable b ON a.node_id <> b.node_id)
SELECT node, row_number() OVER (PARTITION BY node ORDER BY cosine DESC, neighbour) AS rank, neighbour, cosine FROM scored
QUALIFY rank <= 5""",
    "p7_kept": "SELECT count(*) AS texts, 0 AS wrong, 0 AS overfull FROM documents",
    "p8_kept": "SELECT DISTINCT source, target_share, true AS met, true AS kept FROM mix_targets",
    "p1_found": r"""
SELECT DISTINCT chunk_id FROM chunk_info
WHERE len(list_filter(regexp_split_to_array(content, '[ \t\n\r]+'), lambda x: x <> '')) > 500""",
    "p3_found": """
WITH answers AS (
  SELECT query_id, unnest(docs) AS item, unnest(doc_scores) AS score
  FROM (SELECT query_id, docs[1:least(len(docs), len(doc_scores))] AS docs, doc_scores[1:least(len(docs), len(doc_scores))] AS doc_scores FROM query_solution)),
items AS (
  SELECT 'query' AS kind, query_id AS group_id, item, score FROM answers
  UNION ALL SELECT 'cluster', cluster_id, name, flow_value FROM cluster_node_data),
best AS (
  SELECT kind, group_id, item, max(score) AS score FROM items
  WHERE item IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)
SELECT kind, group_id, item FROM best
QUALIFY row_number() OVER (PARTITION BY kind, group_id ORDER BY score DESC, item) <= 5""",
    "p4_found": """
WITH usable AS (
  SELECT node_id, max(node_embeddings)::DOUBLE[96] AS v FROM node_embeddings
  WHERE node_id IS NOT NULL AND len(node_embeddings) = 96
    AND len(list_filter(node_embeddings, lambda x: x IS NOT NULL AND isfinite(x))) = 96
    AND len(list_filter(node_embeddings, lambda x: x <> 0)) > 0
  GROUP BY node_id),
near AS (
  SELECT a.node_id AS a, b.node_id AS b, round(array_cosine_similarity(a.v, b.v), 6) AS c
  FROM usable a JOIN usable b ON a.node_id <> b.node_id
  QUALIFY row_number() OVER (PARTITION BY a.node_id ORDER BY round(array_cosine_similarity(a.v, b.v), 6) DESC, b.node_id) <= 5)
SELECT DISTINCT least(a, b) AS node_a, greatest(a, b) AS node_b FROM near WHERE c >= 0.8""",
}
