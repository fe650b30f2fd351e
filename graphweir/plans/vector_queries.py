"""Vector queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweir.functions import similarity as sim
from graphweir.operators import kv
from graphweir.operators import vector as vec
from graphweir.providers import HashedWords
from graphweir.sources.tables import load

DIMS = 64


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return vec.usable(load(spark, d, "embeddings"), "vec_id", "embedding", DIMS)


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 20, against all rows."""
    return _keys(spark, d).where(F.col("id") % 20 == 0)


def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    return vec.top_k(_queries(spark, d), _keys(spark, d), 10).select("query_id", "rank", "id", "cosine")


def vector_min_max(spark: SparkSession, d: str) -> DataFrame:
    """Dot products of queries with all rows, scaled within each query."""
    q = _queries(spark, d).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    near = vec.block_knn(_queries(spark, d), _keys(spark, d), 25)
    k = _keys(spark, d)
    pairs = near.select("query_id", "id").join(q, "query_id").join(k, "id")
    return vec.scored(pairs, "query_id", F.col("q"), F.col("v")).select("query_id", "id", F.round("score", 5).alias("score"))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    k = _keys(spark, d)
    return k.select("id", F.round(sim.norm(F.col("v")), 6).alias("norm"), F.round(sim.norm(sim.unit(F.col("v"))), 6).alias("unit_norm"))


def vector_contrast(spark: SparkSession, d: str) -> DataFrame:
    near = vec.block_knn(_queries(spark, d), _keys(spark, d), 5)
    c = F.col("cosine")
    return near.select("query_id", "id", *[F.round(sim.contrast(c, m), 7).alias(m) for m in ("normalized", "relu", "relu_sq")])


def vector_quantized(spark: SparkSession, d: str) -> DataFrame:
    """8-bit levels and what is lost by them."""
    q = _keys(spark, d).select("id", "v", sim.quantize(F.col("v")).alias("q"))
    worst = F.array_max(F.zip_with("v", sim.dequantize(F.col("q")), lambda x, y: F.abs(x - y)))
    return q.select("id", F.aggregate(F.col("q.levels"), F.lit(0), lambda s, x: s + x).alias("levels"), (worst <= (F.col("q.high") - F.col("q.low")) / 510 + 1e-9).alias("within_half_step"))


def vector_label_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the ten nearest rows share the query's label."""
    labels = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    near = vec.block_knn(_queries(spark, d), _keys(spark, d), 10)
    own = labels.select(F.col("id").alias("query_id"), F.col("label").alias("own"))
    return near.join(labels, "id").join(own, "query_id").groupBy("query_id").agg(F.count_if(F.col("label") == F.col("own")).alias("hits"))


def vector_cached_response(spark: SparkSession, d: str) -> DataFrame:
    """Queries answered by the most similar stored row of their label above a cosine."""
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("mode"), "embedding")
    requests = rows.where(F.col("id") % 20 == 0).select(F.col("id").alias("request_id"), "mode", F.lit("").alias("args_hash"), "embedding")
    cache = rows.where(F.col("id") % 20 != 0).select("mode", F.format_string("%08d", "id").alias("args_hash"), "embedding", F.concat(F.lit("r"), F.col("id").cast("string")).alias("response"))
    return kv.cached_response(requests, cache, 0.2)


def vector_hashed_words(spark: SparkSession, d: str) -> DataFrame:
    """Titles embedded by hashed words: non-zero dimensions and the first of them."""
    e = load(spark, d, "documents").where("title is not null").select("doc_id", HashedWords(64).embed(F.col("title")).alias("e"))
    return e.select("doc_id", F.size(F.filter("e", lambda x: x > 0)).alias("dimensions"), F.round(F.array_max("e"), 6).alias("largest"))


QUERIES = {f.__name__: f for f in (vector_top_k, vector_min_max, vector_norms, vector_contrast, vector_quantized, vector_label_recall, vector_cached_response, vector_hashed_words)}

_PAIRS = """k AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT id AS query_id, v AS q FROM k WHERE id % 20 = 0),
c AS (SELECT query_id, id, round(list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))), 6) AS cosine, q, v FROM q, k WHERE query_id <> id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM c)"""

ORACLES = {
    "vector_top_k": f"WITH {_PAIRS} SELECT query_id, rank::INT AS rank, id, cosine FROM r WHERE rank <= 10 AND cosine >= 0.2",
    "vector_min_max": f"""
WITH {_PAIRS}, p AS (SELECT query_id, id, list_dot_product(q, v) AS raw FROM r WHERE rank <= 25)
SELECT query_id, id, round((raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w), 5) AS score FROM p WINDOW w AS (PARTITION BY query_id)""",
    "vector_norms": "SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, 1.0 AS unit_norm FROM embeddings",
    "vector_contrast": f"""
WITH {_PAIRS} SELECT query_id, id, round(greatest((cosine + 1) / 2, 0), 7) AS normalized, round(greatest(cosine, 0), 7) AS relu, round(greatest(cosine, 0) * greatest(cosine, 0), 7) AS relu_sq FROM r WHERE rank <= 5""",
    "vector_quantized": """
WITH k AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT id, list_sum(list_transform(v, lambda x: round((x - list_min(v)) / (list_max(v) - list_min(v)) * 255)))::INT AS levels, true AS within_half_step FROM k""",
    "vector_label_recall": f"WITH {_PAIRS} SELECT query_id, count(CASE WHEN a.label = b.label THEN 1 END) AS hits FROM r JOIN embeddings a ON a.vec_id = id JOIN embeddings b ON b.vec_id = query_id WHERE rank <= 10 GROUP BY query_id",
    "vector_cached_response": """
WITH k AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT a.id AS request_id, b.id AS id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s FROM k a JOIN k b USING (label) WHERE a.id % 20 = 0 AND b.id % 20 <> 0)
SELECT request_id, 'r' || id AS response, round(s, 6) AS similarity FROM c WHERE s > 0.2 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round(s, 6) DESC, id) = 1""",
    "vector_hashed_words": r"""
WITH t AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(lower(title), '[ \t\n\r\f]+'), lambda x: x <> ''), lambda w: (('0x' || md5(w)[1:7])::INT) % 64) AS b FROM documents WHERE title IS NOT NULL),
c AS (SELECT doc_id, list_transform(range(64), lambda k: len(list_filter(b, lambda x: x = k))::DOUBLE) AS c FROM t)
SELECT doc_id, len(list_filter(c, lambda x: x > 0))::INT AS dimensions, round(CASE WHEN list_sum(c) > 0 THEN list_max(c) / sqrt(list_dot_product(c, c)) ELSE 0.0 END, 6) AS largest FROM c""",
}
