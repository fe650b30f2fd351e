"""Vector stores and searches.

Queries are a table, never a loop. A stated query set meets all rows in blocks
(``block_knn``): keys are cut into blocks by hash, queries are copied once per
block, each block is one dense product in an Arrow batch, and only the k best
of a block leave it; the query set must be bounded, which is checked. Vectors
of unequal length, with nulls or all zero take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweir.functions.similarity import cosine, dot, min_max, norm

SCORE_FLOOR = 0.2
#: Most queries of one exact search, since each block holds them all; beyond, search in parts or use the forest.
MOST_QUERIES = 100_000


def usable(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    v = F.col(vector)
    rows = df.select(F.col(key).alias("id"), v.cast("array<double>").alias("v"))
    whole = (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & whole)


def block_knn(queries: DataFrame, keys: DataFrame, k: int, floor: float | None = None, digits: int = 6, block_rows: int = 20_000, most_queries: int = MOST_QUERIES, part: str | None = None) -> DataFrame:
    """Exact k nearest keys by cosine for each query: query_id, id, cosine, rank.

    Both inputs are (id, v), and with ``part`` a column that queries and keys
    must share to meet. A query is no neighbour of itself. Ties go to the
    smaller id.
    """
    n_queries = queries.count()
    if n_queries > most_queries:
        raise ValueError(f"{n_queries} queries; search in parts of {most_queries}")
    blocks = max(1, -(-keys.count() // block_rows))
    share = F.col(part).cast("string").alias("part") if part else F.lit("").alias("part")
    tagged = keys.select(share, F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(False).alias("asks"), "id", "v")
    asked = queries.select(share, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), F.lit(True).alias("asks"), "id", "v")

    def search(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ask = frame["asks"].to_numpy(bool)
        q, s = frame[ask], frame[~ask]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not len(q) or not len(s):
            return pd.DataFrame({"query_id": q["id"].to_numpy(object)[:0], "id": s["id"].to_numpy(object)[:0], "cosine": np.zeros(0)})
        a, b = np.stack(q["v"].to_numpy()), np.stack(s["v"].to_numpy())
        a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
        q_id, s_id = q["id"].to_numpy(object), s["id"].to_numpy(object)
        order_of_id = np.argsort(np.argsort(s_id, kind="stable"))
        for first in range(0, len(a), 1000):
            c = np.round(a[first : first + 1000] @ b.T, digits)
            c[q_id[first : first + 1000, None] == s_id[None, :]] = -9
            take = min(k, c.shape[1])
            kth = -np.partition(-c, take - 1, axis=1)[:, take - 1]
            for row in range(len(c)):
                near = np.flatnonzero(c[row] >= kth[row])
                near = near[np.lexsort((order_of_id[near], -c[row, near]))][:take]
                near = near[c[row, near] >= (-2 if floor is None else floor)]
                found.append((np.full(len(near), q_id[first + row], object), s_id[near], c[row, near]))
        return pd.DataFrame({n: np.concatenate(x) for n, x in zip(("query_id", "id", "cosine"), zip(*found, strict=True), strict=True)})

    kind = keys.schema["id"].dataType.simpleString()
    found = tagged.unionByName(asked).groupBy("part", "block").applyInPandas(search, f"query_id {kind}, id {kind}, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, keys: DataFrame, k: int, floor: float = SCORE_FLOOR) -> DataFrame:
    """Top k with a score floor."""
    return block_knn(queries, keys, k, floor)


def scored(pairs: DataFrame, query: str, left: Column, right: Column) -> DataFrame:
    """Dot products scaled to [0, 1] within each query."""
    return pairs.withColumn("raw", dot(left, right)).withColumn("score", min_max(F.col("raw"), query))


def by_entity(vectors: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """Vectors left after deleting entities by name."""
    return vectors.join(gone.select(F.col("name").alias(name)), name, "left_anti")


def relations_without(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    """Relation vectors left after deleting those that touch an entity at either end."""
    g = gone.select("name")
    left = vectors.join(g, vectors["src_id"] == g["name"], "left_anti")
    return left.join(g, left["tgt_id"] == g["name"], "left_anti")


def or_zero(v: Column, dims: int) -> Column:
    """A vector, or zeros where none could be made."""
    return F.when(F.size(v) == dims, v).otherwise(F.array_repeat(F.lit(0.0), dims))


def norms(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(key, norm(F.col(vector)).alias("norm"))


def synonym_edges(keys: DataFrame, names: DataFrame, threshold: float, most: int = 101, k: int = 2047) -> DataFrame:
    """Edges between similar entities: names of more than two letters or digits, at least
    ``threshold``, the ``most`` nearest. Columns src, tgt, weight."""
    long = names.where(F.length(F.regexp_replace("name", "[^A-Za-z0-9]", "")) > 2).select("id")
    asking = keys.join(long, "id", "left_semi")
    near = block_knn(asking, keys, min(k, most), threshold)
    return near.select(F.col("query_id").alias("src"), F.col("id").alias("tgt"), F.col("cosine").alias("weight"))


__all__ = ["block_knn", "by_entity", "cosine", "norms", "or_zero", "relations_without", "scored", "synonym_edges", "top_k", "usable"]
