"""Keyed tables: Parquet tables read as DataFrames, changed by joins.

Upserts insert if absent: a stored row is never overwritten. Repeated keys in
a batch keep one row (the last by the given order). Null keys are not stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweir.functions.identity import content_id
from graphweir.functions.text import strip
from graphweir.operators.vector import block_knn


def keys(table: DataFrame, key: str) -> DataFrame:
    return table.select(key)


def get(table: DataFrame, key: str, value: object) -> DataFrame:
    return table.where(F.col(key) == value)


def get_many(table: DataFrame, key: str, requested: DataFrame, asked: str, order: list[str], fields: list[str]) -> DataFrame:
    """A row per request, null fields for misses. ``order`` are columns that place a request and stay in its row: rows of a
    table have no other order, and who shows them sorts by it."""
    stored = table.select(F.col(key).alias("__key"), *fields)
    return requested.join(stored, requested[asked] == F.col("__key"), "left").drop("__key").select(asked, *order, *fields)


def new_keys(batch: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return batch.where(F.col(key).isNotNull()).join(table.select(key), key, "left_anti")


def insert_absent(table: DataFrame, batch: DataFrame, key: str, order: Column) -> tuple[DataFrame, DataFrame]:
    """The table after the upsert, and the rows that were inserted."""
    last = Window.partitionBy(key).orderBy(order.desc())
    one = batch.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    added = one.join(table.select(key), key, "left_anti").select(*table.columns)
    return table.unionByName(added), added


def insert_texts(texts: DataFrame, text: str, order: str, prefix: str, stored: DataFrame | None = None) -> DataFrame:
    """Content-hash dedup: one row per distinct non-blank text not stored yet (hash_id, content)."""
    rows = texts.where(strip(F.col(text)) != "").select(content_id(prefix, F.col(text)).alias("hash_id"), F.col(text).alias("content"), F.col(order).alias("__order"))
    one = rows.groupBy("hash_id").agg(F.max_by("content", "__order").alias("content"))
    return one if stored is None else one.join(stored.select("hash_id"), "hash_id", "left_anti")


def delete(table: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def cached_response(requests: DataFrame, cache: DataFrame, threshold: float = 0.95) -> DataFrame:
    """The stored response per request: that of its own hash, else the most similar one above a cosine.

    Requests (request_id, mode, args_hash, embedding), a bounded batch; cache
    (mode, args_hash, embedding, response). Rows meet only within a mode, in
    blocks; ties go to the smaller hash.
    """
    exact = requests.join(cache.select("mode", "args_hash", "response"), ["mode", "args_hash"]).groupBy("request_id").agg(F.min("response").alias("response")).withColumn("similarity", F.lit(1.0))
    left = requests.join(exact.select("request_id"), "request_id", "left_anti")
    queries = left.select(F.concat(F.lit("?"), F.col("request_id").cast("string")).alias("id"), F.col("embedding").cast("array<double>").alias("v"), "mode")
    keys_ = cache.select(F.col("args_hash").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "mode", "response")
    near = block_knn(queries, keys_.select("id", "v", "mode"), 1, part="mode").where(F.col("cosine") > threshold)
    best = near.join(keys_.select("id", "response").dropDuplicates(["id"]), "id")
    similar = left.select("request_id", F.concat(F.lit("?"), F.col("request_id").cast("string")).alias("query_id")).join(best, "query_id").select("request_id", "response", F.col("cosine").alias("similarity"))
    return exact.unionByName(similar)


def drop(table: DataFrame) -> DataFrame:
    """The table without its rows; its columns stay."""
    return table.where(F.lit(False))


def missing(requested: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Distinct keys asked for that are not stored."""
    return new_keys(requested.select(key).distinct(), table, key)
