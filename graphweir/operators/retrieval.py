"""Seed selection, ranking and context assembly for batches of queries.

Everything is keyed by query_id; ranks have an id as tie-break. Contexts are
rows until they are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASSAGE_WEIGHT = 0.05


def ranked(df: DataFrame, partition: list[str], score: str, tie: str, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(F.col(score).desc(), tie)))


def best(df: DataFrame, partition: list[str], score: str, tie: str, k: int) -> DataFrame:
    return ranked(df, partition, score, tie).where(F.col("rank") <= k)


def closest_candidate(returned: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each returned fact's candidate of least edit distance within its query (ties to the smaller id)."""
    pairs = returned.join(candidates, "query_id").withColumn("distance", F.levenshtein("fact", "candidate"))
    return pairs.groupBy("query_id", "fact").agg(F.min(F.struct("distance", "fact_id")).getField("fact_id").alias("fact_id"))


def or_fallback(chosen: DataFrame, fallback: DataFrame, key: str = "query_id") -> DataFrame:
    """The chosen rows, and the fallback's for keys that have none."""
    return chosen.unionByName(fallback.join(chosen.select(key).distinct(), key, "left_anti").select(*chosen.columns))


def entity_seeds(facts: DataFrame, entity_chunks: DataFrame, k: int) -> DataFrame:
    """Seed weights of entities of scored facts (query_id, s, o, score): the mean over occurrences
    of score / chunks of the entity; the k best per query."""
    ends = facts.select("query_id", "score", F.explode(F.array("s", "o")).alias("name"))
    weighed = ends.join(entity_chunks, "name").groupBy("query_id", "name").agg(F.avg(F.col("score") / F.greatest("chunks", F.lit(1))).alias("weight"))
    return best(weighed, ["query_id"], "weight", "name", k).select("query_id", F.col("name").alias("node"), "weight")


def combined_seeds(entities: DataFrame, passages: DataFrame, passage_weight: float = PASSAGE_WEIGHT) -> DataFrame:
    """Entity seeds plus min-max passage scores times a small weight, summed per node."""
    p = passages.select("query_id", "node", (F.col("score") * passage_weight).alias("weight"))
    return entities.unionByName(p).groupBy("query_id", "node").agg(F.sum("weight").alias("weight"))


def token_prefix(df: DataFrame, partition: list[str], order: list[Column], tokens: str, budget: int) -> DataFrame:
    """Rows in order while their running token count stays within the budget: a prefix, ended by the first overflow."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def text_units(entities: DataFrame, sources: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks of seed entities (query_id, position, name), best first.

    ``sources`` is (name, chunk). A chunk's order is the first position of an
    entity it belongs to; its relation count, how many out-neighbours of these
    entities share it.
    """
    own = entities.join(sources, "name").select("query_id", "position", "name", "chunk")
    near = edges.select(F.col("src").alias("name"), F.col("tgt").alias("other")).distinct().join(sources.select(F.col("name").alias("other"), "chunk").distinct(), "other")
    shared = own.join(near, ["name", "chunk"]).groupBy("query_id", "chunk").agg(F.count(F.lit(1)).alias("relations"))
    first = own.groupBy("query_id", "chunk").agg(F.min("position").alias("order"))
    rows = first.join(shared, ["query_id", "chunk"], "left").select("query_id", "chunk", "order", F.coalesce("relations", F.lit(0)).alias("relations"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("order", F.col("relations").desc(), "chunk")))


def entity_context(entities: DataFrame, nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """Context rows of entities in order: id from 0, entity, type, description, rank (degree)."""
    rows = entities.join(nodes, "name", "left").join(degrees, "name", "left")
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("position")) - 1
    return rows.select("query_id", at.alias("id"), F.col("name").alias("entity"), F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type"), F.coalesce("description", F.lit("UNKNOWN")).alias("description"), F.coalesce("degree", F.lit(0)).alias("rank"))


def csv_line(*columns: Column) -> Column:
    """A line of comma-separated values, quoted where they hold a comma, quote or line end."""

    def cell(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *[cell(c) for c in columns])


def csv_context(rows: DataFrame, partition: str, order: str, columns: list[str], header: bool = True) -> DataFrame:
    """One CSV text per partition."""
    lines = rows.groupBy(partition).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), csv_line(*[F.col(c) for c in columns]).alias("l")))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["l"]), "\n")
    return lines.select(partition, (F.concat(F.lit(",".join(columns) + "\n"), body) if header else body).alias("context"))


def combine_contexts(high: DataFrame, low: DataFrame, partition: str, columns: list[str]) -> DataFrame:
    """High-level rows before low-level ones, repeats dropped keeping the first, numbered from 1. Inputs have ``id``."""
    both = high.select(partition, F.lit(0).alias("level"), "id", *columns).unionByName(low.select(partition, F.lit(1).alias("level"), "id", *columns))
    first = both.groupBy(partition, *columns).agg(F.min(F.struct("level", "id")).alias("at"))
    return first.select(partition, F.row_number().over(Window.partitionBy(partition).orderBy("at.level", "at.id", *columns)).alias("id"), *columns)


def hybrid(local: DataFrame, global_: DataFrame, partition: str, columns: list[str]) -> DataFrame:
    """Both branches in order, numbered anew, repeats kept."""
    both = local.select(partition, F.lit(0).alias("level"), "id", *columns).unionByName(global_.select(partition, F.lit(1).alias("level"), "id", *columns))
    return both.select(partition, (F.row_number().over(Window.partitionBy(partition).orderBy("level", "id", *columns)) - 1).alias("id"), *columns)


def cluster_summary(scores: DataFrame) -> DataFrame:
    """A sentence per cluster without any model: its source, three strongest nodes and range of flow."""
    top = best(scores, ["query_id", "source"], "x", "node", 3).groupBy("query_id", "source").agg(F.array_sort(F.collect_list(F.struct("rank", "node"))).alias("t"))
    sizes = scores.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    names = F.array_join(F.transform("t", lambda x: x["node"].cast("string")), ", ")
    text = F.concat(F.lit("Around "), F.col("source").cast("string"), F.lit(" "), F.col("n").cast("string"), F.lit(" nodes, led by "), names, F.lit(", with flow from "), F.format_string("%.3f", F.round("low", 3)), F.lit(" to "), F.format_string("%.3f", F.round("high", 3)), F.lit("."))
    return sizes.join(top, ["query_id", "source"]).select("query_id", "source", text.alias("summary"))


def split_summaries(df: DataFrame, key: str, output: str, expected: str) -> DataFrame:
    """Sections ``Cluster i:`` of a batch answer, one row each; missing ones are empty."""
    number = F.explode(F.sequence(F.lit(1), F.col(expected)))
    rows = df.where(F.col(expected) >= 1).select(key, output, number.alias("cluster"))
    pattern = F.concat(F.lit(r"(?s)Cluster "), F.col("cluster").cast("string"), F.lit(r":\s*(.*?)\s*(?:Cluster [0-9]+:|$)"))
    return rows.select(key, "cluster", F.coalesce(F.call_function("regexp_extract", F.col(output), pattern, F.lit(1)), F.lit("")).alias("summary"))


def prompt(template: str, **columns: Column) -> Column:
    """A template with {name} places filled by columns."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if k % 2 == 0 else F.coalesce(columns[p].cast("string"), F.lit("")) for k, p in enumerate(parts)])
