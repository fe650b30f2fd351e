"""Text and extraction operators.

All are narrow maps or one aggregation. Null and blank texts give no chunk, no
record, no triple; very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweir.functions import identity
from graphweir.functions.text import clean, is_float, phrase, strip, words

RECORD, FIELD, COMPLETE = "##", "<|>", "<|COMPLETE|>"
SEP = "<SEP>"


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of an array; a last window wholly inside the overlap is given too."""
    step = size - overlap if size > overlap else size
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(step)))
    return F.transform(starts, lambda s: F.slice(tokens, s + 1, F.lit(size)))


def token_chunks(df: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 100) -> DataFrame:
    """Chunks of ``size`` tokens: key, chunk_order_index, content, tokens, chunk_id."""
    source = df.select(F.col(key).alias("k"), words(F.col(text)).alias("w"))
    cut = source.select("k", F.posexplode(windows(F.col("w"), size, overlap)).alias("chunk_order_index", "part"))
    content = strip(F.array_join("part", " "))
    return cut.select(F.col("k").alias(key), "chunk_order_index", content.alias("content"), F.size("part").alias("tokens"), identity.chunk_id(content).alias("chunk_id"))


def word_chunks(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of ``size`` words; a text of no more words is its own chunk, unchanged."""
    source = df.select(F.col(key).alias("k"), F.col(text).alias("t"), words(F.col(text)).alias("w"))
    joined = F.transform(windows(F.col("w"), size, overlap), lambda p: F.array_join(p, " "))
    parts = F.when(F.size("w") <= size, F.array("t")).otherwise(joined)
    cut = source.where("size(w) > 0").select("k", F.posexplode(parts).alias("chunk_order_index", "content"))
    return cut.select(F.col("k").alias(key), "chunk_order_index", "content", identity.chunk_id(F.col("content")).alias("chunk_id"))


def render_records(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Model output in the record notation, one text per source (for round trips)."""
    quote = lambda c: F.concat(F.lit('"'), F.coalesce(F.col(c), F.lit("")), F.lit('"'))
    entity = F.concat(F.lit('("entity"'), F.lit(FIELD), quote("name"), F.lit(FIELD), quote("type"), F.lit(FIELD), quote("description"), F.lit(")"))
    relation = F.concat(F.lit('("relationship"'), F.lit(FIELD), quote("src"), F.lit(FIELD), quote("tgt"), F.lit(FIELD), quote("description"), F.lit(FIELD), quote("keywords"), F.lit(FIELD), F.coalesce(F.col("weight").cast("string"), F.lit("")), F.lit(")"))
    rows = entities.select("source", entity.alias("r")).unionByName(relations.select("source", relation.alias("r")))
    return rows.groupBy("source").agg(F.concat(F.array_join(F.array_sort(F.collect_list("r")), RECORD), F.lit(COMPLETE)).alias("output"))


def _records(outputs: DataFrame, source: str, output: str) -> DataFrame:
    parts = F.split(F.replace(F.col(output), F.lit(COMPLETE), F.lit(RECORD)), RECORD)
    body = F.regexp_extract(F.col("part"), r"(?s)\((.*)\)", 1)
    fields = F.transform(F.split(body, r"<\|>"), lambda x: F.regexp_replace(clean(x), r'^"|"$', ""))
    return outputs.select(F.col(source).alias("source"), F.explode(parts).alias("part")).select("source", fields.alias("f"))


def parse_entities(outputs: DataFrame, source: str = "source", output: str = "output") -> DataFrame:
    """Entity records: source, name, type, description. Others and short ones are passed over."""
    r = _records(outputs, source, output).where((F.size("f") >= 4) & (F.get("f", F.lit(0)) == "entity"))
    return r.select("source", F.get("f", F.lit(1)).alias("name"), F.get("f", F.lit(2)).alias("type"), F.get("f", F.lit(3)).alias("description")).where("name != ''")


def parse_relations(outputs: DataFrame, source: str = "source", output: str = "output") -> DataFrame:
    """Relation records: source, src, tgt, description, keywords, weight (the last field if a number, else 1)."""
    r = _records(outputs, source, output).where((F.size("f") >= 5) & (F.get("f", F.lit(0)) == "relationship"))
    last = F.element_at("f", -1)
    return r.select("source", F.get("f", F.lit(1)).alias("src"), F.get("f", F.lit(2)).alias("tgt"), F.get("f", F.lit(3)).alias("description"), F.get("f", F.lit(4)).alias("keywords"), F.when(is_float(last), last.cast("double")).otherwise(F.lit(1.0)).alias("weight"))


def valid_triples(triples: Column) -> Column:
    """Arrays of exactly three parts, repeats dropped, order kept."""
    return F.array_distinct(F.filter(triples, lambda t: F.size(t) == 3))


def facts(df: DataFrame, chunk: str, s: str, p: str, o: str) -> DataFrame:
    """Distinct normalised triples per chunk: chunk, s, p, o, fact_id. Triples with an empty part are dropped."""
    t = df.select(F.col(chunk).alias("chunk"), phrase(F.col(s)).alias("s"), phrase(F.col(p)).alias("p"), phrase(F.col(o)).alias("o"))
    t = t.where("s != '' and p != '' and o != ''").distinct()
    return t.withColumn("fact_id", identity.fact_id(F.col("s"), F.col("p"), F.col("o")))


def triple_entities(facts_: DataFrame) -> DataFrame:
    """Entities of triples per chunk: chunk, entity, entity_id."""
    e = facts_.select("chunk", F.explode(F.array("s", "o")).alias("entity")).distinct()
    return e.withColumn("entity_id", identity.content_id("entity-", F.col("entity")))


def merge_nodes(df: DataFrame, name: str, kind: str, description: str, source: str) -> DataFrame:
    """One node per name: its most frequent type (ties to the smaller), sorted distinct descriptions and sources.

    Types are counted per (name, type) first, so that a hot name is merged from
    partial counts.
    """
    rows = df.select(F.col(name).alias("name"), F.coalesce(F.col(kind), F.lit("UNKNOWN")).alias("type"), F.col(description).alias("description"), F.col(source).alias("source")).where("name is not null")
    per_type = rows.groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"), F.collect_set("description").alias("d"), F.collect_set("source").alias("s"))
    return per_type.groupBy("name").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "type")).getField("type").alias("entity_type"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("d")))), SEP).alias("description"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))), SEP).alias("source_id"),
    )


def merge_edges(df: DataFrame, src: str, tgt: str, weight: str, description: str, keywords: str, source: str) -> DataFrame:
    """One edge per directed pair: summed weight (null counts 1), sorted distinct texts."""
    rows = df.select(F.col(src).alias("src_id"), F.col(tgt).alias("tgt_id"), F.coalesce(F.col(weight), F.lit(1.0)).alias("weight"), F.col(description).alias("d"), F.col(keywords).alias("k"), F.col(source).alias("s")).where("src_id is not null and tgt_id is not null")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), SEP)
    return rows.groupBy("src_id", "tgt_id").agg(F.sum("weight").alias("weight"), joined("d").alias("description"), joined("k").alias("keywords"), joined("s").alias("source_id"))


def stub_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that edges name but the node table lacks, typed UNKNOWN."""
    ends = edges.select(F.col("src_id").alias("name")).unionByName(edges.select(F.col("tgt_id").alias("name"))).distinct()
    return ends.join(nodes.select("name"), "name", "left_anti").select("name", F.lit("UNKNOWN").alias("entity_type"))


def entity_text(name: Column, description: Column) -> Column:
    return F.concat(name, F.coalesce(description, F.lit("")))


def relation_text(keywords: Column, src: Column, tgt: Column, description: Column) -> Column:
    return F.concat(F.coalesce(keywords, F.lit("")), src, tgt, F.coalesce(description, F.lit("")))


def node_text(name: Column, description: Column) -> Column:
    """What is embedded for a node: its name, with its description if it has one."""
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat_ws(" ", name, description)).otherwise(name)


def needs_summary(description: Column, limit: int = 5000) -> Column:
    return F.size(words(description)) >= limit


def distinct_texts(df: DataFrame, field: str, most: int | None = None) -> DataFrame:
    """Distinct non-blank texts of a field; with ``most`` the first of them in order (a stated slice)."""
    rows = df.select(F.col(field).alias("text")).where("trim(text) != ''").distinct()
    return rows if most is None else rows.orderBy("text").limit(most)


def extraction_parts(chunks: DataFrame, extracted: DataFrame) -> DataFrame:
    """Entities and triples of every chunk (chunk); chunks without a result have empty ones."""
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return chunks.select("chunk").distinct().join(extracted, "chunk", "left").select("chunk", empty("entities", "array<string>"), empty("triples", "array<array<string>>"))
