"""Schema graphs: tables and columns as nodes, containment and references as edges.

Input is the long form of a profile: columns(db_id, table_name, name, type,
is_primary_key, is_foreign_key, references_table, references_column) and
tables(db_id, table_name, row_count). Names compare in lower case without
quotes and qualifiers; repeated rows count once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweir.functions.identity import schema_relation_id
from graphweir.operators.references import bare_name

CONTAINS, REFERENCES, INFERRED_CONTAINS = 10.0, 15.0, 8.0
SAME_PREFIX, SHARED_WORD = 6.0, 5.0


def columns_of(columns: DataFrame) -> DataFrame:
    """One row per (db, table, column), the latest extraction standing for it."""
    rows = columns.select(
        "db_id", bare_name(F.col("table_name")).alias("table_name"), bare_name(F.col("name")).alias("column_name"),
        F.struct("extracted_at", "column_id", F.coalesce("type", F.lit("TEXT")).alias("type"), F.coalesce("is_primary_key", F.lit(False)).alias("pk"), F.coalesce("is_foreign_key", F.lit(False)).alias("fk"), bare_name(F.col("references_table")).alias("rt"), bare_name(F.col("references_column")).alias("rc")).alias("v"),
    ).where("db_id is not null and table_name is not null and column_name is not null")
    last = rows.groupBy("db_id", "table_name", "column_name").agg(F.max("v").alias("v"))
    return last.select("db_id", "table_name", "column_name", F.col("v.type").alias("data_type"), F.col("v.pk").alias("is_primary_key"), F.col("v.fk").alias("is_foreign_key"), F.col("v.rt").alias("references_table"), F.col("v.rc").alias("references_column"))


def quoted_name(*parts: Column) -> Column:
    return F.concat(F.lit('"'), F.concat_ws(".", *parts), F.lit('"'))


def nodes(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Table and column nodes: db_id, name, entity_type, description."""
    c = columns_of(columns)
    sizes = tables.select("db_id", bare_name(F.col("table_name")).alias("table_name"), "row_count").groupBy("db_id", "table_name").agg(F.max("row_count").alias("row_count"))
    counts = c.groupBy("db_id", "table_name").agg(F.count(F.lit(1)).alias("columns"))
    t = counts.join(sizes, ["db_id", "table_name"], "left")
    table = t.select("db_id", quoted_name(F.col("table_name")).alias("name"), F.lit("complete_table").alias("entity_type"), F.concat(F.lit("Table "), F.col("table_name"), F.lit(" with "), F.col("columns").cast("string"), F.lit(" columns and "), F.coalesce(F.col("row_count").cast("string"), F.lit("unknown")), F.lit(" rows")).alias("description"))
    key = F.when(F.col("is_primary_key"), ", primary key").otherwise("")
    ref = F.when(F.col("is_foreign_key") & F.col("references_table").isNotNull(), F.concat(F.lit(", refers to "), F.col("references_table"))).otherwise("")
    column = c.select("db_id", quoted_name(F.col("table_name"), F.col("column_name")).alias("name"), F.lit("column").alias("entity_type"), F.concat(F.lit("Column "), F.col("column_name"), F.lit(" of "), F.col("table_name"), F.lit(", "), F.col("data_type"), key, ref).alias("description"))
    return table.unionByName(column)


def edges(columns: DataFrame) -> DataFrame:
    """Containment edges (10) and reference edges (15) to tables that exist: db_id, src, tgt, kind, weight, rel_id."""
    c = columns_of(columns)
    t, col = quoted_name(F.col("table_name")), quoted_name(F.col("table_name"), F.col("column_name"))
    contains = c.select("db_id", t.alias("src"), col.alias("tgt"), F.lit("contains").alias("kind"), F.lit(CONTAINS).alias("weight"))
    known = c.select("db_id", F.col("table_name").alias("references_table")).distinct()
    refs = c.where("references_table is not null").join(known, ["db_id", "references_table"], "left_semi")
    refers = refs.select("db_id", col.alias("src"), F.when(F.col("references_column").isNull(), quoted_name(F.col("references_table"))).otherwise(quoted_name(F.col("references_table"), F.col("references_column"))).alias("tgt"), F.lit("references").alias("kind"), F.lit(REFERENCES).alias("weight"))
    return contains.unionByName(refers).withColumn("rel_id", schema_relation_id(F.col("src"), F.col("tgt")))


def inferred_edges(columns: DataFrame) -> DataFrame:
    """Edges between tables of one database whose names share a word of four letters or more: 5, or 6 with the first word.

    Tables meet on their words; a word that many tables of a database share
    still gives each pair once.
    """
    t = columns_of(columns).select("db_id", "table_name").distinct()
    words = t.select("db_id", "table_name", F.posexplode(F.split("table_name", "_")).alias("at", "word")).where("length(word) >= 4")
    a, b = words.select("db_id", F.col("table_name").alias("a"), "word", F.col("at").alias("at_a")), words.select("db_id", F.col("table_name").alias("b"), "word", F.col("at").alias("at_b"))
    pairs = a.join(b, ["db_id", "word"]).where("a < b")
    return pairs.groupBy("db_id", "a", "b").agg(F.max(F.when((F.col("at_a") == 0) & (F.col("at_b") == 0), SAME_PREFIX).otherwise(SHARED_WORD)).alias("weight"))


def guessed_keys(columns: DataFrame) -> DataFrame:
    """Keys of undeclared schemas: <table>_id is a primary key, another *_id a foreign key to the first table, by name, whose name holds its stem.

    Columns meet the tables of their own database only, as many as a schema has.
    """
    c = columns_of(columns).select("db_id", "table_name", "column_name")
    own = c.withColumn("stem", F.regexp_extract("column_name", "^(.+)_id$", 1)).withColumn("pk", F.col("column_name") == F.concat("table_name", F.lit("_id")))
    targets = c.select("db_id", F.col("table_name").alias("target")).distinct()
    asking = own.where("stem != '' and not pk")
    hit = asking.join(targets, (asking["db_id"] == targets["db_id"]) & F.contains("target", "stem") & (F.col("target") != F.col("table_name"))).drop(targets["db_id"]).groupBy("db_id", "table_name", "column_name").agg(F.min("target").alias("references_table"))
    return own.join(hit, ["db_id", "table_name", "column_name"], "left").where("pk or references_table is not null").select("db_id", "table_name", "column_name", F.col("pk").alias("is_primary_key"), "references_table")


def schema_type(columns: DataFrame) -> DataFrame:
    """Per database: ``db_summary`` if any column declares or names a reference, else ``reconstruct``."""
    told = F.coalesce(F.col("is_foreign_key"), F.lit(False)) | F.col("references_table").isNotNull()
    return columns.where("db_id is not null").groupBy("db_id").agg(F.when(F.max(told), "db_summary").otherwise("reconstruct").alias("schema_type"))


def sample_json(samples: DataFrame, most: int = 3, longest: int = 80) -> DataFrame:
    """The first rows of each table as JSON (table_name, at, row of strings by column): long strings are cut and end in dots."""
    cut = lambda _, v: F.when(F.length(v) > longest, F.concat(F.substring(v, 1, longest - 3), F.lit("..."))).otherwise(v)
    first = samples.withColumn("n", F.row_number().over(Window.partitionBy("table_name").orderBy("at"))).where(F.col("n") <= most)
    rows = first.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("n", F.to_json(F.transform_values("row", cut)).alias("j")))).alias("r"))
    return rows.select("table_name", F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["j"]), ","), F.lit("]")).alias("samples"))


def enhanced(edges_: DataFrame, scores: DataFrame) -> DataFrame:
    """Edge weights times a given score (src, tgt, score); the original is kept."""
    joined = edges_.join(scores.select("src", "tgt", "score"), ["src", "tgt"], "left")
    return joined.withColumn("original_weight", F.col("weight")).withColumn("weight", F.col("weight") * F.coalesce("score", F.lit(1.0)))


def relation_tables(text: Column) -> Column:
    """Tables named in texts such as "a.b -> c.d"."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r'"?([A-Za-z_][\w$]*)(?:\.[\w$]+)?"?\s*(?:->|$)'), 1), F.lower)))


def cluster_tables(cluster_nodes: DataFrame) -> DataFrame:
    """Columns per table of the nodes of clusters (query_id, name): names split at the first dot, quotes dropped."""
    bare = F.regexp_replace("name", '"', "")
    rows = cluster_nodes.select("query_id", F.lower(F.substring_index(bare, ".", 1)).alias("table_name"), F.when(F.contains(bare, F.lit(".")), F.lower(F.expr("substr(replace(name, '\"', ''), instr(replace(name, '\"', ''), '.') + 1)"))).alias("column_name")).distinct()
    return rows.groupBy("query_id", "table_name").agg(F.array_sort(F.collect_set("column_name")).alias("columns"))


def render_tables(columns: DataFrame) -> DataFrame:
    """CREATE TABLE texts per (db, table): columns in name order, primary keys first."""
    c = columns_of(columns)
    line = F.concat(F.lit("  "), F.col("column_name"), F.lit(" "), F.col("data_type"), F.when(F.col("is_primary_key"), " PRIMARY KEY").otherwise(""), F.when(F.col("is_foreign_key") & F.col("references_table").isNotNull(), F.concat(F.lit(" REFERENCES "), F.col("references_table"), F.coalesce(F.concat(F.lit("("), F.col("references_column"), F.lit(")")), F.lit("")))).otherwise(""))
    lines = c.groupBy("db_id", "table_name").agg(F.array_sort(F.collect_list(F.struct((~F.col("is_primary_key")).alias("o"), "column_name", line.alias("l")))).alias("x"))
    return lines.select("db_id", "table_name", F.concat(F.lit("CREATE TABLE "), F.col("table_name"), F.lit(" (\n"), F.array_join(F.transform("x", lambda x: x["l"]), ",\n"), F.lit("\n);")).alias("ddl"))


def render_simple(columns: DataFrame) -> DataFrame:
    c = columns_of(columns)
    rows = c.groupBy("db_id", "table_name").agg(F.array_sort(F.collect_list("column_name")).alias("x"))
    return rows.select("db_id", "table_name", F.concat(F.col("table_name"), F.lit(": "), F.array_join("x", ", ")).alias("text"))


def node_class(name: Column, kind: Column) -> Column:
    """What a node is shown as."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(low.isin("complete_table", "table"), "table").when((low == "column") | F.contains(name, F.lit(".")), "column").when(low == "", "unknown").otherwise("entity")


def lookup(names: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables by full name, else by short name (the smallest full name of it)."""
    full = tables.select(F.lower("table_name").alias("full")).distinct()
    short = full.groupBy(F.regexp_extract("full", r"([^.]*)$", 1).alias("short")).agg(F.min("full").alias("by_short"))
    asked = names.select("name", F.lower("name").alias("n"), F.regexp_extract(F.lower("name"), r"([^.]*)$", 1).alias("s"))
    return asked.join(full, F.col("n") == F.col("full"), "left").join(short, F.col("s") == F.col("short"), "left").select("name", F.coalesce("full", "by_short").alias("table_name"))


def pack_by_tokens(columns: DataFrame, budget: int) -> DataFrame:
    """Tables of each database packed in name order into parts of at most ``budget`` tokens.

    Filling in order is sequential: one group per database, bounded by the
    size of a schema. A table over the budget is cut into runs of columns.
    """
    c = columns_of(columns).select("db_id", "table_name", "column_name", "data_type")

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["table_name", "column_name"], ignore_index=True)
        part, used, parts = 0, 0, []
        for _, rows in frame.groupby("table_name", sort=True):
            need = len(rows) * 2 + 1
            if used and used + need > budget:
                part, used = part + 1, 0
            for _ in range(len(rows)):
                if used + 2 > budget:
                    part, used = part + 1, 0
                parts.append(part)
                used += 2
            used += 1
        frame["part"] = parts
        return frame[["db_id", "table_name", "column_name", "part"]]

    return c.groupBy("db_id").applyInPandas(pack, "db_id string, table_name string, column_name string, part int")


def schema_scores(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Case-insensitive column sets per database (db_id, table_name, column_name): found and gold arrays."""
    sets = lambda df, n: df.groupBy("db_id").agg(F.collect_set(F.lower(F.concat_ws(".", "table_name", "column_name"))).alias(n))
    return sets(found, "found").join(sets(gold, "gold"), "db_id", "full")


__all__ = ["cluster_tables", "columns_of", "edges", "enhanced", "guessed_keys", "inferred_edges", "lookup", "node_class", "nodes", "pack_by_tokens", "quoted_name", "relation_tables", "render_simple", "render_tables", "schema_scores"]
