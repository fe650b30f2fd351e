"""References to records that do not exist.

Parents and children come in one long form, tagged, and are grouped by parent
table and key. A parent row says that its key existed in ``[since, until)``;
a child row says that a record made at ``at`` refers to the key. A child whose
key no parent covered at that time is an orphan: the key is missing, was
deleted before, or arrived later.

The plan has no join of children with parents and no group that must fit into
one task. Long rows are cut by (table, key, day). A first aggregation, partial
before its shuffle, keeps the latest end of the parents that began on each
day; a running maximum over the days of a key (as many rows as the key has
days) gives what each day inherits. Within a day a second running maximum over
the rows ordered by time decides each child. A key that holds a third of all
rows is so spread over as many groups as it has days.

Defined results
---------------
* A child with null key is no reference. A child with null time is an orphan:
  no parent can be shown to have existed.
* A parent with null key or null ``since`` never existed; null ``until`` means
  that it still exists.
* Repeated rows count once. Empty inputs give empty outputs. Only the named
  columns are read, so further columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Later than any timestamp in the data: the end of a parent that still exists.
OPEN_END = "9999-12-31 00:00:00"
#: Earlier than any timestamp: the start of a parent whose time is not asked.
OPEN_START = "0001-01-01 00:00:00"

LONG = ("parent_table", "key", "at", "until", "src_table", "record_id", "ref_key", "period")


def parents(df: DataFrame, table: str, key: Column, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Long parent rows of ``df``; without ``since`` the key exists at any time."""
    start = F.lit(OPEN_START).cast("timestamp") if since is None else since.cast("timestamp")
    end = F.lit(None).cast("timestamp") if until is None else until.cast("timestamp")
    return df.select(
        F.lit(table).alias("parent_table"),
        key.cast("string").alias("key"),
        start.alias("at"),
        F.coalesce(end, F.lit(OPEN_END).cast("timestamp")).alias("until"),
        F.lit(None).cast("string").alias("src_table"),
        F.lit(None).cast("bigint").alias("record_id"),
        F.lit(None).cast("string").alias("ref_key"),
        F.lit(None).cast("timestamp").alias("period"),
    ).where("key is not null and at is not null")


def children(df: DataFrame, table: str, key: Column, src_table: str, record_id: Column, ref_key: Column, at: Column | None, period: Column) -> DataFrame:
    """Long child rows of ``df``; ``at`` None asks for the key at any time.

    Such rows keep the time of their period, by which a hot key is spread;
    parents of any time cover it.
    """
    when = F.coalesce(period.cast("timestamp"), F.lit(OPEN_START).cast("timestamp")) if at is None else at.cast("timestamp")
    return df.select(
        F.lit(table).alias("parent_table"),
        key.cast("string").alias("key"),
        when.alias("at"),
        F.lit(None).cast("timestamp").alias("until"),
        F.lit(src_table).alias("src_table"),
        record_id.cast("bigint").alias("record_id"),
        ref_key.alias("ref_key"),
        F.date_trunc("month", period.cast("timestamp")).alias("period"),
    ).where("key is not null")


def orphans(*parts: DataFrame) -> DataFrame:
    """The orphan children of the union of long ``parts``: one row per
    (src_table, record_id, ref_key, parent_table, period)."""
    everything = reduce(DataFrame.unionByName, parts)
    timeless = everything.where("at is null and src_table is not null").select("src_table", "record_id", "ref_key", "parent_table", "period")
    long = everything.where("at is not null").withColumn("day", F.to_date("at"))
    days = long.groupBy("parent_table", "key", "day").agg(F.max("until").alias("latest"), F.max(F.col("src_table").isNotNull()).alias("asked"))
    over_days = Window.partitionBy("parent_table", "key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    # a day that no child asks about needs no rows of its own
    inherited = days.withColumn("inherited", F.max("latest").over(over_days)).where("asked").select("parent_table", "key", "day", "inherited")
    rows = long.join(inherited, ["parent_table", "key", "day"])
    within = Window.partitionBy("parent_table", "key", "day").orderBy("at", F.col("src_table").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = F.greatest("inherited", F.max("until").over(within)) > F.col("at")
    found = rows.withColumn("covered", F.coalesce(covered, F.lit(False))).where("src_table is not null and not covered")
    return found.select("src_table", "record_id", "ref_key", "parent_table", "period").unionByName(timeless).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references summed per referring table, missing table and month.

    A record whose reference lacks several parents (table and column) counts
    for each of them.
    """
    return found.groupBy("src_table", "parent_table", "period").agg(
        F.count(F.lit(1)).alias("orphan_references"),
        F.count_distinct("record_id").alias("orphan_records"),
    )


# --- this project's references ------------------------------------------------

#: Values of edge_data.source_id that are no references (fixed values).
NO_REFERENCE = ("", "unknown", "schema_extraction")
#: What separates or encloses chunk ids in a packed source_id.
ID_BREAKS = r"(?i)<\|?sep\|?>|&lt;sep&gt;|[\s ,;|\[\]\"'`]+"
#: Joins the parts of a composite key.
UNIT = "\u001f"


def bare_name(name: Column) -> Column:
    """An identifier in lower case without quotes and qualifier."""
    plain = F.regexp_replace(F.lower(F.trim(name)), r"[\"'`\[\]]", "")
    bare = F.trim(F.regexp_extract(plain, r"([^.]*)$", 1))
    return F.when(bare != "", bare)


def chunk_references(edge_data: DataFrame, chunk_info: DataFrame) -> list[DataFrame]:
    """Long rows for chunk ids named in edge_data.source_id."""
    ids = F.explode(F.array_distinct(F.filter(F.split(F.lower("source_id"), ID_BREAKS), lambda x: ~x.isin(*NO_REFERENCE))))
    edges = edge_data.select("edge_id", "created_at", ids.alias("chunk"))
    return [
        parents(chunk_info, "chunk_info", F.lower(F.trim("chunk_id")), F.col("ingested_at"), F.col("deleted_at")),
        children(edges, "chunk_info", F.col("chunk"), "edge_data", F.col("edge_id"), F.col("chunk"), F.col("created_at"), F.col("created_at")),
    ]


def schema_references(schema_columns: DataFrame, schema_tables: DataFrame) -> list[DataFrame]:
    """Long rows for tables and columns named in schema_columns.references_*."""
    key = lambda *parts: F.concat_ws(UNIT, *parts)
    refs = schema_columns.select("column_id", "extracted_at", "db_id", bare_name(F.col("references_table")).alias("ref_table"), bare_name(F.col("references_column")).alias("ref_column")).where("ref_table is not null and db_id is not null")
    with_column = refs.where("ref_column is not null")
    return [
        parents(schema_tables.where("db_id is not null"), "schema_tables", key("db_id", bare_name(F.col("table_name"))), F.col("first_seen_at"), F.col("dropped_at")),
        parents(schema_columns.where("db_id is not null").select("db_id", "table_name", "name").distinct(), "schema_columns", key("db_id", bare_name(F.col("table_name")), bare_name(F.col("name")))),
        children(refs, "schema_tables", key("db_id", "ref_table"), "schema_columns", F.col("column_id"), F.col("ref_table"), F.col("extracted_at"), F.col("extracted_at")),
        children(with_column, "schema_columns", key("db_id", "ref_table", "ref_column"), "schema_columns", F.col("column_id"), F.col("ref_table"), None, F.col("extracted_at")),
    ]
