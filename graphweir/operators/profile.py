"""Table profiling: column statistics, keys, relationships, table-name patterns.

A table is scanned once for all its simple statistics (one aggregate per
column in one job) and once, unpivoted, for distinct values; nothing is
collected. Keys are scored from these statistics; inclusion of one column in
another is a left anti join of distinct values.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words in a type name that make a column numeric, text or temporal (fixed values).
NUMERIC = ("int", "real", "float", "double", "number", "decimal", "numeric")
TEXT = ("text", "char", "varchar", "string")
TEMPORAL = ("date", "time", "timestamp", "datetime")
#: Name patterns of key columns with their points; the first match counts (fixed values).
KEY_NAMES = (
    (r"^id$", 15), (r"^{table}_id$", 15), (r"^{table}_key$", 15), (r"^pk_", 15), (r"^key$", 10), (r"^code$", 8), (r"^uuid$", 15), (r"^guid$", 15), (r"^serial$", 15), (r"^seq", 10), (r"id$", 5),
    (r"uuid$", 10), (r"code$", 5), (r"num$", 5), (r"no$", 5), (r"^record", 8), (r"^pid$", 15), (r"^mid$", 15), (r"^uid$", 15), (r"^eid$", 15), (r"^[a-z]+id$", 10), (r"^[a-z]+_id$", 10),
)
COMMON_LIMIT, COMMON_MOST = 100, 5


def type_class(name: Column) -> Column:
    low = F.lower(name)
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return F.when(has(TEMPORAL), F.lit("temporal")).when(has(NUMERIC), F.lit("numeric")).when(has(TEXT), F.lit("text")).otherwise(F.lit("other"))


def _simple(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def class_of(kind: T.DataType) -> str:
    return "temporal" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "numeric" if isinstance(kind, T.NumericType) else "text" if isinstance(kind, T.StringType) else "other"


def column_stats(df: DataFrame, table: str, exact: bool = True) -> DataFrame:
    """One row per simple column: rows, distinct, nulls, ratios, least, greatest, mean, text length, date span.

    Distinct values are counted exactly by one aggregation over the unpivoted
    columns, partial before its shuffle; the rest is one scan. With ``exact``
    False they are sketched in that scan, and nothing but the sketches is shuffled.
    """
    fields = _simple(df)
    parts = []
    for f in fields:
        c, kind = F.col(f"`{f.name}`"), class_of(f.dataType)
        number = c.cast("double") if kind == "numeric" else F.lit(None).cast("double")
        micros = F.unix_micros(c.cast("timestamp")) if kind == "temporal" else F.lit(None).cast("bigint")
        parts.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(kind).alias("type_class"),
                F.count(F.lit(1)).alias("row_count"),
                F.count_if(c.isNull()).alias("null_count"),
                F.min(number).alias("min_value"),
                F.max(number).alias("max_value"),
                F.avg(number).alias("avg_value"),
                (F.avg(F.length(c)) if kind == "text" else F.lit(None).cast("double")).alias("avg_length"),
                ((F.max(micros) - F.min(micros)) / 86_400_000_000.0).alias("span_days"),
                (F.lit(None).cast("bigint") if exact else F.approx_count_distinct(c)).alias("sketched"),
            )
        )
    stats = df.agg(*[p.alias(f"s{k}") for k, p in enumerate(parts)]).select(F.explode(F.array(*[F.col(f"s{k}") for k in range(len(parts))])).alias("s")).select("s.*")
    values = df.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f"`{f.name}`").cast("string").alias("v")) for f in fields])).alias("x")).select("x.column_name", "x.v").where("v is not null")
    distinct = values.distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
    d = F.coalesce("distinct_count", F.lit(0)) if exact else F.col("sketched")
    return (stats.join(distinct, "column_name", "left") if exact else stats).select(
        F.lit(table).alias("table_name"), "column_name", "type_class", "row_count", d.alias("distinct_count"), "null_count",
        (F.round(F.col("null_count") * 10_000.0 / F.nullif("row_count", F.lit(0))) / 10_000).alias("nullability"), (F.round(d * 10_000.0 / F.nullif("row_count", F.lit(0))) / 10_000).alias("cardinality"),
        "min_value", "max_value", F.round("avg_value", 4).alias("avg_value"), F.round("avg_length", 2).alias("avg_length"), F.round("span_days", 2).alias("date_range_days"),
    )


def common_values(df: DataFrame, table: str) -> DataFrame:
    """The most frequent values of columns of few distinct ones: rank, value, count (ties to the smaller value)."""
    fields = _simple(df)
    values = df.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f"`{f.name}`").cast("string").alias("value")) for f in fields])).alias("x")).select("x.*").where("value is not null")
    counts = values.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    few = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") <= COMMON_LIMIT).select("column_name")
    w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), "value")
    return counts.join(few, "column_name", "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= COMMON_MOST).select(F.lit(table).alias("table_name"), "column_name", "rank", "value", "n")


def spread_stats(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Median and sample deviation of numeric columns."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.median(c).alias("median"), F.stddev_samp(c).alias("stddev")) for c in columns]
    return df.agg(*[p.alias(f"s{k}") for k, p in enumerate(parts)]).select(F.explode(F.array(*[F.col(f"s{k}") for k in range(len(parts))])).alias("s")).select(F.lit(table).alias("table_name"), "s.*")


def sample_rows(df: DataFrame, order: list[str], n: int, longest: int = 100) -> DataFrame:
    """The first rows by an order, long strings cut with an ellipsis (a sample is the feature)."""
    cut = lambda f: F.when(F.length(f.name) > longest, F.concat(F.substring(f.name, 1, longest - 3), F.lit("..."))).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.concat(F.lit("<binary data: "), F.length(f.name), F.lit(" bytes>")).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name)
    return df.orderBy(*order).limit(n).select(*[cut(f) for f in df.schema.fields])


def sequence_test(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Whether integer columns count up without gap, and look auto-incremented.

    Without gap: as many distinct values as the range is wide. Auto-increment:
    least value 0 or 1 and greatest value the row count.
    """
    parts = [F.struct(F.lit(c).alias("column_name"), F.min(c).cast("bigint").alias("least"), F.max(c).cast("bigint").alias("greatest"), F.count_distinct(c).alias("d"), F.count(F.lit(1)).alias("n")) for c in columns]
    rows = reduce(DataFrame.unionByName, [df.agg(p.alias("s")).select("s.*") for p in parts])
    return rows.select(F.lit(table).alias("table_name"), "column_name", (F.col("greatest") - F.col("least") + 1 == F.col("d")).alias("gapless"), (F.col("least").isin(0, 1) & (F.col("greatest") == F.col("n"))).alias("auto_increment"))


def key_scores(stats: DataFrame, sequences: DataFrame | None = None, least: int = 25, near: float = 0.8) -> DataFrame:
    """Primary-key candidates with their points; ``chosen`` are all within ``near`` of the table's best.

    Needs uniqueness of at least 0.9 and a null share of at most 0.1. Points:
    30 for unique, 20 above 0.98; 20 without nulls; 15 for numbers, 5 for
    text; by name; 15 for auto-increment; 10 without gaps.
    """
    u = F.col("distinct_count") / F.col("row_count")
    name = F.lower("column_name")
    by_name = F.lit(0)
    for pattern, points in reversed(KEY_NAMES):
        named = re.match(r"\^\{table\}(\w+)\$$", pattern)
        hit = name == F.concat(F.lower("table_name"), F.lit(named[1])) if named else name.rlike(pattern)
        by_name = F.when(hit, F.lit(points)).otherwise(by_name)
    points = F.when(u == 1, 30).when(u > 0.98, 20).otherwise(0) + F.when(F.col("null_count") == 0, 20).otherwise(0) + F.when(F.col("type_class") == "numeric", 15).when(F.col("type_class") == "text", 5).otherwise(0) + by_name
    rows = stats.where("row_count > 0")
    if sequences is not None:
        rows = rows.join(sequences, ["table_name", "column_name"], "left")
        points = points + F.when(F.coalesce("auto_increment", F.lit(False)), 15).otherwise(0) + F.when(F.coalesce("gapless", F.lit(False)), 10).otherwise(0)
    fit = rows.where((u >= 0.9) & (F.col("null_count") / F.col("row_count") <= 0.1)).select("table_name", "column_name", "type_class", points.alias("points")).where(F.col("points") >= least)
    w = Window.partitionBy("table_name")
    return fit.withColumn("chosen", F.col("points") >= near * F.max("points").over(w))


def foreign_by_name(columns: DataFrame, keys: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Foreign keys suggested by names: (table, column) whose name is the key's, or the key table's name with id or key.

    Columns meet keys on derived names by equality, within the ``scope`` columns, not by a product of tables.
    """
    low = F.lower("column_name")
    t = F.lower("table_name")
    single = F.regexp_replace(t, "s$", "")
    derived = F.array(low, F.concat(t, F.lit("_"), low), F.concat(single, F.lit("_"), low), F.concat(t, F.lit("id")), F.concat(single, F.lit("id")), F.concat(F.lit("fk_"), t), F.concat(F.lit("fk_"), single))
    k = keys.select(*scope, F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"), F.col("type_class").alias("ref_class"), F.explode(F.array_distinct(derived)).alias("wanted"))
    k = k.where(~F.col("wanted").isin("id", "key", "code", "name"))
    c = columns.select(*scope, "table_name", "column_name", "type_class", low.alias("wanted"))
    rows = c.join(k, [*scope, "wanted"]).where(F.col("table_name") != F.col("ref_table"))
    return rows.select(*scope, "table_name", "column_name", "ref_table", "ref_column", F.when(F.col("type_class") == F.col("ref_class"), F.lit("medium")).otherwise(F.lit("low")).alias("confidence")).distinct()


def inclusion(source: DataFrame, column: str, reference: DataFrame, ref_column: str) -> DataFrame:
    """Whether all values of a column are among a reference column's: orphans, coverage, confidence (one row).

    Null values on either side are left out.
    """
    a = source.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct()
    b = reference.where(F.col(ref_column).isNotNull()).select(F.col(ref_column).cast("string").alias("v")).distinct()
    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2))).groupBy("v").agg(F.sum("side").alias("sides"))
    sums = both.agg(F.count_if(F.col("sides") == 1).alias("orphans"), F.count_if(F.col("sides") == 3).alias("shared"), F.count_if(F.col("sides") >= 2).alias("ref_distinct"))
    coverage = F.col("shared") / F.nullif("ref_distinct", F.lit(0))
    return sums.select("orphans", F.round(coverage, 6).alias("coverage"), F.when((F.col("orphans") == 0) & (coverage > 0.3), "high").when((F.col("orphans") == 0) & (coverage > 0.01), "medium").alias("confidence"))


#: Classes of table names in upper case: label, pattern, base group (fixed values; the first match counts).
NAME_CLASSES = (
    ("YEARLY", r"^(.+?)(?:19\d{2}|20\d{2}|2100)$"),
    ("YEARLY_SUFFIX", r"^(.+?)_(?:19\d{2}|20\d{2}|2100)_.+$"),
    ("DATE_STREAMING", r"^(.+)_\d{8}$"),
    ("DATE_STREAMING", r"^(.+)_\d{4}_\d{2}_\d{2}$"),
    ("QUARTERLY", r"^(.+)_Q[1-4]_\d{4}$"),
    ("QUARTERLY", r"^(_)(?:19\d{2}|20\d{2}|2100)_Q[1-4]$"),
    ("MONTHLY", r"^(.+)_(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)_?\d{4}$"),
    ("NUMERIC_SUFFIX", r"^([A-Z]+[A-Z])\d{2,4}$"),
    ("SEQUENTIAL", r"^(.+)_\d{3,}$"),
    ("RELEASE_VERSIONED", r"^([A-Z]+)\d{2,3}_.+$"),
    ("VERSIONED", r"^(.+)_(?:V\d+|VER_\d+|VERSION_\d+)$"),
    ("ARCHIVE", r"^(.*)_(?:ARCHIVE|BACKUP|BAK|HIST|HISTORICAL)$"),
)


def name_class(name: Column) -> Column:
    """The pattern class of a table name, read in upper case, and its base: struct<class, base>."""
    up = F.upper(name)
    found = F.struct(F.lit("STANDALONE").alias("class"), up.alias("base"))
    for label, pattern in reversed(NAME_CLASSES):
        found = F.when(up.rlike(pattern), F.struct(F.lit(label).alias("class"), F.regexp_extract(up, pattern, 1).alias("base"))).otherwise(found)
    return found


def representatives(tables: DataFrame, group: str, name: str, columns: str) -> DataFrame:
    """Tables of like names and the one that stands for them: 1000 points a column, and for recency.

    Ties go to the smaller name. Columns: group, class, base, members,
    representative, reduction (members it replaces).
    """
    year = F.regexp_extract(F.lower(F.col(name)), r"(19|20)\d{2}", 0)
    recent = F.when((year >= "2015") & (year <= "2022"), 25).when((year >= "2010") & (year <= "2024"), 15).when(year >= "2000", 10).otherwise(0)
    rows = tables.select(F.col(group).alias(group), F.lower(F.col(name)).alias("n"), (F.col(columns) * 1000 + recent).alias("points"), name_class(F.col(name)).alias("c")).distinct()
    return rows.groupBy(group, F.col("c.class").alias("class"), F.col("c.base").alias("base")).agg(
        F.count_distinct("n").alias("members"), F.min(F.struct((-F.col("points")).alias("p"), "n")).getField("n").alias("representative"), (F.count_distinct("n") - 1).alias("reduction")
    )


def describe_group(names: Column, most: int = 10, ends: int = 3) -> Column:
    """Sorted names as a text; of many only the first and last."""
    s = F.array_sort(names)
    return F.when(F.size(s) <= most, F.array_join(s, ", ")).otherwise(F.concat(F.array_join(F.slice(s, 1, ends), ", "), F.lit(" ... "), F.array_join(F.slice(s, -ends, ends), ", ")))


def schema_totals(columns: DataFrame) -> DataFrame:
    """Per database: tables, columns, tables with keys and foreign keys, relationships."""
    rows = columns.select("db_id", F.lower("table_name").alias("t"), F.lower("name").alias("c"), F.coalesce("is_primary_key", F.lit(False)).alias("pk"), F.coalesce("is_foreign_key", F.lit(False)).alias("fk")).distinct()
    return rows.groupBy("db_id").agg(
        F.count_distinct("t").alias("total_tables"), F.count(F.lit(1)).alias("total_columns"), F.count_distinct(F.when(F.col("pk"), F.col("t"))).alias("tables_with_primary_keys"), F.count_distinct(F.when(F.col("fk"), F.col("t"))).alias("tables_with_foreign_keys"), F.count_if("fk").alias("total_relationships")
    )


def quoted(name: Column) -> Column:
    """An identifier in backticks where it needs them: special characters, a leading digit, a reserved word."""
    reserved = F.upper(name).isin("SELECT", "FROM", "WHERE", "GROUP", "ORDER", "BY", "TABLE", "INDEX", "KEY", "JOIN", "UNION", "LIMIT", "VALUES", "DEFAULT", "CHECK", "REFERENCES", "PRIMARY", "FOREIGN")
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~reserved, name).otherwise(F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`")))


def declared_first(declared: DataFrame, inferred: DataFrame, table: str = "table_name") -> DataFrame:
    """Declared keys, and inferred ones of the tables that declare none; ``origin`` tells which."""
    own = declared.withColumn("origin", F.lit("declared"))
    return own.unionByName(inferred.select(*declared.columns).withColumn("origin", F.lit("inferred")).join(declared.select(table).distinct(), table, "left_anti").select(*own.columns))


def without_skipped(columns: DataFrame, skipped: DataFrame) -> DataFrame:
    """Columns but for those that a list of (db_id, column_name) leaves out, names compared in lower case."""
    s = skipped.select("db_id", F.lower("column_name").alias("__c")).distinct()
    return columns.join(s, (columns["db_id"] == s["db_id"]) & (F.lower(columns["column_name"]) == s["__c"]), "left_anti")


def relationships(columns: DataFrame) -> DataFrame:
    """References between tables of (db_id, table_name, column_name, references_table, references_column): one row per pair
    of tables, their columns in order, ``composite`` if there are several."""
    rows = columns.where("references_table is not null").distinct()
    pairs = rows.groupBy("db_id", F.col("table_name").alias("from_table"), F.col("references_table").alias("to_table")).agg(F.array_sort(F.collect_list(F.struct("column_name", "references_column"))).alias("c"))
    return pairs.select("db_id", "from_table", F.transform("c", lambda x: x["column_name"]).alias("from_columns"), "to_table", F.transform("c", lambda x: x["references_column"]).alias("to_columns"), F.when(F.size("c") > 1, "composite").otherwise("simple").alias("type"))


def sampled_stats(samples: DataFrame) -> DataFrame:
    """Statistics of exported sample rows (table_name, column_name, value), values compared as strings: rows, nulls,
    distinct values, and uniqueness over the rows that have one."""
    v = F.col("value").cast("string")
    some = samples.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("rows"), F.count_if(v.isNull()).alias("nulls"), F.count_distinct(v).alias("distinct_values"))
    return some.withColumn("uniqueness", F.coalesce(F.col("distinct_values") / F.nullif(F.col("rows") - F.col("nulls"), F.lit(0)), F.lit(0.0)))
