"""Profiling queries: statistics, keys and relationships of the relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweir.operators import profile as pf
from graphweir.sources.tables import load

#: The profiled tables and the classes of their columns (n numeric, t text, d temporal).
FIELDS = {
    "region": "r_regionkey:n r_name:t",
    "nation": "n_nationkey:n n_name:t n_regionkey:n",
    "customer": "c_custkey:n c_name:t c_nationkey:n c_acctbal:n c_mktsegment:t",
    "supplier": "s_suppkey:n s_name:t s_nationkey:n s_acctbal:n",
    "part": "p_partkey:n p_name:t p_brand:t p_type:t p_size:n p_retailprice:n",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:t o_totalprice:n o_orderdate:d o_orderpriority:t",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n l_extendedprice:n l_discount:n l_tax:n l_returnflag:t l_linestatus:t l_shipdate:d",
    "events": "event_id:n ts:d user_id:n event_type:t value:n props:t",
}
COLUMNS = {t: [tuple(c.split(":")) for c in cols.split()] for t, cols in FIELDS.items()}
SEQUENCES = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"]}
INCLUSIONS = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_custkey", "orders", "o_custkey"))


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return load(spark, d, name).select(*[c for c, _ in COLUMNS[name]])


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [pf.column_stats(_table(spark, d, t), t) for t in COLUMNS])


def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d)


def profile_common_values(spark: SparkSession, d: str) -> DataFrame:
    text = {t: [c for c, k in cols if k == "t"] for t, cols in COLUMNS.items()}
    return reduce(DataFrame.unionByName, [pf.common_values(load(spark, d, t).select(*cols), t) for t, cols in text.items() if cols])


def profile_spread(spark: SparkSession, d: str) -> DataFrame:
    rows = pf.spread_stats(load(spark, d, "lineitem"), "lineitem", ["l_quantity", "l_extendedprice", "l_discount"]).unionByName(pf.spread_stats(load(spark, d, "orders"), "orders", ["o_totalprice"]))
    return rows.select("table_name", "column_name", F.round("median", 4).alias("median"), F.round("stddev", 4).alias("stddev"))


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [pf.sequence_test(load(spark, d, t), t, cols) for t, cols in SEQUENCES.items()])


def profile_sequences(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d)


def profile_keys(spark: SparkSession, d: str) -> DataFrame:
    return pf.key_scores(_stats(spark, d), _sequences(spark, d)).select("table_name", "column_name", "points", "chosen")


def profile_inclusion(spark: SparkSession, d: str) -> DataFrame:
    parts = [pf.inclusion(load(spark, d, a), ac, load(spark, d, b), bc).select(F.lit(f"{a}.{ac}").alias("source"), F.lit(f"{b}.{bc}").alias("reference"), "*") for a, ac, b, bc in INCLUSIONS]
    return reduce(DataFrame.unionByName, parts)


def profile_foreign_names(spark: SparkSession, d: str) -> DataFrame:
    """Foreign keys suggested by the names of profiled schemas."""
    c = load(spark, d, "schema_columns").select("db_id", F.lower("table_name").alias("table_name"), F.lower("name").alias("column_name"), pf.type_class(F.col("type")).alias("type_class"), "is_primary_key").distinct()
    return pf.foreign_by_name(c, c.where("is_primary_key"), ("db_id",))


def profile_name_classes(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "schema_tables").select("db_id", "table_name").distinct()
    return t.select("db_id", "table_name", pf.name_class(F.col("table_name")).alias("c")).select("db_id", "table_name", F.col("c.class").alias("class"), F.col("c.base").alias("base"))


def profile_representatives(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "schema_columns").select("db_id", F.lower("table_name").alias("table_name"), F.lower("name").alias("name")).distinct()
    t = c.groupBy("db_id", "table_name").agg(F.count(F.lit(1)).alias("columns"))
    return pf.representatives(t, "db_id", "table_name", "columns")


def profile_schema_totals(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "schema_columns")
    one = c.groupBy("db_id", F.lower("table_name").alias("table_name"), F.lower("name").alias("name")).agg(F.max("is_primary_key").alias("is_primary_key"), F.max("is_foreign_key").alias("is_foreign_key"))
    return pf.schema_totals(one)


def profile_type_classes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "schema_columns").select("type", pf.type_class(F.col("type")).alias("type_class")).groupBy("type", "type_class").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (profile_columns, profile_common_values, profile_spread, profile_sequences, profile_keys, profile_inclusion, profile_foreign_names, profile_name_classes, profile_representatives, profile_schema_totals, profile_type_classes)}

_CLASS = {"n": "numeric", "t": "text", "d": "temporal"}


def _stat_sql(t: str, c: str, k: str) -> str:
    number = f"{c}::DOUBLE" if k == "n" else "NULL::DOUBLE"
    length = f"round(avg(length({c})), 2)" if k == "t" else "NULL::DOUBLE"
    span = f"round((max(epoch_us({c})) - min(epoch_us({c}))) / 86400000000.0, 2)" if k == "d" else "NULL::DOUBLE"
    return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, '{_CLASS[k]}' AS type_class, count(*) AS row_count, count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS null_count,
  round((count(*) - count({c})) * 10000.0::DOUBLE / nullif(count(*), 0)) / 10000 AS nullability, round(count(DISTINCT {c}) * 10000.0::DOUBLE / nullif(count(*), 0)) / 10000 AS cardinality,
  min({number}) AS min_value, max({number}) AS max_value, round(avg({number}), 4) AS avg_value, {length} AS avg_length, {span} AS date_range_days FROM {t}"""


_STATS = "\nUNION ALL ".join(_stat_sql(t, c, k) for t, cols in COLUMNS.items() for c, k in cols)
_SEQ = "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, max({c}) - min({c}) + 1 = count(DISTINCT {c}) AS gapless, min({c}) IN (0, 1) AND max({c}) = count(*) AS auto_increment FROM {t}" for t, cols in SEQUENCES.items() for c in cols)
# written apart from the operator's tables, so that a wrong pattern on either side shows
_NAME_POINTS = r"""
  WHEN lower(column_name) = 'id' THEN 15 WHEN lower(column_name) IN (lower(table_name) || '_id', lower(table_name) || '_key') THEN 15 WHEN lower(column_name) LIKE 'pk\_%' ESCAPE '\' THEN 15
  WHEN lower(column_name) = 'key' THEN 10 WHEN lower(column_name) = 'code' THEN 8 WHEN lower(column_name) IN ('uuid', 'guid', 'serial') THEN 15 WHEN lower(column_name) LIKE 'seq%' THEN 10
  WHEN lower(column_name) LIKE '%id' THEN 5 WHEN lower(column_name) LIKE '%code' OR lower(column_name) LIKE '%num' OR lower(column_name) LIKE '%no' THEN 5 WHEN lower(column_name) LIKE 'record%' THEN 8"""
_UP = "upper(table_name)"
_YEAR = "(19[0-9][0-9]|20[0-9][0-9]|2100)"
_RULES = [
    ("YEARLY", f"^(.+?){_YEAR}$"), ("YEARLY_SUFFIX", f"^(.+?)_{_YEAR}_.+$"), ("DATE_STREAMING", "^(.+)_[0-9]{8}$"), ("DATE_STREAMING", "^(.+)_[0-9]{4}_[0-9]{2}_[0-9]{2}$"), ("QUARTERLY", "^(.+)_Q[1-4]_[0-9]{4}$"), ("QUARTERLY", f"^(_){_YEAR}_Q[1-4]$"),
    ("MONTHLY", "^(.+)_(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)_?[0-9]{4}$"), ("NUMERIC_SUFFIX", "^([A-Z][A-Z]+)[0-9]{2,4}$"), ("SEQUENTIAL", "^(.+)_[0-9]{3,}$"), ("RELEASE_VERSIONED", "^([A-Z]+)[0-9]{2,3}_.+$"),
    ("VERSIONED", "^(.+)_(V[0-9]+|VER_[0-9]+|VERSION_[0-9]+)$"), ("ARCHIVE", "^(.*)_(ARCHIVE|BACKUP|BAK|HIST|HISTORICAL)$"),
]
_CASE = " ".join(f"WHEN regexp_matches({_UP}, '{p}') THEN '{n}'" for n, p in _RULES)
_BASE = " ".join(f"WHEN regexp_matches({_UP}, '{p}') THEN regexp_extract({_UP}, '{p}', 1)" for _, p in _RULES)
_TYPE = "CASE WHEN regexp_matches(lower(type), 'date|time') THEN 'temporal' WHEN regexp_matches(lower(type), 'int|real|float|double|number|decimal|numeric') THEN 'numeric' WHEN regexp_matches(lower(type), 'text|char|string') THEN 'text' ELSE 'other' END"
_INCLUSION = "\nUNION ALL ".join(
    f"""SELECT '{a}.{ac}' AS source, '{b}.{bc}' AS reference, orphans, round(coverage, 6) AS coverage, CASE WHEN orphans = 0 AND coverage > 0.3 THEN 'high' WHEN orphans = 0 AND coverage > 0.01 THEN 'medium' END AS confidence
FROM (SELECT (SELECT count(DISTINCT {ac}) FROM {a} WHERE {ac} NOT IN (SELECT {bc} FROM {b} WHERE {bc} IS NOT NULL)) AS orphans,
  (SELECT count(DISTINCT {ac}) FROM {a} WHERE {ac} IN (SELECT {bc} FROM {b})) / nullif((SELECT count(DISTINCT {bc}) FROM {b}), 0)::DOUBLE AS coverage)"""
    for a, ac, b, bc in INCLUSIONS
)

ORACLES = {
    "profile_columns": _STATS,
    "profile_common_values": "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, rank::INT AS rank, value, n FROM (SELECT {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank, count(*) OVER () AS d FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE d <= 100 AND rank <= 5"
        for t, cols in COLUMNS.items() for c, k in cols if k == "t"
    ),
    "profile_spread": "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS stddev FROM {t}" for t, c in (("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("lineitem", "l_discount"), ("orders", "o_totalprice"))),
    "profile_sequences": _SEQ,
    "profile_keys": f"""
WITH s AS ({_STATS}), q AS ({_SEQ}),
r AS (SELECT s.*, coalesce(q.gapless, false) AS gapless, coalesce(q.auto_increment, false) AS auto_increment, distinct_count / row_count::DOUBLE AS u FROM s LEFT JOIN q USING (table_name, column_name) WHERE row_count > 0),
p AS (SELECT table_name, column_name, (CASE WHEN u = 1 THEN 30 WHEN u > 0.98 THEN 20 ELSE 0 END + CASE WHEN null_count = 0 THEN 20 ELSE 0 END + CASE type_class WHEN 'numeric' THEN 15 WHEN 'text' THEN 5 ELSE 0 END
  + CASE {_NAME_POINTS} ELSE 0 END + CASE WHEN auto_increment THEN 15 ELSE 0 END + CASE WHEN gapless THEN 10 ELSE 0 END)::INT AS points FROM r WHERE u >= 0.9 AND null_count / row_count::DOUBLE <= 0.1)
SELECT table_name, column_name, points, points >= 0.8 * max(points) OVER (PARTITION BY table_name) AS chosen FROM p WHERE points >= 25""",
    "profile_inclusion": _INCLUSION,
    "profile_foreign_names": f"""
WITH c AS (SELECT DISTINCT db_id, lower(table_name) AS t, lower(name) AS c, {_TYPE} AS k, is_primary_key FROM schema_columns),
p AS (SELECT DISTINCT db_id, t, c, k, regexp_replace(t, 's$', '') AS o FROM c WHERE is_primary_key),
w AS (SELECT db_id, t, c, k, unnest([c, t || '_' || c, o || '_' || c, t || 'id', o || 'id', 'fk_' || t, 'fk_' || o]) AS wanted FROM p)
SELECT DISTINCT c.db_id, c.t AS table_name, c.c AS column_name, w.t AS ref_table, w.c AS ref_column, CASE WHEN c.k = w.k THEN 'medium' ELSE 'low' END AS confidence
FROM c JOIN w ON c.db_id = w.db_id AND c.c = w.wanted WHERE c.t <> w.t AND wanted NOT IN ('id', 'key', 'code', 'name')""",
    "profile_name_classes": f"SELECT DISTINCT db_id, table_name, CASE {_CASE} ELSE 'STANDALONE' END AS class, CASE {_BASE} ELSE upper(table_name) END AS base FROM schema_tables",
    "profile_representatives": f"""
WITH t AS (SELECT db_id, lower(table_name) AS table_name, count(DISTINCT lower(name)) AS columns FROM schema_columns GROUP BY ALL),
y AS (SELECT *, regexp_extract(table_name, '(19|20)\\d{{2}}') AS y, CASE {_CASE} ELSE 'STANDALONE' END AS class, CASE {_BASE} ELSE upper(table_name) END AS base FROM t),
p AS (SELECT *, columns * 1000 + CASE WHEN y >= '2015' AND y <= '2022' THEN 25 WHEN y >= '2010' AND y <= '2024' THEN 15 WHEN y >= '2000' THEN 10 ELSE 0 END AS points FROM y)
SELECT db_id, class, base, count(*) AS members, first(table_name ORDER BY points DESC, table_name) AS representative, count(*) - 1 AS reduction FROM p GROUP BY ALL""",
    "profile_schema_totals": """
WITH c AS (SELECT db_id, lower(table_name) AS t, lower(name) AS c, bool_or(is_primary_key) AS pk, bool_or(is_foreign_key) AS fk FROM schema_columns GROUP BY ALL)
SELECT db_id, count(DISTINCT t) AS total_tables, count(*) AS total_columns, count(DISTINCT CASE WHEN pk THEN t END) AS tables_with_primary_keys, count(DISTINCT CASE WHEN fk THEN t END) AS tables_with_foreign_keys, count(CASE WHEN fk THEN 1 END) AS total_relationships FROM c GROUP BY db_id""",
    "profile_type_classes": f"SELECT type, {_TYPE} AS type_class, count(*) AS n FROM schema_columns GROUP BY ALL",
}
