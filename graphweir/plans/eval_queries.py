"""Evaluation queries over answers and retrieved documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweir.operators import evaluate as ev
from graphweir.operators import schema_graph as sg
from graphweir.sources.tables import load


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "query_solution")


def eval_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d).where("answer is not null and gold_answers is not null")
    return ev.answer_scores(rows, "query_id", "answer", "gold_answers", articles_first=False).withColumn("f1", F.round("f1", 6))


def eval_recall(spark: SparkSession, d: str) -> DataFrame:
    return ev.recall_at(_answers(spark, d), "query_id", "docs", "gold_docs")


def _sets(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d).select("query_id", "docs", "gold_docs").distinct()
    return ev.set_scores(rows, "query_id", "docs", "gold_docs")


def eval_sets(spark: SparkSession, d: str) -> DataFrame:
    return _sets(spark, d).select("query_id", "missing", "extra", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def eval_macro(spark: SparkSession, d: str) -> DataFrame:
    return ev.macro(_sets(spark, d)).select("n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_of_averages", "average_f1")])


def eval_golds(spark: SparkSession, d: str) -> DataFrame:
    g = ev.all_golds(_answers(spark, d).select("query_id", "gold_answers", F.array("answer").alias("aliases")).distinct(), "query_id", "gold_answers", "aliases")
    return g.select("query_id", F.array_join("golds", "|").alias("golds"))


def eval_spread(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d).select("query_id", "dataset", F.size("docs").cast("double").alias("v")).where("docs is not null").distinct()
    return ev.spread(rows, "dataset", "v").select("dataset", *[F.round(c, 6).alias(c) for c in ("mean", "std_pop", "std_samp", "least", "greatest", "score_range")])


def eval_truncated(spark: SparkSession, d: str) -> DataFrame:
    return ev.truncated(_answers(spark, d).where("answer is not null").select("query_id", "answer").distinct(), "query_id", "answer")


def eval_selected(spark: SparkSession, d: str) -> DataFrame:
    return ev.select_questions(_answers(spark, d), "dataset", "query_id", 3, 20)


def eval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE and BLEU of answers against their first gold answer."""
    rows = _answers(spark, d).select("query_id", "answer", F.get("gold_answers", F.lit(0)).alias("gold")).where("answer is not null and gold is not null").distinct()
    return ev.text_overlap(rows, "query_id", "answer", "gold").select("query_id", *[F.round(c, 6).alias(c) for c in ("rouge1", "rouge2", "bleu1", "bleu2")])


def eval_ddl(spark: SparkSession, d: str) -> DataFrame:
    """Columns parsed from rendered tables: what was rendered comes back."""
    ddl = sg.render_tables(load(spark, d, "schema_columns")).select(F.concat_ws("/", "db_id", "table_name").alias("key"), "ddl")
    return ev.parse_ddl(ddl, "key", "ddl")


QUERIES = {f.__name__: f for f in (eval_answers, eval_recall, eval_sets, eval_macro, eval_golds, eval_spread, eval_truncated, eval_selected, eval_overlap, eval_ddl)}

_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '[ \t\n\r\f]+'), lambda x: x NOT IN ('', 'a', 'an', 'the'))"
_PLAIN = r"list_filter(regexp_split_to_array(lower({0}), '[ \t\n\r\f]+'), lambda x: x <> '')"
_COMMON = "coalesce(list_sum(list_transform(list_distinct({a}), lambda t: least(len(list_filter({a}, lambda x: x = t)), len(list_filter({b}, lambda x: x = t))))), 0)"
_SETS = """
SELECT query_id, list_distinct(coalesce(docs, [])) AS f, list_distinct(coalesce(gold_docs, [])) AS g FROM (SELECT DISTINCT query_id, docs, gold_docs FROM query_solution)"""
_SCORED = f"""
SELECT query_id, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1, missing, extra FROM (
  SELECT query_id, CASE WHEN len(f) = 0 AND len(g) = 0 THEN 1.0::DOUBLE WHEN len(f) = 0 OR len(g) = 0 THEN 0.0 ELSE len(list_intersect(f, g))::DOUBLE / len(f) END AS p,
    CASE WHEN len(f) = 0 AND len(g) = 0 THEN 1.0::DOUBLE WHEN len(f) = 0 OR len(g) = 0 THEN 0.0 ELSE len(list_intersect(f, g))::DOUBLE / len(g) END AS r,
    len(list_filter(g, lambda x: NOT list_contains(f, x)))::INT AS missing, len(list_filter(f, lambda x: NOT list_contains(g, x)))::INT AS extra FROM ({_SETS}))"""
_GRAMS2 = "list_transform(range(1, greatest(len({0}), 1)), lambda i: {0}[i] || ' ' || {0}[i + 1])"

ORACLES = {
    "eval_answers": f"""
WITH r AS (SELECT DISTINCT query_id, answer, gold_answers FROM query_solution WHERE answer IS NOT NULL AND gold_answers IS NOT NULL),
n AS (SELECT row_number() OVER () AS id, query_id, {_TOKENS.format('answer')} AS a, gold_answers FROM r),
e AS (SELECT id, query_id, a, {_TOKENS.format('x')} AS g FROM (SELECT id, query_id, a, unnest(gold_answers) AS x FROM n) WHERE x IS NOT NULL),
s AS (SELECT id, array_to_string(a, ' ') = array_to_string(g, ' ') AS em, {_COMMON.format(a='a', b='g')} AS c, len(a) AS la, len(g) AS lg FROM e)
SELECT n.query_id, max(coalesce(s.em, false))::INT AS exact_match,
  round(max(CASE WHEN coalesce(c, 0) > 0 THEN 2.0 * (c / la) * (c / lg) / (c / la + c / lg) ELSE 0.0 END), 6) AS f1
FROM n LEFT JOIN s ON n.id = s.id GROUP BY n.id, n.query_id""",
    "eval_recall": """
WITH r AS (SELECT DISTINCT docs, gold_docs, query_id FROM query_solution),
g AS (SELECT docs, list_distinct(list_filter(gold_docs, lambda x: x IS NOT NULL)) AS g, query_id FROM r),
k AS (SELECT unnest([1, 2, 5, 10, 20, 50, 100, 200]) AS k)
SELECT k::INT AS k, round(avg(len(list_intersect(coalesce(docs, [])[1:k], g))::DOUBLE / len(g)), 4) AS recall, count(*) AS questions FROM g, k WHERE len(g) > 0 GROUP BY k""",
    "eval_sets": f"SELECT query_id, missing, extra, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM ({_SCORED})",
    "eval_macro": f"""
SELECT count(*) AS n, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(2 * avg(p) * avg(r) / (avg(p) + avg(r)), 6) AS f1_of_averages, round(avg(f1), 6) AS average_f1 FROM ({_SCORED})""",
    "eval_golds": r"""
SELECT query_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_concat(coalesce(gold_answers, []), [answer]), lambda x: x IS NOT NULL AND regexp_replace(x, '[ \t\n\r\f]+', '', 'g') <> ''))), '|'), '') AS golds
FROM (SELECT DISTINCT query_id, gold_answers, answer FROM query_solution)""",
    "eval_spread": """
SELECT dataset, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std_pop, round(stddev_samp(v), 6) AS std_samp, round(min(v), 6) AS least, round(max(v), 6) AS greatest, round(max(v) - min(v), 6) AS score_range
FROM (SELECT DISTINCT query_id, dataset, len(docs)::DOUBLE AS v FROM query_solution WHERE docs IS NOT NULL) GROUP BY dataset""",
    "eval_truncated": r"""
SELECT query_id, coalesce(array_to_string((list_filter(regexp_split_to_array(answer, '[ \t\n\r\f]+'), lambda x: x <> ''))[1:14], ' '), '') AS answer
FROM (SELECT DISTINCT query_id, answer FROM query_solution WHERE answer IS NOT NULL)""",
    "eval_selected": """
WITH f AS (SELECT dataset, min(query_id) AS q FROM query_solution WHERE dataset IS NOT NULL GROUP BY dataset ORDER BY q, dataset LIMIT 3)
SELECT dataset, query_id FROM (SELECT DISTINCT dataset, query_id FROM query_solution WHERE dataset IN (SELECT dataset FROM f))
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY query_id) <= 20""",
    "eval_overlap": f"""
WITH r AS (SELECT DISTINCT query_id, answer, gold_answers[1] AS gold FROM query_solution WHERE answer IS NOT NULL AND gold_answers[1] IS NOT NULL),
t AS (SELECT query_id, {_PLAIN.format('answer')} AS a, {_PLAIN.format('gold')} AS g FROM r),
t2 AS (SELECT *, {_GRAMS2.format('a')} AS a2, {_GRAMS2.format('g')} AS g2 FROM t),
s AS (SELECT query_id, len(a) AS la, len(g) AS lg, len(a2) AS la2, len(g2) AS lg2, {_COMMON.format(a='a', b='g')}::DOUBLE AS c1, {_COMMON.format(a='a2', b='g2')}::DOUBLE AS c2 FROM t2),
b AS (SELECT *, CASE WHEN la >= lg THEN 1.0 ELSE exp(1 - lg::DOUBLE / greatest(la, 1)) END AS bp, ln((CASE WHEN c1 = 0 THEN 0.1 ELSE c1 END) / greatest(la, 1)) AS l1, ln((CASE WHEN c2 = 0 THEN 0.1 ELSE c2 END) / greatest(la2, 1)) AS l2 FROM s)
SELECT query_id, round(CASE WHEN c1 > 0 THEN 2 * c1 / (la + lg) ELSE 0.0 END, 6) AS rouge1, round(CASE WHEN c2 > 0 THEN 2 * c2 / (la2 + lg2) ELSE 0.0 END, 6) AS rouge2,
  round(CASE WHEN la = 0 OR c1 = 0 THEN 0.0 ELSE bp * exp(l1) END, 6) AS bleu1, round(CASE WHEN la = 0 OR c1 = 0 THEN 0.0 ELSE bp * exp((l1 + l2) / 2) END, 6) AS bleu2 FROM b""",
    "eval_ddl": """
SELECT DISTINCT db_id || '/' || lower(trim(table_name)) AS key, lower(trim(table_name)) AS table_name, lower(trim(name)) AS column_name FROM schema_columns""",
}
