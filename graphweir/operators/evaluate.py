"""Evaluation of answers and retrieved sets.

Scores are computed per question and averaged in a second aggregation; arrays
are compared inside rows, so that only keys and numbers are shuffled. A
question without gold answers is skipped by the recall operators and scores 0
in the answer operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweir.functions.text import first_words, normalize_answer, strip, words

RECALL_AT = (1, 2, 5, 10, 20, 50, 100, 200)


def exact_match(answer: Column, golds: Column, articles_first: bool = True) -> Column:
    n = normalize_answer(answer, articles_first)
    return F.coalesce(F.exists(golds, lambda g: normalize_answer(g, articles_first) == n), F.lit(False)).cast("int")


def overlaps(df: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """Multiset overlap of two token arrays per key: keys, common, n_a, n_b.

    Tokens are counted per key over both sides in one aggregation, partial
    before its shuffle, so that long texts cost their length and no more. Keys
    must tell rows apart.
    """
    rows = df.select(*keys, a.alias("a"), b.alias("b"))
    tokens = rows.select(*keys, F.explode("a").alias("t"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(rows.select(*keys, F.explode("b").alias("t"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    counts = tokens.groupBy(*keys, "t").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return counts.groupBy(*keys).agg(F.sum(F.least("x", "y")).alias("common"), F.sum("x").alias("n_a"), F.sum("y").alias("n_b"))


def answer_scores(df: DataFrame, key: str, answer: str, golds: str, articles_first: bool = True) -> DataFrame:
    """Per distinct (key, answer, golds): exact match with any gold, and token F1 with the best one."""
    rows = df.select(F.col(key), F.col(answer).alias("a"), F.col(golds).alias("g")).distinct().withColumn("row", F.xxhash64("a", "g"))
    each = rows.select(key, "row", "a", F.posexplode("g").alias("n", "gold")).where("gold is not null")
    common = overlaps(each, [key, "row", "n"], words(normalize_answer(F.col("a"), articles_first)), words(normalize_answer(F.col("gold"), articles_first)))
    f1 = F.when(F.col("common") > 0, 2.0 * F.col("common") / (F.col("n_a") + F.col("n_b"))).otherwise(F.lit(0.0))
    best = common.groupBy(key, "row").agg(F.max(f1).alias("f1"))
    matched = rows.select(key, "row", exact_match(F.col("a"), F.col("g"), articles_first).alias("exact_match"))
    return matched.join(best, [key, "row"], "left").select(key, "exact_match", F.coalesce("f1", F.lit(0.0)).alias("f1"))


def recall_at(df: DataFrame, key: str, docs: str, golds: str, at: tuple[int, ...] = RECALL_AT) -> DataFrame:
    """Mean recall at each cut over questions with gold documents: k, recall, questions."""
    rows = df.select(F.col(key), F.array_distinct(F.col(docs)).alias("all"), F.col(docs).alias("d"), F.array_distinct(F.filter(golds, lambda g: g.isNotNull())).alias("g")).distinct().where("size(g) > 0")
    found = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.size(F.array_intersect(F.slice(F.coalesce("d", F.array().cast("array<string>")), 1, k), "g")) / F.size("g")).alias("r")) for k in at])).alias("x"))
    return found.groupBy(F.col("x.k").alias("k")).agg(F.round(F.avg("x.r"), 4).alias("recall"), F.count(F.lit(1)).alias("questions"))


def precision_recall(found: Column, gold: Column) -> tuple[Column, Column]:
    """Of two sets: both empty give (1, 1), one empty (0, 0)."""
    f, g = F.array_distinct(found), F.array_distinct(gold)
    hit = F.size(F.array_intersect(f, g))
    both = (F.size(f) == 0) & (F.size(g) == 0)
    none = (F.size(f) == 0) | (F.size(g) == 0)
    p = F.when(both, F.lit(1.0)).when(none, F.lit(0.0)).otherwise(hit / F.size(f))
    r = F.when(both, F.lit(1.0)).when(none, F.lit(0.0)).otherwise(hit / F.size(g))
    return p, r


def f1_of(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def set_scores(df: DataFrame, key: str, found: str, gold: str) -> DataFrame:
    """Per row: precision, recall, F1, missing and extra elements."""
    rows = df.select(F.col(key), F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("f"), F.coalesce(F.filter(gold, lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("g"))
    p, r = precision_recall(F.col("f"), F.col("g"))
    return rows.select(key, p.alias("precision"), r.alias("recall"), F.size(F.array_except("g", "f")).alias("missing"), F.size(F.array_except("f", "g")).alias("extra")).withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def macro(scores: DataFrame) -> DataFrame:
    """Averages, with the F1 of the averages and the average of the F1s."""
    p, r = F.avg("precision"), F.avg("recall")
    return scores.agg(p.alias("precision"), r.alias("recall"), f1_of(p, r).alias("f1_of_averages"), F.avg("f1").alias("average_f1"), F.count(F.lit(1)).alias("n"))


def spread(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean with both standard deviations, least and greatest per group."""
    v = F.col(value)
    return df.groupBy(group).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_pop"), F.stddev_samp(v).alias("std_samp"), F.min(v).alias("least"), F.max(v).alias("greatest"), (F.max(v) - F.min(v)).alias("score_range"))


def all_golds(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Gold answers and aliases united, blanks and nulls dropped."""
    arrays = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns]
    united = F.filter(F.array_distinct(F.concat(*arrays)), lambda g: g.isNotNull() & (strip(g) != ""))
    return df.select(key, F.array_sort(united).alias("golds"))


def truncated(df: DataFrame, key: str, answer: str, n: int = 14) -> DataFrame:
    return df.select(key, first_words(F.col(answer), n).alias("answer"))


def select_questions(df: DataFrame, document: str, question: str, documents: int, questions: int) -> DataFrame:
    """The first ``documents`` by order of their first question, and the first ``questions`` of each."""
    first = df.where(F.col(document).isNotNull()).groupBy(document).agg(F.min(question).alias("__first")).orderBy("__first", document).limit(documents)
    inner = Window.partitionBy(document).orderBy(question)
    chosen = df.select(document, question).distinct().join(F.broadcast(first.select(document)), document, "left_semi")  # ``documents`` rows
    return chosen.withColumn("n", F.row_number().over(inner)).where(F.col("n") <= questions).drop("n")


def ngrams(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def text_overlap(df: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    """Unstemmed ROUGE-1/2 F and BLEU-1/2 (one reference, equal weights, brevity penalty,
    0.1 for an order without a match) of lower-case words."""
    rows = df.select(F.col(key).alias(key), words(F.lower(candidate)).alias("c"), words(F.lower(reference)).alias("r"))
    part = {n: overlaps(rows, [key], ngrams(F.col("c"), n), ngrams(F.col("r"), n)).select(key, F.col("common").alias(f"hit{n}"), F.col("n_a").alias(f"c{n}"), F.col("n_b").alias(f"r{n}")) for n in (1, 2)}
    joined = rows.select(key).join(part[1], key, "left").join(part[2], key, "left").fillna(0)
    rouge = {n: F.when(F.col(f"hit{n}") > 0, 2.0 * F.col(f"hit{n}") / (F.col(f"c{n}") + F.col(f"r{n}"))).otherwise(F.lit(0.0)) for n in (1, 2)}
    log = {n: F.log(F.when(F.col(f"hit{n}") == 0, F.lit(0.1)).otherwise(F.col(f"hit{n}").cast("double")) / F.greatest(f"c{n}", F.lit(1))) for n in (1, 2)}
    brevity = F.when(F.col("c1") >= F.col("r1"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r1") / F.greatest("c1", F.lit(1))))
    some = (F.col("c1") > 0) & (F.col("hit1") > 0)
    return joined.select(key, rouge[1].alias("rouge1"), rouge[2].alias("rouge2"), F.when(some, brevity * F.exp(log[1])).otherwise(F.lit(0.0)).alias("bleu1"), F.when(some, brevity * F.exp((log[1] + log[2]) / 2)).otherwise(F.lit(0.0)).alias("bleu2"))


def parse_ddl(df: DataFrame, key: str, ddl: str) -> DataFrame:
    """Tables and columns of CREATE TABLE texts: key, table_name, column_name.

    A line either opens a table or names a column of the last opened one.
    """
    lines = df.select(F.col(key), F.posexplode(F.split(ddl, "\r?\n")).alias("at", "line"))
    opened = F.regexp_extract("line", r'(?i)^\s*CREATE TABLE\s+[`"]?([^`"(\s]+)', 1)
    column = F.regexp_extract("line", r'^\s+[`"]?([A-Za-z_][\w$]*)[`"]?\s+[A-Za-z]', 1)
    reserved = F.upper(column).isin("PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "CONSTRAINT", "CREATE")
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = lines.withColumn("table_name", F.last(F.when(opened != "", opened), ignorenulls=True).over(w)).withColumn("column_name", column)
    return named.where((F.col("column_name") != "") & ~reserved & (opened == "") & F.col("table_name").isNotNull()).select(key, F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name")).distinct()
