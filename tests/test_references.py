"""Orphan references against brute force over intervals."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from graphweir.operators import references as ref

T0 = datetime(2024, 1, 1)


def build(spark, parents, children):
    p = spark.createDataFrame(parents, "k STRING, a TIMESTAMP, z TIMESTAMP, src_table STRING")
    c = spark.createDataFrame(children, "id BIGINT, k STRING, at TIMESTAMP, until STRING")
    return ref.orphans(ref.parents(p, "p", F.col("k"), F.col("a"), F.col("z")), ref.children(c, "p", F.col("k"), "c", F.col("id"), F.col("k"), F.col("at"), F.col("at")))


def test_against_brute_force(spark):
    rng = random.Random(3)
    when = lambda: T0 + timedelta(hours=rng.randrange(24 * 90))
    parents = [(rng.choice("abcdH"), None if rng.random() < 0.05 else (s := when()), None if rng.random() < 0.4 else when(), "x") for _ in range(60)]
    parents += [("H", T0, T0 + timedelta(days=30), "x")] * 50  # a hot, repeated parent
    children = [(n, rng.choice("abcdeHHHH"), None if rng.random() < 0.03 else when(), "y") for n in range(800)]
    children += children[:40]
    got = {(r.record_id, r.ref_key) for r in build(spark, parents, children).collect()}
    want = {(n, k) for n, k, at, _ in children if at is None or not any(p == k and a is not None and a <= at and (z is None or z > at) for p, a, z, _ in parents)}
    assert got == want
    del s


def test_boundaries_and_nulls(spark):
    day = timedelta(days=1)
    parents = [("k", T0, T0 + day, ""), ("k", T0 + 3 * day, None, ""), (None, T0, None, "")]
    children = [(1, "k", T0, ""), (2, "k", T0 + day, ""), (3, "k", T0 - timedelta(seconds=1), ""), (4, "k", T0 + 3 * day, ""), (5, None, T0, ""), (6, "other", T0, ""), (None, "other", T0, "")]
    assert {r.record_id for r in build(spark, parents, children).collect()} == {2, 3, 6, None}


def test_empty(spark):
    assert build(spark, [], []).count() == 0
    assert {r.record_id for r in build(spark, [], [(1, "k", T0, "")]).collect()} == {1}
    report = ref.orphan_report(build(spark, [], [(1, "k", T0, ""), (1, "k", T0, ""), (2, "k", T0 + timedelta(days=40), "")]))
    assert sorted((r.period.month, r.orphan_references) for r in report.collect()) == [(1, 1), (2, 1)]
