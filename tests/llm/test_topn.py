import random

from graphweir.llm import topn


def brute(rows, n):
    best = {}
    for g, item, score in rows:
        if item is not None and score is not None and score == score:
            best[g, item] = max(score, best.get((g, item), score))
    groups = {}
    for (g, item), score in best.items():
        groups.setdefault(g, []).append((-score, item.encode(), item))
    return {(g, x[2], k + 1) for g, xs in groups.items() for k, x in enumerate(sorted(xs)[:n])}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    value = lambda: rng.choice([None, float("nan"), 0.0, -0.0, 0.5, 0.5, 1.0, rng.random()])
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, "", "é", "z", "Z", *"abcdefghij"]), value()) for _ in range(4000)]
    rows += [(100 + k, "only", 1.0) for k in range(300)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "g INT, item STRING, score DOUBLE, rank INT")
    got = {(r.g, r.item, r["rank"]) for r in topn.top_n(df, ["g"], "item", "score", 3).collect()}
    assert got == brute(rows, 3)


def test_states_merge(spark):
    import pyarrow as pa

    table = pa.table({"g": [1, 1, 1, 2], "item": ["a", "a", "b", "c"], "score": [1.0, 3.0, 2.0, 0.0]})
    whole = topn.heap_state(table, ["g"], "item", "score", 1)
    parts = pa.concat_tables([topn.heap_state(table.slice(k, 1), ["g"], "item", "score", 1) for k in range(4)])
    assert topn.heap_state(parts, ["g"], "item", "score", 1).to_pylist() == whole.to_pylist()


def test_empty(spark):
    df = spark.createDataFrame([], "g INT, item STRING, score DOUBLE")
    assert topn.top_n(df, ["g"], "item", "score", 3).count() == 0
