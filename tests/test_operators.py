"""Properties and brute-force checks of core operators."""

import json
import math
import os
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from graphweir.functions import similarity as sim
from graphweir.functions import text as tx
from graphweir.operators import diffusion, evaluate, graph, kv, retrieval, vector
from graphweir.operators import text as ops
from graphweir.providers import HashedWords, embedding_model, get, keywords, names, register
from graphweir.session import written
from graphweir.streaming import ingest


def test_word_chunks_at_the_limit(spark):
    docs = spark.createDataFrame([(1, " ".join(["w"] * 500)), (2, "  a  b " + " ".join(["w"] * 499)), (3, None), (4, " \n"), (5, " ".join(f"w{k}" for k in range(1300)))], "id INT, t STRING")
    got = {}
    for r in ops.word_chunks(docs, "id", "t").orderBy("id", "chunk_order_index").collect():
        got.setdefault(r.id, []).append(r.content.split())
    assert [len(c) for c in got[1]] == [500] and [len(c) for c in got[2]] == [500, 51] and 3 not in got and 4 not in got
    assert [len(c) for c in got[5]] == [500, 500, 400] and got[5][0][450:] == got[5][1][:50]


def test_phrases_and_answers(spark):
    df = spark.createDataFrame([("The A. Dog's  Bön!",)], "t STRING")
    row = df.select(tx.phrase(F.col("t")), tx.normalize_answer(F.col("t")), tx.normalize_answer(F.col("t"), False), tx.clean(F.lit(" &lt;b&gt;\x00x&amp; ")), tx.slug(F.lit("/a/My Model-2/"))).first()
    assert list(row) == ["the a  dog s  b n", "dogs bön", "dogs bön", "<b>x&", "my_model_2"]


def test_answer_scores(spark):
    df = spark.createDataFrame([(1, "the red red fox", ["red fox", "a cat"]), (2, "x", None), (3, None, ["x"]), (4, "Red, fox", ["red fox"])], "id INT, a STRING, g ARRAY<STRING>")
    got = {r.id: (r.exact_match, round(r.f1, 4)) for r in evaluate.answer_scores(df, "id", "a", "g").collect()}
    assert got == {1: (0, 0.8), 2: (0, 0.0), 3: (0, 0.0), 4: (1, 1.0)}


def test_min_max_of_equal_scores_is_one(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 0.0), (2, 5.0)], "q INT, s DOUBLE").withColumn("m", sim.min_max(F.col("s"), "q"))
    assert sorted((r.q, r.m) for r in df.collect()) == [(1, 1.0), (1, 1.0), (2, 0.0), (2, 1.0)]


def test_cosine_guards_and_quantisation(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    rows = df.select(sim.cosine01(F.col("a"), F.col("b")).alias("c"), sim.dequantize(sim.quantize(F.col("a"))).alias("q")).collect()
    assert [round(r.c, 6) for r in rows] == [0.0, 1.0] and rows[1].q == [3.0, 4.0]


def test_insert_if_absent_is_idempotent(spark):
    stored = spark.createDataFrame([("a", "old")], "k STRING, v STRING")
    batch = spark.createDataFrame([("a", "new", 1), ("b", "first", 1), ("b", "last", 2), (None, "x", 3)], "k STRING, v STRING, at INT")
    table, added = kv.insert_absent(stored, batch, "k", F.col("at"))
    assert sorted(map(tuple, table.collect())) == [("a", "old"), ("b", "last")] and added.count() == 1
    again, added = kv.insert_absent(table, batch, "k", F.col("at"))
    assert again.count() == 2 and added.count() == 0


def test_ingest_twice_is_once(spark):
    texts = spark.createDataFrame([("one text",), (" one text ",), ("",), (None,), (" ".join(["w"] * 950),)], "text STRING")  # three windows, two of equal words
    docs, chunks = ingest.ingest_batch(texts, None, None)
    assert docs.count() == 2 and chunks.count() == 3
    docs2, chunks2 = ingest.ingest_batch(texts, docs, chunks)
    assert docs2.count() == 0 and chunks2.count() == 0


def _random_graph(seed, n=12, p=0.35):
    rng = random.Random(seed)
    return [(f"n{a:02d}", f"n{b:02d}", round(rng.uniform(0.5, 2), 3)) for a in range(n) for b in range(n) if a < b and rng.random() < p]


def _diffuse(edges, alpha, rounds, eps, step):
    names_ = sorted({x for e in edges for x in e[:2]})
    at = {x: k for k, x in enumerate(names_)}
    w = np.zeros((len(names_),) * 2)
    for a, b, x in edges:
        w[at[a], at[b]] = w[at[b], at[a]] = x
    degree = np.maximum((w > 0).sum(1), 1)
    sink = degree * 10 / degree.sum()
    mass, x = np.zeros(len(names_)), np.zeros(len(names_))
    mass[0] = alpha * 10
    for _ in range(rounds):
        active = (mass > sink + eps) & (w.sum(1) > 0)
        excess = np.where(active, mass - sink, 0)
        x += step * excess / (w.sum(1) + 1e-8)
        mass = mass - excess + (excess / (w.sum(1) + 1e-8)) @ w
    return dict(zip(names_, x, strict=True)), mass.sum()


def test_diffusion_against_numpy(spark):
    rows = _random_graph(1)
    e = spark.createDataFrame(rows, "src STRING, tgt STRING, weight DOUBLE")
    both = graph.undirected(e)
    nodes = both.select(F.col("src").alias("name")).distinct()
    sims = nodes.select(F.lit(0).alias("query_id"), F.col("name").alias("node"), F.lit(0.3).alias("sim"))
    first = min(r[0] for r in rows)
    mass = diffusion.source_mass(spark.createDataFrame([(0, first, first, 1.0)], "query_id INT, source STRING, node STRING, weight DOUBLE"), 1.5)
    got = {r.node: r.x for r in diffusion.diffuse(diffusion.query_edges(both, sims, "none"), diffusion.capacities(both, nodes), mass, 5).collect()}
    want, total = _diffuse(rows, 1.5, 5, 0.01, 0.2)
    assert all(math.isclose(got.get(k, 0.0), v, abs_tol=1e-9) for k, v in want.items()) and math.isclose(total, 15, rel_tol=1e-6)


def test_diffusion_in_parts_leaves_scores_only(spark, monkeypatch):
    rows = _random_graph(1)
    both = graph.undirected(spark.createDataFrame(rows, "src STRING, tgt STRING, weight DOUBLE"))
    nodes = both.select(F.col("src").alias("name")).distinct()
    sims = nodes.select(F.lit(0).alias("query_id"), F.col("name").alias("node"), F.lit(0.3).alias("sim"))
    mass = diffusion.source_mass(nodes.select(F.lit(0).alias("query_id"), F.col("name").alias("source"), F.col("name").alias("node"), F.lit(1.0).alias("weight")), 1.5)
    tables = []
    monkeypatch.setattr(diffusion, "written", lambda df, name, *a: tables.append((name, written(df, name, *a))) or tables[-1][1])
    got = diffusion.diffuse(diffusion.query_edges(both, sims, "none"), diffusion.capacities(both, nodes), mass, 4, most=4).collect()
    first = min(r[0] for r in rows)
    want = _diffuse(rows, 1.5, 4, 0.01, 0.2)[0]
    assert len(got) == len({(r.source, r.node) for r in got}) and len({r.source for r in got}) == nodes.count()
    assert {r.node: round(r.x, 9) for r in got if r.source == first} == {k: round(v, 9) for k, v in want.items() if v > 0}
    there = Counter(name for name, table in tables for path in {os.path.dirname(f) for f in table.inputFiles()} if os.path.exists(path.removeprefix("file://")))
    assert set(there) == {"diffusion-scores"} and sum(name == "diffusion-scores" for name, _ in tables) == 3


def test_order_does_not_matter_below_capacity(spark):
    rows = _random_graph(4)
    both = graph.undirected(spark.createDataFrame(rows, "src STRING, tgt STRING, weight DOUBLE"))
    nodes = both.select(F.col("src").alias("name")).distinct()
    sims = nodes.select(F.lit(0).alias("query_id"), F.col("name").alias("node"), F.lit(0.3).alias("sim"))
    first = min(r[0] for r in rows)
    mass = diffusion.source_mass(spark.createDataFrame([(0, first, first, 1.0)], "query_id INT, source STRING, node STRING, weight DOUBLE"), 0.3)
    e, sinks = diffusion.query_edges(both, sims, "none"), diffusion.capacities(both, nodes)
    a = {r.node: r.x for r in diffusion.diffuse(e, sinks, mass, 30, epsilon=1e-7).collect()}
    b = {r.node: r.x for r in diffusion.diffuse_sequential(e, sinks, mass, 5000, epsilon=1e-7).collect()}
    assert set(a) == set(b) and all(math.isclose(a[k], b[k], rel_tol=1e-3, abs_tol=1e-5) for k in a)


def test_cascade_and_cluster_json(spark):
    n = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", None)], "name STRING, entity_type STRING")
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "src STRING, tgt STRING, weight DOUBLE")
    r = spark.createDataFrame([("a", "b"), ("b", "c")], "src_id STRING, tgt_id STRING")
    left = graph.cascade_delete(n, e, n.select("name"), r, spark.createDataFrame([("a",)], "name STRING"))
    assert [x.count() for x in left] == [2, 1, 2, 1]
    m = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.9), (2, "c", 0.1)], "c INT, name STRING, x DOUBLE")
    got = {x.c: json.loads(x.json) for x in graph.cluster_json(m, e, n, "c").collect()}
    assert [v["entity"] for v in got[1]["nodes"]] == ["b", "a"] and got[1]["total_edges"] == 1 and got[2]["nodes"][0]["rank"] == 0


def test_table_names(spark, small):
    from graphweir.sources import tables

    assert {"documents", "orders"} <= set(tables.names(spark, small)) and ("doc_id", "bigint") in tables.columns(spark, small, "documents")


def test_components_and_pagerank(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("d", "e", 1.0)], "src STRING, tgt STRING, weight DOUBLE")
    n = spark.createDataFrame([(x,) for x in "abcdef"], "name STRING")
    assert {r.name: r.component for r in graph.components(n, e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    assert {r.name for r in graph.largest_component(n, e).collect()} == {"a", "b", "c"}
    assert math.isclose(sum(r.score for r in graph.pagerank(n, e, rounds=6, tolerance=None).collect()), 1.0, abs_tol=1e-9)
    assert graph.components(n.limit(0), e.limit(0)).count() == 0


def test_block_search_in_several_blocks(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((120, 8))
    keys = spark.createDataFrame([(k, v[k].tolist()) for k in range(120)], "id INT, v ARRAY<DOUBLE>")
    got = {(r.query_id, r["rank"]): r.id for r in vector.block_knn(keys.where("id < 10"), keys, 3, block_rows=25).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = np.round(u @ u.T, 6)
    np.fill_diagonal(c, -9)
    for q in range(10):
        assert [got[q, r] for r in (1, 2, 3)] == np.lexsort((np.arange(120), -c[q]))[:3].tolist()


def test_token_prefix_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 1)], "q INT, o INT, tokens INT")
    assert [r.o for r in retrieval.token_prefix(df, ["q"], [F.col("o")], "tokens", 8).collect()] == [1]


def test_csv_line_and_prompt(spark):
    row = spark.range(1).select(retrieval.csv_line(F.lit('a,"b"'), F.lit(None).cast("string"), F.lit(3)), retrieval.prompt("Q: {q} ({n})", q=F.lit("why"), n=F.lit(2))).first()
    assert list(row) == ['"a,""b""",,3', "Q: why (2)"]


def test_split_summaries(spark):
    df = spark.createDataFrame([(1, "Cluster 1: first one.\nCluster 2: second", 3)], "k INT, o STRING, n INT")
    assert [r.summary for r in retrieval.split_summaries(df, "k", "o", "n").orderBy("cluster").collect()] == ["first one.", "second", ""]


def test_records_round_trip(spark):
    e = spark.createDataFrame([("s", "Old Mill", "place", "A mill (by the river)")], "source STRING, name STRING, type STRING, description STRING")
    r = spark.createDataFrame([("s", "Old Mill", "River", "lies at", "near", 2.5)], "source STRING, src STRING, tgt STRING, description STRING, keywords STRING, weight DOUBLE")
    out = ops.render_records(e, r)
    assert list(ops.parse_entities(out).first()) == ["s", "Old Mill", "place", "A mill (by the river)"]
    assert list(ops.parse_relations(out).first()) == ["s", "Old Mill", "River", "lies at", "near", 2.5]


def test_providers(spark):
    row = spark.range(1).select(HashedWords(16).embed(F.lit("red fox red")).alias("e"), HashedWords(16).embed(F.lit(" ")).alias("z"), keywords(F.lit("Who is the Red Fox?")).alias("k")).first()
    assert math.isclose(sum(x * x for x in row.e), 1.0) and not any(row.z) and row.k == ["red", "fox"]
    register("retriever", "mine", dict)
    assert get("retriever", "mine") is dict and "mine" in names("retriever")
    assert embedding_model("nope")[0] == "jina-v3" and embedding_model(llm="gpt-4o")[1] == 1536


def test_json_text(spark):
    assert json.loads(spark.range(1).select(tx.json_body(F.lit('say {"a":\n 1} now'))).first()[0]) == {"a": 1}
