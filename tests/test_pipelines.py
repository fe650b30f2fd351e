"""Parsing of model output and the pipelines, end to end on small inputs."""

from pyspark.sql import functions as F

from graphweir.config import PassageSettings, QuerySettings
from graphweir.operators import graph, parsing
from graphweir.plans import pipelines as pl
from graphweir.sources.tables import load


def test_parsing(spark):
    rows = [("say {'a': 1}", r"café", '{"x": [1, 2, {"y": "a,b"', "[[ ## fact_after_filter ## ]]\n{\"fact\": [[\"a\",\"b\",\"c\"],[\"d\"]]}\n[[ ## done ## ]]"), (None, None, None, None), ("none", "plain", "no json", "nothing")]
    df = spark.createDataFrame(rows, "a STRING, b STRING, c STRING, d STRING")
    got = df.select(parsing.json_response(F.col("a"), "a INT").getField("a").alias("a"), parsing.decode_unicode("b").alias("b"), parsing.repair_json("c").alias("c"), parsing.filtered_facts(F.col("d")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(1, "café", '{"x": [1, 2, {}]}', [["a", "b", "c"]]), (None, None, None, []), (None, "plain", None, [])]


def test_responses(spark):
    row = spark.range(1).select(
        parsing.named_entities(F.lit('x {"named_entities": ["A", "B", "A"]}')),
        parsing.response_triples(F.lit('{"triples": [["a","b","c"],["a","b"],["a","b","c"]]}')),
        parsing.keyword_lists(F.lit('{"high_level_keywords": ["h"], "low_level_keywords": ["l", "m"]}')),
        parsing.rating(F.lit("Score: 87.5 points")), parsing.rating(F.lit("999")),
    ).first()
    assert row[0] == ["A", "B"] and row[1] == [["a", "b", "c"]] and tuple(row[2]) == ("h", "l, m") and row[3] == 87.5 and row[4] is None


def test_passages_are_found(spark):
    chunks = spark.createDataFrame([("c1", "Alder Mill stands near Birch Bridge. Birch Bridge crosses Cedar River."), ("c2", "Dune Lighthouse guards Elm Harbour."), ("c3", "nothing of note")], "chunk_id STRING, content STRING")
    asked = spark.createDataFrame([(1, "Where does Alder Mill stand?"), (2, "What guards Elm Harbour?"), (3, "zzz?")], "query_id INT, question STRING")
    got = {}
    for r in pl.retrieve_passages(asked, chunks, PassageSettings(retrieval_top_k=2)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.chunk_id
    assert got[1][1] == "c1" and got[2][1] == "c2" and 3 not in got


def test_common_words_and_far_passages_are_answered(spark):
    """A question of common words alone, and a passage reached after more than three rounds."""
    names = ["Alder Mill", "Birch Bridge", "Cedar River", "Dune House", "Elm Harbour", "Fern Tower", "Gorse Lodge"]
    rows = [(f"h{k}", f"{a} near {b}.") for k, (a, b) in enumerate(zip(names, names[1:], strict=False))]
    rows += [(f"n{k:02d}", "water everywhere and nothing else") for k in range(14)]
    chunks = spark.createDataFrame(rows, "chunk_id STRING, content STRING")
    asked = spark.createDataFrame([(1, "water everywhere"), (2, "Alder Mill")], "query_id INT, question STRING")
    got = {}
    for r in pl.retrieve_passages(asked, chunks, PassageSettings(linking_top_k=1, edge_weight_scheme="none", alpha=50.0, rounds=5)).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    assert got[1] and got[1] >= {"n00"} and {"h0", "h3"} <= got[2]


def test_similar_entities_are_joined(spark):
    chunks = spark.createDataFrame([("c1", "Alder Mill saw Birch Bridge."), ("c2", "Mill Alder met Cedar River.")], "chunk_id STRING, content STRING")
    _, edges = pl.passage_graph(chunks, pl.extract_facts(chunks), PassageSettings())
    assert edges.where("src ilike 'entity:alder mill' and tgt ilike 'entity:mill alder'").count() == 1


def test_entity_context_keeps_its_budgets(spark, small):
    nodes = load(spark, small, "entity_nodes").groupBy(F.col("entity_name").alias("name")).agg(F.max("entity_type").alias("entity_type"), F.max("description").alias("description"))
    edges = graph.edge_list(load(spark, small, "edge_data").distinct(), "src_id", "tgt_id", "weight")
    sources = load(spark, small, "entity_nodes").where("source_id is not null").select(F.col("entity_name").alias("name"), F.col("source_id").alias("chunk")).distinct()
    chunks = load(spark, small, "chunk_info").groupBy(F.col("chunk_id").alias("chunk")).agg(F.max("content").alias("content"))
    asked = load(spark, small, "query_solution").select("query_id", "question").distinct()
    out = pl.entity_context(asked, nodes, edges, sources, chunks, QuerySettings(max_token_for_local_context=30))
    used = {(r.query_id, r.section): r.t for r in out.groupBy("query_id", "section").agg(F.sum("tokens").alias("t")).collect()}
    assert used and all(t <= (30 if s == "entities" else 4000) for (_, s), t in used.items()) and {s for _, s in used} >= {"entities", "relations"}


def test_schema_context(spark, small):
    columns = load(spark, small, "schema_columns")
    db = columns.where("db_id is not null").first()
    asked = spark.createDataFrame([(1, db.db_id, f"Which {db.table_name} has {db.name}?".replace("_", " "))], "query_id INT, db_id STRING, question STRING")
    rows = pl.schema_context(asked, columns).orderBy("rank").collect()
    assert rows and rows[0].ddl.startswith("CREATE TABLE") and db.table_name.lower().strip('"`') in [r.table_name for r in rows]


def test_empty_inputs(spark):
    chunks = spark.createDataFrame([], "chunk_id STRING, content STRING")
    asked = spark.createDataFrame([(1, "Where?")], "query_id INT, question STRING")
    assert pl.retrieve_passages(asked, chunks).count() == 0
