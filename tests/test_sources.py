"""Readers and writers on small files."""

import json

from graphweir.sources import files


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_key_value(spark, tmp_path):
    p = put(tmp_path / "kv.json", json.dumps({"a": {"x": 1}, "b": {"x": 2}}))
    assert {r.id: r.value.x for r in files.json_kv(spark, p, "STRUCT<x: INT>").collect()} == {"a": 1, "b": 2}
    assert files.json_kv(spark, str(tmp_path / "none.json")).count() == 0


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a<b", "place"), ("c", None)], "name STRING, entity_type STRING")
    edges = spark.createDataFrame([("a<b", "c", 2.5)], "src STRING, tgt STRING, weight DOUBLE")
    files.write_graphml(nodes, edges, str(tmp_path / "g"))
    n, e = files.graphml(spark, str(tmp_path / "g"))
    assert {r.name for r in n.collect()} == {"a<b", "c"} and [(r.src, r.tgt, r.weight) for r in e.collect()] == [("a<b", "c", 2.5)]


def test_questions_of_three_shapes(spark, tmp_path):
    rows = [
        {"question": "q1", "answer": "x", "supporting_facts": [["T", "0"]], "context": [{"title": "T", "sentences": ["s1", "s2"]}, {"title": "U", "sentences": ["n"]}]},
        {"question": "q2", "gold_ans": "y", "answer_aliases": ["z"], "contexts": [{"title": "A", "text": "t", "is_supporting": True}, {"title": "B", "text": "u", "is_supporting": False}]},
        {"question": "q3", "reference": "w", "paragraphs": [{"title": "P", "paragraph_text": "pt", "is_supporting": True}]},
    ]
    got = {r.question: (r.gold_answers, r.gold_docs) for r in files.questions(spark, put(tmp_path / "q.json", json.dumps(rows))).collect()}
    assert got == {"q1": (["x"], ["T\ns1 s2"]), "q2": (["y", "z"], ["A\nt"]), "q3": (["w"], ["P\npt"])}


def test_corpus_stories_instances(spark, tmp_path):
    c = files.corpus(spark, put(tmp_path / "c.json", json.dumps([{"title": "T", "text": "x"}])))
    assert c.first().content == "T\nx"
    s = {"document": "d", "questions": [{"question_text": "q", "responses": [{"response_text": ""}, {"response_text": "r"}]}, {"question_text": "e", "responses": [{"response_text": ""}]}], "metadata": {"passage_id": "1"}}
    assert [(r.question, r.answer) for r in files.story_questions(spark, put(tmp_path / "s.jsonl", json.dumps(s))).collect()] == [("q", "r")]
    i = put(tmp_path / "i.jsonl", "\n".join(json.dumps({"instance_id": str(k), "db": "a" if k else "b", "question": "q"}) for k in range(3)))
    assert files.instances(spark, i, ["1", "2"], "a").count() == 2


def test_openie(spark, tmp_path):
    p = put(tmp_path / "o.json", json.dumps({"docs": [{"idx": "1", "passage": "p", "extracted_entities": ["Old Mill"], "extracted_triples": []}, {"idx": "2", "passage": "e", "extracted_entities": [], "extracted_triples": []}]}))
    o = files.openie(spark, p)
    assert [r.done for r in o.orderBy("passage").collect()] == [False, True] and list(files.openie_averages(o).first()) == [8.0, 2.0]


def test_table_exports_and_ddl(spark, tmp_path):
    (tmp_path / "db" / "S1").mkdir(parents=True)
    put(tmp_path / "db" / "S1" / "t.json", json.dumps({"table_name": "T", "column_names": ["a", "b"], "column_types": ["INT", "TEXT"]}))
    put(tmp_path / "db" / "u.json", json.dumps({"table_fullname": "x.y.U", "column_names": ["c"], "column_types": ["INT"]}))
    got = {(r.schema_name, r.table_name, r.column_name, r.type) for r in files.table_exports(spark, str(tmp_path / "db")).collect()}
    assert got == {("S1", "T", "a", "INT"), ("S1", "T", "b", "TEXT"), ("PUBLIC", "U", "c", "INT")}
    d = put(tmp_path / "DDL.csv", "table_name,column_name,data_type\nt,a,INT64\n")
    live = spark.createDataFrame([("t", "a", "STRING"), ("t", "b", "BOOL")], "table_name STRING, column_name STRING, data_type STRING")
    assert {(r.column_name, r.data_type) for r in files.ddl_csv(spark, [d], live).collect()} == {("a", "INT64"), ("b", "BOOL")}


def test_names_summary_custom_graph(spark, tmp_path):
    n = spark.createDataFrame([("sales",), ("sales_2020",), ("salesman",)], "name STRING")
    p = spark.createDataFrame([("sales",)], "pattern STRING")
    assert {r.name for r in files.expand_names(n, p).collect()} == {"sales", "sales_2020"}
    for samples in ({"a": ["1", "2"]}, [{"a": "1"}, {"a": "2"}]):
        s = put(tmp_path / "s.json", json.dumps({"tables": {"t": {"columns": [{"name": "a", "type": "INT"}], "samples": samples}}}))
        assert files.summary_columns(spark, s).first().samples == ["1", "2"]
    kg = {"chunks": [{"content": "c", "source_id": "1"}], "entities": [{"entity_name": "Ann", "source_id": "1"}], "relationships": [{"src_id": "Ann", "tgt_id": "Bob", "source_id": "9"}]}
    _, nodes, edges = files.custom_graph(spark, kg)
    assert {r.name: r.entity_type for r in nodes.collect()} == {'"ann"': "UNKNOWN", '"bob"': "UNKNOWN"} and edges.first().weight == 1.0 and edges.first().source_id == "UNKNOWN"
