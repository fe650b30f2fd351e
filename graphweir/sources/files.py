"""Sources and sinks other than plain Parquet tables.

All readers take explicit schemas and are distributed; what is read on the
driver is configuration, and is said to be.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUESTION = "question STRING, answer STRING, gold_ans STRING, reference STRING, answer_aliases ARRAY<STRING>, supporting_facts ARRAY<ARRAY<STRING>>, context ARRAY<STRUCT<title: STRING, sentences: ARRAY<STRING>>>, contexts ARRAY<STRUCT<title: STRING, text: STRING, is_supporting: BOOLEAN>>, paragraphs ARRAY<STRUCT<title: STRING, text: STRING, paragraph_text: STRING, is_supporting: BOOLEAN>>"
OPENIE = "docs ARRAY<STRUCT<idx: STRING, passage: STRING, extracted_entities: ARRAY<STRING>, extracted_triples: ARRAY<ARRAY<STRING>>>>, avg_ent_chars DOUBLE, avg_ent_words DOUBLE"
SQUALITY = "document STRING, questions ARRAY<STRUCT<question_text: STRING, responses: ARRAY<STRUCT<response_text: STRING>>>>, metadata STRUCT<passage_id: STRING>"
INSTANCE = "instance_id STRING, db STRING, question STRING, external_knowledge STRING"
#: A list of name patterns is a setting; a longer one is refused.
MOST_PATTERNS = 10_000
TABLE_EXPORT = "table_name STRING, table_fullname STRING, column_names ARRAY<STRING>, column_types ARRAY<STRING>, sample_rows ARRAY<STRING>"


def json_kv(spark: SparkSession, path: str, value: str = "STRING", lines: bool = False) -> DataFrame:
    """A JSON object file (with ``lines``, an object a line) as (id, value); a missing file is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"id STRING, value {value}")
    raw = spark.read.text(path, wholetext=not lines).select(F.from_json("value", f"MAP<STRING, {value}>").alias("m"))
    return raw.select(F.explode("m").alias("id", "value"))


def write_json_kv(df: DataFrame, path: str) -> None:
    """(id, value) rows as JSON objects, one of a single entry per line."""
    df.select(F.to_json(F.map_from_arrays(F.array("id"), F.array("value"))).alias("value")).write.mode("overwrite").text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, attributes) and edges (src, tgt, attributes, weight) of GraphML; missing weights are 0, empty attributes dropped.

    Attributes are keyed as in the file's key declarations (``d0`` and so on).
    """
    data = "data ARRAY<STRUCT<_key: STRING, _VALUE: STRING>>"
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    attributes = F.map_from_entries(F.filter(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(d["_key"].alias("key"), d["_VALUE"].alias("value"))), lambda d: d["value"].isNotNull()))
    nodes = read("node", f"_id STRING, {data}").select(F.col("_id").alias("name"), attributes.alias("attributes"))
    edges = read("edge", f"_source STRING, _target STRING, {data}").select(F.col("_source").alias("src"), F.col("_target").alias("tgt"), attributes.alias("attributes"))
    names = {r["_id"]: r["name"] for r in read("key", "_id STRING, `_attr.name` STRING, _for STRING").select("_id", F.col("`_attr.name`").alias("name")).collect()}  # declarations
    weight = next((k for k, n in names.items() if n == "weight"), "d3")
    return nodes, edges.withColumn("weight", F.coalesce(F.try_element_at("attributes", F.lit(weight)).cast("double"), F.lit(0.0)))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes (name, entity_type) and edges (src, tgt, weight) as GraphML text, in parts that concatenate in order."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    kind = F.when(F.col("entity_type").isNotNull(), F.concat(F.lit('<data key="d0">'), esc(F.col("entity_type")), F.lit("</data>"))).otherwise("")
    n = nodes.select(F.lit(1).alias("part"), F.col("name").alias("key"), F.concat(F.lit('<node id="'), esc(F.col("name")), F.lit('">'), kind, F.lit("</node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws("\u001f", "src", "tgt").alias("key"), F.concat(F.lit('<edge source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("tgt")), F.lit('"><data key="d3">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("line"))
    spark = nodes.sparkSession
    head = '<?xml version="1.0" encoding="utf-8"?><graphml><key id="d0" for="node" attr.name="entity_type" attr.type="string"/><key id="d3" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="directed">'
    ends = spark.createDataFrame([(0, "", head), (3, "", "</graph></graphml>")], "part INT, key STRING, line STRING")
    n.unionByName(e).unionByName(ends).orderBy("part", "key").select("line").write.mode("overwrite").text(path)


def corpus(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A multi-hop corpus (JSON array or lines of title, text): title, text, content."""
    rows = spark.read.schema("title STRING, text STRING").option("multiLine", not lines).json(path)
    return rows.withColumn("content", F.concat_ws("\n", "title", "text"))


def questions(spark: SparkSession, path: str, joiner: str = " ", lines: bool = False) -> DataFrame:
    """Multi-hop questions with gold answers and gold documents from three shapes.

    Golds come from answer, gold_ans or reference, and aliases. Gold documents
    come from supporting facts over contexts (sentences joined by ``joiner``),
    else from supporting contexts, else from supporting paragraphs.
    """
    q = spark.read.schema(QUESTION).option("multiLine", not lines).json(path)
    named = F.transform("supporting_facts", lambda f: f[0])
    shape_a = F.transform(F.filter("context", lambda c: F.array_contains(named, c["title"])), lambda c: F.concat(c["title"], F.lit("\n"), F.array_join(c["sentences"], joiner)))
    shape_b = F.transform(F.filter("contexts", lambda c: c["is_supporting"]), lambda c: F.concat(c["title"], F.lit("\n"), c["text"]))
    shape_c = F.transform(F.filter("paragraphs", lambda c: c["is_supporting"]), lambda c: F.concat(c["title"], F.lit("\n"), F.coalesce(c["text"], c["paragraph_text"])))
    gold = F.array_distinct(F.filter(F.concat(F.array(F.coalesce("answer", "gold_ans", "reference")), F.coalesce("answer_aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull()))
    return q.select("question", gold.alias("gold_answers"), F.array_distinct(F.coalesce(shape_a, shape_b, shape_c, F.array().cast("array<string>"))).alias("gold_docs"))


def story_questions(spark: SparkSession, path: str) -> DataFrame:
    """Stories exploded to (passage_id, document, question, answer, all_answers); empty answers dropped."""
    rows = spark.read.schema(SQUALITY).json(path).select("document", F.col("metadata.passage_id").alias("passage_id"), F.explode("questions").alias("q"))
    answers = F.filter(F.transform("q.responses", lambda r: r["response_text"]), lambda r: F.coalesce(r, F.lit("")) != "")
    return rows.select("passage_id", "document", F.col("q.question_text").alias("question"), answers.alias("all_answers")).where("size(all_answers) > 0").withColumn("answer", F.col("all_answers")[0])


def instances(spark: SparkSession, path: str, ids: list[str] | None = None, db: str | None = None) -> DataFrame:
    """Text-to-SQL instances by ids and database."""
    rows = spark.read.schema(INSTANCE).json(path)
    if ids is not None:
        rows = rows.where(F.col("instance_id").isin(ids))
    return rows if db is None else rows.where(F.col("db") == db)


def openie(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Extraction results: passage, entities, triples; ``done`` if there is any entity or triple."""
    docs = spark.read.schema(OPENIE).option("multiLine", not lines).json(path).select(F.explode("docs").alias("d"))
    return docs.select(F.col("d.passage").alias("passage"), F.coalesce("d.extracted_entities", F.array().cast("array<string>")).alias("entities"), F.coalesce("d.extracted_triples", F.array().cast("array<array<string>>")).alias("triples")).withColumn("done", (F.size("entities") > 0) | (F.size("triples") > 0))


def openie_averages(extracted: DataFrame) -> DataFrame:
    """Mean characters and words of extracted entities (one row)."""
    e = extracted.select(F.explode("entities").alias("e"))
    return e.agg(F.round(F.avg(F.length("e")), 4).alias("avg_ent_chars"), F.round(F.avg(F.size(F.split(F.trim("e"), r"\s+"))), 4).alias("avg_ent_words"))


def table_exports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A directory of table JSONs (schema folders or flat) as columns: schema_name, table_name, column_name, type, at."""
    rows = spark.read.schema(TABLE_EXPORT).option("multiLine", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    folder = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    base = os.path.basename(path.rstrip("/"))
    pairs = F.posexplode(F.arrays_zip("column_names", "column_types")).alias("at", "c")
    return rows.select(F.when(folder == base, F.lit("PUBLIC")).otherwise(folder).alias("schema_name"), F.coalesce("table_name", F.regexp_extract("table_fullname", r"([^.]*)$", 1)).alias("table_name"), pairs).select("schema_name", "table_name", F.col("c.column_names").alias("column_name"), F.col("c.column_types").alias("type"), "at")


def ddl_csv(spark: SparkSession, paths: list[str], metadata: DataFrame | None = None) -> DataFrame:
    """DDL lists (table_name, column_name, data_type) merged with live metadata; local types are preferred."""
    local = spark.read.schema("table_name STRING, column_name STRING, data_type STRING").option("header", True).csv(paths)
    local = local.where("column_name is not null").dropDuplicates(["table_name", "column_name"])
    if metadata is None:
        return local
    live = metadata.select("table_name", "column_name", F.col("data_type").alias("live_type"))
    return local.join(live, ["table_name", "column_name"], "full").select("table_name", "column_name", F.coalesce("data_type", "live_type").alias("data_type"))


def expand_names(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """Names matched by patterns: a glob, or a bare prefix that means itself and ``prefix_*``."""
    if patterns.limit(MOST_PATTERNS + 1).count() > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    p = patterns.select("pattern", F.when(F.contains("pattern", F.lit("*")), F.concat(F.lit("^"), F.replace(F.replace("pattern", F.lit("."), F.lit("\\.")), F.lit("*"), F.lit(".*")), F.lit("$"))).otherwise(F.concat(F.lit("^"), F.col("pattern"), F.lit("(_.*)?$"))).alias("r"))
    return names.join(F.broadcast(p), F.expr("name rlike r")).select("name", "pattern").distinct()  # at most MOST_PATTERNS rows


def custom_graph(spark: SparkSession, kg: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph given as {chunks, entities, relationships}: names quoted in lower case, sources
    resolved to chunk ids (else UNKNOWN), missing ends added, weight 1 by default."""
    from graphweir.functions.identity import chunk_id
    from graphweir.operators.text import stub_nodes

    make = lambda rows, schema: spark.createDataFrame([[r.get(f.name) for f in T.StructType.fromDDL(schema)] for r in rows], schema)
    chunks = make(kg.get("chunks", []), "content STRING, source_id STRING").withColumn("chunk_id", chunk_id(F.trim("content")))
    source = chunks.select("source_id", "chunk_id")
    name = lambda c: F.concat(F.lit('"'), F.lower(F.trim(c)), F.lit('"'))
    entities = make(kg.get("entities", []), "entity_name STRING, entity_type STRING, description STRING, source_id STRING").join(source, "source_id", "left")
    nodes = entities.select(name("entity_name").alias("name"), F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("chunk_id", F.lit("UNKNOWN")).alias("source_id"))
    relations = make(kg.get("relationships", []), "src_id STRING, tgt_id STRING, description STRING, keywords STRING, weight DOUBLE, source_id STRING").join(source, "source_id", "left")
    edges = relations.select(name("src_id").alias("src_id"), name("tgt_id").alias("tgt_id"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("keywords", F.lit("")).alias("keywords"), F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("chunk_id", F.lit("UNKNOWN")).alias("source_id"))
    stubs = stub_nodes(edges, nodes).withColumn("description", F.lit("UNKNOWN")).withColumn("source_id", F.lit("UNKNOWN"))
    return chunks.select("chunk_id", "content"), nodes.unionByName(stubs), edges


def summary_columns(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Columns of profile summaries (JSON): table_name, column_name, type, is_primary_key, references_table, references_column, samples.

    Samples may be a map of lists or a list of rows; both come out per column.
    """
    raw = spark.read.text(path, wholetext=not lines).select(F.from_json("value", "tables MAP<STRING, STRUCT<columns: ARRAY<STRUCT<name: STRING, type: STRING, is_primary_key: BOOLEAN, is_foreign_key: BOOLEAN, references_table: STRING, references_column: STRING>>, samples: STRING>>").alias("s"))
    tables = raw.select(F.explode("s.tables").alias("table_name", "t"))
    columns = tables.select("table_name", F.explode("t.columns").alias("c"), F.col("t.samples").alias("samples"))
    by_map = F.from_json("samples", "MAP<STRING, ARRAY<STRING>>")
    by_rows = F.from_json("samples", "ARRAY<MAP<STRING, STRING>>")
    one = F.coalesce(F.try_element_at(by_map, F.col("c.name")), F.transform(by_rows, lambda r: F.try_element_at(r, F.col("c.name"))))
    return columns.select("table_name", F.col("c.name").alias("column_name"), F.col("c.type").alias("type"), F.coalesce("c.is_primary_key", F.lit(False)).alias("is_primary_key"), F.col("c.references_table").alias("references_table"), F.col("c.references_column").alias("references_column"), F.slice(F.filter(one, lambda x: x.isNotNull()), 1, 3).alias("samples"))


def write_summary(stats: DataFrame, path: str) -> None:
    """Profile rows as one JSON document per table."""
    per_table = stats.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct(*[c for c in stats.columns if c != "table_name"]))).alias("columns"))
    per_table.select(F.to_json(F.struct("table_name", "columns")).alias("value")).write.mode("overwrite").text(path)


def summary_path(db: str, folders: list[str]) -> str | None:
    """The first summary file of a database over search folders (driver-side path lookup)."""
    for suffix in ("_db_summary.json", "_bigquery_summary.json"):
        for folder in folders:
            for candidate in (Path(folder) / f"{db}{suffix}", Path(folder) / db / f"{db}{suffix}"):
                if candidate.exists():
                    return str(candidate)
    return None


def chat_template(path: str, program: str) -> list[dict[str, str]]:
    """A few-shot template as chat messages (driver-side configuration)."""
    with open(path, encoding="utf-8") as f:
        return template_messages(json.load(f)[program])


def template_messages(body: dict) -> list[dict[str, str]]:
    """A template (system, demos) as messages of the system, and of user and assistant for each demonstration."""
    messages = [{"role": "system", "content": body.get("system", "")}]
    for demo in body.get("demos", []):
        messages.append({"role": "user", "content": f"[[ ## question ## ]]\n{demo['question']}\n\n[[ ## fact_before_filter ## ]]\n{demo['fact_before_filter']}"})
        messages.append({"role": "assistant", "content": f"[[ ## fact_after_filter ## ]]\n{demo['fact_after_filter']}"})
    return messages


def excel_columns(spark: SparkSession, path: str) -> DataFrame:
    """Sheets and columns of a workbook with null counts and three samples; needs an Excel reader for pandas."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e
    import pandas as pd

    rows = []
    for sheet, frame in pd.read_excel(path, sheet_name=None).items():
        for column in frame.columns:
            rows.append((os.path.basename(path), str(sheet), str(column), int(frame[column].isna().sum()), [str(x) for x in frame[column].dropna().head(3)]))
    return spark.createDataFrame(rows, "file STRING, sheet STRING, column_name STRING, nulls INT, samples ARRAY<STRING>")


def write_results(rows: DataFrame, path: str) -> None:
    """Answers or scores as JSON, a document a row."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
