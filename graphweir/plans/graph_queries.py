"""Graph and diffusion queries over the entity graph of entity_nodes and edge_data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweir.functions.similarity import cosine01
from graphweir.operators import diffusion as df_
from graphweir.operators import graph as gr
from graphweir.operators import text as ops
from graphweir.operators import vector as vec
from graphweir.session import checkpointed, written
from graphweir.sources.tables import load

ROUNDS = 4
ALPHA = 2.0


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "entity_nodes").where("entity_name is not null").select(F.col("entity_name").alias("name"), "entity_type").distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    return gr.edge_list(load(spark, d, "edge_data").select("edge_id", "src_id", "tgt_id", "weight").distinct(), "src_id", "tgt_id", "weight")


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return gr.degrees(edges(spark, d))


def graph_edge_degrees(spark: SparkSession, d: str) -> DataFrame:
    return gr.edge_degrees(edges(spark, d))


def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Out-neighbours of the sources of all clusters."""
    return gr.neighbours(edges(spark, d), load(spark, d, "cluster_node_data").select(F.col("source_node").alias("name"))).distinct()


def graph_undirected(spark: SparkSession, d: str) -> DataFrame:
    return gr.undirected(edges(spark, d)).withColumn("weight", F.round("weight", 6))


def graph_guarded(spark: SparkSession, d: str) -> DataFrame:
    return gr.guarded(edges(spark, d), nodes(spark, d)).select("src", "tgt")


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return gr.stats(nodes(spark, d), "entity_type")


def graph_without_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Edges left after deleting the nodes of unknown type."""
    n = nodes(spark, d)
    gone = n.where("entity_type is null or upper(entity_type) = 'UNKNOWN'")
    return gr.without_nodes(n, edges(spark, d), gone)[1].select("src", "tgt")


def graph_induced(spark: SparkSession, d: str) -> DataFrame:
    """Edges inside each cluster, counted per cluster."""
    members = load(spark, d, "cluster_node_data").where("name is not null").select("cluster_id", "name").distinct()
    inside = gr.induced(edges(spark, d), members, "cluster_id")
    return inside.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 6).alias("weight"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return ops.facts(load(spark, d, "edge_data"), "source_id", "src_id", "keywords", "tgt_id").where("chunk is not null")


def graph_fact_edges(spark: SparkSession, d: str) -> DataFrame:
    return gr.fact_edges(_facts(spark, d))


def graph_entity_chunks(spark: SparkSession, d: str) -> DataFrame:
    return gr.entity_chunks(_facts(spark, d))


def graph_passage_edges(spark: SparkSession, d: str) -> DataFrame:
    return gr.passage_edges(_facts(spark, d))


def graph_synonym_edges(spark: SparkSession, d: str) -> DataFrame:
    """Similar rows of the embeddings table, among at most 101 of each."""
    k = vec.usable(load(spark, d, "embeddings"), "vec_id", "embedding", 64)
    names = k.select("id", F.concat(F.lit("vec"), F.col("id").cast("string")).alias("name"))
    return vec.synonym_edges(k, names, 0.3)


def graph_combined(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d)
    synonym = gr.fact_edges(f).where("weight > 1").withColumn("weight", F.lit(0.9))
    return gr.combine(synonym, gr.passage_edges(f), gr.fact_edges(f))


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return gr.components(nodes(spark, d), gr.guarded(edges(spark, d), nodes(spark, d)))


def graph_largest_component(spark: SparkSession, d: str) -> DataFrame:
    return gr.largest_component(nodes(spark, d), gr.guarded(edges(spark, d), nodes(spark, d)))


def graph_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return gr.pagerank(nodes(spark, d), gr.guarded(edges(spark, d), nodes(spark, d)), rounds=5, tolerance=None).select("name", F.round("score", 8).alias("score"))


def graph_personal_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Damping 0.5, undirected, reset to the sources of clusters by their flow."""
    flow = load(spark, d, "cluster_node_data").groupBy(F.col("source_node").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    both = gr.undirected(gr.guarded(edges(spark, d), nodes(spark, d)))
    return gr.pagerank(nodes(spark, d), both, rounds=5, damping=0.5, reset=flow, tolerance=None).select("name", F.round("score", 8).alias("score"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Every cluster source that is a node of the graph, as one query."""
    s = load(spark, d, "cluster_node_data").select(F.col("source_node").alias("name")).distinct()
    return gr.has_nodes(s, nodes(spark, d)).select(F.lit(0).alias("query_id"), F.col("name").alias("source"), F.col("name").alias("node"), F.lit(1.0).alias("weight"))


def flow_diffusion(spark: SparkSession, d: str) -> DataFrame:
    """Structural diffusion from every cluster source, all in one job."""
    n = nodes(spark, d)
    both = written(gr.undirected(gr.guarded(edges(spark, d), n)), "graph-edges")
    sim = n.select(F.lit(0).alias("query_id"), F.col("name").alias("node"), F.lit(0.0).alias("sim")).distinct()
    q = df_.query_edges(both, sim, "none")
    mass = df_.source_mass(_sources(spark, d), ALPHA)
    x = df_.diffuse(q, df_.capacities(both, n), mass, ROUNDS)
    return x.select("source", "node", F.round("x", 6).alias("x"))


#: Query sets of entity types that a search takes at once.
MOST_KINDS = 1_000


def flow_query_aware(spark: SparkSession, d: str) -> DataFrame:
    """Query-aware diffusion: each entity type asks by the mean vector of its nodes, from its five most similar nodes. A report
    of the 20 best nodes of each; more than ``MOST_KINDS`` types are refused."""
    v = load(spark, d, "node_embeddings")
    usable = vec.usable(v.select("node_id", "entity_name", "node_embeddings").distinct(), "entity_name", "node_embeddings", 96).dropDuplicates(["id"])
    kinds = nodes(spark, d).where("entity_type is not null").select(F.col("name").alias("id"), F.upper(F.trim("entity_type")).alias("query_id")).distinct()
    parts = usable.join(kinds, "id").select("query_id", F.posexplode("v").alias("at", "x")).groupBy("query_id", "at").agg(F.avg("x").alias("x"))
    centres = parts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("q"))
    centres = checkpointed(centres)
    if centres.count() > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} entity types")
    # a stated query set of checked size (one row per entity type) against all rows
    sim = checkpointed(usable.join(F.broadcast(centres), F.size("v") == F.size("q")).select("query_id", F.col("id").alias("node"), cosine01(F.col("v"), F.col("q")).alias("sim")))
    both = checkpointed(gr.undirected(gr.guarded(edges(spark, d), nodes(spark, d))))
    from graphweir.operators.retrieval import best

    seeds = best(sim, ["query_id"], "sim", "node", 5).select("query_id", F.lit("").alias("source"), "node", (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("query_id"))).alias("weight"))
    x = df_.diffuse(df_.query_edges(both, sim, "multiply"), df_.capacities(both, nodes(spark, d)), df_.source_mass(seeds, 1.5), ROUNDS)
    return df_.passages(x, nodes(spark, d).select(F.col("name").alias("node"))).where("rank <= 20").select("query_id", "rank", "node", F.round("score", 6).alias("score"))


def flow_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the stored flow: sizes and range of flow, those of several nodes above a floor."""
    c = load(spark, d, "cluster_node_data").where("name is not null and flow_value > 0 and not isnan(flow_value)")
    x = c.groupBy(F.col("cluster_id").alias("query_id"), F.col("source_node").alias("source"), F.col("name").alias("node")).agg(F.max("flow_value").alias("x"))
    return df_.clusters(x, 0.05)


QUERIES = {f.__name__: f for f in (graph_degrees, graph_edge_degrees, graph_neighbours, graph_undirected, graph_guarded, graph_stats, graph_without_unknown, graph_induced, graph_fact_edges, graph_entity_chunks, graph_passage_edges, graph_synonym_edges, graph_combined, graph_components, graph_largest_component, graph_pagerank, graph_personal_pagerank, flow_diffusion, flow_query_aware, flow_clusters)}

_E = """n AS (SELECT DISTINCT entity_name AS name, entity_type FROM entity_nodes WHERE entity_name IS NOT NULL),
e AS (SELECT src_id AS src, tgt_id AS tgt, sum(coalesce(weight, 1.0)) AS weight FROM (SELECT DISTINCT edge_id, src_id, tgt_id, weight FROM edge_data) WHERE src_id IS NOT NULL AND tgt_id IS NOT NULL GROUP BY ALL),
g AS (SELECT * FROM e WHERE src <> tgt AND src IN (SELECT name FROM n) AND tgt IN (SELECT name FROM n)),
pair AS (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, last(weight ORDER BY src, tgt) AS weight FROM {0} WHERE src <> tgt GROUP BY ALL),
u AS (SELECT a AS src, b AS tgt, weight FROM pair UNION ALL SELECT b, a, weight FROM pair)"""
_DIRECTED, _GUARDED = _E.format("e"), _E.format("g")
_PHRASE = "trim(regexp_replace(lower({0}), '[^A-Za-z0-9 ]', ' ', 'g'))"
_F = f"""f AS (SELECT * FROM (SELECT DISTINCT source_id AS chunk, {_PHRASE.format('src_id')} AS s, {_PHRASE.format('keywords')} AS p, {_PHRASE.format('tgt_id')} AS o FROM edge_data WHERE source_id IS NOT NULL) WHERE s <> '' AND p <> '' AND o <> ''),
fe AS (SELECT src, tgt, count(*)::DOUBLE AS weight FROM (SELECT s AS src, o AS tgt FROM f UNION ALL SELECT o, s FROM f) GROUP BY ALL),
pe AS (SELECT DISTINCT chunk AS src, x AS tgt, 1.0::DOUBLE AS weight FROM (SELECT chunk, s AS x FROM f UNION ALL SELECT chunk, o FROM f))"""


def _rank_sql(edges_: str, damping: float, reset: str) -> str:
    return f"""
WITH RECURSIVE {_GUARDED},
names AS (SELECT DISTINCT name FROM n),
raw AS ({reset}),
base AS (SELECT name, w / (SELECT sum(w) FROM raw) AS reset FROM raw),
steps AS (SELECT src, tgt, weight / sum(weight) OVER (PARTITION BY src) AS share FROM {edges_}),
pr AS (
  SELECT 0 AS k, name, reset AS score FROM base
  UNION ALL
  SELECT r.k + 1, b.name, {damping} * (coalesce(g.given, 0) + (1 - r.passed) * b.reset) + (1 - {damping}) * b.reset
  FROM base b
  CROSS JOIN (SELECT p.k, coalesce(sum(p.score * s.share), 0) AS passed FROM pr p LEFT JOIN steps s ON p.name = s.src WHERE p.k < 5 GROUP BY p.k) r
  LEFT JOIN (SELECT s.tgt, sum(p.score * s.share) AS given FROM pr p JOIN steps s ON p.name = s.src WHERE p.k < 5 GROUP BY s.tgt) g ON g.tgt = b.name)
SELECT name, round(score, 8) AS score FROM pr WHERE k = 5"""


ORACLES = {
    "graph_degrees": f"WITH {_DIRECTED} SELECT name, count(*) AS degree FROM (SELECT src AS name FROM e UNION ALL SELECT tgt FROM e) GROUP BY name",
    "graph_edge_degrees": f"WITH {_DIRECTED}, d AS (SELECT name, count(*) AS degree FROM (SELECT src AS name FROM e UNION ALL SELECT tgt FROM e) GROUP BY name) SELECT src, tgt, a.degree + b.degree AS edge_degree FROM e JOIN d a ON a.name = src JOIN d b ON b.name = tgt",
    "graph_neighbours": f"WITH {_DIRECTED} SELECT DISTINCT src AS name, tgt AS neighbour FROM e WHERE src IN (SELECT source_node FROM cluster_node_data)",
    "graph_undirected": f"WITH {_DIRECTED} SELECT src, tgt, round(weight, 6) AS weight FROM u",
    "graph_guarded": f"WITH {_DIRECTED} SELECT src, tgt FROM g",
    "graph_stats": f"WITH {_DIRECTED} SELECT coalesce(entity_type, 'unknown') AS entity_type, count(*) AS nodes FROM n GROUP BY 1",
    "graph_without_unknown": f"WITH {_DIRECTED}, gone AS (SELECT name FROM n WHERE entity_type IS NULL OR upper(entity_type) = 'UNKNOWN') SELECT src, tgt FROM e WHERE src NOT IN (SELECT name FROM gone) AND tgt NOT IN (SELECT name FROM gone)",
    "graph_induced": f"WITH {_DIRECTED}, m AS (SELECT DISTINCT cluster_id, name FROM cluster_node_data WHERE name IS NOT NULL) SELECT a.cluster_id, count(*) AS edges, round(sum(weight), 6) AS weight FROM e JOIN m a ON a.name = src JOIN m b ON b.name = tgt AND a.cluster_id = b.cluster_id GROUP BY 1",
    "graph_fact_edges": f"WITH {_F} SELECT * FROM fe",
    "graph_entity_chunks": f"WITH {_F} SELECT tgt AS name, count(*) AS chunks FROM pe GROUP BY 1",
    "graph_passage_edges": f"WITH {_F} SELECT * FROM pe",
    "graph_synonym_edges": """
WITH k AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
c AS (SELECT a.id AS src, b.id AS tgt, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS weight FROM k a JOIN k b ON a.id <> b.id)
SELECT src, tgt, weight FROM c QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, tgt) <= 101 AND weight >= 0.3""",
    "graph_combined": f"WITH {_F}, x AS (SELECT src, tgt, weight, 1 AS p FROM fe UNION ALL SELECT src, tgt, weight, 2 FROM pe UNION ALL SELECT src, tgt, 0.9, 3 FROM fe WHERE weight > 1) SELECT src, tgt, last(weight ORDER BY p, weight) AS weight FROM x GROUP BY ALL",
    "graph_components": f"""
WITH RECURSIVE {_GUARDED},
r(name, root) AS (SELECT DISTINCT name, name FROM n UNION SELECT u.tgt, r.root FROM r JOIN u ON u.src = r.name WHERE r.root < u.tgt)
SELECT name, min(root) AS component FROM r GROUP BY name""",
    "graph_largest_component": f"""
WITH RECURSIVE {_GUARDED},
r(name, root) AS (SELECT DISTINCT name, name FROM n UNION SELECT u.tgt, r.root FROM r JOIN u ON u.src = r.name WHERE r.root < u.tgt),
c AS (SELECT name, min(root) AS component FROM r GROUP BY name)
SELECT name FROM c WHERE component = (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)""",
    "graph_pagerank": _rank_sql("g", 0.85, "SELECT name, 1.0 AS w FROM names"),
    "graph_personal_pagerank": _rank_sql("u", 0.5, "SELECT names.name, coalesce(c.w, 0)::DOUBLE AS w FROM names LEFT JOIN (SELECT source_node AS name, count(*) AS w FROM cluster_node_data GROUP BY 1) c USING (name)"),
    "flow_diffusion": f"""
WITH RECURSIVE {_GUARDED},
deg AS (SELECT names.name, greatest(coalesce(c, 0), 1)::DOUBLE AS d FROM (SELECT DISTINCT name FROM n) names LEFT JOIN (SELECT src, count(*) AS c FROM u GROUP BY src) x ON x.src = names.name),
sink AS (SELECT name, d * 10.0 / (SELECT sum(d) FROM deg) AS sink FROM deg),
w AS (SELECT src, sum(weight) AS w FROM u GROUP BY src),
st AS (
  SELECT 0 AS k, s.source_node AS source, s.source_node AS node, {ALPHA * 10.0}::DOUBLE AS mass, 0.0::DOUBLE AS x
  FROM (SELECT DISTINCT source_node FROM cluster_node_data WHERE source_node IN (SELECT name FROM n)) s
  UNION ALL
  SELECT k, source, node, sum(mass), sum(x) FROM (
    SELECT k + 1 AS k, source, node, mass - excess AS mass, x + coalesce(0.2 * excess / (w + 1e-8), 0) AS x FROM (
      SELECT st.*, w.w, CASE WHEN mass > sink + 0.01 AND coalesce(w.w, 0) > 0 THEN mass - sink ELSE 0 END AS excess FROM st JOIN sink ON sink.name = st.node LEFT JOIN w ON w.src = st.node WHERE k < {ROUNDS})
    UNION ALL
    SELECT k + 1, source, u.tgt, (mass - sink) * u.weight / (w.w + 1e-8), 0.0 FROM st JOIN sink ON sink.name = st.node JOIN w ON w.src = st.node JOIN u ON u.src = st.node
    WHERE k < {ROUNDS} AND mass > sink + 0.01 AND w.w > 0 AND u.weight > 0)
  GROUP BY k, source, node)
SELECT source, node, round(x, 6) AS x FROM st WHERE k = {ROUNDS} AND x > 0""",
    "flow_clusters": """
WITH x AS (SELECT cluster_id AS query_id, source_node AS source, name AS node, max(flow_value) AS x FROM cluster_node_data WHERE name IS NOT NULL AND flow_value > 0 AND NOT isnan(flow_value) GROUP BY ALL)
SELECT query_id, source, count(*) AS cluster_size, max(x) AS max_flow, min(x) AS min_flow FROM x GROUP BY ALL HAVING count(*) > 1 AND max(x) >= 0.05""",
}
