"""Graph tables and algorithms: nodes(name, ...), edges(src, tgt, weight).

Iterations are rounds of join and aggregation over edge tables that are hashed
by source once; each round is cut from its lineage by a checkpoint in the
shared folder. Sums over a hub's neighbours are aggregated before their
shuffle; joins with hubs are left to skew-join splitting at run time. Null
ends are no edges; self loops are dropped where stated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweir.session import checkpointed


def edge_list(df: DataFrame, src: str, tgt: str, weight: str) -> DataFrame:
    """Directed edges with summed weights; null weights count 1."""
    rows = df.select(F.col(src).alias("src"), F.col(tgt).alias("tgt"), F.coalesce(F.col(weight).cast("double"), F.lit(1.0)).alias("weight"))
    return rows.where("src is not null and tgt is not null").groupBy("src", "tgt").agg(F.sum("weight").alias("weight"))


def has_nodes(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    return asked.join(nodes.select("name").distinct(), "name", "left_semi")


def has_edges(asked: DataFrame, edges: DataFrame) -> DataFrame:
    return asked.join(edges.select("src", "tgt").distinct(), ["src", "tgt"], "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """In plus out degree of every end: name, degree."""
    ends = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("tgt").alias("name")))
    return ends.groupBy("name").agg(F.count(F.lit(1)).alias("degree"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    """The summed degrees of each edge's ends."""
    d = degrees(edges)
    left, right = d.select(F.col("name").alias("src"), F.col("degree").alias("a")), d.select(F.col("name").alias("tgt"), F.col("degree").alias("b"))
    return edges.select("src", "tgt").join(left, "src").join(right, "tgt").select("src", "tgt", (F.col("a") + F.col("b")).alias("edge_degree"))


def neighbours(edges: DataFrame, asked: DataFrame, direction: str = "out") -> DataFrame:
    a, b = ("src", "tgt") if direction == "out" else ("tgt", "src")
    return edges.join(asked.select(F.col("name").alias(a)).distinct(), a, "left_semi").select(F.col(a).alias("name"), F.col(b).alias("neighbour"))


def guarded(edges: DataFrame, nodes: DataFrame, loops: bool = False) -> DataFrame:
    """Edges whose two ends exist; self loops only if wanted."""
    names = nodes.select("name").distinct()
    kept = edges if loops else edges.where("src != tgt")
    kept = kept.join(names.select(F.col("name").alias("src")), "src", "left_semi")
    return kept.join(names.select(F.col("name").alias("tgt")), "tgt", "left_semi").select(*edges.columns)


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each pair, of equal weight: that of the pair's last edge in (src, tgt) order."""
    pair = edges.where("src != tgt").groupBy(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).agg(F.max_by("weight", F.struct("src", "tgt")).alias("weight"))
    return pair.select(F.col("a").alias("src"), F.col("b").alias("tgt"), "weight").unionByName(pair.select(F.col("b").alias("src"), F.col("a").alias("tgt"), "weight"))


def parallel(edges: DataFrame) -> DataFrame:
    """Both directions of every directed edge, kept apart: a pair with edges both ways counts twice."""
    e = edges.where("src != tgt").select("src", "tgt", "weight")
    return e.unionByName(e.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "weight"))


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    g = gone.select("name").distinct()
    left = edges.join(g.select(F.col("name").alias("src")), "src", "left_anti").join(g.select(F.col("name").alias("tgt")), "tgt", "left_anti")
    return nodes.join(g, "name", "left_anti"), left.select(*edges.columns)


def cascade_delete(nodes: DataFrame, edges: DataFrame, entity_vectors: DataFrame, relation_vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, entity vectors (name) and relation vectors (src_id, tgt_id) without the entities of ``gone`` (name)."""
    from graphweir.operators import vector

    n, e = without_nodes(nodes, edges, gone)
    return n, e, vector.by_entity(entity_vectors, "name", gone), vector.relations_without(relation_vectors, gone)


def cluster_json(members: DataFrame, edges: DataFrame, nodes: DataFrame, cluster: str) -> DataFrame:
    """Each cluster of (cluster, name, x) as a JSON text: its nodes in order of flow, with their degree
    inside the cluster as rank, and its inner edges. A cluster is one row by nature."""
    inner = induced(edges, members, cluster)
    ends = inner.select(cluster, F.col("src").alias("name")).unionByName(inner.select(cluster, F.col("tgt").alias("name"))).groupBy(cluster, "name").agg(F.count(F.lit(1)).alias("rank"))
    known = nodes.groupBy("name").agg(F.max("entity_type").alias("entity_type"))
    rows = members.groupBy(cluster, "name").agg(F.max("x").alias("x")).join(ends, [cluster, "name"], "left").join(known, "name", "left")
    listed = rows.groupBy(cluster).agg(F.max("x").alias("max_flow_value"), F.count(F.lit(1)).alias("cluster_size"), F.array_sort(F.collect_list(F.struct((-F.col("x")).alias("o"), F.col("name").alias("entity"), F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type"), F.coalesce("rank", F.lit(0)).alias("rank")))).alias("n"))
    linked = inner.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("src", "tgt", "weight"))).alias("edges"), F.count(F.lit(1)).alias("total_edges"))
    body = F.struct("cluster_size", "max_flow_value", F.transform("n", lambda x: F.struct(x["entity"].alias("entity"), x["entity_type"].alias("entity_type"), x["rank"].alias("rank"))).alias("nodes"), F.coalesce("edges", F.array().cast("array<struct<src:string,tgt:string,weight:double>>")).alias("edges"), F.coalesce("total_edges", F.lit(0)).alias("total_edges"))
    return listed.join(linked, cluster, "left").select(cluster, F.to_json(body).alias("json"))


def stats(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.groupBy(F.coalesce(F.col(kind), F.lit("unknown")).alias("entity_type")).agg(F.count(F.lit(1)).alias("nodes"))


def induced(edges: DataFrame, members: DataFrame, cluster: str) -> DataFrame:
    """Edges inside each cluster of (cluster, name)."""
    m = members.select(cluster, "name").distinct()
    left = edges.join(m.select(F.col(cluster).alias("c"), F.col("name").alias("src")), "src")
    right = m.select(F.col(cluster).alias("c"), F.col("name").alias("tgt"))
    return left.join(right, ["c", "tgt"]).select(F.col("c").alias(cluster), "src", "tgt", "weight")


def fact_edges(facts: DataFrame) -> DataFrame:
    """+1 in both directions for each (chunk, triple)."""
    pairs = facts.select(F.explode(F.array(F.struct(F.col("s").alias("src"), F.col("o").alias("tgt")), F.struct(F.col("o").alias("src"), F.col("s").alias("tgt")))).alias("e"))
    return pairs.groupBy("e.src", "e.tgt").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def entity_chunks(facts: DataFrame) -> DataFrame:
    """Number of chunks that name each entity."""
    e = facts.select("chunk", F.explode(F.array("s", "o")).alias("name")).distinct()
    return e.groupBy("name").agg(F.count(F.lit(1)).alias("chunks"))


def passage_edges(facts: DataFrame) -> DataFrame:
    e = facts.select(F.col("chunk").cast("string").alias("src"), F.explode(F.array("s", "o")).alias("tgt")).distinct()
    return e.select("src", "tgt", F.lit(1.0).alias("weight"))


def combine(synonym: DataFrame, passage: DataFrame, fact: DataFrame) -> DataFrame:
    """One weight per ordered pair: synonym before passage before fact edges."""
    ranked = fact.select("src", "tgt", "weight", F.lit(1).alias("p")).unionByName(passage.select("src", "tgt", "weight", F.lit(2).alias("p"))).unionByName(synonym.select("src", "tgt", "weight", F.lit(3).alias("p")))
    return ranked.groupBy("src", "tgt").agg(F.max_by("weight", F.struct("p", "weight")).alias("weight"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, damping: float = 0.85, reset: DataFrame | None = None, tolerance: float | None = 1e-6) -> DataFrame:
    """Weighted PageRank: name, score. Rounds end when the scores of all nodes together move by less than ``tolerance``
    a node; if ``rounds`` do not suffice that is an error. Without a tolerance there are just so many rounds.

    ``reset`` (name, weight) personalises it: negative, NaN and null weights
    are 0, the rest is scaled to sum 1 (uniform if all are 0). Mass of nodes
    without out-edges returns by the reset.
    """
    n = nodes.select("name").distinct()
    if reset is None:
        start = n.withColumn("w", F.lit(1.0))
    else:
        good = F.when(F.isnan("weight") | (F.col("weight") < 0), F.lit(0.0)).otherwise(F.col("weight"))
        start = n.join(reset.groupBy("name").agg(F.sum(F.coalesce(good, F.lit(0.0))).alias("w")), "name", "left").select("name", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = start.agg(F.sum("w").alias("sum"), F.count(F.lit(1)).alias("count"))
    base = start.join(F.broadcast(total)).select("name", F.when(F.col("sum") > 0, F.col("w") / F.col("sum")).otherwise(1.0 / F.col("count")).alias("reset"))
    base = checkpointed(base)
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    steps = checkpointed(edges.join(out.where("out > 0"), "src").select("src", "tgt", (F.col("weight") / F.col("out")).alias("share")))
    ranks = base.select("name", F.col("reset").alias("score"))
    for number in range(rounds):
        given = ranks.join(steps, ranks["name"] == steps["src"]).groupBy("tgt").agg(F.sum(F.col("score") * F.col("share")).alias("given"))
        passed = given.agg(F.coalesce(F.sum("given"), F.lit(0.0)).alias("passed"))
        before = ranks
        ranks = base.join(given, base["name"] == given["tgt"], "left").join(F.broadcast(passed)).select("name", (damping * (F.coalesce("given", F.lit(0.0)) + (1 - F.col("passed")) * F.col("reset")) + (1 - damping) * F.col("reset")).alias("score"))
        if number % 3 == 2 or number == rounds - 1:
            if tolerance is not None:
                ranks = ranks.join(before.select("name", F.col("score").alias("before")), "name")
            ranks = checkpointed(ranks)
            if tolerance is not None:
                moved = ranks.agg(F.sum(F.abs(F.col("score") - F.col("before"))) < tolerance * F.count(F.lit(1))).first()[0]
                ranks = ranks.select("name", "score")
                if moved is None or moved:
                    return ranks
    if tolerance is not None and rounds:
        raise RuntimeError(f"scores are not settled after {rounds} rounds")
    return ranks


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """The connected component of every node, named by its smallest member: name, component.

    Min-label propagation with pointer jumping, until nothing changes; an error
    if that takes more than ``rounds``, since labels would be incomplete. Labels
    stay in the cluster; only whether any changed reaches the driver.
    """
    both = edges.where("src != tgt").select("src", "tgt").unionByName(edges.where("src != tgt").select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))).distinct()
    both = checkpointed(both)
    labels = checkpointed(nodes.select("name").distinct().select("name", F.col("name").alias("component")))
    for _ in range(rounds):
        heard = both.join(labels.select(F.col("name").alias("tgt"), "component"), "tgt").groupBy("src").agg(F.min("component").alias("heard"))
        lower = labels.join(heard, labels["name"] == heard["src"], "left").select("name", F.col("component").alias("old"), F.least("component", "heard").alias("component"))
        jump = lower.select(F.col("name").alias("component"), F.col("component").alias("root"))
        after = checkpointed(lower.join(jump, "component", "left").select("name", "old", F.least("component", F.coalesce("root", "component")).alias("component")))
        changed = after.where("old != component").limit(1).count()
        labels = after.select("name", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components are not settled after {rounds} rounds")


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Names of the largest component (ties to the smaller name)."""
    labels = components(nodes, edges)
    top = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "component").limit(1)
    return labels.join(F.broadcast(top.select("component")), "component", "left_semi").select("name")  # one row


def stable_names(nodes: DataFrame, name: str) -> DataFrame:
    """Names trimmed, in upper case, with entities undone; merged where they fall together."""
    from graphweir.functions.text import strip, unescape

    return nodes.select(F.upper(strip(unescape(F.col(name)))).alias("name")).where("name != ''").distinct()


def attributes(asked: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The stored attributes of nodes (name) or edges (src, tgt) asked for; unknown ones have none."""
    return asked.select(*keys).distinct().join(table, keys, "left")


def summary(nodes: DataFrame, edges: DataFrame, samples: int = 5) -> DataFrame:
    """Per entity type: nodes, all nodes and edges of the graph beside them, and the first names (a sample is the feature)."""
    kinds = nodes.select("name", F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"))
    first = kinds.withColumn("n", F.row_number().over(Window.partitionBy("entity_type").orderBy("name"))).where(F.col("n") <= samples).groupBy("entity_type").agg(F.array_sort(F.collect_list("name")).alias("samples"))
    totals = nodes.agg(F.count(F.lit(1)).alias("all_nodes")).join(edges.agg(F.count(F.lit(1)).alias("all_edges")))  # one row each
    return kinds.groupBy("entity_type").agg(F.count(F.lit(1)).alias("nodes")).join(first, "entity_type").join(F.broadcast(totals))


def info(nodes: DataFrame, passages: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entity and passage nodes, and edges among entities, between both, and in all."""
    p = passages.select(F.col("name").alias("src"), F.lit(True).alias("passage"))
    kinds = edges.join(p, "src", "left")
    return kinds.agg(F.count(F.lit(1)).alias("edges"), F.count_if("passage").alias("passage_edges")).withColumn("entity_edges", F.col("edges") - F.col("passage_edges")).join(nodes.agg(F.count(F.lit(1)).alias("entities")).join(passages.agg(F.count(F.lit(1)).alias("passages"))))  # one row each
