"""Query-aware flow diffusion in synchronous rounds.

Many (query, source) pairs diffuse in one job; every key carries both. A round
lets each node over its capacity push its excess at once: what it keeps adds
to its score over the structural weights, what leaves is routed by the
query-aware weights. The number of rounds is fixed; with a total mass below
the total capacity the result does not depend on the schedule.

    excess = mass - sink                 where mass > sink + epsilon and Q > 0
    x     += step * excess / (W + 1e-8)  W: structural weight sum, or Q if 0
    mass   = sink
    mass(neighbour) += excess * w_qa / (Q + 1e-8)

Edges are written once, each with the capacity, W and Q of the node it leads
to, so a row of the state has all that decides whether it pushes. The state of
a round is written in the shared folder, since it is read twice, and removed
when the next is there. In the last round nothing arrives, as only scores are
asked for. A state holds a row per pair and reached node, so pairs diffuse in
parts of ``MOST_PAIRS``: what lies on disk at once follows that number and the
scores, not pairs x nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweir.session import dropped, written

SCHEMES = ("multiply", "add", "original", "none")
TINY = 1e-8
TOTAL_SINK = 10.0
#: Pairs (query, source) that diffuse at a time.
MOST_PAIRS = 8_192


def edge_weight(w: Column, s1: Column, s2: Column, scheme: str, a: float = 1.0, b: float = 0.5) -> Column:
    """Query-aware weight of an edge whose ends have similarities s1, s2 to the query; null similarity is 0."""
    s1, s2 = F.coalesce(s1, F.lit(0.0)), F.coalesce(s2, F.lit(0.0))
    aware = {"multiply": w * s1 * s2, "add": (w + s1 + s2) / 3, "original": w * (a + b * (s1 + s2) / 2), "none": w}
    if scheme not in aware:
        raise ValueError(f"unknown scheme {scheme!r}")
    return F.when(w <= 0, F.lit(0.0)).otherwise(aware[scheme])


def seed_weights(seeds: DataFrame, least: float = 1e-5) -> DataFrame:
    """Seeds (query_id, node, weight) scaled to sum 1 per query; weights under ``least`` are 0, all zero is uniform."""
    rows = seeds.groupBy("query_id", "node").agg(F.sum("weight").alias("w")).withColumn("w", F.when(F.col("w") < least, F.lit(0.0)).otherwise(F.coalesce("w", F.lit(0.0))))
    total = rows.groupBy("query_id").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n"))
    return rows.join(total, "query_id").select("query_id", "node", F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(1.0 / F.col("n")).alias("weight"))


def capacities(edges: DataFrame, nodes: DataFrame, total: float = TOTAL_SINK) -> DataFrame:
    """Sink capacity of each node: its degree, at least 1, scaled to sum ``total``."""
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    rows = nodes.select(F.col("name").alias("node")).distinct().join(degree, "node", "left").select("node", F.greatest(F.coalesce("degree", F.lit(0)), F.lit(1)).cast("double").alias("d"))
    return rows.join(F.broadcast(rows.agg(F.sum("d").alias("all")))).select("node", (F.col("d") * total / F.col("all")).alias("sink"))


def query_edges(edges: DataFrame, similarity: DataFrame, scheme: str) -> DataFrame:
    """Edges per query with structural and query-aware weights and their sums per source node.

    ``similarity`` is (query_id, node, sim), with a row for every node that may
    push in a query (0 where it has no embedding): edges and queries meet by
    their source node, not by a product of tables.
    """
    left = similarity.select("query_id", F.col("node").alias("src"), F.col("sim").alias("s1"))
    right = similarity.select("query_id", F.col("node").alias("tgt"), F.col("sim").alias("s2"))
    per_query = edges.join(left, "src").join(right, ["query_id", "tgt"], "left")
    weighed = per_query.select("query_id", "src", "tgt", "weight", edge_weight(F.col("weight"), F.col("s1"), F.col("s2"), scheme).alias("aware"))
    sums = weighed.groupBy("query_id", "src").agg(F.sum("weight").alias("w_sum"), F.sum("aware").alias("q_sum"))
    return weighed.join(sums, ["query_id", "src"]).select("query_id", "src", "tgt", "aware", F.when(F.col("w_sum") == 0, F.col("q_sum")).otherwise(F.col("w_sum")).alias("w_sum"), "q_sum")


def warm_start(edges: DataFrame, seeds: DataFrame, steps: int = 2) -> DataFrame:
    """Lazy walk from the seeds over structural weights: x <- (s + P'x) / 2. Seeds (query_id, node, weight)."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = edges.join(total, "src").select("src", "tgt", (F.col("weight") / F.col("total")).alias("share"))
    x = seeds.select("query_id", "node", (F.col("weight") / 1).alias("x"))
    for _ in range(steps):
        moved = x.join(share, x["node"] == share["src"]).groupBy("query_id", F.col("tgt").alias("node")).agg(F.sum(F.col("x") * F.col("share")).alias("x"))
        both = seeds.select("query_id", "node", (F.col("weight") / 2).alias("x")).unionByName(moved.select("query_id", "node", (F.col("x") / 2).alias("x")))
        x = both.groupBy("query_id", "node").agg(F.sum("x").alias("x"))
    return x


def _excess(state: DataFrame, epsilon: float, step: float) -> DataFrame:
    """Each row with what it pushes in this round (excess), that taken from its mass and added to its score."""
    active = (F.col("mass") > F.col("sink") + epsilon) & (F.coalesce("q_sum", F.lit(0.0)) > 0)
    over = state.withColumn("excess", F.when(active, F.col("mass") - F.col("sink")).otherwise(F.lit(0.0)))
    return over.withColumn("x", F.col("x") + F.coalesce(step * F.col("excess") / (F.col("w_sum") + TINY), F.lit(0.0))).withColumn("mass", F.col("mass") - F.col("excess"))


def _round(state: DataFrame, edges: DataFrame, epsilon: float, step: float) -> DataFrame:
    """The state after all nodes over their capacity have pushed once."""
    over = _excess(state, epsilon, step)
    pushed = over.where("excess > 0").select("query_id", "source", F.col("node").alias("src"), "excess", F.col("q_sum").alias("q")).join(edges, ["query_id", "src"])
    arrived = pushed.select("query_id", "source", F.col("tgt").alias("node"), (F.col("excess") * F.col("aware") / (F.col("q") + TINY)).alias("mass"), F.lit(0.0).alias("x"), "sink", "w_sum", "q_sum")
    return over.drop("excess").unionByName(arrived).groupBy("query_id", "source", "node").agg(F.sum("mass").alias("mass"), F.sum("x").alias("x"), *[F.max(c).alias(c) for c in ("sink", "w_sum", "q_sum")])


def _scores(state: DataFrame, edges: DataFrame, rounds: int, epsilon: float, step: float) -> DataFrame:
    """Scores of some pairs, written. In the last round only scores are asked for, so nothing arrives."""
    held = state
    for left in range(rounds - 1, 0, -1):
        state = _round(state, edges, epsilon, step)
        if left > 1:
            before, held = held, written(state, "diffusion-state")
            state = held
            dropped(state.sparkSession, *([before] if left < rounds - 1 else []))
            if state.where(F.col("mass") > F.col("sink") + epsilon).isEmpty():
                break
    last = _excess(state, epsilon, step) if rounds > 0 else state
    scores = written(last.where("x > 0").select("query_id", "source", "node", "x"), "diffusion-scores", "zstd")
    del last, state
    dropped(scores.sparkSession, *([held] if rounds > 2 else []))
    return scores


def diffuse(edges: DataFrame, sinks: DataFrame, mass: DataFrame, rounds: int, epsilon: float = 0.01, step: float = 0.2, most: int = MOST_PAIRS) -> DataFrame:
    """Scores after so many rounds, or fewer if no node holds more than its sink and epsilon: query_id, source, node, x > 0.

    ``edges`` come from :func:`query_edges`, ``sinks`` is (node, sink),
    ``mass`` (query_id, source, node, mass) the initial mass. About ``most``
    pairs (query_id, source) diffuse at a time.
    """
    spark = edges.sparkSession
    edges = written(edges, "diffusion-edges")
    sums = edges.groupBy("query_id", F.col("src").alias("node")).agg(F.max("w_sum").alias("w_sum"), F.max("q_sum").alias("q_sum"))
    state = mass.groupBy("query_id", "source", "node").agg(F.sum("mass").alias("mass")).join(sinks, "node").join(sums, ["query_id", "node"], "left").withColumn("x", F.lit(0.0))
    state = written(state, "diffusion-starts")
    inner = edges.where("aware > 0").select("query_id", "src", "tgt", "aware")
    ends = inner.select("query_id", "tgt").distinct().join(sinks.withColumnRenamed("node", "tgt"), "tgt").join(sums.withColumnRenamed("node", "tgt"), ["query_id", "tgt"], "left")
    ways = written(inner.join(ends, ["query_id", "tgt"]), "diffusion-ways")
    del inner, ends, sums
    dropped(spark, edges)
    parts = -(-state.select("query_id", "source").distinct().count() // most)
    part = F.pmod(F.xxhash64("query_id", "source"), F.lit(max(parts, 1)))
    scores = [_scores(state.where(part == k) if parts > 1 else state, ways, rounds, epsilon, step) for k in range(max(parts, 1))]
    dropped(spark, state, ways)
    return reduce(DataFrame.unionByName, scores)


def diffuse_sequential(edges: DataFrame, sinks: DataFrame, mass: DataFrame, most: int = 500, epsilon: float = 0.01, step: float = 0.2, most_edges: int = 200_000) -> DataFrame:
    """Scores by single pushes, the node of the largest excess first (ties to the smaller name), at most ``most`` of them.

    For parity with the synchronous rounds below capacity, on graphs that one
    task holds: a query with more than ``most_edges`` edges is refused.
    """
    largest = edges.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most_edges:
        raise ValueError(f"a query has {largest} edges; use diffuse")
    packed = edges.groupBy("query_id").agg(F.collect_list(F.struct("src", "tgt", "aware", "w_sum", "q_sum")).alias("edges"))
    caps = sinks.agg(F.collect_list(F.struct("node", "sink")).alias("sinks"))
    starts = mass.groupBy("query_id", "source", "node").agg(F.sum("mass").alias("mass")).groupBy("query_id", "source").agg(F.collect_list(F.struct("node", "mass")).alias("mass"))
    rows = starts.join(packed, "query_id").join(F.broadcast(caps))  # one row of a graph that one task holds

    def push(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                sink = {x["node"]: x["sink"] for x in row.sinks}
                out: dict[str, list[tuple[str, float]]] = {}
                sums: dict[str, tuple[float, float]] = {}
                for e in row.edges:
                    out.setdefault(e["src"], []).append((e["tgt"], e["aware"]))
                    sums[e["src"]] = (e["w_sum"], e["q_sum"])
                m = {x["node"]: x["mass"] for x in row.mass if x["node"] in sink}
                x: dict[str, float] = {}
                for _ in range(most):
                    over = [(m[v] - sink[v], v) for v in m if m[v] > sink[v] + epsilon and sums.get(v, (0, 0))[1] > 0]
                    if not over:
                        break
                    excess, node = min(over, key=lambda t: (-t[0], t[1]))
                    w_sum, q_sum = sums[node]
                    x[node] = x.get(node, 0.0) + step * excess / (w_sum + TINY)
                    m[node] = sink[node]
                    for tgt, aware in out[node]:
                        m[tgt] = m.get(tgt, 0.0) + excess * aware / (q_sum + TINY)
                if x:
                    yield pd.DataFrame({"query_id": row.query_id, "source": row.source, "node": list(x), "x": list(x.values())})

    kind = mass.schema["query_id"].dataType.simpleString()
    return rows.select("query_id", "source", "mass", "edges", "sinks").mapInPandas(push, f"query_id {kind}, source string, node string, x double")


def source_mass(sources: DataFrame, alpha: float, confidence: float = 0.0, total: float = TOTAL_SINK) -> DataFrame:
    """Initial mass of sources (query_id, source, node, weight): alpha * total capacity * (1 + confidence) * weight."""
    return sources.select("query_id", "source", "node", (F.col("weight") * alpha * total * (1 + confidence)).alias("mass"))


def passages(scores: DataFrame, passage_nodes: DataFrame) -> DataFrame:
    """Scores at the passages that flow reached, scaled to sum 1 per query, ranked.

    A query whose flow reaches no passage has no row; its dense ranking stands in.
    """
    x = scores.join(passage_nodes.select("node").distinct(), "node", "left_semi").groupBy("query_id", "node").agg(F.sum("x").alias("x"))
    total = x.groupBy("query_id").agg(F.sum("x").alias("total"))
    scaled = x.join(total, "query_id").select("query_id", "node", (F.col("x") / F.col("total")).alias("score"))
    return scaled.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node")))


def clusters(scores: DataFrame, least_flow: float) -> DataFrame:
    """Clusters of several nodes whose greatest score reaches ``least_flow``: one row per (query, source)."""
    c = scores.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("cluster_size"), F.max("x").alias("max_flow"), F.min("x").alias("min_flow"))
    return c.where((F.col("cluster_size") > 1) & (F.col("max_flow") >= least_flow))
