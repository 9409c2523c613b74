"""The behaviour graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import node_type


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, type), with how often and when it was seen."""
    return edges.groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("weight"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def signal_edges(signals: DataFrame) -> DataFrame:
    """Host to signal, host to target, signal to target."""
    edge = lambda a, b, t: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(t).alias("type"))
    all_edges = F.array(edge("entity", "signal_id", "GENERATED_SIGNAL"), edge("entity", "target", "COMMUNICATES_WITH"), edge("signal_id", "target", "TARGETED_BY"))
    return signals.select("ts", F.explode(all_edges).alias("e")).select("e.*", "ts").where("src is not null and dst is not null")


def incident_edges(incidents: DataFrame, signals: DataFrame, key: tuple[str, ...] = ("entity", "group_no")) -> DataFrame:
    own = signals.join(incidents.select(*key, "incident_id"), list(key))
    edge = lambda a: F.struct(F.col(a).alias("src"), F.col("incident_id").alias("dst"), F.lit("PART_OF_INCIDENT").alias("type"))
    return own.select("ts", F.explode(F.array(edge("entity"), edge("signal_id"))).alias("e")).select("e.*", "ts")


def signal_nodes(signals: DataFrame) -> DataFrame:
    """Typed nodes with the time they were last touched."""
    node = lambda c, t: F.struct(F.col(c).alias("id"), t.alias("type"))
    found = signals.select("ts", F.explode(F.array(node("entity", F.lit("HOST_IP")), node("signal_id", F.lit("SIGNAL")), node("target", node_type("target")))).alias("n"))
    return found.where("n.id is not null").groupBy("n.id", "n.type").agg(F.max("ts").alias("updated"))


def k_hop_subgraph(edges: DataFrame, start: str, depth: int = 2) -> DataFrame:
    """Nodes within ``depth`` (at most 4) undirected hops of ``start``, with their distance.

    Each hop joins the nodes of the hop before to their neighbours and keeps
    the least distance of each node. The nodes so far stand in it once, so
    the plan grows by one join and one sum a hop; the edges' exchange is
    reused.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src is not null and dst is not null").distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, hops int")
    for hop in range(1, min(depth, 4) + 1):
        met = seen.join(both, (F.col("id") == F.col("src")) & (F.col("hops") == hop - 1), "left")
        own, next_ = F.struct("id", "hops"), F.struct(F.col("dst").alias("id"), F.lit(hop).alias("hops"))
        reached = met.select(F.explode(F.array_compact(F.array(own, F.when(F.col("dst").isNotNull(), next_)))).alias("n"))
        seen = reached.groupBy("n.id").agg(F.min("n.hops").alias("hops"))
    return seen


def k_hop_edges(edges: DataFrame, nodes: DataFrame, depth: int = 2) -> DataFrame:
    """The edges that a walk of ``depth`` hops goes along: those with an end among ``nodes`` nearer than that."""
    near = nodes.where(F.col("hops") < depth).select("id")
    ends = edges.withColumn("__end", F.explode(F.array_distinct(F.array("src", "dst"))))
    return ends.join(near, F.col("__end") == F.col("id"), "left_semi").select(*edges.columns).distinct()


def prune_graph(nodes: DataFrame, edges: DataFrame, n: int = 5000) -> tuple[DataFrame, DataFrame]:
    """The ``n`` nodes touched last, and the edges with both ends among them."""
    kept = nodes.orderBy(F.desc("updated"), "id").limit(n)
    ids = kept.select("id").distinct()
    return kept, edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


def export_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A JSON text per node and per link, so that the export stays a table."""
    a = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "type")).alias("json"))
    return a.unionByName(edges.select(F.lit("link").alias("kind"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type")).alias("json")))
