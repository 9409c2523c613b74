"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_files, release, stash, tidy


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``: the smallest node reachable.

    Alternating large-star and small-star rounds: each round joins every node
    only to the smallest of its neighbourhood, so the edges never grow and a
    hub's rows are summed map-side; the rounds are about the logarithm of the
    longest path. Each round is written to the shared folder. Self-loops keep
    a node, repeated edges count once; no edges give no rows.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    rows = edges.count()
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour of a node, and the node, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        edges, asked = stash(few_files(small, rows), "edges"), edges
        release(asked)
        with tidy(edges.sparkSession):
            now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = members.unionByName(roots)
    return found.unionByName(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
