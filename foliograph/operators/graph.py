"""Graph programs: hops, paths, smoothing, co-occurrence, bounded views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import written


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def hops(edges: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """(node, hop, path): all nodes within ``radius`` of the seeds, with the first shortest path in order.

    Each step joins the frontier only and is written, so lineage stays short; of the paths to a
    node the least is kept by aggregation, so none are enumerated.
    """
    both = written(undirected(edges).where("src <> dst").distinct(), "edges")
    reached = written(seeds.select("node", F.lit(0).alias("hop"), F.array("node").alias("path")), "hops")
    frontier = reached
    for hop in range(1, radius + 1):
        step = frontier.join(both, frontier["node"] == both["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        fresh = step.groupBy("node").agg(F.min("path").alias("path")).join(reached, "node", "left_anti")
        frontier = written(fresh.select("node", F.lit(hop).alias("hop"), "path"), "hops")
        reached = reached.unionByName(frontier)
    return reached


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    kept = nodes.select("node").distinct()
    return edges.join(kept, edges["src"] == kept["node"], "left_semi").join(kept, edges["dst"] == kept["node"], "left_semi")


def smoothed(edges: DataFrame, base: DataFrame, damping: float = 0.85, steps: int = 2) -> DataFrame:
    """(node, value): (1 - d) * base + d * mean of the neighbours, ``steps`` times; several edges count as often."""
    both = undirected(edges)
    now = base.select("node", F.col("value").alias("x"))
    for _ in range(steps):
        mean = both.join(now, both["dst"] == now["node"]).groupBy(both["src"].alias("node")).agg(F.avg("x").alias("m"))
        now = written(base.join(mean, "node", "left").select("node", ((1 - damping) * F.col("value") + damping * F.coalesce("m", F.lit(0.0))).alias("x")), "smoothed")
    return now.select("node", F.col("x").alias("value"))


def cooccurrence(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, n): pairs of distinct items, a < b, and the number of groups that hold both. For groups of bounded size."""
    one = rows.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    a, b = one.select("g", F.col("i").alias("a")), one.select("g", F.col("i").alias("b"))
    return a.join(b, "g").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def bounded_view(edges: DataFrame, max_edges: int, max_nodes: int) -> DataFrame:
    """The first ``max_edges`` edges in order, closed over the first ``max_nodes`` of their nodes."""
    some = edges.orderBy("src", "dst").limit(max_edges)
    nodes = some.select(F.col("src").alias("node")).unionByName(some.select(F.col("dst").alias("node"))).distinct().orderBy("node").limit(max_nodes)
    return induced(some, nodes)
