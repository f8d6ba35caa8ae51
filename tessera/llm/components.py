"""Connected components of a link table, by contraction rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long, not null) -> ``node, root``: all linked nodes, each with one node of its component.

    In every round a node joins its neighbour of lowest random rank (new
    ranks each round) or stays a root, and links are rewritten between the
    roots.  A constant share of nodes goes in a round, whatever the shape of
    the graph, so rounds grow with the logarithm of the nodes.  Only minima
    and distinct links are aggregated, so a node with very many links is
    pre-aggregated by every task.  Each round is written to the shared folder.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                    .where("a != b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        turn = F.lit(len(steps))
        ranked = lambda c, t=turn: F.struct(F.xxhash64(t, c).alias("rank"), c.alias("id"))
        best = edges.groupBy("a").agg(F.min(ranked(F.col("b"))).alias("best"))
        step = written(best.select(F.col("a").alias("node"), F.least(F.col("best"), ranked(F.col("a")))["id"].alias("parent")), "parents")
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = step.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = written(edges.join(left, "a").select("pa", "b").distinct().join(right, "b").where("pa != pb")
                        .select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[-1].select("node", F.col("parent").alias("root"))
    for step in reversed(steps[:-1]):
        up = roots.select(F.col("node").alias("parent"), "root")
        roots = step.join(up, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return roots
