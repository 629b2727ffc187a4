"""Connected components of an edge table, by contraction.

Each round lets every node point at its smallest neighbour, if that is smaller than itself, and
replaces the edges by those between the nodes pointed at. Neighbour minima are aggregates with a
partial step, so a node of any degree is no hot group; the joins are between written tables, which
adaptive execution can split. Every round at least halves the nodes that still have edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (columns a and b); root is the same throughout a component."""
    steps = []
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        to = materialize(to, "cc-to")
        steps.append(to)
        one = left.join(to.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("p"), "b")
        two = one.join(to.withColumnRenamed("node", "b"), "b").select("p", F.col("to").alias("q")).where("p <> q")
        left = materialize(two.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "cc-edges")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[0].withColumnRenamed("to", "root")
    for to in steps[1:]:
        up = to.select(F.col("node").alias("root"), F.col("to"))
        roots = materialize(roots.join(up, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "cc-roots")
    return roots
