"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.sources.scratch import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(a, b)`` to ``(node, label)``: nodes have equal labels, the least node, where a path of edges joins them.

    Each round points every node to the least of itself and its neighbours and follows the pointers to their end, doubling the
    length of a step each time. Edges are then replaced by those between the ends. Two rounds leave at most half of the nodes,
    and a chain of any length is one round: rounds and steps grow with the logarithm of the graph. A node with very many edges is
    pre-aggregated before the shuffle, and only tables of edges and labels are ever held, on the executors. Null ends are left
    out; an empty table gives an empty result.
    """
    left = written(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), f"{name}-edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).where("node is not null").distinct()
    labels = written(nodes.withColumn("label", F.col("node")), f"{name}-labels")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        ends = ended(written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m")), f"{name}-least"), name)
        hop = ends.select(F.col("v").alias("label"), "m")
        labels = written(labels.join(hop, "label", "left").select("node", F.coalesce("m", "label").alias("label")), f"{name}-labels")
        pairs = left.join(ends.select(F.col("v").alias("a"), F.col("m").alias("x")), "a").join(ends.select(F.col("v").alias("b"), F.col("m").alias("y")), "b")
        left = written(pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-edges")
    return labels


def ended(pointers: DataFrame, name: str = "pointers") -> DataFrame:
    """``pointers(v, m)``, each ``m`` another ``v`` or itself, with ``m`` replaced by the end of its way."""
    while True:
        onward = pointers.select(F.col("v").alias("m"), F.col("m").alias("next"))
        stepped = written(pointers.join(onward, "m").select("v", F.col("next").alias("m"), (F.col("next") != F.col("m")).alias("moved")), f"{name}-steps")
        pointers = stepped.select("v", "m")
        if stepped.where("moved").isEmpty():
            return pointers
