"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanix.session import cut


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) -> (node, component), the component being named by its smallest node.

    Alternates two steps on the links until they stay the same: every node links
    its larger neighbours to the smallest node it knows, then its smaller
    neighbours to it.  Each step is one aggregation by node of (node, smallest)
    and one join, so nothing of a component is ever collected, and the number
    of rounds grows with the logarithm of a component's size.  Only nodes that
    have a link are returned; self links and null ends are ignored.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("node"), F.least("m", "hi").alias("m"))
        large = both.where("lo > hi").join(least, both.hi == least.node).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = cut(large, "large")
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(smallest, "hi")
        small = moved.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(smallest.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct()
        small = cut(small, "small")
        if small.count() == edges.count() and small.join(edges, ["hi", "lo"], "left_anti").isEmpty():
            edges = small
            break
        edges = small
    else:
        raise RuntimeError(f"not settled after {most_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()
