"""Connected components of an edge table, by minimum labels and pointer jumping, cut to the shared folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the least node of the component.

    A hub's edges meet only in aggregates with map-side combination and in joins on the neighbour's side.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        of_root = labels.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        new = cut(hooked.join(of_root, F.col("root") == F.col("n2"), "left").select("node", F.least("root", F.coalesce("r2", "root")).alias("root"), "was"))
        if new.where("root <> was").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
