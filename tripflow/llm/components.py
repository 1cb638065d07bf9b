"""Connected components of a graph given by its edges, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """`node` and `root`, the smallest node reachable, for every node but the roots; `edges` has the columns `a` and `b`.

    Each round links every node to the smallest node of its neighbourhood, so a component of n nodes ends as one star
    after some log n rounds. Minima are aggregated before they are shuffled and then joined, so a node with very many
    neighbours is split like any skewed join key. Null ends and loops are ignored; no edges give no rows.
    """
    ends = edges.where("a is not null and b is not null and a <> b")
    edges = checkpointed(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(30,0)"))).first()
        if mark == before or mark[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        # Large star: every neighbour above a node goes to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node's neighbours below it, and the node itself, go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
