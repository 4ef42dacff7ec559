"""Connected components of an edge table, with joins and aggregates only."""

from pyspark.sql import functions as F

from strideforge.llm.common import materialize


def connected(links):
    """Nodes of ``links(a, b)`` with the smallest node of their component: columns node, label.

    Alternates the two star contractions until the edges stay the same, which takes a number of rounds that grows with
    the logarithm of the longest path. Every round is written to the shared folder; the driver sees two sums a round.
    Loops and repeated edges are allowed; an empty table gives an empty one. Edges that form stars already, such as the labels of
    an earlier call, take no further rounds.
    """

    def sums(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "edges")
    before = sums(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node point to the least of its neighbourhood
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its lower neighbours point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        edges = materialize(small.filter("u <> v").distinct(), "edges")
        after = sums(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
