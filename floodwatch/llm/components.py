"""Connected components by alternating large and small stars, cut at written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.

    ``edges`` has two columns of one orderable type. Each round moves the larger
    neighbours of a node to its smallest one (large star), then the smaller ones
    (small star). Rounds grow with the logarithm of a component's diameter. The
    smallest neighbour is aggregated before it is joined back, so a node with
    very many neighbours is a skewed join at most, which Spark splits; neither a
    component nor a neighbourhood is ever in one task or on the driver.
    """
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    e = cut(e, "edges")
    mark = None
    while True:
        own = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == (own["n"], own["x"]) or not own["n"]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = own["n"], own["x"]
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        e = cut(small, "edges")
