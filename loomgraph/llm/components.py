"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the smallest node it is linked to.

    Alternates two rounds that hang nodes on the smallest neighbour, of those above a node
    and of those below it, until nothing changes; the number of rounds grows with the
    logarithm of the nodes.  Each round is stored in the shared folder.
    """
    below = stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        # every node's larger neighbours go to its smallest neighbour
        both = below.unionByName(below.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        below = stash(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = below.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first()
        if now == state:
            break
        state = now
    root = below.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
