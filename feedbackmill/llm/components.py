"""Connected components of a table of links, by rounds of star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedbackmill.session import stage


def components(links: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    """Each node of the links (a, b) and the smallest node it is connected to.

    Nodes are long; links with a null side and links of a node to itself say nothing. Each round
    hangs a node's larger neighbours on its smallest one, then does so with the smaller ones; the
    number of rounds grows with the logarithm of the longest chain. Every round is a staged table,
    so a lost executor costs one round at most. No links give no rows.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, mark = stage(pairs.distinct(), "links"), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == mark or not now["n"]:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
        )
        edges = stage(small.distinct(), "small-star")
    ends = edges.select(F.col("u").alias(node), F.col("v").alias(root))
    return ends.unionByName(ends.select(F.col(root).alias(node), F.col(root))).distinct()
