"""Connected components by alternating large and small stars; nothing leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.scratch import materialize


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: comparable keys) to ``node``, ``component`` (the smallest key reachable).

    Self links and null ends carry no information and are ignored; nodes without a link do not
    appear. Every round is one aggregate and one join per star, so a node with any number of links
    is an ordinary skewed join. Rounds grow with the logarithm of the longest chain; each is stored
    in the shared scratch folder, which cuts the lineage.
    """
    edges = links.select("a", "b").where("a <> b")
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(large.where("u <> v").distinct(), "large-star")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, "small-star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
