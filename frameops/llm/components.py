"""Connected components of a graph of long ids, without collecting nodes or links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameops.session import stage


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (u, v) can reach.

    Alternates the large-star and small-star steps: each node's neighbours are moved to its
    smallest neighbour until all links point at a root. Every step is an aggregation with partial
    sums and a join that can split hot nodes; no task holds a node's neighbours together. Each
    round is written to the shared folder, so a lost executor costs one round at most.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    links = stage(links.distinct(), label)
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u")
        large = stage(large.select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved")), label)

        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved"))
        small = small.unionAll(least.select("u", F.col("m").alias("v"), F.lit(False).alias("moved")))
        small = stage(small.groupBy("u", "v").agg(F.bool_or("moved").alias("moved")), label)
        links = small.select("u", "v")
        # Links that no step moved to another end are stars.
        if not large.filter("moved").take(1) and not small.filter("moved").take(1):
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
