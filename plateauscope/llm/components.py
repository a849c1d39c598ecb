"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateauscope.llm.tables import written


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) of every node of ``links(u, v)``; root = smallest node reachable.

    Large star: a node's larger neighbours point to its smallest neighbour. Small star: its
    smaller neighbours and itself do. Both take minima with map-side combine, so a hub is no
    hot task, and the join that hands a minimum back may be split by the optimiser. Rounds
    are written tables; the driver sees a count and a checksum of each and goes on until they
    no longer change. With ``rounds`` it stops after that many: a root is then some smaller
    node that is reachable, not yet the smallest.
    """
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .filter("u <> v").distinct(), "links")
    seen, done = None, 0
    while rounds is None or done < rounds:
        done += 1
        both = _both_ways(edges)
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"),
                                                            F.col("m").alias("v")))
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(near, "u").filter("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(near.withColumnRenamed("m", "v")).distinct())
        edges = written(small, "stars")
        if done == rounds:
            break
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")))
            .groupBy("node").agg(F.min("root").alias("root")))
