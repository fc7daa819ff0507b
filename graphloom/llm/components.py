"""Union-find over a distributed table of links.

Every node points at the smallest node it knows.  Large-star links a node's
larger neighbours to its smallest neighbour (union), small-star links the
smaller ones (path compression); repeated in turn, every component ends as a
star around its smallest node.  Links never leave the executors; each round is
a written table, and only two numbers of it reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) with u > v."""
    if large:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links
    low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = near.join(low, "u")
    if large:
        return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = low.where("m < u").select("u", F.col("m").alias("v"))
    return out.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct()


def connected_components(links: DataFrame) -> tuple[DataFrame, str]:
    """(node, comp) for each node of links (a, b); comp is the smallest node reachable.

    Nodes may have any orderable type.  Links of a node with itself and repeated
    links change nothing; null ends are ignored.  No links: an empty table.
    Returns the table and its path.
    """
    spark = links.sparkSession
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = materialize(links, "links")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if tuple(state) == before or not state["n"]:
            break
        before, old = tuple(state), path
        large, mid = materialize(_star(now, True), "large")
        now, path = materialize(_star(large, False), "small")
        release(spark, old, mid)
    out = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return out.unionByName(out.select(F.col("comp").alias("node"), "comp").distinct()), path
