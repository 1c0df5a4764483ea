"""Connected components of a graph of links, by alternating large and small stars.

Each round replaces a node's links by links to its least neighbour; after a few rounds
every component is a star around its least node. Only links are shuffled, minima are
taken before the shuffle, and each round is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum((F.xxhash64("u", "v") % 1_000_000_007).cast("long"))).first()
    return tuple(r)


def starred(links: DataFrame) -> DataFrame:
    """Links (u, v) as one from each u to its least v and one from each other v to that.

    Nodes that were joined stay joined, and one row is made of each. All links of one u
    come together, so a u must have few; a v may have any number.
    """
    least = F.min("v").over(Window.partitionBy("u"))
    return links.distinct().withColumn("m", least).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; links has columns u and v of one type.

    Loops and repeated links are allowed; no links give no rows.
    """
    edges = checkpoint(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        # In every link u > v, so a node's least neighbour is the least v, or the node itself.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        large = edges.join(least.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # The row of the least v links u to it, each other row its v.
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        edges = checkpoint(small)
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.groupBy("v").agg(F.max("v").alias("root"))
    return edges.toDF("node", "root").union(roots.toDF("node", "root"))
