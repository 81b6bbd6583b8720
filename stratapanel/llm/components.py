"""Connected components of a graph given as links, by alternating large and small stars.

Every round ties each node's neighbours to the smallest of them; after a few rounds (about the logarithm of the longest path)
each node hangs from its component's smallest node. Links stay in Spark; a count and a checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.llm import store


def tied(links: DataFrame) -> DataFrame:
    return links.filter("u <> v").distinct()


def large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return tied(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    return tied(links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own))


def components(links: DataFrame) -> DataFrame:
    """(node, least): for each node that a link joins to a smaller one, the smallest node of its component.

    `links` has two columns of one orderable type without nulls; direction, loops and repeats do not matter.
    """
    u, v = (F.col(c) for c in links.columns)
    now = store.written(tied(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))), "links")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("least"))
        before = state
        now = store.written(small_star(large_star(now)), "links")
