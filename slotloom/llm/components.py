"""Connected components of a table of links, in rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.common import drop_written, joined, written


def _shortened(links: DataFrame) -> DataFrame:
    """One round: every node hands its larger neighbours, then its smaller ones and itself, to the smallest node it knows. A node with very many neighbours is no task of its own."""
    both = written(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
    large = joined(both, least, ["u"], "n", both.count()).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    down = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "down")
    least = written(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    small = joined(down, least, ["u"], "n", down.count()).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links (u, v)``; the component is its smallest node.

    Nodes are of any ordered type, links go either way, and repeated links and loops do no harm; links with a null are left out.
    The rounds end when every link leads from a node to its component's smallest node. The number of links never grows, so each
    round moves as much as the first at most, and rounds grow with the logarithm of the longest chain.
    """
    now = written(links.select("u", "v").where("u != v").distinct(), "links")
    while True:
        done = now.agg(F.count("u").alias("n"), F.countDistinct("u").alias("d")).first()
        if done["n"] == done["d"] and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        then = written(_shortened(now), "links")
        drop_written(now)
        now = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
