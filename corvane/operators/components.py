"""Connected components by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.plans.lineage import kept


#: Links of a node beyond which it may be a hub, and hubs at most.
HUB_LINKS, HUBS = 1024, 10_000


def _to_least(links: DataFrame, n: int) -> DataFrame:
    """(a, b, m): links (a, b) with the least b of each a.

    A hub, with more than HUB_LINKS links and more than one in HUBS of all n, leaves its links where they are: the
    least of the hubs, HUBS rows at most, are broadcast to them. Few links need no such care.
    """
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("links"))
    if n <= 16 * HUB_LINKS:
        return links.join(least.select("a", "m"), "a")
    hubs = F.broadcast(least.where(F.col("links") > max(HUB_LINKS, n // HUBS)).select("a", "m"))
    return links.join(hubs, "a").unionByName(links.join(hubs.select("a"), "a", "left_anti").join(least.select("a", "m"), "a"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b) that isn't alone; root is the component's least node.

    Each round links every node's larger neighbours, then its smaller ones, to its least neighbour, until the links
    are stars. Rounds grow with the logarithm of the number of nodes; each is written to the checkpoint folder.
    """
    links = kept(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n, sign = links.count(), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both, 2 * n).where("b > a").select(F.least("a", "m").alias("m"), "b").where("m <> b").distinct()
        down = large.select(F.greatest("m", "b").alias("a"), F.least("m", "b").alias("b"))
        small = _to_least(down, 2 * n).select("m", F.explode(F.array("a", "b")).alias("b")).where("m <> b")
        links = kept(small.select(F.col("m").alias("a"), "b").distinct())
        before = n, sign
        n, sign = links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if (n, sign) == before:
            break
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
