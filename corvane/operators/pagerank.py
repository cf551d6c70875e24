"""PageRank and personalized PageRank in probabilities, with top-k reports.

An iteration joins ranks to edges, sums what arrives at each node, and gives back what got lost: what dangling nodes
held and what went to ids without a record. Lists of targets with their sources' degrees are written once, partitioned
and sorted by source, so that no iteration moves or sorts them; what arrives is written in every iteration, for it is read twice, and so neither plans nor lineage grow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import graph
from corvane.plans.lineage import kept
from corvane.sources import readers, sinks

ALPHA = 0.15
#: Targets in one row, about.
LINKS = 1 << 14


def shared_edges(edges: DataFrame) -> DataFrame:
    """(src, part, dsts): up to about LINKS targets of a source, with the part of its mass that each gets; partitioned and sorted by source."""
    edges = kept(edges.select("src", "dst").repartition("src"))
    degrees = edges.groupBy("src").agg(F.count("*").alias("n"))
    slot = F.pmod(F.xxhash64("dst"), F.ceil(F.col("n") / LINKS)).alias("slot")
    lists = edges.join(degrees, "src").groupBy("src", "n", slot).agg(F.collect_list("dst").alias("dsts"))
    return kept(lists.select("src", (F.lit(1.0) / F.col("n")).alias("part"), "dsts").repartition("src").sortWithinPartitions("src"))


def _arriving(ranks: DataFrame, shares: DataFrame, *sent: str) -> DataFrame:
    """(dst, m of each column of ranks in `sent`): what arrives at each target."""
    each = ranks.join(shares, ranks.id == shares.src).select(F.explode("dsts").alias("dst"), *[(F.col(p) * F.col("part")).alias(p) for p in sent])
    return each.groupBy("dst").agg(*[F.sum(p).alias(p.replace("p", "m")) for p in sent])


def counters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (nodes, edges, messages, received, missing): what an iteration handles.

    messages: edges of nodes with a record; received: all of them, by whatever id; missing: ids that get one without a record.
    """
    sent = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    got = sent.groupBy("dst").agg(F.count("*").alias("n")).join(nodes.select(F.col("id").alias("dst"), F.lit(1).alias("known")), "dst", "left")
    sums = got.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("received"), F.count_if(F.col("known").isNull()).alias("missing"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(sums)).select("nodes", F.col("received").alias("edges"), F.col("received").alias("messages"), "received", "missing")


def _changed(ranks: DataFrame, shares: DataFrame, alpha: float, n: int) -> DataFrame:
    """(id, q, p): ranks before and after one more iteration; what arrives is written."""
    arriving = _arriving(ranks, shares, "p")
    held = kept(ranks.join(arriving, ranks.id == arriving.dst, "left").select("id", F.col("p").alias("q"), F.coalesce("m", F.lit(0.0)).alias("m")))
    lost = held.agg(F.greatest(F.lit(0.0), F.lit(1.0) - F.sum("m")).alias("lost"))
    return held.crossJoin(F.broadcast(lost)).select("id", "q", (F.lit(alpha / n) + (1 - alpha) * (F.col("m") + F.col("lost") / n)).alias("p"))


def stepped(ranks: DataFrame, shares: DataFrame, alpha: float, n: int) -> DataFrame:
    """ranks (id, p) of all nodes after one more iteration."""
    return _changed(ranks, shares, alpha, n).select("id", "p")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int | None = 10, alpha: float = ALPHA, n: int | None = None, tolerance: float | None = None, most: int = 200, start: DataFrame | None = None) -> DataFrame:
    """(id, p) after a number of iterations, or, with a tolerance, once no iteration changes the sum of ranks by more.

    n: the number of nodes, counted if not given. p' = alpha / n + (1 - alpha) * (arriving + lost / n). start: the ranks
    (id, p) to go on from, the same for every node if not given. An id with more than one record is an error, and so
    is a tolerance that `most` iterations don't reach.
    """
    nodes = graph.unique(nodes)
    n = n or nodes.count()
    if n == 0:
        return nodes.withColumn("p", F.lit(0.0))
    shares = shared_edges(edges)
    ranks = nodes.join(start.select("id", "p"), "id", "left") if start is not None else nodes.withColumn("p", F.lit(1.0 / n))
    if tolerance is None:
        for _ in range(iterations or 0):
            ranks = stepped(ranks, shares, alpha, n)
        return ranks
    change = float("inf")
    for _ in range(most):
        after = _changed(ranks, shares, alpha, n)
        change = after.agg(F.sum(F.abs(F.col("p") - F.col("q")))).first()[0]
        ranks = after.select("id", "p")
        if change <= tolerance:
            return ranks
    raise RuntimeError(f"after {most} iterations ranks still change by {change}, more than {tolerance}")


def pagerank_from(nodes: DataFrame, edges: DataFrame, base: str, first: int, last: int, alpha: float = ALPHA, n: int | None = None) -> DataFrame:
    """(id, p) of iteration `last`, every one from `first` on written to base as iterNNNN.

    The ranks of iteration `first` are read from there; iteration 0, if it isn't there, is the same rank for every node.
    A run that broke off is taken up from its last iteration.
    """
    nodes = graph.unique(nodes)
    n = n or nodes.count()
    shares, spark = shared_edges(edges), nodes.sparkSession
    try:
        ranks = readers.iteration(spark, base, first)
    except AnalysisException as e:
        if first or "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        ranks = nodes.withColumn("p", F.lit(1.0 / max(n, 1)))
        sinks.write_iteration(ranks, base, 0)
    for k in range(first + 1, last + 1):
        sinks.write_iteration(stepped(ranks, shares, alpha, n), base, k)
        ranks = readers.iteration(spark, base, k)
    return ranks


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, sources: list[int], iterations: int = 10, alpha: float = ALPHA) -> DataFrame:
    """(source, id, p): for each source, p' = (1 - alpha) * arriving, and at the source itself alpha + (1 - alpha) * (arriving + lost) .

    All sources go through each join together, one column each. A source without a record is an error.
    """
    sources = list(dict.fromkeys(sources))
    nodes = graph.unique(nodes)
    known = {r.id for r in nodes.where(F.col("id").isin(sources)).distinct().collect()}
    if absent := [s for s in sources if s not in known]:
        raise ValueError(f"sources without a record: {absent}")
    shares = shared_edges(edges)
    at: list[Column] = [F.col("id") == s for s in sources]
    ranks = nodes.select("id", *[F.when(a, 1.0).otherwise(0.0).alias(f"p{i}") for i, a in enumerate(at)])
    for _ in range(iterations):
        arriving = _arriving(ranks, shares, *[f"p{i}" for i in range(len(sources))])
        held = kept(nodes.join(arriving, nodes.id == arriving.dst, "left").select("id", *[F.coalesce(f"m{i}", F.lit(0.0)).alias(f"m{i}") for i in range(len(sources))]))
        lost = held.agg(*[F.greatest(F.lit(0.0), F.lit(1.0) - F.sum(f"m{i}")).alias(f"l{i}") for i in range(len(sources))])
        p = [(F.when(a, alpha).otherwise(0.0) + (1 - alpha) * (F.col(f"m{i}") + F.when(a, F.col(f"l{i}")).otherwise(0.0))).alias(f"p{i}") for i, a in enumerate(at)]
        ranks = held.crossJoin(F.broadcast(lost)).select("id", *p)
    return reduce(DataFrame.unionByName, [ranks.select(F.lit(s).cast("long").alias("source"), "id", F.col(f"p{i}").alias("p")) for i, s in enumerate(sources)])


def with_log(ranks: DataFrame) -> DataFrame:
    """ranks with logp, the natural logarithm of p; null where p is 0."""
    return ranks.withColumn("logp", F.when(F.col("p") > 0, F.log("p")))


def top_nodes(ranks: DataFrame, k: int = 100) -> DataFrame:
    """(id, p): the k highest; ties go to the smaller id. Each task sends on its own k at most."""
    return ranks.orderBy(F.col("p").desc(), "id").limit(k)


def top_personalized(ranks: DataFrame, k: int) -> DataFrame:
    """(source, place, id, p): the k highest of each source."""
    order = Window.partitionBy("source").orderBy(F.col("p").desc(), "id")
    return ranks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("source", "place", "id", "p")
