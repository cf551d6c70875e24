"""Directed graphs as nodes (id) and edges (src, dst): loading, validation, counters, partitions, weak components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.components import components
from corvane.plans.lineage import kept


def from_adjacency(adjacency: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (src, dst) of (id, adj). Parallel edges stay."""
    return adjacency.select("id"), adjacency.select(F.col("id").alias("src"), F.explode("adj").alias("dst"))


def to_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, adj): each node with its sorted out-neighbours; dangling nodes have none."""
    lists = edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("adj"))
    return nodes.join(lists, nodes.id == lists.src, "left").select("id", F.coalesce("adj", F.array().cast("array<long>")).alias("adj"))


def repeated_nodes(nodes: DataFrame) -> DataFrame:
    """(id, cnt) of ids with more than one record; a valid graph has none."""
    return nodes.groupBy("id").agg(F.count("*").alias("cnt")).where("cnt > 1")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (nodes, edges, active, dangling); active nodes have an out-edge."""
    degrees = edges.groupBy("src").agg(F.count("*").alias("deg"))
    rows = nodes.join(degrees, nodes.id == degrees.src, "left")
    count = F.count("*")
    return rows.agg(count.alias("nodes"), F.coalesce(F.sum("deg"), F.lit(0)).alias("edges"), F.count("deg").alias("active"), (count - F.count("deg")).alias("dangling"))


def unique(nodes: DataFrame) -> DataFrame:
    """nodes (id), written; an id with more than one record is an error."""
    nodes = kept(nodes.select("id"))
    if twice := repeated_nodes(nodes).orderBy("id").limit(5).collect():
        raise ValueError(f"nodes with more than one record: {[r.id for r in twice]}")
    return nodes


def summary(nodes: DataFrame, edges: DataFrame, jump: float = 0.15) -> DataFrame:
    """One row (components, edges, nodes, jump)."""
    found = weak_components(nodes, edges).agg(F.count_distinct("component").alias("components"))
    size = stats(nodes, edges).select("edges", "nodes")
    return found.crossJoin(F.broadcast(size)).withColumn("jump", F.lit(jump))


def missing_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dst, cnt): edge targets that have no record, with their edges."""
    return edges.join(nodes, edges.dst == nodes.id, "left_anti").groupBy("dst").agg(F.count("*").alias("cnt"))


def hash_part(key: Column, n: int) -> Column:
    """The partition of a whole number by its own value."""
    return F.pmod(key, F.lit(n)).cast("int")


def range_part(key: Column, n_nodes: int, n: int) -> Column:
    """The partition of a number in 0 .. n_nodes - 1 by where it lies in that range; larger ones go round."""
    return F.pmod(F.floor(key * F.lit(float(n)) / n_nodes), F.lit(n)).cast("int")


def partitioned(nodes: DataFrame, n: int, mode: str = "hash", n_nodes: int | None = None) -> DataFrame:
    """nodes laid out in n partitions: by `hash` or exact `range` of a number space, or `sampled` ranges of what there is."""
    if mode == "sampled":
        return nodes.repartitionByRange(n, "id")
    part = hash_part(F.col("id"), n) if mode == "hash" else range_part(F.col("id"), n_nodes or nodes.count(), n)
    return nodes.repartitionById(n, part)


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): component is the least id that edges, taken either way, connect a node to."""
    roots = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.join(roots, nodes.id == roots.node, "left").select("id", F.coalesce("root", "id").alias("component"))
