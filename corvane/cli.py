"""Command line: each program reads files, runs one operator and writes its result.

    python -m corvane.cli word-count --input in.txt --output out [--alpha]
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import ALPHABETIC
from corvane.operators import cooc, counts, graph, index, pagerank, timeseries
from corvane.sources import readers, sinks


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    return readers.lines_with_offset(spark, path).select(F.col("docno"), F.col("value").alias("text"))


def word_count(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return counts.word_count(readers.lines(spark, o.input), "value", ALPHABETIC if o.alpha else None)


def bigram_count(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return counts.bigram_count(readers.lines(spark, o.input), "value")


def pmi(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    find = cooc.pmi_stripes if o.stripes else cooc.pmi
    return find(_numbered(spark, o.input), o.min_count, not o.compat, line="text", key=("docno",))


def build_index(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    built = index.build_index(_numbered(spark, o.input))
    return index.compressed(built) if o.compressed else built


def _index(spark: SparkSession, path: str) -> DataFrame:
    stored = readers.keyed(spark, path)
    return index.decompressed(stored) if "blob" in stored.columns else stored


def lookup(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return index.tf_histogram(_index(spark, o.index), o.term) if o.histogram else index.lookup(_index(spark, o.index), o.term)


def retrieve(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return index.fetch(index.boolean_query(_index(spark, o.index), o.query), _numbered(spark, o.input)).orderBy("docno")


def analyze(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """Of a stored PMI result (tuples): the number of pairs, the best pair, and the best partners of some words."""
    scores = readers.tuples(spark, o.input).withColumnRenamed("value", "pmi")
    best = [("pairs", scores.agg(F.count("*").cast("string").alias("value")))]
    best.append(("best", cooc.pmi_max(scores).select(F.concat_ws(" ", "left", "right", F.col("pmi").cast("string")).alias("value"))))
    best += [(w, cooc.pmi_topk(scores, w, o.top).select(F.concat_ws(" ", "right", F.col("pmi").cast("string")).alias("value"))) for w in (o.words or "").split(",") if w]
    return reduce(DataFrame.unionByName, [d.select(F.lit(name).alias("what"), "value") for name, d in best])


def ranks(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    nodes, edges = graph.from_adjacency(readers.adjacency(spark, o.input))
    if o.sources:
        found = pagerank.personalized_pagerank(nodes, edges, [int(s) for s in o.sources.split(",") if s], o.iterations, o.jump)
        return sinks.rank_report(pagerank.top_personalized(found, o.top))
    if o.base:
        return pagerank.top_nodes(pagerank.pagerank_from(nodes, edges, o.base, o.start, o.iterations if o.end is None else o.end, o.jump, o.nodes), o.top)
    return pagerank.top_nodes(pagerank.pagerank(nodes, edges, o.iterations, o.jump, o.nodes, tolerance=o.tolerance), o.top)


def graph_counters(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return pagerank.counters(*graph.from_adjacency(readers.adjacency(spark, o.input)))


def graph_summary(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return graph.summary(*graph.from_adjacency(readers.adjacency(spark, o.input)), o.jump)


def components(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return graph.weak_components(*graph.from_adjacency(readers.adjacency(spark, o.input)))


def graph_stats(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return graph.stats(*graph.from_adjacency(readers.adjacency(spark, o.input)))


def partition_graph(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return graph.partitioned(readers.adjacency(spark, o.input), o.partitions, o.mode, o.nodes)


def hourly(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    rows = timeseries.parsed_events(readers.events(spark, o.input))
    if o.keywords:
        rows = timeseries.with_keyword(rows, "text", o.keywords.lower().split(","))
    return timeseries.hourly_counts(rows, F.col("ts"), o.format, o.zone)


PROGRAMS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], DataFrame], dict[str, dict]]] = {
    "word-count": (word_count, {"--alpha": {"action": "store_true"}}),
    "bigram-count": (bigram_count, {}),
    "pmi": (pmi, {"--min-count": {"type": int, "default": 10}, "--compat": {"action": "store_true"}, "--stripes": {"action": "store_true"}}),
    "index": (build_index, {"--compressed": {"action": "store_true"}}),
    "lookup": (lookup, {"--index": {"required": True}, "--term": {"required": True}, "--histogram": {"action": "store_true"}}),
    "retrieve": (retrieve, {"--index": {"required": True}, "--query": {"required": True}}),
    "pagerank": (ranks, {"--sources": {}, "--iterations": {"type": int, "default": 10}, "--jump": {"type": float, "default": 0.15}, "--tolerance": {"type": float}, "--nodes": {"type": int}, "--base": {}, "--start": {"type": int, "default": 0}, "--end": {"type": int}, "--top": {"type": int, "default": 100}}),
    "graph-counters": (graph_counters, {}),
    "graph-summary": (graph_summary, {"--jump": {"type": float, "default": 0.15}}),
    "analyze-pmi": (analyze, {"--words": {}, "--top": {"type": int, "default": 3}}),
    "components": (components, {}),
    "graph-stats": (graph_stats, {}),
    "partition-graph": (partition_graph, {"--partitions": {"type": int, "required": True}, "--mode": {"choices": ["hash", "range", "sampled"], "default": "hash"}, "--nodes": {"type": int}}),
    "hourly": (hourly, {"--keywords": {}, "--format": {"default": "yyyyMMddHH"}, "--zone": {}}),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corvane")
    programs = parser.add_subparsers(dest="program", required=True)
    for name, (_, options) in PROGRAMS.items():
        p = programs.add_parser(name)
        p.add_argument("--input", required=name != "lookup")
        p.add_argument("--output", required=True)
        for flag, how in options.items():
            p.add_argument(flag, **how)
    o = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"corvane {o.program}").getOrCreate()
    out = PROGRAMS[o.program][0](spark, o)
    if o.program == "index":
        sinks.write_keyed(out, o.output, "term")
    elif o.program == "pmi":
        sinks.write_tuples(out.withColumnRenamed("pmi", "value"), o.output, "none")
    elif o.program == "partition-graph":
        sinks.write_parquet(out, o.output)
    else:
        sinks.write_text(out, o.output, [c for c in out.columns if c in ("term", "first", "hour", "left")])


if __name__ == "__main__":
    main()
