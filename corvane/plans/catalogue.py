"""The engine's own queries, by name, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import ALPHABETIC
from corvane.functions.time import EVENT_TIME, MONTH_DAY_HOUR, YEAR_TO_HOUR
from corvane.operators import cooc, counts, graph, index, pagerank, timeseries
from corvane.plans import oracle
from corvane.plans.lineage import scratch
from corvane.sources import readers, sinks

TERM, WORD, QUERY_AND, QUERY_OR, QUERY_NESTED, QUERY_MISSING = oracle.TERM, oracle.WORD, oracle.QUERY_AND, oracle.QUERY_OR, oracle.QUERY_NESTED, oracle.QUERY_MISSING
SOURCES, KEYWORDS, PARTS = oracle.SOURCES, oracle.KEYWORDS, oracle.PARTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("docno"), "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.split_lines(table(spark, sf_dir, "documents"))


def inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build_index(documents(spark, sf_dir))


def stored(spark: SparkSession, sf_dir: str, pack: bool = False) -> DataFrame:
    """The index as a stored table, which the application builds once."""
    return index.stored(spark, documents(spark, sf_dir), sf_dir, pack)


def part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts, and an edge from each to every part on the next line of the same order: a graph with cycles."""
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"))
    b = a.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("src").alias("dst"))
    edges = a.join(b, ["l_orderkey", "l_linenumber"]).select("src", "dst").distinct()
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), edges


def acyclic_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Its edges to larger parts alone."""
    nodes, edges = part_graph(spark, sf_dir)
    return nodes, edges.where("src < dst")


def thinned_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A thirteenth of those, which falls into many components, where the whole graph is one."""
    nodes, edges = acyclic_graph(spark, sf_dir)
    return nodes, edges.where("(src * 7 + dst) % 13 = 0")


def sparse_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where("id % 7 <> 0")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def postings_text(df: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["docno"], p["tf"])), ",")
    return df.select("term", "chunk", "n", text.alias("postings"))


# Words and pairs of words


def word_count_alpha(spark, sf_dir):
    return counts.word_count(documents(spark, sf_dir), pattern=ALPHABETIC)


def word_count_all(spark, sf_dir):
    return counts.word_count(documents(spark, sf_dir))


def vocab_size(spark, sf_dir):
    return counts.vocabulary_size(documents(spark, sf_dir))


def vocab_size_alpha(spark, sf_dir):
    return counts.vocabulary_size(documents(spark, sf_dir), pattern=ALPHABETIC)


def bigram_count(spark, sf_dir):
    return counts.bigram_count(lines(spark, sf_dir))


def bigram_count_text(spark, sf_dir):
    return counts.bigram_count_text(lines(spark, sf_dir))


# Co-occurrence


def cooc_marginals(spark, sf_dir):
    return cooc.marginals(lines(spark, sf_dir), cooc.MIN_COUNT)


def cooc_pairs(spark, sf_dir):
    return cooc.pairs(lines(spark, sf_dir)).select("left", "right", "cnt")


def cooc_conditional(spark, sf_dir):
    return cooc.conditional(lines(spark, sf_dir))


def cooc_stripes(spark, sf_dir):
    return cooc.stripe_pairs(cooc.stripes(lines(spark, sf_dir)))


def pmi(spark, sf_dir):
    return rounded(cooc.pmi(lines(spark, sf_dir)), "pmi")


def pmi_compat(spark, sf_dir):
    return rounded(cooc.pmi(lines(spark, sf_dir), normalise=False), "pmi")


def pmi_stripes(spark, sf_dir):
    return rounded(cooc.pmi_stripes(lines(spark, sf_dir)), "pmi")


def pmi_count(spark, sf_dir):
    return cooc.pmi(lines(spark, sf_dir)).agg(F.count("*").alias("pairs"))


def pmi_top_pair(spark, sf_dir):
    return cooc.pmi_best(lines(spark, sf_dir))


def pmi_topk_for_word(spark, sf_dir):
    return cooc.pmi_topk(rounded(cooc.pmi_of(lines(spark, sf_dir), WORD), "pmi"), WORD, 10)


# Index and retrieval


def inverted_index(spark, sf_dir):
    return postings_text(inverted(spark, sf_dir))


def inverted_index_compressed(spark, sf_dir):
    return index.compressed(inverted(spark, sf_dir)).select("term", "chunk", "n", F.hex("blob").alias("blob"))


def document_frequencies(spark, sf_dir):
    return index.document_frequencies(stored(spark, sf_dir))


def index_roundtrip(spark, sf_dir):
    return postings_text(index.decompressed(index.compressed(inverted(spark, sf_dir))))


def index_two_shuffles(spark, sf_dir):
    return postings_text(index.build_index(documents(spark, sf_dir), chunk=oracle.SMALL_CHUNK, unique=False))


def postings_lookup(spark, sf_dir):
    return index.lookup(stored(spark, sf_dir), TERM)


def postings_lookup_compressed(spark, sf_dir):
    return index.lookup(index.decompressed(stored(spark, sf_dir, pack=True).where(F.col("term") == TERM)), TERM)


def tf_histogram(spark, sf_dir):
    return index.tf_histogram(stored(spark, sf_dir), TERM)


def boolean(query: str, pack: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        have = stored(spark, sf_dir, pack)
        if pack:
            have = index.decompressed(have.where(F.col("term").isin(index.parsed_query(query)[0])))
        return index.boolean_query(have, query)

    return run


def fetch_lines(spark, sf_dir):
    return index.fetch(index.boolean_query(stored(spark, sf_dir), QUERY_AND), documents(spark, sf_dir))


def fetch_stored_lines(spark, sf_dir):
    """From a collection sorted by document number, of which only the row groups with found numbers are read."""
    path = scratch(spark)
    sinks.write_keyed(documents(spark, sf_dir), path, "docno")
    return index.fetch(index.boolean_query(stored(spark, sf_dir), QUERY_AND), readers.keyed(spark, path))


# Graphs


def graph_stats(spark, sf_dir):
    return graph.stats(*part_graph(spark, sf_dir))


def graph_adjacency(spark, sf_dir):
    return graph.to_adjacency(*part_graph(spark, sf_dir)).select("id", F.array_join(F.transform("adj", lambda x: x.cast("string")), ",").alias("adj"))


def graph_repeated_nodes(spark, sf_dir):
    nodes, edges = part_graph(spark, sf_dir)
    return graph.repeated_nodes(nodes.unionByName(edges.select(F.col("src").alias("id"))))


def graph_range_partition(spark, sf_dir):
    nodes, _ = part_graph(spark, sf_dir)
    return graph.partitioned(nodes, PARTS, "range").select("id", F.spark_partition_id().alias("part"))


def graph_hash_partition(spark, sf_dir):
    nodes, _ = part_graph(spark, sf_dir)
    return graph.partitioned(nodes, PARTS, "hash").select("id", F.spark_partition_id().alias("part"))


def graph_hash_partition_counts(spark, sf_dir):
    return graph_hash_partition(spark, sf_dir).groupBy("part").agg(F.count("*").alias("cnt"))


def graph_missing_targets(spark, sf_dir):
    nodes, edges = part_graph(spark, sf_dir)
    return graph.missing_targets(sparse_nodes(nodes), edges)


def pagerank_k(spark, sf_dir):
    return rounded(pagerank.pagerank(*part_graph(spark, sf_dir), iterations=10), "p", places=9)


def pagerank_acyclic(spark, sf_dir):
    return rounded(pagerank.pagerank(*acyclic_graph(spark, sf_dir), iterations=10), "p", places=9)


def pagerank_missing_nodes(spark, sf_dir):
    nodes, edges = part_graph(spark, sf_dir)
    return rounded(pagerank.pagerank(sparse_nodes(nodes), edges.where("src % 7 <> 0"), iterations=10), "p", places=9)


def pagerank_top(spark, sf_dir):
    return pagerank.top_nodes(pagerank_k(spark, sf_dir), 20)


def pagerank_log(spark, sf_dir):
    return rounded(pagerank.with_log(pagerank.pagerank(*part_graph(spark, sf_dir), iterations=10)), "p", "logp", places=7)


def pagerank_resumed(spark, sf_dir):
    """Four iterations in one run, six more in the next one from what that has written."""
    base = scratch(spark)
    graph_ = part_graph(spark, sf_dir)
    pagerank.pagerank_from(*graph_, base, 0, 4)
    return rounded(pagerank.pagerank_from(*graph_, base, 4, 10), "p", places=9)


def pagerank_converged(spark, sf_dir):
    return rounded(pagerank.pagerank(*part_graph(spark, sf_dir), tolerance=1e-11), "p", places=8)


def pagerank_counters(spark, sf_dir):
    nodes, edges = part_graph(spark, sf_dir)
    return pagerank.counters(sparse_nodes(nodes), edges)


def ppr_k(spark, sf_dir):
    return rounded(pagerank.personalized_pagerank(*part_graph(spark, sf_dir), SOURCES, 10), "p", places=9)


def ppr_top(spark, sf_dir):
    return pagerank.top_personalized(ppr_k(spark, sf_dir), 10)


def ppr_report(spark, sf_dir):
    return sinks.rank_report(ppr_top(spark, sf_dir))


def wcc_labels(spark, sf_dir):
    return graph.weak_components(*part_graph(spark, sf_dir))


def wcc_thinned(spark, sf_dir):
    return graph.weak_components(*thinned_graph(spark, sf_dir))


def wcc_count(spark, sf_dir):
    return wcc_thinned(spark, sf_dir).agg(F.count_distinct("component").alias("components"))


def graph_summary(spark, sf_dir):
    return graph.summary(*part_graph(spark, sf_dir))


# Sources and sinks: what is written is read again


def src_text(spark, sf_dir):
    path = scratch(spark)
    sinks.write_text(table(spark, sf_dir, "nation"), path, ["n_nationkey"])
    return readers.lines(spark, path)


def src_gzip(spark, sf_dir):
    path = scratch(spark)
    sinks.write_text(table(spark, sf_dir, "customer"), path, compression="gzip")
    return readers.lines(spark, path)


def src_offsets(spark, sf_dir):
    path = scratch(spark)
    sinks.write_text(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").coalesce(1), path, ["s_suppkey"])
    return readers.lines_with_offset(spark, path)


def src_tuples(spark, sf_dir):
    path = scratch(spark)
    sinks.write_tuples(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("left"), F.col("o_orderstatus").alias("right"), F.col("o_totalprice").alias("value")), path)
    return readers.tuples(spark, path)


def src_parquet(spark, sf_dir):
    path = scratch(spark)
    sinks.write_parquet(table(spark, sf_dir, "part"), path)
    sinks.write_parquet(table(spark, sf_dir, "part"), path)
    return readers.keyed(spark, path)


def src_keyed(spark, sf_dir):
    path = scratch(spark)
    sinks.write_keyed(table(spark, sf_dir, "orders"), path, "o_orderkey")
    return readers.keyed(spark, path).where("o_orderkey in (7, 42, 4242)")


def _graph_file(spark, sf_dir, between: str) -> str:
    path = scratch(spark)
    lists = graph.to_adjacency(*part_graph(spark, sf_dir))
    lists.select(F.array_join(F.transform(F.concat(F.array("id"), "adj"), lambda x: x.cast("string")), between).alias("value")).write.text(path)
    return path


def src_adjacency(spark, sf_dir):
    return graph.from_adjacency(readers.adjacency(spark, _graph_file(spark, sf_dir, " ")))[1]


def src_tab_adjacency(spark, sf_dir):
    return readers.tab_edges(spark, _graph_file(spark, sf_dir, "\t"))


def _events_file(spark, sf_dir) -> str:
    path = scratch(spark)
    time = F.date_format(F.col("ts").cast("timestamp"), EVENT_TIME)
    sinks.write_text(events(spark, sf_dir).where("ts is not null").select("event_id", time, F.coalesce(F.col("user_id"), F.lit(0)), F.coalesce("event_type", F.lit(""))), path)
    return path


def src_events(spark, sf_dir):
    return timeseries.hourly_counts(timeseries.parsed_events(readers.events(spark, _events_file(spark, sf_dir))), F.col("ts"), YEAR_TO_HOUR)


def src_events_csv(spark, sf_dir):
    return timeseries.hourly_counts(timeseries.with_keyword(timeseries.parsed_events(readers.events_csv(spark, _events_file(spark, sf_dir))), "text", KEYWORDS), F.col("ts"), YEAR_TO_HOUR)


def sink_iterations(spark, sf_dir):
    """The second of three states written one after another."""
    path = scratch(spark)
    for k in (1, 2, 3):
        sinks.write_iteration(table(spark, sf_dir, "region").select("r_name", F.lit(k).alias("k")), path, k)
    return readers.iteration(spark, path, 2)


# Events


def hourly_all(spark, sf_dir):
    return timeseries.hourly_counts(events(spark, sf_dir), F.col("ts"), YEAR_TO_HOUR)


def hourly_all_mdh(spark, sf_dir):
    return timeseries.month_day_hour_counts(events(spark, sf_dir), F.col("ts"))


def hourly_month_day(spark, sf_dir):
    return timeseries.hourly_counts(events(spark, sf_dir), F.col("ts"), MONTH_DAY_HOUR)


def hourly_zone(spark, sf_dir):
    return timeseries.hourly_counts(events(spark, sf_dir), F.col("ts"), YEAR_TO_HOUR, tz="Asia/Tokyo")


def hourly_keyword(spark, sf_dir):
    return timeseries.hourly_counts(timeseries.with_keyword(events(spark, sf_dir), "event_type", KEYWORDS), F.col("ts"))


def hourly_keyword_regex(spark, sf_dir):
    return timeseries.month_day_hour_counts(timeseries.matching(events(spark, sf_dir), "event_type", KEYWORDS), F.col("ts"))


def hourly_parsed_text(spark, sf_dir):
    text = F.when(F.col("event_id") % 11 == 0, "not a time").otherwise(F.date_format(F.col("ts").cast("timestamp"), EVENT_TIME))
    return timeseries.hourly_counts(timeseries.parsed_events(events(spark, sf_dir).select(text.alias("creationtime"))), F.col("ts"), YEAR_TO_HOUR)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        word_count_alpha, word_count_all, vocab_size, vocab_size_alpha, bigram_count, bigram_count_text,
        cooc_marginals, cooc_pairs, cooc_conditional, cooc_stripes, pmi, pmi_compat, pmi_stripes, pmi_count, pmi_top_pair, pmi_topk_for_word,
        inverted_index, inverted_index_compressed, document_frequencies, index_roundtrip, index_two_shuffles, postings_lookup, postings_lookup_compressed, tf_histogram, fetch_lines, fetch_stored_lines,
        graph_stats, graph_adjacency, graph_repeated_nodes, graph_range_partition, graph_hash_partition, graph_hash_partition_counts, graph_missing_targets,
        pagerank_k, pagerank_acyclic, pagerank_missing_nodes, pagerank_top, pagerank_log, pagerank_resumed, pagerank_converged, pagerank_counters, ppr_k, ppr_top, ppr_report, wcc_labels, wcc_thinned, wcc_count, graph_summary,
        src_text, src_gzip, src_offsets, src_tuples, src_parquet, src_keyed, src_adjacency, src_tab_adjacency, src_events, src_events_csv, sink_iterations,
        hourly_all, hourly_all_mdh, hourly_month_day, hourly_zone, hourly_keyword, hourly_keyword_regex, hourly_parsed_text,
    )
} | {"bool_and": boolean(QUERY_AND), "bool_or": boolean(QUERY_OR), "bool_nested": boolean(QUERY_NESTED), "bool_missing_term": boolean(QUERY_MISSING), "bool_nested_compressed": boolean(QUERY_NESTED, pack=True)}


def oracles() -> dict[str, str]:
    return oracle.sql()
