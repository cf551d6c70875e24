"""Inverted index: building, compressing, storing, lookup, and Boolean retrieval of documents.

An index has a row for each term and range of CHUNK document numbers: (term, chunk, n, postings), n being how many
postings the row has. So the postings of a term that every document has are many rows, of bounded size, made by as many
tasks; the number of documents of a term is the sum of its rows' n.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.codec import decoded, encoded
from corvane.plans.lineage import scratch
from corvane.sources import readers, sinks

OPERATORS = {"AND": lambda a, b: a & b, "OR": lambda a, b: a | b}
#: Document numbers of one range.
CHUNK = 1 << 20
#: Rows that are sent to the JVM together, about.
ROWS = 1 << 16
#: Documents that fetch() names in a pushed-down condition, at most.
NAMED = 10_000


def _rows(counts: Iterator[tuple[int, Counter]], kind: pa.DataType, most: int) -> Iterator[pa.RecordBatch]:
    """(term, docno, tf) of counts, in batches of about `most` rows however many documents a batch brought."""
    docnos, terms, tfs = [], [], []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(docnos, kind), pa.array(tfs, pa.int32())], names=["term", "docno", "tf"])

    for docno, found in counts:
        docnos += [docno] * len(found)
        terms += found.keys()
        tfs += found.values()
        if len(terms) >= most:
            yield made()
            docnos, terms, tfs = [], [], []
    if terms:
        yield made()


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None]]:
    for batch in batches:
        yield from ((docno.as_py(), text.as_py()) for docno, text in zip(batch.column(0), batch.column(1), strict=True))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, docno, tf) of texts: those that follow one another under one number are one document."""

    def counts() -> Iterator[tuple[int, Counter]]:
        for docno, texts in groupby(_documents(batches), itemgetter(0)):
            found: Counter = Counter()
            for _, text in texts:
                found.update((text or "").encode().split())
            yield docno, found

    return _rows(counts(), pa.int64(), ROWS)


def term_frequencies(docs: DataFrame, docno: str = "docno", text: str = "text", unique: bool = True) -> DataFrame:
    """(term, docno, tf). Where document numbers are unique, a document's row is counted where it stands, without a
    shuffle, and reaches Python line by line, so that a batch of some thousand rows is small; else texts, which are
    smaller than their tokens as rows, are brought together by number."""
    rows = docs.select(F.col(docno).cast("long").alias("docno"), F.col(text).alias("text"))
    if unique:
        rows = rows.select("docno", F.explode(F.split("text", "\n")).alias("text"))
    else:
        rows = rows.repartitionByRange("docno").sortWithinPartitions("docno")
    return rows.mapInArrow(_counted, "term string, docno long, tf int")


def build_index(docs: DataFrame, docno: str = "docno", text: str = "text", chunk: int = CHUNK, unique: bool = True) -> DataFrame:
    """(term, chunk, n, postings): postings sorted by document number."""
    rows = term_frequencies(docs, docno, text, unique).withColumn("chunk", F.expr(f"docno div {chunk}"))
    postings = F.array_sort(F.collect_list(F.struct("docno", "tf")))
    return rows.groupBy("term", "chunk").agg(F.count("*").alias("n"), postings.alias("postings"))


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df): in how many documents each term is."""
    return index.groupBy("term").agg(F.sum("n").alias("df"))


def compressed(index: DataFrame) -> DataFrame:
    """(term, chunk, n, blob): gap-coded postings."""
    return index.select("term", "chunk", "n", encoded("postings").alias("blob"))


def decompressed(blobs: DataFrame) -> DataFrame:
    """(term, chunk, n, postings) of compressed()."""
    return blobs.select("term", "chunk", "n", decoded("blob").alias("postings"))


_stored: dict[tuple[str, str, bool], str] = {}


def stored(spark: SparkSession, docs: DataFrame, name: str, pack: bool = False) -> DataFrame:
    """The index of docs as a table sorted by term, built and written the first time that the application asks for that name."""
    key = spark.sparkContext.applicationId, name, pack
    if key not in _stored:
        built = build_index(docs)
        path = scratch(spark)
        sinks.write_keyed(compressed(built) if pack else built, path, "term")
        _stored[key] = path
    return readers.keyed(spark, _stored[key])


def lookup(index: DataFrame, term: str) -> DataFrame:
    """(docno, tf) of a term; none if it isn't in the index. The filter is pushed down to a stored index."""
    return index.where(F.col("term") == term).select(F.explode("postings").alias("p")).select("p.docno", "p.tf")


def tf_histogram(index: DataFrame, term: str) -> DataFrame:
    """(tf, cnt): in how many documents the term has each frequency."""
    return lookup(index, term).groupBy("tf").agg(F.count("*").alias("cnt"))


def parsed_query(query: str) -> tuple[list[str], Column]:
    """The terms of a query in reverse Polish notation, and its condition on the columns f0, f1, ... that say which a document has."""
    terms: list[str] = []
    stack: list[Column] = []
    for token in query.split():
        if token in OPERATORS:
            if len(stack) < 2:
                raise ValueError(f"{token} needs two operands: {query!r}")
            b, a = stack.pop(), stack.pop()
            stack.append(OPERATORS[token](a, b))
        else:
            if token not in terms:
                terms.append(token)
            stack.append(F.col(f"f{terms.index(token)}"))
    if len(stack) != 1:
        raise ValueError(f"a query leaves one result, this one {len(stack)}: {query!r}")
    return terms, stack[0]


def boolean_query(index: DataFrame, query: str) -> DataFrame:
    """(docno) of the documents that a query finds: one scan, one shuffle, whatever its depth."""
    terms, condition = parsed_query(query)
    hits = index.where(F.col("term").isin(terms)).select("term", F.explode("postings.docno").alias("docno"))
    flags = [F.max(F.col("term") == t).alias(f"f{i}") for i, t in enumerate(terms)]
    return hits.groupBy("docno").agg(*flags).where(condition).select("docno")


def fetch(found: DataFrame, docs: DataFrame, docno: str = "docno", text: str = "text", named: int = NAMED) -> DataFrame:
    """(docno, text) of found documents.

    Up to `named` of them are named in a condition, so that a collection sorted by document number is read only where
    they are; more are joined.
    """
    docs = docs.select(F.col(docno).alias("docno"), F.col(text).alias("text"))
    some = [r.docno for r in found.select("docno").limit(named + 1).collect()]
    return docs.where(F.col("docno").isin(some)) if len(some) <= named else docs.join(found, "docno", "left_semi")


def boolean_queries(index: DataFrame, queries: list[str]) -> DataFrame:
    """(query, docno) of several queries."""
    return reduce(DataFrame.unionByName, [boolean_query(index, q).select(F.lit(q).alias("query"), "docno") for q in queries])
