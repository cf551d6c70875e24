"""The corpus pipeline: five operators in turn, each over all that its predecessor kept.

The result has one row for each piece of a document that the mix takes, with the piece's own text: sorted by piece, a
taken document's texts make what the mix took of it, personal data masked.

Null texts count as empty throughout: such a document is toxic only if texts without words are, is alike to others
without words of the same text, has no personal data, and is never taken by the mix, for it has no words. Null ids and
sources are kept as they are. Of near duplicates the least id stays (nulls last), of rows alike in id and text the one
whose columns hash lowest. Texts of any length are read whole. Further columns, whatever their names, pass through all
stages but the last, which leaves them out. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import mixing, neardup, packing, pii, toxicity
from corvane.llm.common import kept, table


def refreshed(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if they have it, counted again."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity operator, fitted on the labels, doesn't reject."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id."""
    return neardup.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span of personal data masked by its kind."""
    return refreshed(pii.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; the last one of a source is cut at its target."""
    return refreshed(mixing.mixed(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces with their texts and bins; no two of a source or a cluster of equal texts share one."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Most stages run Python on whole texts, which SQL can't express; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written to the checkpoint folder before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
