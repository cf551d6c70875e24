"""Readers: text lines with and without byte offsets, tuple files, adjacency lists, events, keyed indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import tokens

EVENTS = "id string, creationtime string, user string, text string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files, gzipped ones too."""
    return spark.read.text(path)


def lines_with_offset(spark: SparkSession, path: str) -> DataFrame:
    """(docno, value): each line with the byte offset at which it starts, per file."""
    rdd = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text")
    return rdd.toDF("docno long, value string")


def tuples(spark: SparkSession, path: str) -> DataFrame:
    """(left, right, value) of lines `(left, right)  value`; other lines are left out."""
    pattern = r"^\((\S+), (\S+)\)\s+(\S+)$"
    parts = [F.regexp_extract("value", pattern, k) for k in (1, 2, 3)]
    rows = lines(spark, path).where(F.col("value").rlike(pattern))
    return rows.select(parts[0].alias("left"), parts[1].alias("right"), parts[2].try_cast("double").alias("value"))


def _numbers(parts: Column) -> Column:
    return F.transform(parts, lambda x: x.try_cast("long"))


def adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(id, adj) of lines `id neighbour ...` between white space; blank lines, and lines with a field that isn't a whole number, are left out."""
    rows = lines(spark, path).select(_numbers(tokens(F.col("value"))).alias("all")).where((F.size("all") > 0) & ~F.exists("all", lambda x: x.isNull()))
    return rows.select(F.get("all", F.lit(0)).alias("id"), F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))).alias("adj"))


def tab_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of lines `id<TAB>neighbour...`, fields that aren't whole numbers left out; a node without any edge doesn't appear."""
    rows = lines(spark, path).select(_numbers(F.split("value", "\t")).alias("all")).where(F.size("all") > 1)
    return rows.select(F.get("all", F.lit(0)).alias("src"), F.explode(F.slice("all", F.lit(2), F.size("all") - 1)).alias("dst")).dropna()


def events(spark: SparkSession, path: str) -> DataFrame:
    """EVENTS columns of tab-separated lines; missing fields are null, further ones are left out."""
    parts = F.split("value", "\t")
    return lines(spark, path).select(*[F.get(parts, F.lit(k)).alias(c.split()[0]) for k, c in enumerate(EVENTS.split(", "))])


def events_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same by the CSV reader, quotes taken as they stand."""
    return spark.read.schema(EVENTS).option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").csv(path)


def keyed(spark: SparkSession, path: str) -> DataFrame:
    """A table written by sinks.write_keyed; a filter on its key reads the row groups that can hold it."""
    return spark.read.parquet(path)


def iteration(spark: SparkSession, base: str, number: int) -> DataFrame:
    """What sinks.write_iteration wrote as that iteration."""
    return spark.read.parquet(f"{base}/iter{number:04d}")
