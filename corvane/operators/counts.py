"""Counts of words and of adjacent pairs. Partial counts are made before the one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import bigrams, tokens


def exploded(df: DataFrame, text: str = "text", pattern: str | None = None) -> DataFrame:
    """(term): one row a token; pattern: what a token must match as a whole."""
    rows = df.select(F.explode(tokens(F.col(text))).alias("term"))
    return rows.where(F.col("term").rlike(pattern)) if pattern else rows


def word_count(df: DataFrame, text: str = "text", pattern: str | None = None) -> DataFrame:
    """(term, cnt)."""
    return exploded(df, text, pattern).groupBy("term").agg(F.count("*").alias("cnt"))


def vocabulary_size(df: DataFrame, text: str = "text", pattern: str | None = None) -> DataFrame:
    """One row (terms): the number of distinct tokens."""
    return word_count(df, text, pattern).agg(F.count("*").alias("terms"))


def split_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, line_no, line): the lines of each document."""
    return df.select(id_col, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def bigram_count(lines: DataFrame, line: str = "line") -> DataFrame:
    """(first, second, cnt) of adjacent tokens of one line; no pair crosses lines. A line is split once."""
    pairs = lines.select(tokens(F.col(line)).alias("t")).select(F.explode(bigrams(F.col("t"))).alias("b"))
    return pairs.select(F.col("b.0").alias("first"), F.col("b.1").alias("second")).groupBy("first", "second").agg(F.count("*").alias("cnt"))


def bigram_count_text(lines: DataFrame, line: str = "line") -> DataFrame:
    """(bigram, cnt) with the pair written first_second."""
    return bigram_count(lines, line).groupBy(F.concat_ws("_", "first", "second").alias("bigram")).agg(F.sum("cnt").alias("cnt"))
