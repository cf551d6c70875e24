"""Writers: tab-separated text sorted within files, Parquet, tables sorted by key, and reports. All overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_text(df: DataFrame, path: str, sort_by: list[str] | None = None, compression: str = "none") -> None:
    """key<TAB>value lines, sorted within each file; compression may be gzip."""
    df = df.sortWithinPartitions(*sort_by) if sort_by else df
    df.select(F.concat_ws("\t", *[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def write_tuples(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """(left, right, value) as lines `(left, right)<TAB>value`."""
    out = df.select(F.format_string("(%s, %s)\t%s", "left", "right", F.col("value").cast("string")).alias("value"))
    out.write.mode("overwrite").option("compression", compression).text(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_keyed(df: DataFrame, path: str, key: str) -> None:
    """Range-partitioned and sorted by key, so that a point lookup skips files and row groups by their statistics."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_iteration(df: DataFrame, base: str, number: int) -> None:
    """One numbered state of an iteration, beside the others of its base folder."""
    write_parquet(df, f"{base}/iter{number:04d}")


def rank_report(ranks: DataFrame) -> DataFrame:
    """(source, place, line) of (source, id, p, place): lines of `%.5f id`."""
    return ranks.select("source", "place", F.format_string("%.5f %d", "p", "id").alias("line")).orderBy("source", "place")
