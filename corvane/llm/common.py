"""What several operators share: word splitting, checkpoints, and totals along a distributed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.plans.lineage import kept

__all__ = ["BLOCK_ROWS", "BREAKS", "WHOLE", "block_bits", "count_words", "hashed", "hot_join", "kept", "ranked", "running_total", "table", "text_key", "unused", "words"]

#: What separates words; the same bytes that bytes.split() splits on.
BREAKS = "[\\x20\\x09-\\x0D]+"
#: Rows of one block of a distributed order; each block is sorted by one task.
BLOCK_ROWS = 8192
#: Names of the types of whole numbers.
WHOLE = ("byte", "short", "integer", "long")
#: Keys that hot_join() takes apart, at most, and rows that a key may have before it counts as one of them.
HOT_KEYS, HOT_ROWS = 10_000, 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The maximal runs of bytes other than space and \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def count_words(text: Column) -> Column:
    """The number of words of a text column; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def text_key(text: Column) -> Column:
    """16 bytes of SHA-256 of a text, null as the empty one: what stands for equal texts."""
    return F.unhex(F.left(F.sha2(F.coalesce(text, F.lit("")), 256), F.lit(32)))


def hashed(*cols: Column | str, bits: int = 62) -> Column:
    """A non-negative hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - bits)


def block_bits(rows: int, per_block: int = BLOCK_ROWS) -> int:
    """How many leading hash bits make blocks of about per_block rows."""
    return max(0, (max(rows, 1) - 1).bit_length() - (per_block.bit_length() - 1))


def running_total(df: DataFrame, groups: list[str], block: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """df with `out`: the sum of value over the rows before this one, in its groups, by block and then order.

    The block column must grow with the order. No task sees more than a block's rows, nor more than one row for
    each block of a group: the blocks' sums come first, then the offset of each block, then the rows of each block.
    """
    sums = df.groupBy(*groups, block).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*groups, block, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy(*groups, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("_inside", F.coalesce(F.sum(value).over(here), F.lit(0)))
    same = [inside[c].eqNullSafe(offsets[c]) for c in [*groups, block]]
    on = same[0]
    for x in same[1:]:
        on = on & x
    joined = inside.join(offsets, on, "left")
    return joined.select(*[inside[c] for c in df.columns], (F.coalesce(F.col("_before"), F.lit(0)) + F.col("_inside")).cast("long").alias(out))


def ranked(ids: DataFrame) -> DataFrame:
    """(id, rank): the distinct ids (id), but null, numbered from 0 by their order; ids may be of any type that sorts."""
    ids = ids.where("id is not null").distinct()
    parts = max(1, -(-ids.count() // BLOCK_ROWS))
    dealt = kept(ids.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()))
    return kept(running_total(dealt, [], "part", [F.col("id")], F.lit(1), "rank").select("id", "rank"))


def hot_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """left (written, so that its rows keep their order) joined to right, which has one row for each key at most.

    Keys that hold more than HOT_ROWS rows of left, and more than one in HOT_KEYS of all (so HOT_KEYS keys at most,
    whatever the size), are dealt over a task for each HOT_ROWS of their rows; right's row goes to each.
    """
    n = left.count()
    if n <= HOT_ROWS:
        return left.join(right, on, how)
    sizes = left.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > max(HOT_ROWS, n // HOT_KEYS))
    hot = kept(sizes.select(on, F.ceil(F.col("_n") / HOT_ROWS).alias("_parts")))
    if hot.isEmpty():
        return left.join(right, on, how)
    hot = F.broadcast(hot)
    here = left.join(hot, on).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.col("_parts"))).drop("_parts")
    theirs = right.join(hot, on).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    return here.join(theirs, [on, "_part"], how).drop("_part").unionByName(left.join(hot, on, "left_anti").join(right, on, how))
