"""Shards by vector bin packing: bytes, words and rows are balanced jointly.

The groups are equal texts; each goes to the shard where the dot product of its demand with the shard's residual
capacity is highest, largest groups first. A group that would fill more than HEAVY of a shard is dealt by a hash of
its rows' places into parts, SALTS of them or one for each PART rows of the table, each placed like a group; a lighter
one stays whole. Groups are packed into small bins in cells of bounded size; the
bins of all cells, with the groups that are large beside a bin, are then packed in the same way, level by level,
until one cell is left, whose bins are the shards. No task sees more than a cell.

Null texts weigh like empty ones; null ids are ids like others. Texts of any length are placed whole. Among shards of
equal dot product the first is taken; slots follow the rows' places in the table as it was read. Repeated rows stay
rows. An empty table gives an empty result. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BLOCK_ROWS, count_words, kept, running_total

#: Groups packed by one task, and the bins that it packs them into.
CELL, BINS = 2048, 64
#: A group of so many times the mean goes on to the next level as it is.
LARGE = 16
#: Parts of a heavy group at least, rows of the table for each part, and the part of a shard above which a group counts as heavy.
SALTS, PART, HEAVY = 64, 1 << 16, 1 / 2
DIMENSIONS = ("bytes", "tokens", "rows")


def place(demands: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each row of demands (items x dimensions), in the order given."""
    total = demands.sum(axis=0)
    demands = demands / np.where(total > 0, total / bins, 1)
    residual = np.ones((bins, demands.shape[1]))
    out = np.empty(len(demands), dtype=np.int32)
    for i, d in enumerate(demands):
        out[i] = b = int((residual @ d).argmax())
        residual[b] -= d
    return out


def packed(items: DataFrame, cells: int, bins: int) -> DataFrame:
    """(level, a, b, cell, bin) of items (level, a, b, bytes, tokens, rows), packed cell by cell."""

    def pack(x: pd.DataFrame) -> pd.DataFrame:
        demand = x[list(DIMENSIONS)].to_numpy(dtype=float)
        share = (demand / np.maximum(demand.sum(axis=0), 1)).sum(axis=1)
        order = np.lexsort((x["b"], x["a"], x["level"], -share))
        return x.iloc[order][["level", "a", "b", "cell"]].assign(bin=place(demand[order], bins))

    dealt = items.withColumn("cell", F.pmod(F.xxhash64("level", "a", "b"), F.lit(cells)))
    return dealt.groupBy("cell").applyInPandas(pack, "level int, a long, b int, cell long, bin int")


def sums() -> list:
    return [F.sum(d).cast("long").alias(d) for d in DIMENSIONS]


def shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, tokens, shard, slot) for each row; slots count each shard's rows from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = kept(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("bytes"),
            F.crc32(text.cast("binary")).alias("crc"),
            count_words(text).alias("tokens"),
            F.lit(1).cast("long").alias("rows"),
            F.xxhash64(text).alias("key"),
            F.monotonically_increasing_id().alias("place"),
        )
    )
    total = rows.agg(*sums()).first()
    salts = max(SALTS, -(-(total["rows"] or 0) // PART))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(salts)).cast("int"))
    heavy = F.lit(False)
    whole = rows.groupBy("key").agg(*[F.sum(d).alias(f"all_{d}") for d in DIMENSIONS])
    for d in DIMENSIONS:
        heavy = heavy | (F.col(f"all_{d}") > (total[d] or 0) * HEAVY / n_shards)
    parts = rows.select("key", "salt", *DIMENSIONS).groupBy("key", "salt").agg(*sums())
    parts = kept(parts.join(whole, "key").select("key", "salt", F.when(heavy, F.col("salt")).otherwise(-1).alias("unit"), *DIMENSIONS))

    items = parts.groupBy(F.lit(0).alias("level"), F.col("key").alias("a"), F.col("unit").alias("b")).agg(*sums())
    done: list[DataFrame] = []
    while True:
        mean = items.agg(F.count("*").alias("n"), *[F.avg(d).alias(d) for d in DIMENSIONS]).first()
        cells = max(1, -(-mean["n"] // CELL))
        if cells == 1:
            to = packed(items, 1, n_shards).select("level", "a", "b", F.col("bin").alias("shard"))
            break
        large = F.lit(False)
        for d in DIMENSIONS:
            large = large | (F.col(d) > LARGE * mean[d])
        done.append(kept(packed(items.where(~large), cells, BINS)))
        bins = items.join(done[-1], ["level", "a", "b"]).groupBy("cell", "bin").agg(*sums())
        bins = bins.select(F.lit(len(done)).alias("level"), F.col("cell").alias("a"), F.col("bin").alias("b"), *DIMENSIONS)
        items = kept(items.where(large).unionByName(bins))
    for k in range(len(done), 0, -1):
        up = to.where(F.col("level") == k).select(F.col("a").alias("cell"), F.col("b").alias("bin"), "shard")
        to = to.where(F.col("level") < k).unionByName(done[k - 1].join(up, ["cell", "bin"]).select("level", "a", "b", "shard"))
    units = parts.join(to, (parts.key == to.a) & (parts.unit == to.b)).select("key", "salt", "shard")
    placed = rows.join(units, ["key", "salt"])
    placed = placed.withColumn("block", F.expr(f"place div {BLOCK_ROWS}"))
    slots = running_total(placed, ["shard"], "block", [F.col("place")], F.col("rows"), "slot")
    return slots.select(F.col("id").alias(id_col), F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), "tokens", "shard", "slot")
