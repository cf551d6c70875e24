"""Conflict-constrained best-fit packing of documents into bins of CAPACITY words.

A document longer than a bin is cut into pieces of CAPACITY words and a rest. No bin holds two pieces of one source,
nor two of one cluster of duplicates (equal texts, or a cluster column). Bins are kept in order of their residual
capacity and carry bitmaps of their sources and clusters; a piece goes to the compatible bin with the least residual
that holds it, found by successor search from its own size upwards, or else to a new bin. Larger pieces come first.

Rows alike in id, source, cluster and text are counted first and told apart by a copy number. Pieces are dealt by a
hash to shards of about SHARD pieces, each packed by one task with no text and no ids in it; so copies, and a source
with a third of all rows, are spread over all shards. Then each document's pieces meet its text again, whatever its
length, and carry the text from their first word up to the next piece's: a document's pieces, in order, make its text.

A null source conflicts with none. Null and empty texts are one piece of no words; a null text stays null. Null ids
are ids like others. Of pieces of one size those whose keys hash lower come first; of bins that fit equally, the one
that reached that size first. Repeated rows are pieces of their own. An empty table gives no bins. Further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import count_words, hashed, hot_join, kept, text_key
from corvane.llm.shingles import BREAK

CAPACITY, SHARD = 2048, 4096
#: Rows alike that one task spreads out together.
COPIES = 4096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each piece, in the order given; a source or cluster of -1 conflicts with none."""
    levels: dict[int, list[int]] = {}
    present = 0  # bit r: there are bins with residual r
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at, found, residual = size, -1, capacity
        while found < 0 and (above := present >> at):
            residual = at + (above & -above).bit_length() - 1
            for b in levels[residual]:
                if not (source_bits[b] & s or cluster_bits[b] & c):
                    found = b
                    break
            at = residual + 1
        if found < 0:
            found, residual = len(source_bits), capacity
            source_bits.append(0)
            cluster_bits.append(0)
        else:
            levels[residual].remove(found)
            if not levels[residual]:
                present ^= 1 << residual
        source_bits[found] |= s
        cluster_bits[found] |= c
        left = residual - size
        levels.setdefault(left, []).append(found)
        present |= 1 << left
        out.append(found)
    return out


def counted(docs: DataFrame, id_col: str, text_col: str, source_col: str, cluster_col: str | None) -> tuple[DataFrame, DataFrame]:
    """The distinct documents (key, source, cluster, all_words, n: rows alike), and (key, id, source, text) of each."""
    text = F.col(text_col)
    cluster = F.xxhash64(F.col(cluster_col)) if cluster_col else F.xxhash64(F.coalesce(text, F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), cluster.alias("cluster"), text.alias("text"))
    whole = F.concat(F.to_json(F.struct("id", "source", "cluster", F.col("text").isNull().alias("none"))), F.hex(text_key(F.col("text"))))
    rows = rows.withColumn("key", text_key(whole))
    few = rows.select("key", "source", "cluster", count_words(F.col("text")).alias("all_words"))
    few = few.groupBy("key").agg(F.first("source").alias("source"), F.first("cluster").alias("cluster"), F.first("all_words").alias("all_words"), F.count("*").alias("n"))
    return few, rows.groupBy("key").agg(F.first(F.struct("id", "source", "text")).alias("doc")).select("key", "doc.*")


def pieces(few: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(key, copy, source, cluster, piece, from_word, n_words): what there is to pack, of the distinct documents."""
    # Copies in blocks first, so that no array holds more than a block of them.
    rows = few.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}")))).withColumn("upto", F.least((F.col("block") + 1) * COPIES, F.col("n")) - 1)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES, F.col("upto"))))
    parts = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(all_words - 1, 0) div {capacity}"))))
    left = F.col("all_words") - F.col("piece") * capacity
    return parts.select("key", "copy", "source", "cluster", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("from_word"), F.least(left, F.lit(capacity)).cast("long").alias("n_words"))


def _packer(capacity: int):
    def pack(x: pa.Table) -> pa.Table:
        """One shard's pieces with their bins."""
        sizes = x["n_words"].to_numpy()
        order = np.lexsort((x["piece"].to_numpy(), x["copy"].to_numpy(), x["print"].to_numpy(), -sizes))
        x, sizes = x.take(pa.array(order)), sizes[order]
        sources, clusters = (pc.fill_null(x[c].combine_chunks().dictionary_encode().indices, -1).to_pylist() for c in ("source", "cluster"))
        bins = np.array(best_fit(sizes.tolist(), sources, clusters, capacity), dtype=np.int64)
        # Each piece's place in its bin, and the words before it there.
        by = np.argsort(bins, kind="stable")
        starts = np.flatnonzero(np.r_[True, bins[by][1:] != bins[by][:-1]])
        lengths = np.diff(np.append(starts, len(by)))
        before = np.cumsum(sizes[by]) - sizes[by]
        slots, offsets = np.empty(len(by), dtype=np.int32), np.empty(len(by), dtype=np.int64)
        slots[by] = np.arange(len(by)) - np.repeat(starts, lengths)
        offsets[by] = before - np.repeat(before[starts], lengths)
        placed = {"bin": bins + x["shard"].to_numpy() * (1 << 32), "bin_slot": slots, "bin_offset": offsets}
        return pa.table({c: x[c] for c in ("key", "copy", "cluster", "piece", "from_word", "n_words")} | {c: pa.array(v) for c, v in placed.items()})

    return pack


PIECE = {"piece": "int", "from_word": "long", "n_words": "long", "cluster": "long", "bin": "long", "bin_slot": "int", "bin_offset": "long"}


def cut(text: str | None, words: list[int]) -> list[str | None]:
    """A text in parts that begin at the words of these numbers, the first at its very beginning."""
    if len(words) == 1:
        return [text]
    raw = (text or "").encode("utf-8", "surrogatepass")
    inside = np.zeros(len(raw) + 1, dtype=np.int8)
    inside[1:] = ~BREAK[np.frombuffer(raw, dtype=np.uint8)]
    starts = np.flatnonzero(np.diff(inside) == 1)
    at = [0, *starts[words[1:]].tolist(), len(raw)]
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(at[:-1], at[1:], strict=True)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece, with its text, from rows (id, source, text, pieces)."""
    for batch in batches:
        lists = batch.column(3)
        ends = lists.offsets.to_numpy()
        rows, words = lists.flatten(), lists.flatten().field("from_word").to_numpy()
        own = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends)))
        parts: list[str | None] = []
        for text, a, b in zip(batch.column(2).to_pylist(), ends[:-1] - ends[0], ends[1:] - ends[0], strict=True):
            parts += cut(text, words[a:b].tolist())
        columns = [batch.column(0).take(own), batch.column(1).take(own), *[rows.field(c) for c in PIECE], pa.array(parts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "source", *PIECE, "text"])


def packed(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """(id_col, source, cluster, piece, from_word, n_words, bin, bin_slot, bin_offset, text) of every piece."""
    few, texts = counted(docs, id_col, text_col, source_col, cluster_col)
    rows = kept(pieces(few, capacity).withColumn("print", F.xxhash64("key")))
    shards = max(1, -(-rows.count() // SHARD))
    dealt = rows.withColumn("shard", hashed("key", "copy", "piece") % shards)
    types = ", ".join(f"{c} {PIECE[c]}" for c in ("cluster", "piece", "from_word", "n_words", "bin", "bin_slot", "bin_offset"))
    placed = dealt.groupBy("shard").applyInArrow(_packer(capacity), f"key binary, copy long, {types}")
    each = kept(placed.groupBy("key", "copy").agg(F.sort_array(F.collect_list(F.struct(*PIECE))).alias("pieces")))
    both = hot_join(each, texts, "key").select("id", "source", "text", "pieces")
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("source", docs.schema[source_col].dataType)]
    fields += [T.StructField(c, T.IntegerType() if kind == "int" else T.LongType()) for c, kind in PIECE.items()]
    out = both.mapInArrow(_cut, T.StructType([*fields, T.StructField("text", T.StringType())]))
    return out.select(F.col("id").alias(id_col), "source", "cluster", "piece", "from_word", "n_words", "bin", "bin_slot", "bin_offset", "text")
