"""Near duplicates by BagMinHash: weighted-Jaccard signatures, bands, and verified multiset overlap.

A text's bag counts its shingles of five words (the whole text, if it has fewer). Equal texts are one node from the
start. Each shingle's weight, cut into the dyadic cells [0,1), [1,2), [2,4), [4,8) ..., drives one Poisson process for
each cell up to its count; points in the last cell beyond the count are thinned out. Every point goes to one of M
registers, and each register keeps its earliest point, so that two registers agree with the probability of the bags'
weighted Jaccard similarity. A process ends once its time passes the text's latest register.

Nodes that agree in a band share a bucket. First every bucket's best-connected node is compared with the others: its
family. Nodes of a family that are still in different components are then compared block by block: pairs that what
they share with the best node doesn't rule out, and whose signatures agree in LIKELY of the registers, are verified at
once, and only links that join components leave the task. What verifies is the overlap of the two multisets of
shingles, compared as text. Classes are the connected components of the verified pairs of similarity LEAST or more.
No pair is dropped but for a bound or a signature that denies it; a task sees two blocks of a family at most.

Null texts count as empty; texts without words are alike only if equal. Texts of any length are signed and compared
whole. A class is named by its least id, whatever type of id sorts. Null ids and repeated rows are rows of their own,
in the class of their text; a class of null ids alone has a null name. Empty tables give empty results. Further
columns, whatever their names, are ignored by classes(), kept by one_of_each().
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import hot_join, kept, text_key, words
from corvane.llm.shingles import counted, mixed, shingled
from corvane.operators.components import components

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 25, 5
M = BANDS * ROWS
#: Three standard errors below LEAST.
LIKELY = 0.69
#: Rows of a block that is compared with another.
BLOCK = 512
#: Rows of several blocks that a task takes together.
PART = 2048
#: Texts whose registers fill together, and their characters, at most (but for a longer text alone).
BATCH, BATCH_CHARS = 2048, 1 << 21
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from the upper 53 of 64 bits."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The M registers of each text (32-bit names of their earliest points), and whether it has words."""
    doc, run, count = counted(*shingled(texts, SHINGLE))
    # One process for each shingle and dyadic cell below its count.
    cells = np.ceil(np.log2(count)).astype(np.int64) + 1
    rep = np.repeat(np.arange(len(doc)), cells)
    level = np.arange(len(rep)) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0).astype(np.float64)
    width = np.where(level > 0, low, 1.0)
    doc, weight = doc[rep], count[rep].astype(np.float64)
    seed = mixed(run[rep] + level.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    full = low + width <= weight

    times = np.full(len(texts) * M, np.inf)
    names = np.zeros(len(texts) * M, dtype=np.uint32)
    t = np.zeros(len(doc))
    step = 0
    while len(doc):
        step += 1
        a = mixed(seed + np.uint64(step * int(_GOLDEN) % (1 << 64)))
        b = mixed(a ^ seed)
        t = t - np.log(uniform(a)) / width
        latest = times.reshape(-1, M).max(axis=1)
        on = t < latest[doc]
        if not on.all():
            doc, weight, seed, full, low, width, t, a, b = (x[on] for x in (doc, weight, seed, full, low, width, t, a, b))
        at = doc * M + ((b & np.uint64(0xFFFFFFFF)) % np.uint64(M)).astype(np.int64)
        hit = t < times[at]
        if not full.all():
            hit &= full | (low + width * uniform(mixed(b + _GOLDEN)) < weight)
        hit = np.flatnonzero(hit)
        hit = hit[np.argsort(-t[hit], kind="stable")]  # the earliest is written last
        times[at[hit]] = t[hit]
        names[at[hit]] = (mixed(b ^ _GOLDEN)[hit] >> np.uint64(32)).astype(np.uint32)
    has = np.isfinite(times.reshape(-1, M)).all(axis=1) if len(texts) else np.empty(0, dtype=bool)
    return names.reshape(-1, M), has


def slices(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each part has BATCH rows and BATCH_CHARS bytes of text at most, or one row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = min(start + BATCH, max(start + 1, int(np.searchsorted(ends, done + BATCH_CHARS, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sign, bands) of rows (node, text); a node that a task meets again isn't signed again."""
    seen: set[bytes] = set()
    for part in slices(batches):
        nodes = part.column(0).to_pylist()
        new = [k for k, n in enumerate(nodes) if not (n in seen or seen.add(n))]
        part = part.take(pa.array(new, pa.int64()))
        names, has = signatures(part.column(1).to_pylist())
        bands = [[int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(row[b * ROWS : (b + 1) * ROWS].tobytes(), seed=b)))) for b in range(BANDS)] if ok else [] for row, ok in zip(names, has, strict=True)]
        signs = [row.astype("<u2").tobytes() for row in names]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["node", "sign", "bands"])


def bag(text: str) -> Counter[bytes]:
    """How often a text has each shingle, as its words joined by one space."""
    w = words(text)
    if not 0 < SHINGLE <= len(w):
        return Counter([b" ".join(w)] if w else [])
    whole = b" ".join(w)
    ends = list(accumulate(len(x) + 1 for x in w))
    return Counter([whole[s:e] for s, e in zip([0, *ends], [e - 1 for e in ends[SHINGLE - 1 :]], strict=False)])


def shared(a: Counter[bytes], b: Counter[bytes]) -> int:
    """The size of what two bags share."""
    a, b = (a, b) if len(a) < len(b) else (b, a)
    return sum(n if n < (m := b[x]) else m for x, n in a.items() if x in b)


def similarity(a: Counter[bytes], b: Counter[bytes]) -> float:
    """The weighted Jaccard similarity of two bags."""
    both = shared(a, b)
    total = a.total() + b.total() - both
    return both / total if total else 0.0


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) with the sizes of their bags and of what they share, from rows (a, block, lead, node, text).

    The rows of a block follow one another, the one of a itself (lead) first.
    """
    key, held, size = None, Counter(), 0
    for part in slices(batches, 4):
        out: list[tuple] = []
        for a, block, lead, node_, text in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
            if lead:
                key, held = (a, block), bag(text)
                size = held.total()
                continue
            if key != (a, block):
                raise ValueError("a block's rows don't follow its first text")
            other = bag(text)
            out.append((a, node_, size, other.total(), shared(held, other)))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "na", "nb", "both"])


def measured(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, na, nb, both) of pairs (a, b) of nodes; texts: (node, text). A block of BLOCK partners has the text of a once."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = hot_join(pairs, blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), F.lit(False).alias("lead"), F.col("b").alias("node"))
    leads = blocks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("lead"), F.col("a").alias("node"))
    both = hot_join(kept(rows.unionByName(leads)), texts, "node").select("a", "block", "lead", "node", "text")
    dealt = both.repartition("a", "block").sortWithinPartitions("a", "block", F.col("lead").desc())
    return dealt.mapInArrow(_measure, "a binary, b binary, na long, nb long, both long")


def near(measures: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity is LEAST or more."""
    return measures.where(F.col("both") / F.greatest(F.col("na") + F.col("nb") - F.col("both"), F.lit(1)) >= LEAST).select("a", "b")


def _cross(x: pd.DataFrame) -> pd.DataFrame:
    """Links between components of some blocks of families and others, or themselves.

    Two bags share no more than the least of what they share with the best node and the least of the rest.
    """
    out: list[tuple[bytes, bytes]] = []
    if len(x):
        x = x.sort_values(["a", "i", "j", "side", "node"], ignore_index=True)
        names, roots, sides = x["node"].to_numpy(), pd.factorize(x["root"])[0], x["side"].to_numpy()
        signs = np.frombuffer(b"".join(x["sign"]), dtype="<u2").reshape(-1, M)
        size, inner, texts = x["size"].to_numpy(), x["inner"].to_numpy(), x["text"].to_numpy()
        group = pd.factorize(x["a"])[0], x["i"].to_numpy(), x["j"].to_numpy()
        new = np.r_[True, np.any([g[1:] != g[:-1] for g in group], axis=0)]
        starts = np.flatnonzero(new)
        for start, stop in zip(starts, np.append(starts[1:], len(x)), strict=True):
            left = start + np.flatnonzero(sides[start:stop] == 0)
            right = start + np.flatnonzero(sides[start:stop] == 1)
            within = group[1][start] == group[2][start]
            own = roots.copy()  # components, as links join them
            bags: dict[int, Counter[bytes]] = {}
            for n, i in enumerate(left):
                j = left[n + 1 :] if within else right
                j = j[own[j] != own[i]]
                most = np.minimum(inner[j], inner[i]) + np.minimum(size[j] - inner[j], size[i] - inner[i])
                j = j[most >= LEAST * (size[j] + size[i] - most) - 1e-6]
                if not len(j):
                    continue
                agree = (signs[j] == signs[i]).mean(axis=1)
                for k in j[np.argsort(-agree, kind="stable")][: int((agree >= LIKELY).sum())]:
                    if own[k] == own[i]:
                        continue
                    p, q = (bags.setdefault(m, bag(texts[m])) if m not in bags else bags[m] for m in (i, k))
                    if similarity(p, q) >= LEAST:
                        out.append((min(names[i], names[k]), max(names[i], names[k])))
                        here = np.concatenate([left, right])
                        own[here[own[here] == own[k]]] = own[i]
    return pd.DataFrame({"a": [p[0] for p in out], "b": [p[1] for p in out]}, dtype=object)


def links(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b): pairs of nodes that are near, enough of them that their components are those of all near pairs."""
    texts = docs.select(text_key(F.col(text_col)).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = kept(texts.mapInArrow(_sign, "node binary, sign binary, bands array<long>"))
    distinct = signed.groupBy("node").agg(F.first("bands").alias("bands"))
    rows = distinct.select("node", F.posexplode("bands").alias("band", "key"))
    common = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = kept(rows.join(common, ["band", "key"]).select("node", F.struct("band", "key").alias("bucket"), "n"))
    degree = buckets.groupBy("node").agg(F.sum("n").alias("degree"))
    those = degree.select("node")
    # Equal texts become one in the tasks that read them, so that no task meets all copies of a text.
    some = kept(texts.groupBy("node").agg(F.first("text").alias("text")).join(those, "node", "left_semi"))

    # Round 1: the best-connected node of each bucket with the others.
    best = buckets.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("top"))
    stars = hot_join(buckets, best, "bucket").select(F.col("top.node").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    compared = kept(measured(kept(stars), some))
    found = near(compared)

    # Round 2: what is still apart within a family, by blocks.
    roots = kept(components(found))
    family = compared.select("a", F.col("b").alias("node"), F.col("nb").alias("size"), F.col("both").alias("inner"))
    apart = kept(family.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    sizes = apart.groupBy("a", "root").agg(F.count("*").alias("own"))
    sizes = sizes.groupBy("a").agg(F.max(F.struct("own", "root")).alias("main"), F.sum("own").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    apart = apart.join(sizes.select("a", F.col("main.root").alias("most"), F.col("main.own").alias("in_main"), "n"), "a")
    apart = apart.withColumn("other", F.col("root") != F.col("most"))
    apart = apart.withColumn("others", F.ceil((F.col("n") - F.col("in_main")) / BLOCK)).withColumn("mains", F.ceil(F.col("in_main") / BLOCK))
    apart = apart.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("other"), F.col("others")).otherwise(F.col("mains"))))
    # The others' block i meets the others' blocks i and up, and every block of the main component.
    up = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j"), (j < F.col("block")).cast("int").alias("side")))
    main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: F.struct(F.col("block").alias("i"), (-1 - j).alias("j"), F.lit(0).alias("side")))
    meets = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: F.struct(i.alias("i"), (-1 - F.col("block")).alias("j"), F.lit(1).alias("side")))
    dealt = apart.withColumn("meet", F.explode(F.when(F.col("other"), F.concat(up, main)).otherwise(meets)))
    dealt = kept(dealt.select("a", "node", "root", "size", "inner", "meet.*"))
    parts = max(1, -(-dealt.count() // PART))
    signs = signed.join(those, "node", "left_semi").groupBy("node").agg(F.first("sign").alias("sign"))
    dealt = dealt.join(signs.join(some, "node"), "node").withColumn("part", F.pmod(F.xxhash64("a", "i", "j"), F.lit(parts)))
    return found.unionByName(dealt.groupBy("part").applyInPandas(_cross, "a binary, b binary"))


def _roots(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (id, node), written, and (node, root, least) of each node: its component's root, and its least id and text (nulls last)."""
    roots = components(links(docs, text_col))
    rows = kept(docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("node")))
    nodes = rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("least"))
    return rows, kept(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, class_id) of each row; class_id is the least id in the class."""
    rows, nodes = _roots(docs, id_col, text_col)
    least = nodes.groupBy("root").agg(F.min("least").alias("first")).select("root", F.col("first.id").alias("class"))
    named = kept(hot_join(nodes.select("node", "root"), least, "root").select("node", "class"))
    return hot_join(rows, named, "node").select(F.col("id").alias(id_col), F.col("class").alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each class: that of the least id (nulls last).

    Of rows alike in id and text the one whose columns hash lowest stays.
    """
    _, nodes = _roots(docs, id_col, text_col)
    first = nodes.groupBy("root").agg(F.min("least").alias("first")).select(F.col("first.id").alias("id"), F.col("first.node").alias("node"))
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(*plain).alias("print"), F.col(id_col).alias("own_id"), text_key(F.col(text_col)).alias("own"))
    both = own.join(first, (F.col("own") == F.col("node")) & F.col("own_id").eqNullSafe(F.col("id")))
    order = Window.partitionBy("node").orderBy("print")
    return both.withColumn("k", F.row_number().over(order)).where("k = 1").select("row.*")
