"""A mix of sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash, laid end to end and cut into blocks of BLOCK words (the last may be
shorter). Van der Corput points, mapped through the sources' cumulative weights, name the source of each slot; a
slot's rank among those of its source says which block it takes, going round the source again when its blocks run
out. The last slot of a source is cut so that the source gives its target, to the word. Slots that a source's
discrepancy leaves it short of come after the schedule.

Targets: all sources share the whole size by weight; none gets more than REPEATS times its own size, and what is
cut off there is shared again by weight among the others.

Null texts and empty ones have no words and are never taken. A null source is a source of its own, last in order; null
ids are ids like others. Texts of any length are laid whole; a text longer than a block fills several. Rows alike in
id, source and text are counted first, stand next to one another in the order, and are told apart by a copy number;
of places that hash alike the order is that of id, then of the text's hash. An empty table gives an empty mix. Only
the three named columns are read; mixed() returns all columns of docs, whatever their names. Of rows alike in those
three but not in others, which one is taken more often is settled by a hash of all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import BREAKS, block_bits, count_words, hashed, kept, running_total

#: Words of a block, the most times that a document is taken, and the weights that sources get in turn.
BLOCK, REPEATS, WEIGHTS = 1024, 3, (1, 2, 3)
#: Rows alike that one task spreads out together.
COPIES = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, index, target) from (source, source_size)."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("index", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("index") % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * repeats)
    # With sources in order of cap / weight, those that are cut off come first: level is what a unit of weight gets
    # if all before are cut off, and the first source that stays below its cap sets it for all that follow.
    rising = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "index").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(rising), F.lit(0))
    s = s.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(rising), F.lit(0))))
    s = s.withColumn("share", F.max(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))).over(every))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("share") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("source", "source_size", "index", target.alias("target"))


def van_der_corput(t: Column) -> Column:
    """The base-2 point of a number below 2^48: its binary digits, mirrored at the point."""
    return F.conv(F.reverse(F.lpad(F.bin(t), 48, "0")), 2, 10).cast("double") / float(1 << 48)


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, index, epoch, block, words): which block of which source each slot takes, and how many of its words.

    sources: (source, source_size, index, target).
    """
    s = sources.where("source_size > 0 and target >= 0.5").withColumn("goal", F.round("target").cast("long"))
    s = s.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    s = s.withColumn("slots", F.expr(f"goal div source_size * blocks + (goal % source_size + {block - 1}) div {block}"))
    upto = Window.partitionBy(F.lit(0)).orderBy("index")
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("low", (F.sum("slots").over(upto) - F.col("slots")) / F.sum("slots").over(every))
    s = kept(s.withColumn("high", F.coalesce(F.lead("low").over(upto), F.lit(2.0))))
    length, n = s.agg(F.sum("slots"), F.count("*")).first()
    grid = 1 << max(6, (4 * n).bit_length())
    spread = s.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * grid), F.least(F.floor(F.col("high") * grid), F.lit(grid - 1)))))
    points = s.sparkSession.range(length or 0).withColumn("point", van_der_corput(F.col("id")))
    points = points.withColumn("cell", F.floor(F.col("point") * grid))
    hit = points.join(spread, "cell").where("point >= low and point < high").select(F.col("id").alias("slot"), "index")
    ranked = running_total(hit.withColumn("run", F.expr("slot div 8192")), ["index"], "run", [F.col("slot")], F.lit(1), "rank").select("slot", "index", "rank")
    ranked = kept(ranked)
    got = ranked.groupBy("index").agg(F.count("*").alias("got"))
    short = s.join(got, "index", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    tail = short.select("index", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank"), "got")
    tail = tail.select((F.lit(length or 0) + (F.col("rank") - F.col("got")) * (n or 1) + F.col("index")).alias("slot"), "index", "rank")
    out = ranked.unionByName(tail).join(s, "index").where("rank < slots")
    out = out.withColumn("epoch", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    end = F.least((F.col("block") + 1) * block, "source_size", F.col("goal") - F.col("epoch") * F.col("source_size"))
    return out.select("slot", "index", "epoch", "block", (end - F.col("block") * block).alias("words"))


def laid(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], repeats: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, print, copy, size, index, start), start among the words of their source, and the sources with targets."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), count_words(text).alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("print"))
    rows = kept(rows.groupBy("id", "source", "size", "print").agg(F.count("*").alias("n")))
    sources = kept(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), weights, repeats))
    bits = block_bits(rows.count())
    rows = rows.join(sources, rows.source.eqNullSafe(sources.source)).select("id", "print", "n", "size", "index")
    rows = rows.withColumn("place", hashed("id", "print")).withColumn("run", F.shiftrightunsigned("place", 62 - bits))
    rows = running_total(rows, ["index"], "run", [F.col("place"), F.col("id"), F.col("print")], F.col("size") * F.col("n"), "start")
    # Rows alike lie one after another; in blocks first, so that no array holds more than a block of them.
    rows = rows.withColumn("many", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}")))).withColumn("upto", F.least((F.col("many") + 1) * COPIES, F.col("n")) - 1)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("many") * COPIES, F.col("upto"))))
    return kept(rows.select("id", "print", "copy", "size", "index", (F.col("start") + F.col("copy") * F.col("size")).alias("start"))), sources


def mix(rows: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: (slot, index, epoch, start, id, print, copy, size, from, to), words from..to of a document in each slot."""
    low, high = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    pieces = rows.where("size > 0").withColumn("block", F.explode(F.sequence(low, high)))
    both = pieces.join(schedule(sources, block), ["index", "block"])
    a = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    b = F.least(F.col("block") * block + F.col("words") - F.col("start"), F.col("size"))
    return both.withColumn("from", a).withColumn("to", b).where("`to` > `from`").select("slot", "index", "epoch", "start", "id", "print", "copy", "size", "from", "to")


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, size, source_size, target, taken) of each row: what the mix takes of it."""
    rows, sources = laid(docs, id_col, text_col, source_col, WEIGHTS, REPEATS)
    got = mix(rows, sources).groupBy("index", "start").agg(F.sum(F.col("to") - F.col("from")).alias("got"))
    full = rows.where("size > 0").join(got, ["index", "start"], "left").unionByName(rows.where("size = 0").withColumn("got", F.lit(0).cast("long")), allowMissingColumns=True)
    out = full.join(sources, "index")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def first_words(text: Column, k: Column) -> Column:
    """The text up to the end of its k-th word."""
    led = F.when(text.rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0)
    pieces = F.split(text, BREAKS, (k + 1 + led).cast("int"))
    head = F.substring(text, F.lit(1), F.length(text) - F.length(F.element_at(pieces, -1)))
    return F.when(F.size(pieces) <= k + led, text).otherwise(F.regexp_replace(head, "[\\x20\\x09-\\x0D]+$", ""))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The rows that the mix takes, with the columns of docs: one for each time that it takes a document.

    Where the target of a source falls inside a document, the text of that time ends there.
    """
    rows, sources = laid(docs, id_col, text_col, source_col, weights, repeats)
    times = mix(rows, sources).groupBy("index", "epoch", "id", "print", "copy", "size").agg(F.max("to").alias("upto"))
    times = times.join(sources.select("index", "source"), "index").withColumn("key", F.xxhash64("id", "print", "source"))
    print_ = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(*plain).alias("all"), F.xxhash64(F.col(id_col), print_, F.col(source_col)).alias("own_key"))
    own = own.withColumn("own_copy", (F.row_number().over(Window.partitionBy("own_key").orderBy("all")) - 1).cast("long"))
    value = {c: F.col("row").getField(c) for c in docs.columns}
    same = (F.col("own_key") == F.col("key")) & value[id_col].eqNullSafe(F.col("id")) & value[source_col].eqNullSafe(F.col("source"))
    both = own.join(times, same & (F.col("own_copy") == F.col("copy")))
    cut = F.when(F.col("upto") < F.col("size"), first_words(value[text_col], F.col("upto"))).otherwise(value[text_col])
    return both.select(*[(cut if c == text_col else value[c]).alias(c) for c in docs.columns])
