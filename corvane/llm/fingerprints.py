"""Document fingerprints: threshold-scaled sketches, by DataFrame functions alone.

A text's shingles are its runs of five words (the whole text, if it has fewer). Each is hashed to BITS bits of MD5; the
sketch keeps every hash below a fixed part of that range, so that sketches of a document's parts merge into the
sketch of the whole, and the shared part of two sketches estimates containment however unequal the documents are. A
text with words, none of whose hashes lies below, keeps its smallest; a text of fewer than five words keeps the hash
of all its words, marked as no shingle.

merged() takes parts that overlap by four words: the union of their hashes below the fixed part is the sketch of the
whole. What parts kept for want of such hashes counts only where no part has one: then the smallest shingle stands.

A fingerprint writes the sorted hashes in hexadecimal. Equal texts have equal ones; null counts as the empty text,
whose fingerprint is empty. Likeness is the part of the first sketch found in the second: 1 for two empty ones, 0 for
an empty one and another.

edited() pairs every document with the next one by descending id, of whatever type sorts, nulls last, the first
following the last. Rows that share an id share their next one, of which the one with the smallest hash counts. One
document is its own next. Texts of any length are read whole. Repeated rows give repeated results; an empty table gives
none; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import BREAKS, kept, unused

SHINGLE, BITS, FRACTION = 5, 40, 1 / 4
#: What marks the hash of a text that has no shingle.
SHORT = 1 << BITS
#: Ids that one task orders.
RUN = 1 << 15


def named(words: Column) -> Column:
    """The first BITS bits of the MD5 of words joined by one space, in hexadecimal."""
    return F.left(F.md5(F.array_join(words, " ")), F.lit(BITS // 4))


def limit(fraction: float) -> int:
    return int(fraction * (1 << BITS))


def with_sketch(df: DataFrame, text: Column, out: str, fraction: float = FRACTION) -> DataFrame:
    """df with the sketch of a text, an array of long, in column out."""
    columns, words, digits, low = [F.col(f"`{c}`") for c in df.columns if c != out], *(unused(df, x) for x in ("_words", "_digits", "_low"))
    df = df.withColumn(words, F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), ""))
    n, w = F.size(words), F.col(words)
    runs = F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: named(F.slice(w, i, SHINGLE)))
    whole = F.when(n > 0, F.array(F.concat(F.lit("1"), named(w)))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(digits, F.when(n >= SHINGLE, runs).otherwise(whole)).drop(words)
    below = f"{limit(fraction):0{BITS // 4}x}"
    df = df.withColumn(low, F.filter(digits, lambda h: (h < below) & (F.length(h) == BITS // 4)) if limit(fraction) < SHORT else F.filter(digits, lambda h: F.length(h) == BITS // 4))
    few = F.when((F.size(low) == 0) & (F.size(digits) > 0), F.array(F.array_min(digits))).otherwise(F.array_distinct(low))
    return df.select(*columns, F.array_sort(F.transform(few, lambda h: F.conv(h, 16, 10).cast("long"))).alias(out))


def fingerprint(sketch: Column) -> Column:
    """The hashes in hexadecimal, BITS // 4 digits each; one more for the hash of a text without shingles."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), F.when(h >= SHORT, BITS // 4 + 1).otherwise(BITS // 4), F.lit("0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The part of sketch a that is in sketch b."""
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(df: DataFrame, groups: list[str], sketch: str = "sketch", fraction: float = FRACTION) -> DataFrame:
    """(groups, sketch): the sketches of each group as one."""
    name = unused(df, "_h")
    h = F.col(name)
    rows = df.select(*groups, F.explode_outer(sketch).alias(name)).distinct()
    low, rest = F.sort_array(F.collect_list(F.when(h < limit(fraction), h))), F.min(F.when(h >= limit(fraction), h))
    out = F.when(F.size(low) > 0, low).when(rest.isNotNull(), F.array(rest)).otherwise(F.array().cast("array<long>"))
    return rows.groupBy(*groups).agg(out.alias(sketch))


def before(ids: DataFrame) -> DataFrame:
    """(key, prev) of distinct keys (key: struct of an id, need): prev is the row that each follows, by descending id, nulls last."""
    runs = max(1, -(-ids.count() // RUN))
    falling = F.col("key.id").desc_nulls_last()
    dealt = kept(ids.repartitionByRange(runs, falling).withColumn("run", F.spark_partition_id()))
    row = F.struct("key", "need")
    inside = dealt.withColumn("prev", F.lag(row).over(Window.partitionBy("run").orderBy(falling)))
    # In order, a run ends with its null id, or else its least.
    ends = kept(dealt.groupBy("run").agg(F.min(F.struct(F.col("key.id").isNotNull().alias("known"), "key", "need")).alias("end")))
    order = Window.partitionBy(F.lit(0)).orderBy("run")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("run", F.coalesce(F.lag("end").over(order), F.last("end").over(whole)).alias("end"))
    both = inside.join(ends, "run")
    return both.select("key", F.coalesce("prev", F.struct("end.key", "end.need")).alias("prev"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last floor(n_chars / 3) characters replaced by the first as many of the next document.
    """
    # A struct of the id is never null, and equals another if both ids are null.
    own = docs.select(F.struct(F.col(id_col).alias("id")).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prevs = kept(before(kept(own.groupBy("key").agg(F.max(F.expr("length(text) div 3").cast("int")).alias("need")))))
    rows = with_sketch(own, F.col("text"), "sketch")

    # What each document gives to the one it follows: as many first characters as that one needs, and its sketch.
    gives = rows.join(prevs, "key")
    gives = gives.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("text")))).where("k = 1")
    gives = gives.select(F.col("prev.key").alias("key"), F.expr("left(text, prev.need)").alias("next_text"), F.col("sketch").alias("next_sketch"))

    both = rows.join(gives, "key").withColumn("n_chars", F.length("text"))
    cut = F.expr("n_chars div 3").cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - cut), F.substring("next_text", F.lit(1), cut)))
    both = with_sketch(both, F.col("edited"), "edited_sketch")
    return both.select(
        F.col("key.id").alias(id_col),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
