"""Co-occurrence within lines: marginals, pairs, conditional probabilities, PMI, and stripes.

A line counts each of its distinct tokens once. Tokens rarer than min_count can't be in a pair that isn't, so they
are dropped before lines are paired; the rest are paired by number, smaller with larger, and counted once for both
directions. Counts of partial results are combined before the shuffle, which takes about a byte and a half for each
pair that is not of two frequent terms; so pairs are shuffled in rounds, each of which is summed and leaves only the
pairs that reach min_count before the next begins. There is no reserved token.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import distinct_tokens
from corvane.plans.lineage import kept, released, spent

MIN_COUNT = 10
#: Terms of a line that one task pairs with one another, partners in one map of a stripe, about, and pairs that are
#: counted together.
LONG, PARTNERS, HELD = 4096, 1 << 16, 1 << 22
#: Terms whose pairs have a cell each in every task that makes pairs, terms that every task knows, tokens that are
#: looked up together, and rows of a batch.
FREQUENT, WORDS, TOKENS, ROWS = 8192, 1 << 22, 1 << 21, 1 << 17
#: Pairs of a round for each number that the lines hold, about, and what part of these numbers the rarest terms have
#: whose pairs are counted first where the best pair is wanted: one in RARE.
SHARE, RARE = 4, 8


def line_tokens(lines: DataFrame, line: str = "line", key: tuple[str, ...] = ("doc_id", "line_no")) -> DataFrame:
    """(key, term): each line's distinct tokens."""
    return lines.select(*key, F.explode(distinct_tokens(F.col(line))).alias("term"))


def marginals(lines: DataFrame, min_count: int = 1, line: str = "line") -> DataFrame:
    """(term, cnt): in how many lines each term is."""
    rows = lines.select(F.explode(distinct_tokens(F.col(line))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= min_count)


def _joined(rows: DataFrame) -> DataFrame:
    """(term, cnt, n): the terms, numbered from 0 without gaps, frequent ones first: by their place in a partition and the sizes of those before it."""
    place = F.monotonically_increasing_id()
    rows = spent(rows.orderBy(F.col("cnt").desc(), "term").withColumns({"part": F.shiftright(place, 33), "place": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))  # a row for each partition
    firsts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    return spent(rows.join(F.broadcast(firsts), "part").select("term", "cnt", (F.col("first") + F.col("place")).alias("n")))


def _looked_up(words: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(ns): the sorted numbers of each line's terms, of lines with two or more."""

    def numbers(lists: list[pa.Array]) -> pa.RecordBatch:
        flat = pa.chunked_array([x.flatten() for x in lists])
        sizes = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in lists])
        terms = words.value.column("term").combine_chunks().cast(flat.type)
        n = pc.fill_null(pc.index_in(flat, value_set=terms), -1).to_numpy().astype(np.int64)
        own = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        key = np.sort(((own << 32) | n)[n >= 0])
        found = np.bincount(key >> 32, minlength=len(sizes))
        key, found = key[found[key >> 32] > 1], found[found > 1]
        offsets = np.append(0, np.cumsum(found)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array((key & 0xFFFFFFFF).astype(np.int32)))], names=["ns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0))
            size += len(held[-1].flatten())
            if size >= TOKENS:
                yield numbers(held)
                held, size = [], 0
        if held:
            yield numbers(held)

    return run


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of each: all lowest ones first. What is small costs little more than its lowest byte."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, n * width, asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


class _Packets:
    """Rows of PACKETS, sent off by some thousand."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, part: int, dense: int, keys: np.ndarray | None, cnts: np.ndarray) -> None:
        self.rows.append((part, dense, len(cnts), None if keys is None else _packed(np.diff(keys, prepend=0)), _packed(cnts)))

    def sent(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            columns = list(zip(*self.rows, strict=True))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "dense", "n", "keys", "cnts"])
            self.rows.clear()


#: What pairs are shuffled as: part is the task that sums them; dense: the number whose counts with every smaller one
#: follow, or -1 where sorted pairs, as gaps, have counts of their own.
PACKETS = "part int, dense long, n long, keys binary, cnts binary"


def _paired(tasks: int, rounds: int, nth: int, width: int, frequent: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """PACKETS of how often each pair of the nth round stands in rows (left, right, same), `most` pairs being held at a time.

    A row pairs every number of right with every one of left, or with those before it if both are the same; the right
    one is larger; where no row of a batch has numbers in right, it is the left. Right is empty there, not null: Spark
    writes nulls in a column of arrays in a time that grows with the square of a batch's rows. Pairs of numbers below
    `frequent` are of the first round, and counted in a triangle of one cell each until the rows end. Of other pairs,
    the larger number a is dealt to task t = a % tasks, whose numbers are width * t + a // tasks, and which is the
    (t // rounds)-th one of round t % rounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size = _Packets(), [], 0
        cells: np.ndarray | None = None

        def counted() -> None:
            key, cnt = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            cuts = np.searchsorted(key, (np.arange(tasks + 1) * width) << 32)
            for t in np.flatnonzero(np.diff(cuts)).tolist():
                at = slice(cuts[t], cuts[t + 1])
                out.add(t // rounds, -1, key[at], cnt[at].astype(np.int32))

        def made(high: np.ndarray, first: np.ndarray, n: np.ndarray, one: np.ndarray) -> Iterator[np.ndarray]:
            """high plus each of the n numbers of `one` from first on."""
            ends, at = np.cumsum(n), 0
            while at < len(n):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most // 4, side="right")))
                some = n[at:stop]
                key = np.arange(int(some.sum()))
                key += np.repeat(first[at:stop] - np.cumsum(some) + some, some)
                key = one[key]
                key += np.repeat(high[at:stop], some)
                at = stop
                yield key

        for batch in batches:
            left, right = (batch.column(k) for k in (0, 1))
            if not len(right.flatten()):
                right = left
            one, two = (x.flatten().to_numpy().astype(np.int64) for x in (left, right))
            starts, m = left.offsets.to_numpy()[:-1] - left.offsets[0].as_py(), pc.list_value_length(left).to_numpy()
            own = np.repeat(np.arange(batch.num_rows), pc.list_value_length(right).to_numpy())
            place = np.arange(len(two)) - (right.offsets.to_numpy()[:-1] - right.offsets[0].as_py())[own]
            n = np.where(batch.column(2).to_numpy(zero_copy_only=False)[own], place, m[own]).astype(np.int64)
            few = two < frequent
            at = np.flatnonzero(few & (n > 0)) if nth == 0 else ()
            if len(at):
                if cells is None:
                    cells = np.zeros(frequent * (frequent - 1) // 2, dtype=np.int32)
                for cell in made(two[at] * (two[at] - 1) // 2, starts[own[at]], n[at], one):
                    np.add.at(cells, cell, np.int32(1))
            at = np.flatnonzero(~few & (n > 0) & (two % tasks % rounds == nth))
            for key in made((two[at] % tasks * width + two[at] // tasks) << 32, starts[own[at]], n[at], one):
                held.append(key)
                size += len(key)
                if size >= most:
                    counted()
                    size = 0
                    yield from out.sent()
        if size:
            counted()
        yield from out.sent()
        if cells is not None:
            for a in range(1, frequent):
                row = cells[a * (a - 1) // 2 : a * (a + 1) // 2]
                if row.any():
                    out.add(a % tasks // rounds, a, None, row)
                yield from out.sent(1024)
            yield from out.sent()

    return run


Triples = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _read(batches: Iterator[pa.RecordBatch], most: int, dense: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs and their summed counts from PACKETS, merged whenever more than `most` are held; dense rows are summed in `dense`."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key, cnt = (np.concatenate([h[k] for h in held]) if held else np.empty(0, dtype=np.int64) for k in (0, 1))
        held.clear()
        order = np.argsort(key)
        key, cnt = key[order], cnt[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, dtype=np.int64)
        return key[starts], np.add.reduceat(cnt, starts, dtype=np.int64) if len(key) else cnt

    for batch in batches:
        for a, n, keys, cnts in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
            cnt = _unpacked(cnts, n, np.int32)
            if a >= 0:
                dense[a] = dense[a] + cnt if a in dense else cnt.astype(np.int64)
                continue
            held.append((np.cumsum(_unpacked(keys, n, np.int64)), cnt))
            size += n
            if size > most:
                held.append(merged())
                size = len(held[0][0])
                most = max(most, 2 * size)
    return merged()


def _summed(min_count: int, tasks: int, width: int, most: int, finish: Callable[[Triples], Iterator[pa.RecordBatch]]):
    def triples(batches: Iterator[pa.RecordBatch]) -> Triples:
        dense: dict[int, np.ndarray] = {}
        key, cnt = _read(batches, most, dense)
        key, cnt = key[cnt >= min_count], cnt[cnt >= min_count]
        for at in range(0, len(key), ROWS):
            a = key[at : at + ROWS] >> 32
            yield a % width * tasks + a // width, key[at : at + ROWS] & 0xFFFFFFFF, cnt[at : at + ROWS]
        for a, row in dense.items():
            b = np.flatnonzero(row >= min_count)
            if len(b):
                yield np.full(len(b), a), b, row[b]

    return lambda batches: finish(triples(batches))


def _closed(found: Triples) -> Iterator[pa.RecordBatch]:
    """PACKETS of summed pairs, whose part says nothing."""
    out = _Packets()
    for a, b, cnt in found:
        out.add(0, -1, (a << 32) | b, cnt.astype(np.int32))
        yield from out.sent(64)
    yield from out.sent()


def _opened(finish: Callable[[Triples], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """finish() of what _closed() was given."""

    def triples(batches: Iterator[pa.RecordBatch]) -> Triples:
        for batch in batches:
            for n, keys, cnts in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                key = np.cumsum(_unpacked(keys, n, np.int64))
                yield key >> 32, key & 0xFFFFFFFF, _unpacked(cnts, n, np.int32).astype(np.int64)

    return lambda batches: finish(triples(batches))


def _plain(found: Triples) -> Iterator[pa.RecordBatch]:
    for three in found:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in three], names=["a", "b", "cnt"])


def _named(words: Broadcast) -> Callable[[Triples], Iterator[pa.RecordBatch]]:
    """(left, right, cnt, left_cnt, right_cnt) of both directions."""

    def run(found: Triples) -> Iterator[pa.RecordBatch]:
        term, count = (words.value.column(k).combine_chunks() for k in ("term", "cnt"))
        for a, b, cnt in found:
            x, y = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
            yield pa.RecordBatch.from_arrays([term.take(x), term.take(y), pa.array(np.concatenate([cnt, cnt])), count.take(x), count.take(y)], names=["left", "right", "cnt", "left_cnt", "right_cnt"])

    return run


@dataclass
class _Terms:
    """Terms that reach min_count, numbered from the most frequent on: as a table that every task has, or, where they
    are more than WORDS, as rows (term, cnt, n)."""

    size: int
    words: Broadcast | None
    rows: DataFrame | None


def _numbered(lines: DataFrame, min_count: int, line: str) -> _Terms:
    return _terms(spent(marginals(lines, min_count, line)))


def _terms(rows: DataFrame) -> _Terms:
    """The terms of (term, cnt), which were written."""
    size = rows.count()
    if size > WORDS:
        return _Terms(size, None, _joined(rows))
    table = rows.toArrow().sort_by([("cnt", "descending"), ("term", "ascending")]).combine_chunks()
    return _Terms(size, rows.sparkSession.sparkContext.broadcast(table), None)


def _sets(lines: DataFrame, terms: _Terms, line: str, key: tuple[str, ...]) -> DataFrame:
    """(ns): the sorted numbers of each line's terms, of lines with two or more."""
    if terms.words:
        return kept(lines.select(distinct_tokens(F.col(line)).alias("t")).mapInArrow(_looked_up(terms.words), "ns array<int>"))
    rows = line_tokens(lines, line, key).join(terms.rows.select("term", F.col("n").cast("int")), "term")
    return spent(rows.groupBy(*key).agg(F.sort_array(F.collect_list("n")).alias("ns")).where(F.size("ns") > 1).select("ns"))


def _summing(lines: DataFrame, terms: _Terms, line: str, key: tuple[str, ...]) -> tuple[DataFrame, list[DataFrame], tuple[int, int]]:
    """PACKETS of the first round's pairs of lines by the task that sums them, those of later rounds, and for all rounds
    the number of tasks and how many numbers each has.

    Pairs are made and counted in Arrow batches. Those of FREQUENT terms, most of a line's, are counted where they are
    made, by as many tasks as run at once, and leave a cell each; the others leave gaps between sorted pairs, to be
    summed by as many tasks as 2 * HELD pairs each need. These are dealt over rounds, each of SHARE pairs for each number
    that the lines hold, about, so that a round's shuffle grows as the lines do, not as their pairs. A line of more than
    LONG terms is paired block by block, by as many tasks.
    """
    sets = _sets(lines, terms, line, key)
    size, few = F.size("ns").cast("long"), F.size(F.filter("ns", lambda n: n < FREQUENT)).cast("long")
    rest, numbers, longest = sets.agg(F.sum((size * (size - 1) - few * (few - 1)) / 2), F.sum(size), F.max(size)).first()
    parallel = lines.sparkSession.sparkContext.defaultParallelism
    each = max(parallel * HELD, SHARE * (numbers or 0))
    rounds = -(-int(rest or 0) // each) or 1
    tasks = rounds * max(parallel, -(-int(rest or 0) // (2 * HELD * rounds)))
    dealt = sets.where(F.size("ns") <= LONG).select(F.col("ns").alias("left"), F.expr("cast(array() as array<int>)").alias("right"), F.lit(True).alias("same")).coalesce(parallel)
    if (longest or 0) > LONG:
        blocks = F.expr(f"sequence(0, (size(ns) - 1) div {LONG})")
        long = sets.where(F.size("ns") > LONG).select("ns", F.explode(F.flatten(F.transform(blocks, lambda i: F.transform(F.filter(blocks, lambda j: j >= i), lambda j: F.struct(i.alias("i"), j.alias("j")))))).alias("at"))
        cut = [F.slice("ns", F.col(f"at.{k}") * LONG + 1, LONG) for k in ("i", "j")]
        long = long.select(cut[0].alias("left"), cut[1].alias("right"), (F.col("at.i") == F.col("at.j")).alias("same"))
        dealt = dealt.unionByName(long.repartition(parallel, F.xxhash64("left", "right")))
    width = -(-terms.size // tasks) or 1
    frequent = min(FREQUENT, terms.size)
    made = [dealt.mapInArrow(_paired(tasks, rounds, nth, width, frequent, HELD), PACKETS).repartitionById(tasks // rounds, F.col("part")) for nth in range(rounds)]
    return made[0], made[1:], (tasks, width)


def _counted(lines: DataFrame, terms: _Terms, min_count: int, line: str, key: tuple[str, ...]) -> tuple[DataFrame, int]:
    """PACKETS, as _closed() makes them, of the pairs in min_count lines or more, and among how many tasks they stand.

    Each round is summed and written, and what it shuffled deleted, before the next one begins.
    """
    first, later, (tasks, width) = _summing(lines, terms, line, key)
    done = [spent(packets.mapInArrow(_summed(min_count, tasks, width, 4 * HELD, _closed), PACKETS)) for packets in [first, *later]]
    del first, later  # the lines' numbers, which they read, may go too
    released(lines.sparkSession)
    return reduce(DataFrame.unionByName, done), tasks


def pairs(lines: DataFrame, min_count: int = MIN_COUNT, line: str = "line", key: tuple[str, ...] = ("doc_id", "line_no")) -> DataFrame:
    """(left, right, cnt, left_cnt, right_cnt) of both directions of every pair in min_count lines or more."""
    return _pairs_of(lines, _numbered(lines, min_count, line), min_count, line, key)


def _pairs_of(lines: DataFrame, terms: _Terms, min_count: int, line: str, key: tuple[str, ...]) -> DataFrame:
    """pairs() of these terms."""
    counted, _ = _counted(lines, terms, min_count, line, key)
    if terms.words:
        return counted.mapInArrow(_opened(_named(terms.words)), "left string, right string, cnt long, left_cnt long, right_cnt long")
    half = counted.mapInArrow(_opened(_plain), "a long, b long, cnt long")
    both = half.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p"), "cnt").select("p.x", "p.y", "cnt")
    left = terms.rows.select(F.col("n").alias("x"), F.col("term").alias("left"), F.col("cnt").alias("left_cnt"))
    right = terms.rows.select(F.col("n").alias("y"), F.col("term").alias("right"), F.col("cnt").alias("right_cnt"))
    return both.join(left, "x").join(right, "y").select("left", "right", "cnt", "left_cnt", "right_cnt")


def conditional(lines: DataFrame, min_count: int = MIN_COUNT, **how) -> DataFrame:
    """(left, right, p): the part of left's lines that right is in too."""
    return pairs(lines, min_count, **how).select("left", "right", (F.col("cnt") / F.col("left_cnt")).alias("p"))


def scored(counted: DataFrame, total: DataFrame | None) -> DataFrame:
    """(left, right, pmi) of pairs; total: one row (n) with the number of lines, None to leave that factor out."""
    ratio = F.col("cnt") / (F.col("left_cnt") * F.col("right_cnt"))
    if total is None:
        return counted.select("left", "right", F.log(ratio).alias("pmi"))
    return counted.crossJoin(F.broadcast(total)).select("left", "right", F.log(ratio * F.col("n")).alias("pmi"))


def pmi(lines: DataFrame, min_count: int = MIN_COUNT, normalise: bool = True, **how) -> DataFrame:
    """(left, right, pmi): ln(n * c(a,b) / (c(a) * c(b))); without the factor n if normalise is False."""
    return scored(pairs(lines, min_count, **how), lines.agg(F.count("*").alias("n")) if normalise else None)


def stripes(lines: DataFrame, min_count: int = MIN_COUNT, **how) -> DataFrame:
    """(term, cnt, part, stripe): each term's marginal and maps of its partners' counts.

    Pairs are counted first, for that is what combines before the shuffle; the partners of a term are dealt over as
    many maps (parts) as the vocabulary needs at PARTNERS each.
    """
    return _striped(lines, min_count, False, **how)


def _ways(tasks: int, parts: int, most: int) -> Callable[[Triples], Iterator[pa.RecordBatch]]:
    """PACKETS of both directions of counted pairs, by the task that has the first term's map of the second one."""

    def run(found: Triples) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def sent() -> Iterator[pa.RecordBatch]:
            a, b, cnt = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            x, y, out = np.concatenate([a, b]), np.concatenate([b, a]), _Packets()
            key, cnt, task = (x << 32) | y, np.concatenate([cnt, cnt]), (x * 31 + y % parts) % tasks
            order = np.lexsort((key, task))
            key, cnt = key[order], cnt[order]
            cuts = np.searchsorted(task[order], np.arange(tasks + 1))
            for t in np.flatnonzero(np.diff(cuts)).tolist():
                out.add(t, -1, key[cuts[t] : cuts[t + 1]], cnt[cuts[t] : cuts[t + 1]].astype(np.int32))
            yield from out.sent()

        size = 0
        for three in found:
            held.append(three)
            size += len(three[0])
            if size >= most // 2:
                yield from sent()
                size = 0
        if held:
            yield from sent()

    return run


def _maps(words: Broadcast, parts: int, most: int, marginal: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, cnt, part, stripe) of PACKETS; a stripe's values are counts, or counts and the partner's marginal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, count = (words.value.column(k).combine_chunks() for k in ("term", "cnt"))
        key, cnt = _read(batches, most, {})
        x, y = key >> 32, key & 0xFFFFFFFF
        order = np.lexsort((y % parts, x))
        x, y, cnt = x[order], y[order], cnt[order]
        part = (y % parts).astype(np.int32)
        starts = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (part[1:] != part[:-1]))) if len(x) else np.empty(0, dtype=np.int64)
        ends = np.append(starts[1:], len(x))
        at = 0
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + ROWS, side="right")))
            some, offsets = slice(starts[at], ends[stop - 1]), np.append(starts[at:stop], ends[stop - 1]) - starts[at]
            right, value = pa.array(y[some]), pa.array(cnt[some])
            if marginal:
                value = pa.StructArray.from_arrays([value, count.take(right)], names=["cnt", "right_cnt"])
            stripe = pa.MapArray.from_arrays(pa.array(offsets.astype(np.int32)), term.take(right), value)
            own = pa.array(x[starts[at:stop]])
            yield pa.RecordBatch.from_arrays([term.take(own), count.take(own), pa.array(part[starts[at:stop]]), stripe], names=["term", "cnt", "part", "stripe"])
            at = stop

    return run


def _striped(lines: DataFrame, min_count: int, marginal: bool, line: str = "line", key: tuple[str, ...] = ("doc_id", "line_no")) -> DataFrame:
    """stripes(); marginal: whose values are (cnt, right_cnt)."""
    terms = _numbered(lines, min_count, line)
    parts = -(-terms.size // PARTNERS) or 1
    if not terms.words:
        value = F.struct("cnt", "right_cnt") if marginal else F.col("cnt")
        counted = pairs(lines, min_count, line, key)
        each = counted.groupBy("left", "left_cnt", F.pmod(F.xxhash64("right"), F.lit(parts)).cast("int").alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("right", value.alias("value")))).alias("stripe"))
        return each.select(F.col("left").alias("term"), F.col("left_cnt").alias("cnt"), "part", "stripe")
    counted, tasks = _counted(lines, terms, min_count, line, key)
    ways = counted.mapInArrow(_opened(_ways(tasks, parts, HELD)), PACKETS).repartitionById(tasks, F.col("part"))
    value = "struct<cnt:bigint,right_cnt:bigint>" if marginal else "bigint"
    return ways.mapInArrow(_maps(terms.words, parts, 4 * HELD, marginal), f"term string, cnt long, part int, stripe map<string,{value}>")


def stripe_pairs(striped: DataFrame) -> DataFrame:
    """(left, right, cnt) of stripes."""
    return striped.select(F.col("term").alias("left"), F.explode("stripe").alias("right", "cnt"))


def pmi_stripes(lines: DataFrame, min_count: int = MIN_COUNT, normalise: bool = True, **how) -> DataFrame:
    """The rows of pmi(), by way of stripes that hold each partner's marginal beside the count."""
    striped = _striped(lines, min_count, True, **how)
    each = striped.select(F.col("term").alias("left"), F.col("cnt").alias("left_cnt"), F.explode("stripe").alias("right", "value"))
    counted = each.select("left", "right", "value.cnt", "left_cnt", "value.right_cnt")
    return scored(counted, lines.agg(F.count("*").alias("n")) if normalise else None)


def pmi_max(scores: DataFrame) -> DataFrame:
    """The pair of the highest PMI; ties go to the first in order."""
    return scores.orderBy(F.col("pmi").desc(), "left", "right").limit(1)


def pmi_best(lines: DataFrame, min_count: int = MIN_COUNT, normalise: bool = True, places: int = 6, line: str = "line", key: tuple[str, ...] = ("doc_id", "line_no")) -> DataFrame:
    """pmi_max() of pmi() rounded to so many places, without counting the pairs that can't be the best.

    A pair is in no more lines than its rarer term, so c(a,b) / (c(a) * c(b)) is at most 1 / c of its more frequent one.
    Pairs of the rarest terms are counted first. The best of them says how frequent a term of a pair as good can be; if
    that is beyond the terms counted, the pairs of all terms up to there are counted, and of all terms if none was found.
    """
    rows = spent(marginals(lines, min_count, line))
    sizes = sorted(rows.groupBy("cnt").agg(F.count("*").alias("terms")).collect())
    counts = np.array([r.cnt for r in sizes], dtype=np.int64)
    numbers = np.cumsum([r.cnt * r.terms for r in sizes])
    first = max(1, int(np.searchsorted(numbers, numbers[-1] // RARE, side="right"))) if len(sizes) else 0
    found = _pairs_of(lines, _terms(rows.where(F.col("cnt") <= int(counts[:first].max(initial=0)))), min_count, line, key)
    if first < len(counts):
        best = found.agg(F.max(F.col("cnt") / (F.col("left_cnt") * F.col("right_cnt")))).first()[0]
        most = math.exp(2 * 10.0**-places) / best if best else math.inf  # what rounds to the same is as good
        if counts[first] <= most:
            found = _pairs_of(lines, _terms(rows.where(F.col("cnt") <= int(counts[counts <= most].max()))), min_count, line, key)
    scores = scored(found, lines.agg(F.count("*").alias("n")) if normalise else None)
    return pmi_max(scores.withColumn("pmi", F.round("pmi", places)))


def pmi_of(lines: DataFrame, word: str, min_count: int = MIN_COUNT, normalise: bool = True, line: str = "line") -> DataFrame:
    """The rows of pmi() whose left is the word. A term's lines, and those that the word is in too, are counted together; no other pairs are."""
    sets = lines.select(distinct_tokens(F.col(line)).alias("t"))
    beside = F.array_contains("t", F.lit(word))
    terms = sets.select(F.explode("t").alias("right"), beside.alias("beside")).groupBy("right").agg(F.count("*").alias("right_cnt"), F.count_if("beside").alias("cnt"))
    whole = sets.agg(F.count("*").alias("n"), F.count_if(beside).alias("left_cnt"))
    counted = terms.where((F.col("cnt") >= min_count) & (F.col("right") != word)).crossJoin(F.broadcast(whole)).withColumn("left", F.lit(word))
    ratio = F.col("cnt") / (F.col("left_cnt") * F.col("right_cnt"))
    return counted.select("left", "right", F.log(ratio * F.col("n") if normalise else ratio).alias("pmi"))


def pmi_topk(scores: DataFrame, word: str, k: int) -> DataFrame:
    """(right, pmi): the k best partners of a word."""
    return scores.where(F.col("left") == word).orderBy(F.col("pmi").desc(), "right").limit(k).select("right", "pmi")
