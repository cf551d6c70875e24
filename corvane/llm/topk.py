"""Exact top-k by inner product: M-trees, searched best first.

Vectors of whole numbers are split into blocks of about BLOCK rows by a hash. Each block's vectors get one more
coordinate that gives them all the norm of the block's longest, so that the largest inner product is the smallest
Euclidean distance. A block's M-tree is stored as pages: rows of at most PAGE entries, each with its vector, distance
to the parent's pivot and, above the leaves, its covering radius and child page. The queries, in groups of about
QUERIES, meet every block; one task searches one block for one group. The first block is searched first: its k-th best
score goes with each query to the other blocks as a bound. A search keeps a queue of pages by the least distance that
they can hold. Before computing an entry's distance, the stored distances to its parent bound it by
the triangle inequality; entries, and pages, that can't reach the k-th best score are passed over. Scores that decide
are exact integers; bounds have slack for rounding, and equal scores are searched out, so ties go to the smaller id.

Vectors that are null, of no length, or hold null or non-finite components, take no part, nor do rows with null ids;
vectors of another length than a query's don't meet it. Ids are whole numbers. Every row is a candidate, so a repeated
row can stand in a result as often as it is there; rows with the query's id are the query's own. A query row that is
repeated is asked once; queries of one id and different vectors have a result each, told apart by query_print, a hash
of the vector. Fewer than k candidates give fewer rows; an empty table gives none. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import hashed, kept

BLOCK, PAGE, QUERIES = 8192, 384, 1024
#: Relative slack of distance bounds against rounding.
SLACK = 1e-9
#: No score.
NONE = -(1 << 63)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def distances(x: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - pivot) ** 2).sum(axis=1))


def build(x: np.ndarray, ids: np.ndarray, page: int = PAGE) -> list[dict]:
    """The pages of an M-tree over vectors x; page 0 is the root.

    Each has entries' vectors, radii, distances to the parent's pivot, and child pages (inner) or ids (leaf).
    """
    pages: list[dict] = [{}]

    def fill(number: int, rows: np.ndarray, pivot: np.ndarray | None) -> None:
        here = np.zeros(len(rows)) if pivot is None else distances(x[rows], pivot)
        if len(rows) <= page:
            pages[number] = {"leaf": True, "vector": x[rows], "parent": here, "radius": np.zeros(len(rows)), "to": ids[rows]}
            return
        # Pivots far from one another, the first far from the first row; every row goes to the nearest.
        n = min(page // 2, -(-len(rows) // page) + 1)
        chosen = [int(distances(x[rows], x[rows[0]]).argmax())]
        near = distances(x[rows], x[rows[chosen[0]]])
        owner = np.zeros(len(rows), dtype=np.int64)
        while len(chosen) < n and near.max() > 0:
            chosen.append(int(near.argmax()))
            d = distances(x[rows], x[rows[chosen[-1]]])
            closer = d < near
            owner[closer], near = len(chosen) - 1, np.minimum(near, d)
        groups = [np.flatnonzero(owner == k) for k in range(len(chosen))]
        if len(chosen) == 1 or max(map(len, groups)) == len(rows):  # all alike: cut evenly
            groups = np.array_split(np.arange(len(rows)), n)
            chosen = [int(g[0]) for g in groups]
            near = np.concatenate([distances(x[rows[g]], x[rows[c]]) for g, c in zip(groups, chosen, strict=True)])
        parts = [(c, g) for c, g in zip(chosen, groups, strict=True) if len(g)]
        first = len(pages)
        pages.extend({} for _ in parts)
        pivots = np.array([rows[c] for c, _ in parts])
        pages[number] = {"leaf": False, "vector": x[pivots], "parent": here[[c for c, _ in parts]], "radius": np.array([near[g].max() for _, g in parts]), "to": np.arange(first, first + len(parts))}
        for k, (c, g) in enumerate(parts):
            fill(first + k, rows[g], x[rows[c]])

    fill(0, np.arange(len(x)), None)
    return pages


def search(pages: dict[int, dict], norm: float, query: np.ndarray, own: int, k: int, floor: int = NONE) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id) of those that score `floor` or more, best first, and how many distances were computed.

    norm: the common squared norm of the stored vectors (their last coordinate makes it so).
    """
    q = np.append(query.astype(np.float64), 0.0)
    square = float(q @ q)
    # Sums of whole numbers below 2^52 are exact in float64, in any order.
    exact = square * norm < 2.0**104
    whole = q[:-1] if exact else query.astype(np.int64)
    best: list[tuple[int, int]] = []  # a heap of (score, -id)
    queue = [(0.0, 0, 0, 0.0)]
    computed = 0

    def reach() -> float:
        """The distance beyond which nothing can be among the best."""
        least = max(floor, best[0][0]) if len(best) == k else floor
        if least == NONE:
            return np.inf
        return np.sqrt(max(square + norm - 2.0 * least, 0.0)) * (1 + SLACK) + SLACK * (norm + square + 1) ** 0.5

    count = 1
    while queue:
        low, _, number, to_pivot = heapq.heappop(queue)
        limit = reach()
        if low > limit:
            break
        p = pages[number]
        if number:
            on = np.flatnonzero(np.abs(to_pivot - p["parent"]) - p["radius"] <= limit)
        else:
            on = np.arange(len(p["to"]))
        if not len(on):
            continue
        computed += len(on)
        if p["leaf"]:
            rows, ids = p["vector" if exact else "whole"], p["to"]
            rows = rows[:, :-1] if exact else rows
            if len(on) < len(ids):
                rows, ids = rows[on], ids[on]
            scores = (rows @ whole).astype(np.int64)
            if floor != NONE:
                some = np.flatnonzero(scores >= floor)
                scores, ids = scores[some], ids[some]
            if len(best) < k < len(scores):
                # Only the k + 1 highest here (one may be the query's own row), and what equals the last, can be among the best.
                some = np.flatnonzero(scores >= np.partition(scores, -k - 1)[-k - 1])
                scores, ids = scores[some], ids[some]
            elif len(best) == k:
                some = np.flatnonzero(scores >= best[0][0])
                scores, ids = scores[some], ids[some]
            for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        else:
            d = distances(p["vector"][on], q)
            for bound, to, dist in zip(np.maximum(d - p["radius"][on], 0.0).tolist(), p["to"][on].tolist(), d.tolist(), strict=True):
                if bound <= limit:
                    heapq.heappush(queue, (bound, count, to, dist))
                    count += 1
    return [(s, -i) for s, i in sorted(best, reverse=True)], computed


PAGES = "block long, dims int, page int, leaf boolean, norm double, vector binary, parent binary, radius binary, entry binary"


def _pages(x: pd.DataFrame) -> pd.DataFrame:
    """One block's rows (id, v, block, dims) as the rows of its tree's pages."""
    x = x.sort_values("id")
    v = np.stack(x["v"].to_numpy()).astype(np.float64)
    squares = (v * v).sum(axis=1)
    norm = float(squares.max())
    lifted = np.hstack([v, np.sqrt(norm - squares)[:, None]])
    rows = []
    for number, p in enumerate(build(lifted, x["id"].to_numpy(dtype=np.int64))):
        rows.append((int(x["block"].iloc[0]), int(x["dims"].iloc[0]), number, p["leaf"], norm, p["vector"].tobytes(), p["parent"].tobytes(), p["radius"].tobytes(), p["to"].astype(np.int64).tobytes()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")])


def _searcher(k: int):
    def run(pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pages) and len(queries):
            dims, norm, tree = int(pages["dims"].iloc[0]), float(pages["norm"].iloc[0]), {}
            for r in pages.itertuples():
                v = np.frombuffer(r.vector).reshape(-1, dims + 1)
                tree[r.page] = {"leaf": r.leaf, "vector": v, "parent": np.frombuffer(r.parent), "radius": np.frombuffer(r.radius), "to": np.frombuffer(r.entry, dtype=np.int64), "whole": v[:, :-1].astype(np.int64) if r.leaf else None}
            for r in queries.itertuples():
                found, _ = search(tree, norm, np.asarray(r.v), r.id, k, r.floor)
                out += [(r.id, r.print, i, s) for s, i in found]
        return pd.DataFrame(out, columns=["query_id", "print", "vec_id", "score"]).astype("int64")

    return run


def top(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score, query_print): each query's k best of the candidates (id long, v array of long), but for its own id."""
    whole = [x.where("id is not null and v is not null").select("id", "v", F.size("v").alias("dims")) for x in (candidates, queries)]
    rows, asked = kept(whole[0].withColumn("place", F.monotonically_increasing_id())), kept(whole[1].distinct().withColumn("print", F.xxhash64("v")))
    blocks, groups = (max(1, -(-x.count() // n)) for x, n in ((rows, BLOCK), (asked, QUERIES)))
    dealt = rows.withColumn("block", hashed("place") % blocks)
    pages = kept(dealt.groupBy("block", "dims").applyInPandas(_pages, PAGES))
    asked = asked.withColumn("group", hashed("id") % groups)
    keys = ["block", "group", "dims"]

    def searched(some: DataFrame, floors: Column, first: int, last: int) -> DataFrame:
        """What queries find in blocks first to last: pages go once to each group, queries once to each block."""
        left = pages.where(F.col("block").between(first, last)).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        right = some.withColumn("floor", floors).withColumn("block", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_searcher(k), "query_id long, print long, vec_id long, score long")

    found = kept(searched(asked, F.lit(NONE), 0, 0))
    if blocks > 1:
        full = found.groupBy("query_id", "print").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
        bounded = asked.join(full.select(F.col("query_id").alias("id"), "print", "kth"), ["id", "print"], "left")
        found = found.unionByName(searched(bounded, F.coalesce("kth", F.lit(NONE)), 1, blocks - 1))
    order = Window.partitionBy("query_id", "print").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.col("print").alias("query_print"))
