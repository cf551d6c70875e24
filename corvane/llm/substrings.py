"""Removal of repeated passages by compacted paths of a De Bruijn graph of words.

The graph's edges are the windows of WINDOW words, its nodes the runs of WINDOW - 1 words that two windows in a row
share. An edge is named by 192 bits: a hash of its words and the hashes of its two nodes. A window is repeated only if
its anchor, the least hash among its runs of ANCHOR words, stands in several windows; so anchors are joined first, and
only edges with a repeated anchor are joined on.

Every node has an anchor of its own, which names the bucket that all edges of the node meet in. There each edge gets
the earliest of its source coordinates (id, place), and each node its degrees in the graph of the edges that batches
share. A path goes on through a node only if one edge enters it and one leaves it, and if the coordinates go on in
step; such paths go back to their batches as one entry each. Along a document, paths whose coordinates meet are joined
into spans, and a span goes to its source's batch with a digest of its own words. There the source's words from that
coordinate on are read and compared: a span whose words differ is not removed. A word goes if a verified span covers
it whose source is earlier than the span itself.

Texts are dealt by a hash to batches of about BATCH_BYTES, which the plan shuffles once and reads five times. What
goes to a join is one entry for each distinct anchor or path of a batch, packed, so a passage in a third of all
documents costs each join one entry a batch. Whole texts are read, of any length; nothing is sampled.

Null texts have no words. Ids may be whole numbers or anything else that sorts (then ranks stand for them); null ids
come last in order. Rows that share an id are one place in order: of equal windows at one place of theirs none is the
earlier. Repeated rows give repeated results; an empty table gives none. Further columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WHOLE, ranked, words
from corvane.llm.shingles import hashed_words, mixed, runs

WINDOW, ANCHOR = 20, 8
NODE = WINDOW - 1
BATCH_BYTES = 1 << 20
#: Entries that one task joins, by estimate.
BUCKET_ENTRIES = 50_000
LAST = (1 << 63) - 1
#: Edges in a row on their way to the bucket of the nodes between them. alien: whether the first edge's own node has
#: another bucket. And a path on its way back, with its source and that source's batch.
PATH = np.dtype([("id", "<i8"), ("place", "<i4"), ("first", "<i4"), ("n", "<i4"), ("alien", "<i4")])
BACK = np.dtype([("first", "<i4"), ("n", "<i4"), ("batch", "<i8"), ("id", "<i8"), ("place", "<i4")])
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Windows:
    """The windows of a batch of texts, as flat arrays: text number, place and anchor of each."""

    def __init__(self, texts: list[str | None]):
        one, two, bounds = hashed_words(texts)
        self.counts = np.diff(bounds)
        own = np.repeat(np.arange(len(texts)), self.counts)
        n = max(len(one) - WINDOW + 1, 0)
        self.short, self.other = runs(one, ANCHOR), two
        at = np.flatnonzero(own[:n] == own[len(own) - n :]) if n else np.empty(0, dtype=np.int64)
        # The anchor of the node that begins at each word; a window's is the lesser of its two nodes'.
        self.node_anchor = self.short[: n + 1].copy() if n else np.empty(0, dtype=np.uint64)
        for k in range(1, NODE - ANCHOR + 1):
            np.minimum(self.node_anchor, self.short[k : k + n + 1], out=self.node_anchor)
        self.at, self.doc = at, own[at]
        self.anchor = np.minimum(self.node_anchor[at], self.node_anchor[at + 1]) if n else np.empty(0, dtype=np.uint64)
        self.place = at - bounds[self.doc]

    def edges(self, some: np.ndarray) -> np.ndarray:
        """The hashes of the windows numbered by `some`: three overlapping runs cover each."""
        at, gap = self.at[some], (WINDOW - ANCHOR) // 2
        return mixed(self.short[at] * _A + self.short[at + gap] * _B + self.short[at + 2 * gap] * _C)

    def nodes(self) -> np.ndarray:
        """The hash of the node that begins at each word, from the words' other lane."""
        run = runs(self.other, ANCHOR)
        n, gap = len(self.node_anchor), (NODE - ANCHOR + 1) // 2
        return mixed(run[:n] * _A + run[gap : gap + n] * _B + run[NODE - ANCHOR : NODE - ANCHOR + n] * _C)


class Edges:
    """A batch's distinct edges with a repeated anchor, each at its earliest place here, in an order that a rerun repeats."""

    def __init__(self, win: Windows, ids: np.ndarray, found: pd.DataFrame):
        some = np.flatnonzero(np.isin(win.anchor, _joined(found, "name", "u8")))
        nodes = win.nodes()
        w, own, place = win.edges(some), ids[win.doc[some]], win.place[some]
        a, b = nodes[win.at[some]], nodes[win.at[some] + 1]
        order = np.lexsort((place, own, a, w))
        new = _changes(w[order], a[order], b[order])
        group = np.cumsum(new) - 1
        first = order[new]  # the window that stands for each edge
        rank = np.lexsort((w[first], place[first], own[first]))
        number = np.empty(len(first), dtype=np.int64)
        number[rank] = np.arange(len(first))
        self.some, first = some, first[rank]
        self.of = np.empty(len(some), dtype=np.int64)  # each window's edge
        self.of[order] = number[group]
        self.w, self.a, self.b, self.id, self.place = w[first], a[first], b[first], own[first], place[first].astype(np.int64)
        at = win.at[some][first]
        self.before, self.after = win.node_anchor[at], win.node_anchor[at + 1]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; true for the first."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _pieces(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row and the length of each run of rows that break nothing."""
    starts = np.flatnonzero(breaks)
    return starts, np.diff(np.append(starts, len(breaks)))


def _each(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts, starts + 1, ... for each run, one after another."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


def _packed(batch: int, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """One row for each bucket with its entries of each column as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, dtype=np.int64)
    ends = np.append(starts[1:], len(bucket))[: len(starts)]
    out: dict[str, object] = {"bucket": bucket[starts].astype(np.int64), "batch": np.full(len(starts), batch, dtype=np.int64)}
    for name, x in columns.items():
        x = x[order]
        out[name] = [x[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
    return pd.DataFrame(out)


def _joined(x: pd.DataFrame, column: str, kind: str | np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x[column]), dtype=kind)


def _batches(x: pd.DataFrame, column: str, width: int) -> np.ndarray:
    return np.repeat(x["batch"].to_numpy(dtype=np.int64), [len(b) // width for b in x[column]])


def _anchors(buckets: int):
    def run(x: pd.DataFrame) -> pd.DataFrame:
        win = Windows(x["text"].tolist())
        # Windows that share their anchor's first place share one occurrence of it.
        at, where = win.at, np.empty(len(win.at), dtype=np.int64)
        for k in range(WINDOW - ANCHOR, -1, -1):
            where[win.short[at + k] == win.anchor] = k
        names, counts = np.unique(win.anchor[_changes(at + where)], return_counts=True)
        return _packed(int(x["batch"].iloc[0]), (names % np.uint64(buckets)).astype(np.int64), {"name": names, "twice": counts > 1})

    return run


def _repeated(x: pd.DataFrame) -> pd.DataFrame:
    """For each batch, its anchors that some other batch has too, or that it has twice."""
    names, twice, batch = _joined(x, "name", "u8"), _joined(x, "twice", "?"), _batches(x, "name", 8)
    _, where, counts = np.unique(names, return_inverse=True, return_counts=True)
    on = (counts[where] > 1) | np.isin(names, names[twice])
    return _packed(0, batch[on], {"name": names[on]}).assign(batch=lambda y: y["bucket"])[["batch", "name"]]


def _edges(buckets: int):
    """To the bucket of each node's anchor: the edges that enter or leave nodes with that anchor, in rows as they follow."""

    def run(x: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame(columns=["bucket", "batch", "path", "w", "v"])
        x = _ordered(x)
        e = Edges(Windows(x["text"].tolist()), x["id"].to_numpy(dtype=np.int64), found)
        # A row of edges breaks where they don't follow one another, or where the anchor of the node between changes;
        # the edge before a change goes to both buckets.
        follows = ~_changes(e.id, e.place - np.arange(len(e.place)))
        follows[1:] &= e.b[:-1] == e.a[1:]
        same = follows.copy()
        same[1:] &= e.before[1:] == e.before[:-1]
        starts, lengths = _pieces(~same)
        alien = follows[starts]  # the edge before leads into this row's first node
        ends = starts + lengths
        # A last edge whose second node has another anchor, and nothing follows it, goes to that one's bucket alone.
        lone = np.flatnonzero((e.after[ends - 1] != e.before[ends - 1]) & ~np.append(follows, False)[ends])
        first = np.concatenate([starts - alien, ends[lone] - 1])
        n = np.concatenate([lengths + alien, np.ones(len(lone), dtype=np.int64)])
        path = np.empty(len(first), dtype=PATH)
        path["id"], path["place"], path["first"], path["n"] = e.id[first], e.place[first], first, n
        path["alien"] = np.concatenate([alien, np.ones(len(lone), dtype=bool)])
        anchor = np.concatenate([e.before[starts], e.after[ends[lone] - 1]])
        bucket = (anchor % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        path, n, bucket = path[order], n[order], bucket[order]
        out = _packed(int(x["batch"].iloc[0]), bucket, {"path": path})
        # The hashes of the edges and of their nodes (one more a row) follow their rows into the buckets.
        each = _each(path["first"].astype(np.int64), n)
        w = e.w[each]
        v = np.empty(int(n.sum()) + len(n), dtype=np.uint64)
        last = np.cumsum(n + 1) - 1
        inner = np.ones(len(v), dtype=bool)
        inner[last] = False
        v[inner], v[last] = e.a[each], e.b[path["first"].astype(np.int64) + n - 1]
        sizes = [np.frombuffer(p, dtype=PATH)["n"] for p in out["path"]]
        edges, nodes = (np.cumsum([0, *(int(z.sum()) + more * len(z) for z in sizes)]) for more in (0, 1))
        out["w"] = [w[s:t].tobytes() for s, t in zip(edges[:-1], edges[1:], strict=True)]
        out["v"] = [v[s:t].tobytes() for s, t in zip(nodes[:-1], nodes[1:], strict=True)]
        return out

    return run


def _branching(a: np.ndarray, b: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Whether each node is entered, or left, by more than one of the distinct edges from a to b."""
    out = np.zeros(len(nodes), dtype=bool)
    for ends in (a, b):
        names, counts = np.unique(ends, return_counts=True)
        out |= np.isin(nodes, names[counts > 1])
    return out


def _firsts(x: pd.DataFrame) -> pd.DataFrame:
    """For each batch, the paths of its edges that start earlier in another batch, with their sources."""
    path, w, v = _joined(x, "path", PATH), _joined(x, "w", "u8"), _joined(x, "v", "u8")
    batch = _batches(x, "path", PATH.itemsize)
    n = path["n"].astype(np.int64)
    number = _each(path["first"].astype(np.int64), n)
    place = np.repeat(path["place"].astype(np.int64) - path["first"], n) + number
    ids, batch = np.repeat(path["id"], n), np.repeat(batch, n)
    last = np.cumsum(n + 1) - 1
    inner = np.ones(len(v), dtype=bool)
    inner[last] = False
    a = v[inner]
    inner[:] = True
    inner[last - n] = False
    b = v[inner]
    alien = np.zeros(len(w), dtype=bool)
    alien[(np.cumsum(n) - n)[path["alien"] == 1]] = True

    order = np.lexsort((place, ids, a, w))
    new = _changes(w[order], a[order], b[order])
    group = np.cumsum(new) - 1
    first = order[new]
    source = np.empty(len(order), dtype=np.int64)
    source[order] = first[group] if len(order) else order
    # Degrees count the edges that several batches have.
    shared = np.zeros(len(first), dtype=bool)
    shared[group[(batch != batch[source])[order]]] = True
    branching = _branching(a[first[shared]], b[first[shared]], a)

    on = np.flatnonzero(((ids[source] != ids) | (place[source] != place)) & ~alien)
    of, k, sb, sid, sp = batch[on], number[on], batch[source[on]], ids[source[on]], place[source[on]]
    step = np.arange(len(k))
    starts, lengths = _pieces(_changes(of, k - step, sb, sid, sp - step) | branching[on])
    back = np.empty(len(starts), dtype=BACK)
    back["first"], back["n"], back["batch"], back["id"], back["place"] = k[starts], lengths, sb[starts], sid[starts], sp[starts]
    return _packed(0, of[starts], {"back": back}).assign(batch=lambda y: y["bucket"])[["batch", "back"]]


def _ordered(x: pd.DataFrame) -> pd.DataFrame:
    """A batch's rows in an order that every reading of it repeats; rows number themselves by it."""
    return x.iloc[np.lexsort((x["print"].to_numpy(), x["id"].to_numpy()))].reset_index(drop=True)


def _paths(x: pd.DataFrame, found: pd.DataFrame, firsts: pd.DataFrame) -> np.ndarray:
    """The spans of an ordered batch that repeat earlier passages: rows (text number, from word, to word, source batch, source id, source word)."""
    win, ids = Windows(x["text"].tolist()), x["id"].to_numpy(dtype=np.int64)
    e = Edges(win, ids, found)
    back = _joined(firsts, "back", BACK)
    n = back["n"].astype(np.int64)
    sb, sid, sp = np.full(len(e.id), int(x["batch"].iloc[0]), dtype=np.int64), e.id.copy(), e.place.copy()
    at = _each(back["first"].astype(np.int64), n)
    sb[at], sid[at], sp[at] = np.repeat(back["batch"], n), np.repeat(back["id"], n), _each(back["place"].astype(np.int64), n)
    doc, place, batch, source, start = win.doc[e.some], win.place[e.some], sb[e.of], sid[e.of], sp[e.of]
    later = (source < ids[doc]) | ((source == ids[doc]) & (start < place))
    doc, place, batch, source, start = doc[later], place[later], batch[later], source[later], start[later]
    step = np.arange(len(doc))
    starts, lengths = _pieces(_changes(doc, place - step, batch, source, start - step))
    return np.column_stack([doc[starts], place[starts], place[starts] + lengths - 1 + WINDOW, batch[starts], source[starts], start[starts]])


def _digest(some: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(some), digest_size=16).digest()


SPANS = "batch long, row long, from_word long, to_word long, source_batch long, source_id long, source_word long, words binary"


def _spans(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    """A batch's spans, each with the digest of its words."""
    names = [c.split()[0] for c in SPANS.split(", ")]
    if not len(x):
        return pd.DataFrame(columns=names)
    x = _ordered(x)
    paths = _paths(x, y[y["kind"] == 0], y[y["kind"] == 1])
    digests, key, here = [], -1, []
    for row, a, b in paths[:, :3].tolist():
        if row != key:
            key, here = row, words(x["text"].iat[row])
        digests.append(_digest(here[a:b]))
    columns = dict(zip(names[1:-1], paths.T, strict=True))
    return pd.DataFrame({"batch": np.full(len(paths), int(x["batch"].iloc[0])), **columns, "words": digests}, columns=names)


ASKED = "source_batch long, source_id long, source_word long, n long, words binary"


def _differing(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    """Of what spans say stands in a source batch (rows of ASKED), that which doesn't."""
    out = []
    names = [c.split()[0] for c in ASKED.split(", ")]
    if len(y):
        texts: dict[int, list[list[bytes]]] = {}
        asked = set(y["source_id"])
        for i, text in zip(x["id"], x["text"], strict=True):
            if i in asked:
                texts.setdefault(i, []).append(words(text))
        for r in y[names].itertuples(index=False):
            if not any(_digest(t[r.source_word : r.source_word + r.n]) == r.words for t in texts.get(r.source_id, [])):
                out.append(tuple(r))
    return pd.DataFrame(out, columns=names)


def _kept(with_text: bool):
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        names = ["id", "none", "n_words", "n_removed", "kept_sha256", "kept"]
        if not len(x):
            return pd.DataFrame(columns=names)
        x = _ordered(x)
        gone: dict[int, list[tuple[int, int]]] = {}
        for row, a, b in sorted(zip(y["row"], y["from_word"], y["to_word"], strict=True)):
            gone.setdefault(row, []).append((a, b))
        rows = []
        for k, (i, none, text) in enumerate(zip(x["id"], x["none"], x["text"], strict=True)):
            all_words = words(text)
            left = all_words
            if k in gone:
                left, at = [], 0
                for a, b in gone[k]:
                    left += all_words[at:a] if a > at else []
                    at = max(at, b)
                left += all_words[at:]
            whole = b" ".join(left)
            rows.append((i, none, len(all_words), len(all_words) - len(left), hashlib.sha256(whole).hexdigest(), whole.decode("utf-8", "surrogatepass") if with_text else None))
        return pd.DataFrame(rows, columns=names)

    return run


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The texts by batches, their verified spans (SPANS), and the ids that ranks stand for, if they do."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    batches = max(1, -(-size // BATCH_BYTES))
    buckets = max(1, -(-size // (50 * BUCKET_ENTRIES)))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = None
    if docs.schema[id_col].dataType.typeName() not in WHOLE:
        names = ranked(own.select("id"))
        own = own.join(names, "id", "left").select(F.col("rank").alias("id"), "text")
    rows = own.select(F.coalesce(F.col("id").cast("long"), F.lit(LAST)).alias("id"), F.col("id").isNull().alias("none"), "text")
    rows = rows.withColumn("print", F.xxhash64("id", "text", "none")).withColumn("batch", F.pmod("print", F.lit(batches)))
    by = rows.groupBy("batch")
    anchors = by.applyInPandas(_anchors(buckets), "bucket long, batch long, name binary, twice binary")
    repeated = anchors.groupBy("bucket").applyInPandas(_repeated, "batch long, name binary")
    edges = by.cogroup(repeated.groupBy("batch")).applyInPandas(_edges(buckets), "bucket long, batch long, path binary, w binary, v binary")
    firsts = edges.groupBy("bucket").applyInPandas(_firsts, "batch long, back binary")
    none = F.lit(b"")
    told = repeated.select("batch", F.lit(0).alias("kind"), "name", none.alias("back"))
    told = told.unionByName(firsts.select("batch", F.lit(1).alias("kind"), none.alias("name"), "back"))
    found = by.cogroup(told.groupBy("batch")).applyInPandas(_spans, SPANS).repartition("batch")
    # Each passage of a source is asked for once, whoever repeats it. (All columns are read, so that both readers of
    # `found` share one exchange.)
    key = ["source_batch", "source_id", "source_word", "n", "words"]
    asked = found.groupBy("source_batch", "source_id", "source_word", (F.col("to_word") - F.col("from_word")).alias("n"), "words")
    asked = asked.agg(*[F.min(c).alias(f"least_{c}") for c in ("batch", "row", "from_word", "to_word")])
    wrong = by.cogroup(asked.groupBy("source_batch")).applyInPandas(_differing, ASKED)
    return rows, found.withColumn("n", F.col("to_word") - F.col("from_word")).join(wrong, key, "left_anti").drop("n"), names


def _named(out: DataFrame, names: DataFrame | None, kind: str, column: str, to: str) -> DataFrame:
    """out with the ids that a column of ranks stands for, as column `to`; LAST stands for null."""
    if names is None:
        return out.withColumn(to, F.when(F.col(column) != LAST, F.col(column)).cast(kind))
    ids = names.select(F.col("rank").alias(f"_{to}_rank"), F.col("id").alias(f"_{to}_id"))
    return out.join(ids, out[column] == ids[f"_{to}_rank"], "left").withColumn(to, F.col(f"_{to}_id"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, from_word, to_word, source_id, source_word): every verified path that repeats an earlier passage; ends exclusive."""
    rows, found, names = _dealt(docs, id_col, text_col)
    out = rows.groupBy("batch").cogroup(found.groupBy("batch")).applyInPandas(_told, "id long, from_word long, to_word long, source long, source_word long")
    kind = docs.schema[id_col].dataType.simpleString()
    out = _named(_named(out, names, kind, "id", "own"), names, kind, "source", "source_id")
    return out.select(F.col("own").alias(id_col), "from_word", "to_word", "source_id", "source_word")


def _told(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    ids = _ordered(x)["id"].to_numpy() if len(x) else np.empty(0, dtype=np.int64)
    return pd.DataFrame({"id": ids[y["row"].to_numpy(dtype=np.int64)], "from_word": y["from_word"], "to_word": y["to_word"], "source": y["source_id"], "source_word": y["source_word"]})


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256, kept) of each row; kept: the words left, joined by one space."""
    rows, found, names = _dealt(docs, id_col, text_col)
    out = rows.groupBy("batch").cogroup(found.groupBy("batch")).applyInPandas(_kept(with_text), "id long, none boolean, n_words long, n_removed long, kept_sha256 string, kept string")
    out = _named(out, names, docs.schema[id_col].dataType.simpleString(), "id", "own")
    return out.select(F.col("own").alias(id_col), "n_words", "n_removed", "kept_sha256", "kept")
