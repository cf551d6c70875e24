import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import packing
from corvane.llm.common import words
from corvane.llm.queries import op4_packing

SF = "/root/testdata/sf0.01"


def naive(sizes, sources, clusters, capacity):
    """The residual that each piece leaves, and the number of bins; of bins that fit equally the one that came to its residual first."""
    bins, out, came = [], [], {}
    for step, (z, s, c) in enumerate(zip(sizes, sources, clusters, strict=True)):
        fit = [(capacity - sum(x[0] for x in b), came[k], k) for k, b in enumerate(bins) if sum(x[0] for x in b) + z <= capacity and not any((s >= 0 and s == x[1]) or (c >= 0 and c == x[2]) for x in b)]
        k = min(fit)[2] if fit else len(bins)
        if not fit:
            bins.append([])
        bins[k].append((z, s, c))
        came[k] = step
        out.append((capacity - sum(x[0] for x in bins[k])))
    return out, len(bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(-1, 3), st.integers(-1, 6)), max_size=40))
def test_the_tightest_compatible_bin(items):
    sizes, sources, clusters = map(list, zip(*items, strict=True)) if items else ([], [], [])
    got = packing.best_fit(sizes, sources, clusters, 20)
    left, residuals = defaultdict(lambda: 20), []
    for b, z in zip(got, sizes, strict=True):
        left[b] -= z
        residuals.append(left[b])
    want, n = naive(sizes, sources, clusters, 20)
    assert residuals == want and len(left) == n


def joined(rows):
    """The texts that pieces make, by their documents' ids; of rows alike, one after another."""
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.piece):
        out[r.doc_id].append(r.text)
    return out


def held(rows, docs, capacity=packing.CAPACITY):
    bins, cover = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin].append(r)
        cover[r.doc_id].append((r.from_word, r.n_words))
    for b in bins.values():
        b.sort(key=lambda r: r.bin_slot)
        assert sum(r.n_words for r in b) <= capacity and [r.bin_slot for r in b] == list(range(len(b)))
        assert [r.bin_offset for r in b] == [sum(x.n_words for x in b[:k]) for k in range(len(b))]
        named = [r.source for r in b if r.source is not None]
        assert len(named) == len(set(named)) and len(b) == len({r.cluster for r in b})
    for k, n in docs.items():
        at = 0
        for a, z in sorted(cover[k]):
            assert a == at
            at += z
        assert at == n


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op4_packing(spark, SF).collect()
    held(rows, {k: len(words(t)) for k, t in docs.items()})
    assert {k: "".join(x or "" for x in t) for k, t in joined(rows).items()} == {k: t or "" for k, t in docs.items()}
    assert all(len(words(r.text)) == r.n_words for r in rows)


def test_odd_rows(spark):
    random.seed(1)
    rows = [(i, "hot words here", "s") for i in range(400)] + [(1000 + i, "w " * random.randint(0, 5000), random.choice(["s", "t", None])) for i in range(300)] + [(5000, None, None), (None, "", "u")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, bin int")
    held(packing.packed(df).collect(), {r[0]: len(words(r[1])) for r in rows})
    assert packing.packed(df.limit(0)).collect() == []
    assert packing.packed(df.limit(2).union(df.limit(2))).count() == 4


def test_ids_pass_unchanged_and_copies_count(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 2)
    rows = [(None, " lead  w", "s", 1), (2**53 + 1, "a b", "s", 2), (2**53 + 1, "a b", "s", 3), (2**53 + 1, "a b", "s", 3), (2**53, None, None, 4), (7, "", "t", 5)] + [(8, "x\n y  z\tw v ", "u", 6)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key int").withColumn("bin", F.lit("b"))
    out = packing.packed(df, capacity=2).collect()
    assert Counter(r.doc_id for r in out) == {None: 1, 2**53 + 1: 3, 2**53: 1, 7: 1, 8: 9}
    assert [r.text for r in out if r.doc_id == 2**53] == [None] and [r.text for r in out if r.doc_id is None] == [" lead  w"]
    assert sorted((r.piece, r.text) for r in out if r.doc_id == 8) == [(0, "x\n y  ")] * 3 + [(1, "z\tw ")] * 3 + [(2, "v ")] * 3
    held(out, {}, 2)
    assert Counter(r.k for r in packing.packed(df.select(F.concat(F.lit("k"), "doc_id").alias("k"), "text", "source"), id_col="k").collect())["k8"] == 3
