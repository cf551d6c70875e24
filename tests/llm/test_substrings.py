import hashlib

from pyspark.sql import functions as F

from corvane.llm import substrings
from corvane.llm.common import words
from corvane.llm.queries import op5_substrings

SF = "/root/testdata/sf0.01"


def brute(docs):
    """(n_words, n_removed, sha256) of each (id, text), by a table of every window's first place."""
    first, out = {}, {}
    for i in sorted(docs):
        w = words(docs[i])
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone[k : k + 20] = [True] * 20
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got(op5_substrings(spark, SF)) == brute(docs)


def test_odd_rows_and_spans(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_BYTES", 300)
    monkeypatch.setattr(substrings, "BUCKET_ENTRIES", 5)
    a = " ".join(f"a{i}" for i in range(40))
    docs = {1: a, 2: f"x y {a} z", 3: a[: a.index("a19")], 4: None, 5: "", 6: "w " * 60, 7: "w " * 19, 8: " ".join(a.split()[10:35]) + " q " + " ".join(a.split()[:25]), -9: "é ü " * 30, 9: "\x0b".join(a.split()[:20]), 10: a}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("batch", F.lit("b"))
    assert got(substrings.without_repeats(df)) == brute(docs)
    rows = sorted(map(tuple, substrings.spans(df).where("doc_id in (2, 8)").collect()))
    assert rows == [(2, 2, 42, 1, 0), (8, 0, 25, 1, 10), (8, 26, 51, 1, 0)]
    more = df.unionByName(spark.createDataFrame([(None, a, ""), (None, "n o", ""), (1, a, "")], df.schema))
    out = substrings.without_repeats(more).collect()
    assert len(out) == len(docs) + 3 and sorted((r.n_words, r.n_removed) for r in out if r.doc_id is None) == [(2, 0), (40, 40)]
    assert [r.n_removed for r in out if r.doc_id == 1] == [0, 0]
    assert substrings.without_repeats(df.limit(0)).collect() == []


def test_kept_text(spark):
    df = spark.createDataFrame([(1, " a\tb\n"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in substrings.without_repeats(df).collect()} == {1: "a b", 2: ""}


def test_periodic_texts(spark):
    docs = {i: " ".join(f"p{k % period}" for k in range(length)) for i, (period, length) in enumerate([(1, 40), (2, 25), (3, 22), (7, 27), (12, 33), (13, 34), (15, 60), (19, 39), (20, 41), (5, 20)])}
    docs |= {100 + i: " ".join(f"u{i}_{k % period}" for k in range(21 + period)) for i, period in enumerate(range(1, 25))}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert got(substrings.without_repeats(df)) == brute(docs)


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits)


def test_words_that_polynomials_confuse_are_told_apart(spark):
    x = thue_morse(1024)
    y = x.translate(str.maketrans("ab", "ba"))
    docs = {k: " ".join([*(f"w{i}" for i in range(15)), z, *(f"v{i}" for i in range(15))]) for k, z in ((1, x), (2, y), (3, x))}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = got(substrings.without_repeats(df))
    assert found == brute(docs) and found[2][1] == 0 and found[3][1] == 31


def test_spans_whose_words_differ_stay(spark, monkeypatch):
    """With hashes that see a word's length alone, only what the source's words confirm goes."""
    import numpy as np

    def by_length(flat):
        inside = np.r_[False, ~np.isin(flat, list(b" \t\n\x0b\x0c\r")), False].astype(np.int8)
        edges = np.flatnonzero(np.diff(inside))
        sizes = (edges[1::2] - edges[::2]).astype(np.uint64)
        return sizes, sizes, edges[::2]

    from corvane.llm import shingles

    monkeypatch.setattr(shingles, "word_hashes", by_length)
    import pandas as pd

    a, b = " ".join(f"a{i}" for i in range(10, 40)), " ".join(f"b{i}" for i in range(10, 40))
    x = pd.DataFrame({"id": [1, 2, 3], "print": [1, 2, 3], "text": [a, b, a], "batch": 0, "none": False})
    anchors = substrings._anchors(1)(x)
    repeated = substrings._repeated(anchors).assign(kind=0, back=b"")
    found = substrings._spans(x, repeated)
    assert set(found["row"]) == {0, 1, 2}
    asked = found.assign(n=found["to_word"] - found["from_word"])
    wrong = set(substrings._differing(x, asked)["words"])
    assert {r.row for r in found.itertuples() if r.words in wrong} >= {1}


def test_string_ids(spark):
    a = " ".join(f"a{i}" for i in range(30))
    docs = {"z": a, "b": f"x {a}", "c": a[: a.index("a9")], "ä": f"{a} q"}
    df = spark.createDataFrame(list(docs.items()), "doc_id string, text string")
    assert got(substrings.without_repeats(df)) == brute(docs)
    assert {tuple(r) for r in substrings.spans(df).collect()} == {("z", 0, 30, "b", 1), ("ä", 0, 30, "b", 1)}
    none = df.unionByName(spark.createDataFrame([(None, a)], df.schema))
    assert {r.n_removed for r in substrings.without_repeats(none).collect() if r.doc_id is None} == {30}


def test_every_stage_reads_one_exchange(spark):
    """The texts are dealt once, and spans are found once for both that need them."""
    df = spark.createDataFrame([(1, "a " * 50), (2, "a " * 50)], "doc_id long, text string")
    out = substrings.without_repeats(df)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("_spans(") == 1, plan
