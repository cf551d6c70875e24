import hashlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import fingerprints
from corvane.llm.common import words
from corvane.llm.queries import op7_fingerprints

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def edits(docs):
    order = sorted(docs, reverse=True)
    out = {}
    for i, d in enumerate(order):
        t, nxt = docs[d] or "", docs[order[(i + 1) % len(order)]] or ""
        k = len(t) // 3
        out[d] = (t[: len(t) - k] + nxt[:k], nxt)
    return out


def held(rows, docs):
    want, errors, prints = edits(docs), [], {}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        t, (e, nxt) = docs[r.doc_id] or "", want[r.doc_id]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        x, y, z = (slow_sketch(k) for k in (t, e, nxt))
        line = lambda k: "".join(f"{h:0{10 + (h >> 40)}x}" for h in k)
        assert (r.fingerprint, r.edited_fingerprint) == (line(x), line(y))
        like = lambda p, q: len(set(p) & set(q)) / len(p) if p else float(not q)
        assert r.near_edited == pytest.approx(like(x, y)) and r.near_next == pytest.approx(like(x, z))
        a, b = shingles(t), shingles(e)
        if len(a) > 100:
            errors.append(abs(r.near_edited - len(a & b) / len(a)))
    assert not errors or sum(errors) / len(errors) < 0.05


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held(op7_fingerprints(spark, SF).collect(), docs)


def test_odd_rows(spark):
    docs = {1: "a b c d e f g h", 2: None, 9000: "", 9001: "é" * 10, -5: "one", 10**12: "w " * 30000, 7: "x y z"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("sketch", F.lit(1))
    held(fingerprints.edited(df).collect(), docs)
    more = df.unionByName(spark.createDataFrame([(None, "n o", 1), (None, None, 1), (7, "x y z", 1)], df.schema))
    assert fingerprints.edited(more).count() == len(docs) + 3
    assert fingerprints.edited(df.limit(0)).collect() == []
    one = fingerprints.edited(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1


def test_sketches_merge(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    w = text.split()
    df = spark.createDataFrame([(0, " ".join(w[:1504])), (0, " ".join(w[1500:])), (1, text)], "g int, text string")
    out = {r.g: r.sketch for r in fingerprints.merged(fingerprints.with_sketch(df, F.col("text"), "sketch"), ["g"]).collect()}
    assert out[0] == out[1] and 600 < len(out[1]) < 900


def test_short_parts_merge(spark):
    parts = [(0, "a b c d e"), (0, "b c d e f"), (1, "a b c d e f"), (2, "x y"), (2, "q r s t u"), (3, "q r s t u"), (4, "x y"), (5, "")]
    for fraction in (1e-9, 0.5, 1.0):
        df = spark.createDataFrame(parts, "g int, _h string")
        rows = fingerprints.with_sketch(df, F.col("_h"), "sketch", fraction)
        out = {r.g: r.sketch for r in fingerprints.merged(rows, ["g"], fraction=fraction).collect()}
        assert out[0] == out[1] and out[2] == out[3] and len(out[4]) == 1 and out[4][0] >= fingerprints.SHORT and out[5] == []


def slow_sketch(text):
    h = {int(hashlib.md5(b" ".join(x)).hexdigest()[:10], 16) + (len(x) < 5 and 1 << 40) for x in shingles(text)}
    return sorted(x for x in h if x < (1 << 40) // 4) or sorted(h)[:1]


def test_the_sketch_itself(spark):
    texts = ["", "a", " a\tb ", "a b c d e f g", " ".join(f"w{i % 50}" for i in range(400)), "é ü ö ä ß", "one two three four five six " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = [r.s for r in fingerprints.with_sketch(df, F.col("t"), "s").orderBy("k").collect()]
    assert got == [slow_sketch(t) for t in texts]


def test_any_ids_in_runs(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN", 3)
    docs = {f"k{(i * 7919) % 1000}": f"text {i} of some words " * (i % 5) for i in range(40)}
    held(fingerprints.edited(spark.createDataFrame(list(docs.items()), "doc_id string, text string")).collect(), docs)
    far = {(i * 2654435761) % (1 << 62): f"t {i} " * 9 for i in range(1, 60)}
    held(fingerprints.edited(spark.createDataFrame(list(far.items()), "doc_id long, text string")).collect(), far)
    none = spark.createDataFrame([(None, "abcdef"), (1, "uvwxyz")], "doc_id long, text string")
    assert {r.doc_id: r.edited_sha256 for r in fingerprints.edited(none).collect()} == {None: hashlib.sha256(b"abcduv").hexdigest(), 1: hashlib.sha256(b"uvwxab").hexdigest()}
