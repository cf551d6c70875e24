from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing
from corvane.llm.common import words
from corvane.llm.queries import op1_mixing

SF = "/root/testdata/sf0.01"


def brute_targets(sizes, weights=(1, 2, 3), repeats=3):
    """Targets by sharing again and again what is cut off."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = float(sum(sizes.values())), {}, set(names)
    while free:
        left = total - sum(out.values())
        got = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if got[s] >= repeats * sizes[s]}
        if not over:
            return out | got
        out |= {s: repeats * sizes[s] for s in over}
        free -= over
    return out


def held(rows, docs):
    sizes = Counter()
    for d in docs:
        sizes[d.source] += len(words(d.text))
    want = brute_targets(sizes)
    of = {d.doc_id: d.source for d in docs}
    got = Counter()
    for r in rows:
        got[of[r.doc_id]] += r.taken
        assert r.source_size == sizes[of[r.doc_id]] and r.target == pytest.approx(want[of[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
    for s in sizes:
        assert abs(got[s] - want[s]) <= 1, s


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = op1_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d.doc_id for d in docs)
    held(rows, docs)
    assert sorted(rows) == sorted(op1_mixing(spark, SF).collect())


def test_odd_rows(spark):
    data = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "w " * 5000, None), (5, "q r", "y"), (6, "é é f", "zz"), (None, "n o", "y"), (7, None, "empty")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit(9)).withColumn("start", F.lit("s"))
    rows = mixing.taken(df).collect()
    assert len(rows) == len(data)
    assert mixing.taken(df.limit(0)).collect() == [] and mixing.mixed(df.limit(0)).collect() == []
    out = mixing.mixed(df)
    assert out.columns == df.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id, r.source] += len(words(r.text))
    want = Counter()
    src = {(d[0], len(words(d[1]))): d[2] for d in data}
    for r in rows:
        want[r.doc_id, src[r.doc_id, r.size]] += r.taken
    assert +got == +want


def test_schedule_is_even(spark):
    sizes = spark.createDataFrame([("a", 400_000), ("b", 100_000), ("c", 3)], "source string, source_size long")
    slots = [r["index"] for r in mixing.schedule(mixing.targets(sizes), 1000).orderBy("slot").collect()]
    share = slots.count(1) / len(slots)
    for n in range(50, 400, 50):
        assert abs(slots[:n].count(1) - share * n) <= 10


def test_first_words(spark):
    df = spark.createDataFrame([(" a  b\nc ", 2), ("a b", 1), ("a b c", 2), ("\ta", 1)], "t string, k int")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("k"))).collect()] == [" a  b", "a", "a b", "\ta"]


def test_clashing_names_and_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 2)
    data = [(k, "a b c", "x", k, -k, "t") for k in range(3)] + [(9, "p q", "y", 1, 1, "u")] * 7 + [(9, "p q", "y", 2, 2, "v")] * 2 + [(None, "n n n", None, 0, 0, "w")] * 5
    df = spark.createDataFrame(data, "doc_id long, text string, source string, _own int, _k int, _time string")
    rows = mixing.taken(df).collect()
    assert len(rows) == len(data)
    out = mixing.mixed(df).collect()
    full = {(d[0], *d[2:]) for d in data}
    assert {(r.doc_id, *tuple(r)[2:]) for r in out} <= full
    assert sum(len(words(r.text)) for r in out) == sum(r.taken for r in rows)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed(df.repartition(4)).collect()))
    text_ids = df.withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))
    assert mixing.taken(text_ids).count() == len(data)
