import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from corvane.llm import toxicity
from corvane.llm.queries import op8_toxicity

SF = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    s = np.asarray(scores)[order]
    for v in np.unique(s):
        same = np.flatnonzero(s == v)
        ranks[order[same]] = same.mean() + 1
    y = np.asarray(labels)
    n = y.sum()
    return (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op8_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    test = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    # Half of these labels have no telling stem of four characters; the tables of the check tool do (see the README).
    assert auc(*zip(*test, strict=True)) > 0.75
    caught = [s >= 0.5 for s, y in test if y]
    false = [s >= 0.5 for s, y in test if not y]
    assert np.mean(caught) > 0.5 and np.mean(false) < 0.01


INSULTS = ["scoundrel", "knave", "wretch"]


def made(n, toxic, seed):
    rng = np.random.default_rng(seed)
    common = [f"{a}{b}ing" for a in "bcdfghjkl" for b in ("ar", "el", "in", "ol", "ut")]
    out = []
    for _ in range(n):
        w = rng.choice(common, 60).tolist()
        for k in rng.choice(60, 6 * toxic, replace=False):
            w[k] = str(rng.choice(INSULTS))
        out.append(" ".join(w))
    return out


def slow_score(model, text):
    """The score by a compressor made anew for each window from the dictionary's bytes."""
    words = [w.strip(toxicity.PUNCTUATION).decode()[:4].encode() for w in text.lower().encode().split()]
    words = [xxhash.xxh3_128(w).digest() for w in words if w]
    sizes = []
    for held in (model.ordinary, model.toxic):
        row = []
        for i in range(0, len(words), 4):
            d = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_FULLDICT)
            how = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, source_size=64, dict_size=len(held), write_checksum=0, write_content_size=0, write_dict_id=0)
            row.append(len(zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress(b"".join(words[i : i + 4]))))
        sizes.append(row)
    hits = sum(a - b >= model.least for a, b in zip(*sizes, strict=True))
    p, q = model.rates
    x = hits * np.log(q / p) + (len(sizes[0]) - hits) * np.log((1 - q) / (1 - p))
    return 1 / (1 + np.exp(-(model.curve[0] * min(20, max(-20, x)) + model.curve[1])))


def test_two_trained_dictionaries_and_the_slow_way():
    texts = [(t, y) for y, n in ((0, 400), (1, 120)) for t in made(n, y, y)]
    model = toxicity.fit_rows([(i, t, y) for i, (t, y) in enumerate(texts)])
    for held in (model.ordinary, model.toxic):
        assert held[:4] == b"\x37\xa4\x30\xec"  # as trained: with its header and entropy tables
    assert model.ordinary != model.toxic and model.toxic not in model.ordinary
    fresh = made(40, 0, 7) + made(40, 1, 8) + ["one scoundrel", "", "?!", "knave " * 500]
    got = model.scorer()(fresh)
    assert [round(float(slow_score(model, t)), 4) for t in fresh[30:50]] == [round(x, 4) for x in got[30:50]]
    assert sum(x >= 0.5 for x in got[:40]) <= 1 and sum(x >= 0.5 for x in got[40:80]) >= 38
    again = toxicity.fit_rows([(i, t, y) for i, (t, y) in reversed(list(enumerate(texts)))])
    assert again == model


def test_clashing_columns_and_repeated_rows(spark):
    docs = [(i, t, float(i), i, "h") for i, (t, y) in enumerate([(t, y) for y, n in ((0, 100), (1, 40)) for t in made(n, y, y)])]
    df = spark.createDataFrame(docs, "doc_id long, text string, _toxicity double, label int, hash string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in range(140)], "doc_id long, toxic int")
    one, two = (toxicity.fit(d, k) for d, k in ((df, labels), (df.unionByName(df).repartition(7), labels.unionByName(labels))))
    assert one == two
    left = toxicity.clean(df, one)
    assert left.columns == df.columns
    assert set(map(tuple, left.collect())) == {d for d, s in zip(docs, one.scorer()([d[1] for d in docs]), strict=True) if s < 0.5}
    text_ids = df.withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))
    assert toxicity.scored(text_ids, toxicity.fit(text_ids, labels.withColumn("doc_id", F.concat(F.lit("k"), "doc_id")))).count() == 140


def test_small_and_odd_fits(spark):
    assert toxicity.fit_rows([]).scorer()(["x", None]) == [0.0, 0.0]
    assert toxicity.fit_rows([(1, "a", 1)]).scorer()(["x"]) == [1.0]
    rows = [(i, f"well met fair day number{i} of words " * 5, 0) for i in range(60)] + [(100 + i, f"you vile scoundrel number{i} of words " * 5, 1) for i in range(20)]
    of = toxicity.fit_rows(rows).scorer()
    a, b, c = of(["what a vile scoundrel", "what a fair day", None])
    assert a > b and 0 <= c <= 1
    df = spark.createDataFrame([(1, None, 2.0), (None, "", 1.0), (3, "vile scoundrel " * 9000, None), (3, "q", 0.0), (3, "q", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    out = toxicity.scored(df, toxicity.fit(df, labels)).collect()
    assert len(out) == 5 and all(r.score == pytest.approx(0.0) for r in out)
    assert toxicity.clean(df, toxicity.fit_rows(rows)).columns == df.columns
    assert toxicity.scored(df.limit(0), toxicity.fit_rows(rows)).collect() == []
