from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import neardup
from corvane.llm.queries import op9_neardup
from corvane.operators.components import components

SF = "/root/testdata/sf0.01"


def own_bag(text):
    """The words' runs of five, counted as tuples, by no code of the operator."""
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def own_similarity(a, b):
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def brute(texts):
    """The class of each (key, text): components of all pairs of similarity 0.8 or more, by the least key."""
    bags, by = {k: own_bag(t) for k, t in texts.items()}, defaultdict(set)
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, runs in bags.items():
        for r in runs:
            by[r].add(k)
    pairs = {p for x in by.values() for p in combinations(sorted(x), 2)}
    same = defaultdict(list)
    for k, t in texts.items():
        same[t or ""].append(k)
    pairs |= {(min(x), k) for x in same.values() for k in x if k != min(x)}
    for a, b in pairs:
        if (texts[a] or "") == (texts[b] or "") or own_similarity(bags[a], bags[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in texts}


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.class_id for r in op9_neardup(spark, SF).collect()} == brute(texts)


def test_signatures_are_unbiased():
    rng, errors = np.random.default_rng(0), []
    for k in range(150):
        a = [f"a{i}" for i in range(200)]
        b = [w if rng.random() > 0.02 else f"b{k}_{i}" for i, w in enumerate(a)] + a[:40] * (k % 4)
        x, y = " ".join(a + a[:40] * 2) + f" {k}", " ".join(b)
        s, has = neardup.signatures([x, y])
        assert has.all()
        errors.append((s[0] == s[1]).mean() - own_similarity(own_bag(x), own_bag(y)))
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.06


def test_one_text_signs_alike_in_any_company():
    texts = ["a b c d e f g h", "x", "", None, "a b " * 500, "q w e r t y u i o p " * 3]
    whole, has = neardup.signatures(texts)
    assert has.tolist() == [True, True, False, False, True, True]
    for i, t in enumerate(texts):
        assert (neardup.signatures([t])[0][0] == whole[i]).all() or not has[i]


def family(n, seed=1):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(120)]
    out = []
    for k in range(n):
        w = list(base)
        for i in rng.choice(120, rng.integers(0, 12), replace=False):
            w[i] = f"e{k}_{i}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [8, 1024])
def test_family_blocks_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = dict(enumerate(family(150)))
    texts |= {200: None, 201: "", 202: " ", 203: "one two", 204: "one two", 205: "long " * 20000, 206: "long " * 20001}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("node", F.lit(1))
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    assert got == brute(texts)
    if block == 1024:
        more = df.unionByName(spark.createDataFrame([(None, texts[3], 1), (3, texts[3], 1)], df.schema))
        assert neardup.classes(more).count() == len(texts) + 2
        kept = neardup.one_of_each(more)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
        assert neardup.classes(df.limit(0)).collect() == []


def test_components(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 102: 100}


def test_bags_are_those_of_the_words():
    for t in ("", " ", "a", "a b c d", "a b c d e", "a b c d e " * 9, "\x0b é  ü\tq r s a b c d e f"):
        assert Counter({b" ".join(k): n for k, n in own_bag(t).items()}) == neardup.bag(t)


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits)


def test_words_that_polynomials_confuse_are_told_apart(spark):
    x = thue_morse(1024)
    y = x.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, x), (2, y), (3, f"p q r s {x}"), (4, f"p q r s {y}")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_clashing_columns_string_ids_and_a_stable_choice(spark):
    rows = [("b", "x y z", 1, 2, 3), ("a", "x y z", 4, 5, 6), ("a", "x y z", 7, 8, 9), ("c", "other", 1, 1, 1), (None, "other", 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _own int, _k int, row int")
    got = [sorted(map(tuple, neardup.one_of_each(d).collect())) for d in (df, df.repartition(5), df.orderBy(F.col("_own").desc()))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 2 and set(got[0]) <= set(rows) and got[0][0][0] == "a"
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == {"a": "a", "b": "a", "c": "c", None: "c"}


def test_hot_join(spark, monkeypatch):
    from corvane.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    left = spark.createDataFrame([(k % 7 if k % 2 else 1, k) for k in range(50)] + [(99, 0)], "a int, k int")
    right = spark.createDataFrame([(k, str(k)) for k in range(6)], "a int, v string")
    for how in ("inner", "left"):
        assert sorted(map(str, common.hot_join(left, right, "a", how).collect())) == sorted(map(str, left.join(right, "a", how).collect()))
