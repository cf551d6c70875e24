import numpy as np
from pyspark.sql import functions as F

from corvane.llm import topk
from corvane.llm.queries import op2_topk

SF = "/root/testdata/sf0.01"


def brute(vectors, queries, k=5, more=()):
    """The k best of every row of vectors {id: v} and further rows (id, v), but the query's own id."""
    rows = [*vectors.items(), *more]
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], dtype=np.int64)
    out = []
    for q in queries:
        s = x @ np.array(vectors[q], dtype=np.int64)
        best = sorted((-v, i) for v, i in zip(s.tolist(), ids, strict=True) if i != q)[:k]
        out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(best)]
    return sorted(out)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.floor(256 * np.array(r.embedding, dtype=np.float64)).astype(int).tolist() for r in rows}
    got = sorted(tuple(r)[:4] for r in op2_topk(spark, SF).collect())
    assert got == brute(vectors, [i for i in vectors if i % 50 == 0])


def test_blocks_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(0)
    vectors = {i: rng.integers(-3, 4, 4).tolist() for i in range(600)} | {i: [9, 9, 9, 9] for i in range(600, 900)}
    df = spark.createDataFrame([(i, [x / 256 for x in v], "x") for i, v in vectors.items()], "vec_id long, embedding array<double>, v string")
    odd = spark.createDataFrame([(1000, None, ""), (1050, [1.0, None, 1.0, 1.0], ""), (1100, [float("nan")] * 4, ""), (1150, [float("inf")] * 4, ""), (None, [1.0] * 4, ""), (1200, [], ""), (0, [x / 256 for x in vectors[0]], "again")], df.schema)
    both = df.unionByName(odd).select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("v"), F.lit(1).alias("block"))
    queries = both.where("id % 50 = 0")
    want = brute(vectors, [i for i in vectors if i % 50 == 0], more=[(0, vectors[0])])
    assert sorted(tuple(r)[:4] for r in topk.top(both, queries).collect()) == want
    assert topk.top(both.limit(0), queries.limit(0)).collect() == []
    three = both.where("id in (1, 2, 50)")
    assert topk.top(three, three).count() == 6


def test_triangle_bounds_save_distances():
    rng = np.random.default_rng(1)
    centers = rng.integers(-200, 200, (40, 8))
    x = (centers[rng.integers(0, 40, 4000)] + rng.integers(-3, 4, (4000, 8))).astype(np.float64)
    norm = float((x * x).sum(axis=1).max())
    lifted = np.hstack([x, np.sqrt(norm - (x * x).sum(axis=1))[:, None]])
    pages = dict(enumerate(topk.build(lifted, np.arange(4000))))
    for p in pages.values():
        p["whole"] = p["vector"][:, :-1].astype(np.int64) if p["leaf"] else None
    found, computed = topk.search(pages, norm, x[7].astype(np.int64), 7, 5)
    assert computed < 2000 and [(7, r + 1, i, s) for r, (s, i) in enumerate(found)] == brute({i: v.astype(int).tolist() for i, v in enumerate(x)}, [7])
    # A bound from elsewhere saves more, and loses nothing that reaches it.
    bounded, fewer = topk.search(pages, norm, x[7].astype(np.int64), 7, 5, found[2][0])
    assert fewer <= computed and bounded == [f for f in found if f[0] >= found[2][0]]


def test_repeated_rows_and_one_id_with_two_vectors(spark):
    rows = spark.createDataFrame([(1, [2, 1]), (1, [2, 1]), (50, [1, 0]), (50, [0, 1]), (50, [0, 1]), (3, [1, 1])], "id long, v array<long>")
    out = topk.top(rows, rows.where("id = 50"), 3).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in out) == [(1, 1, 1), (1, 1, 2), (2, 1, 1), (2, 1, 2), (3, 3, 1), (3, 3, 1)]
    assert len({r.query_print for r in out}) == 2
