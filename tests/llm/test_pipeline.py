from collections import Counter, defaultdict

import corpus_pipeline
from corvane.llm import neardup, pii, toxicity
from corvane.llm.common import table, words
from tests.llm.test_mixing import brute_targets
from tests.llm.test_neardup import brute
from tests.llm.test_packing import held

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    want = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    scores = dict(zip(want, model.scorer()([r.text for r in want.values()]), strict=True))
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    now = stage["toxicity"](spark, docs, SF)
    assert now.columns == docs.columns
    clean = {k: want[k].text for k in want if scores[k] < 0.5}
    assert {r.doc_id: r.text for r in now.collect()} == clean

    now = stage["near_dedup"](spark, now, SF)
    assert now.columns == docs.columns
    one = {k: clean[k] for k, root in brute(clean).items() if k == root}
    assert {r.doc_id: r.text for r in now.collect()} == one

    now = stage["pii"](spark, now, SF)
    assert now.columns == docs.columns
    masked = {k: pii.masked(t, pii.spans_of(t)) for k, t in one.items()}
    assert {r.doc_id: r.text for r in now.collect()} == masked

    now = stage["mixing"](spark, now, SF)
    assert now.columns == docs.columns
    sizes, got, times = Counter(), Counter(), Counter()
    for k, t in masked.items():
        sizes[want[k].source] += len(words(t))
    rows = now.collect()
    for r in rows:
        assert masked[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) and r.source == want[r.doc_id].source
        got[r.source] += len(words(r.text))
        times[r.doc_id] += 1
    assert max(times.values()) <= 3
    for s, t in brute_targets(sizes).items():
        assert abs(got[s] - t) <= 1

    placed = corpus_pipeline.run(spark, SF).collect()
    assert sum(r.n_words for r in placed) == sum(got.values())
    held(placed, {})
    # The pieces of each document, put together, are what the mix took of it, as often as it took it.
    whole = {k: Counter() for k in masked}
    for r in rows:
        whole[r.doc_id][r.text] += 1
    made = {k: Counter() for k in masked}
    by = defaultdict(list)
    for r in placed:
        by[r.doc_id, r.cluster].append(r)
    for (k, _), x in by.items():
        n = sum(r.piece == 0 for r in x)
        x.sort(key=lambda r: r.piece)
        made[k]["".join(r.text for r in x[::n])] += n
    assert made == whole
    assert neardup.LEAST == 0.8


def test_odd_tables(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars int, _toxicity double, _k int, bin string"
    many = " ".join(f"word{i} other{i % 7}" for i in range(3000))
    rows = [(1, "a b c d e f g", "en", "s", 13, 0.1, 1, "b"), (1, "a b c d e f g", "en", "s", 13, 0.1, 1, "b"), (None, "a b c d e f g", None, None, 1, None, 2, None), (2, None, "en", "t", 0, None, 3, ""), (3, "", "en", None, 0, 0.0, 4, ""), (2**53 + 1, many, "en", "t", len(many), 0.5, 5, "c"), (5, "mail x@y.zz now and then again", "en", "u", 9, 0.5, 6, "d")]
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (9, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {1, 5, 2**53 + 1}
    assert {r.text for r in out if r.doc_id == 5} == {"mail [EMAIL] now and then again"[: len(x.text)] for x in out if x.doc_id == 5}
    docs = spark.createDataFrame(rows, kinds)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.dtypes == docs.dtypes
    for name in ("documents", "labels"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
