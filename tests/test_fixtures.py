"""Hand-computed cases."""

import gzip
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corvane import cli
from corvane.functions import codec
from corvane.functions.text import tokens
from corvane.functions.time import bucket, parsed
from corvane.operators import components as components_of
from corvane.operators import cooc, counts, graph, index, pagerank, timeseries
from corvane.plans import lineage
from corvane.sources import readers, sinks
from corvane.streaming import hourly

TEXT = "a b c\na b\na a b\nb c\n  a  b  \n\n"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("text") / "six.txt"
    path.write_text(TEXT)
    return str(path)


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return readers.lines_with_offset(spark, corpus).withColumnRenamed("value", "text")


def as_dict(df, n=1):
    return {(tuple(r)[:n] if n > 1 else r[0]): tuple(r)[n:] if len(r) > n + 1 else r[n] for r in df.collect()}


def test_text_counts(spark, corpus, tmp_path):
    lines = readers.lines(spark, corpus)
    assert as_dict(counts.word_count(lines, "value")) == {"a": 5, "b": 5, "c": 2}
    assert as_dict(counts.bigram_count(lines, "value"), 2) == {("a", "b"): 4, ("b", "c"): 2, ("a", "a"): 1}
    assert as_dict(counts.bigram_count_text(lines, "value")) == {"a_b": 4, "b_c": 2, "a_a": 1}
    with gzip.open(tmp_path / "six.txt.gz", "wt") as f:
        f.write(TEXT)
    assert as_dict(counts.word_count(readers.lines(spark, str(tmp_path / "six.txt.gz")), "value")) == {"a": 5, "b": 5, "c": 2}
    odd = spark.createDataFrame([("* &c (091) ''but A9 ok",)], "text string")
    assert as_dict(counts.word_count(odd, pattern="^[A-Za-z]+$")) == {"ok": 1}
    assert odd.select(tokens(F.col("text"))).first()[0] == ["*", "&c", "(091)", "''but", "A9", "ok"]


def test_offsets(docs):
    assert sorted((r.docno, r.text) for r in docs.collect())[:4] == [(0, "a b c"), (6, "a b"), (10, "a a b"), (16, "b c")]


def test_cooccurrence(docs):
    how = {"line": "text", "key": ("docno",)}
    assert as_dict(cooc.marginals(docs, 1, "text")) == {"a": 4, "b": 5, "c": 2}
    pairs = {(r.left, r.right): r.cnt for r in cooc.pairs(docs, 1, **how).collect()}
    assert pairs == {("a", "b"): 4, ("b", "a"): 4, ("a", "c"): 1, ("c", "a"): 1, ("b", "c"): 2, ("c", "b"): 2}
    assert as_dict(cooc.conditional(docs, 1, **how), 2) == {("a", "b"): 1.0, ("a", "c"): 0.25, ("b", "a"): 0.8, ("b", "c"): 0.4, ("c", "a"): 0.5, ("c", "b"): 1.0}
    plain = as_dict(cooc.pmi(docs, 1, normalise=False, **how), 2)
    assert plain["a", "b"] == pytest.approx(-1.609438, abs=1e-6) and plain["c", "a"] == pytest.approx(-2.079442, abs=1e-6)
    full = as_dict(cooc.pmi(docs, 1, **how), 2)
    assert full["a", "b"] == pytest.approx(0.182322, abs=1e-6) and full["a", "c"] == pytest.approx(-0.287682, abs=1e-6)
    striped = as_dict(cooc.pmi_stripes(docs, 1, **how), 2)
    assert striped.keys() == full.keys() and all(striped[k] == pytest.approx(v) for k, v in full.items())
    best = cooc.pmi_max(cooc.pmi(docs, 1, normalise=False, **how)).first()
    assert (best.left, best.right) == ("a", "b")
    assert [r.right for r in cooc.pmi_topk(cooc.pmi(docs, 1, **how), "a", 5).collect()] == ["b", "c"]
    assert cooc.pmi(docs, 10, **how).count() == 0


def test_index_and_codec(docs):
    built = index.build_index(docs)
    found = {r.term: [tuple(p) for p in r.postings] for r in built.collect()}
    assert found == {"a": [(0, 1), (6, 1), (10, 2), (20, 1)], "b": [(0, 1), (6, 1), (10, 1), (16, 1), (20, 1)], "c": [(0, 1), (16, 1)]}
    assert as_dict(index.document_frequencies(built)) == {"a": 4, "b": 5, "c": 2} and {r.chunk for r in built.collect()} == {0}
    slow = index.build_index(docs, unique=False)
    assert sorted(map(str, slow.collect())) == sorted(map(str, built.collect()))
    chunked = index.build_index(docs, chunk=10)
    assert {(r.term, r.chunk, r.n): [tuple(p) for p in r.postings] for r in chunked.collect()}["a", 1, 1] == [(10, 2)]
    assert as_dict(index.document_frequencies(chunked)) == {"a": 4, "b": 5, "c": 2}
    assert sorted(map(tuple, index.lookup(chunked, "a").collect())) == found["a"]
    packed = index.compressed(built)
    assert {r.term: bytes(r.blob).hex().upper() for r in packed.collect()} == {"a": "040001060104020A01", "b": "0500010601040106010401", "c": "0200011001"}
    assert {r.term: (r.n, [tuple(p) for p in r.postings]) for r in index.decompressed(packed).collect()} == {t: (len(p), p) for t, p in found.items()}
    for q, want in (("a c AND", {0}), ("a c OR", {0, 6, 10, 16, 20}), ("zzz a AND", set()), ("a c AND b OR", {0, 6, 10, 16, 20})):
        assert {r.docno for r in index.boolean_query(built, q).collect()} == want
    assert sorted(r.text for r in index.fetch(index.boolean_query(built, "a c AND"), docs).collect()) == ["a b c"]
    assert as_dict(index.tf_histogram(built, "a")) == {1: 3, 2: 1} and index.lookup(built, "zzz").count() == 0
    for bad in ("a AND", "a b", "", "AND"):
        with pytest.raises(ValueError):
            index.parsed_query(bad)


@pytest.mark.parametrize("value, code", [(3, "03"), (127, "7F"), (128, "8F80"), (255, "8FFF"), (256, "8E0100"), (300, "8E012C"), (65536, "8D010000"), (1000000000, "8C3B9ACA00"), (0, "00"), (1 << 40, "8A010000000000")])
def test_vint(value, code):
    data, size = codec.write_vints(np.array([value]))
    assert data.tobytes().hex().upper() == code and size.tolist() == [len(code) // 2]
    assert codec.read_vints(data, np.array([0]), np.array([len(data)]))[0].tolist() == [value]


def test_many_vints():
    values = np.array([-1, -112, -113, -256, -65537, 5, -(1 << 50), (1 << 62) + 12345, 127, 128] * 40)
    data, size = codec.write_vints(values)
    ends = np.cumsum(size)
    got, counts = codec.read_vints(data, np.array([0, ends[6], ends[6]]), np.array([ends[6], ends[6], ends[-1]]))
    assert got.tolist() == values.tolist() and counts.tolist() == [7, 0, 393]


def test_lists_and_blobs(spark):
    rng = np.random.default_rng(0)
    lists = [sorted(rng.choice(1 << 40, n, replace=False).tolist()) for n in (0, 1, 5, 300, 0, 2)]
    tfs = rng.integers(1, 1000, sum(map(len, lists)))
    blobs = codec.encode_lists(np.array(sum(lists, []), dtype=np.int64), tfs, np.array([len(x) for x in lists]))
    docnos, got, sizes = codec.decode_lists([*blobs, b""])
    assert docnos.tolist() == sum(lists, []) and got.tolist() == tfs.tolist() and sizes.tolist() == [*map(len, lists), 0]
    rows = spark.createDataFrame([(None,), ([(3, 1), (300, 2)],), ([],)], "postings array<struct<docno:bigint,tf:int>>")
    back = [r.p for r in rows.select(codec.encoded("postings").alias("b")).select(codec.decoded("b").alias("p")).collect()]
    assert back == [None, [(3, 1), (300, 2)], []]


def made(spark, lists):
    rows = spark.createDataFrame(list(lists.items()), "id long, adj array<long>")
    return graph.from_adjacency(rows)


def test_pagerank(spark):
    t = made(spark, {1: [2, 4], 2: [3, 5], 3: [4], 4: [5], 5: [1, 2, 3]})
    one, three = as_dict(pagerank.pagerank(*t, 1)), as_dict(pagerank.pagerank(*t, 3))
    assert [round(one[k], 6) for k in range(1, 6)] == [0.086667, 0.171667, 0.171667, 0.285, 0.285]
    assert [round(three[k], 6) for k in range(1, 6)] == [0.127809, 0.174878, 0.190532, 0.233221, 0.27356]
    t2 = made(spark, {1: [2, 3], 2: [3], 3: [], 4: [9]})
    assert [round(v, 6) for _, v in sorted(as_dict(pagerank.pagerank(*t2, 3)).items())] == [0.166328, 0.237018, 0.430326, 0.166328]
    ppr = {r.id: r.p for r in pagerank.personalized_pagerank(*t2, [1], 3).collect()}
    assert [round(ppr[k], 6) for k in range(1, 5)] == [0.51125, 0.217281, 0.271469, 0]
    assert as_dict(graph.missing_targets(*t2)) == {9: 1}
    assert tuple(graph.stats(*t2).first()) == (4, 4, 3, 1)
    done = as_dict(pagerank.pagerank(*t, tolerance=1e-10))
    assert sum(done.values()) == pytest.approx(1) and all(done[k] == pytest.approx(v, abs=1e-6) for k, v in as_dict(pagerank.pagerank(*t, 150)).items())
    logs = as_dict(pagerank.with_log(pagerank.personalized_pagerank(*t2, [1], 1)).select("id", "logp"))
    assert logs[4] is None and logs[1] == pytest.approx(math.log(0.15))
    with pytest.raises(ValueError):
        pagerank.personalized_pagerank(*t2, [77], 1)
    tops = pagerank.top_personalized(pagerank.personalized_pagerank(*t, [1, 2], 2), 2).collect()
    assert [(r.source, r.place) for r in sorted(tops)] == [(1, 1), (1, 2), (2, 1), (2, 2)]


def slow_ranks(lists, iterations, alpha=0.15):
    nodes = sorted(lists)
    p = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(iterations):
        m = dict.fromkeys(nodes, 0.0)
        for k, out in lists.items():
            for t in out:
                if t in m:
                    m[t] += p[k] / len(out)
        lost = max(0.0, 1 - sum(m.values()))
        p = {k: alpha / len(nodes) + (1 - alpha) * (v + lost / len(nodes)) for k, v in m.items()}
    return p


def own_graph(n=120, seed=3):
    """Sparse ids, cycles, nodes without edges, parallel edges, and edges to ids without a record."""
    rng = np.random.default_rng(seed)
    ids = rng.choice(10**7, n, replace=False).tolist()
    return {k: rng.choice([*ids[: n // 2], 5], rng.integers(0, 4)).tolist() if i % 3 else [] for i, k in enumerate(ids)}


def test_a_graph_against_slow_ranks(spark, tmp_path):
    lists = own_graph()
    (tmp_path / "g.txt").write_text("".join("\t".join(map(str, [k, *out])) + "\n" for k, out in lists.items()))
    nodes, edges = graph.from_adjacency(readers.adjacency(spark, str(tmp_path / "g.txt")))
    want = slow_ranks(lists, 10)
    got = as_dict(pagerank.pagerank(nodes, edges, 10))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    # Broken off after four iterations and taken up again; iteration 4 is there to read.
    base = str(tmp_path / "base")
    pagerank.pagerank_from(nodes, edges, base, 0, 4)
    assert as_dict(readers.iteration(spark, base, 4)) == pytest.approx(slow_ranks(lists, 4))
    assert as_dict(pagerank.pagerank_from(nodes, edges, base, 4, 10)) == pytest.approx(want)
    assert as_dict(pagerank.pagerank(nodes, edges, 6, start=readers.iteration(spark, base, 4))) == pytest.approx(want)
    with pytest.raises(AnalysisException):
        pagerank.pagerank_from(nodes, edges, base, 77, 78)
    # Counters and summary.
    sent = [t for out in lists.values() for t in out]
    assert tuple(pagerank.counters(nodes, edges).first()) == (len(lists), len(sent), len(sent), len(sent), len({t for t in sent if t not in lists}))
    root = {k: k for k in [*lists, *sent]}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, out in lists.items():
        for t in out:
            x, y = sorted((find(k), find(t)))
            root[y] = x
    parts = {k: find(k) for k in lists}
    assert as_dict(graph.weak_components(nodes, edges)) == parts
    assert tuple(graph.summary(nodes, edges, 0.2).first()) == (len(set(parts.values())), len(sent), len(lists), 0.2)


def test_what_ranks_refuse(spark):
    t = made(spark, {1: [2], 2: [1, 3], 3: []})
    for f in (lambda n: pagerank.pagerank(n, t[1]), lambda n: pagerank.personalized_pagerank(n, t[1], [1])):
        with pytest.raises(ValueError, match="more than one record"):
            f(t[0].unionByName(t[0].where("id = 1")))
    with pytest.raises(RuntimeError, match="still change"):
        pagerank.pagerank(*t, tolerance=1e-12, most=3)


@pytest.mark.parametrize("hub", [4, 1024])
def test_components_with_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(components_of, "HUB_LINKS", hub)
    pairs = [(0, k) for k in range(1, 60)] + [(100 + k, 99) for k in range(30)] + [(200 + k, 201 + k) for k in range(20)] + [(59, 129), (7, 7)]
    got = {r.node: r.root for r in components_of.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 0 for k in [*range(60), *range(99, 130)]} | {k: 200 for k in range(200, 221)}


@pytest.mark.parametrize("long", [3, 4096])
def test_long_lines_are_paired_by_blocks(spark, monkeypatch, long):
    monkeypatch.setattr(cooc, "LONG", long)
    monkeypatch.setattr(cooc, "HELD", 5)
    monkeypatch.setattr(cooc, "PARTNERS", 2)
    rows = [(1, "a b c d e f g h"), (2, "a b"), (3, "h g f e d c b a a"), (4, "c e g")]
    df = spark.createDataFrame(rows, "docno long, text string")
    want = {}
    for _, t in rows:
        s = set(t.split())
        for x in s:
            for y in s - {x}:
                want[x, y] = want.get((x, y), 0) + 1
    how = {"line": "text", "key": ("docno",)}
    assert {(r.left, r.right): r.cnt for r in cooc.pairs(df, 1, **how).collect()} == want
    striped = cooc.stripes(df, 1, **how)
    assert {(r.left, r.right): r.cnt for r in cooc.stripe_pairs(striped).collect()} == want and striped.agg({"part": "max"}).first()[0] > 0
    a, b = (as_dict(f(df, 1, **how), 2) for f in (cooc.pmi, cooc.pmi_stripes))
    assert a == pytest.approx(b)


def _lines(spark, n=400):
    draw = np.random.default_rng(7)
    return spark.createDataFrame([(k, " ".join(f"w{int(x)}" for x in draw.zipf(1.3, 30) % 3000)) for k in range(n)], "docno long, text string")


@pytest.mark.parametrize("frequent, words, held", [(8192, 1 << 22, 1 << 22), (20, 1 << 22, 300), (2, 0, 300), (0, 0, 1 << 22)])
def test_pairs_of_frequent_and_of_rare_terms(spark, monkeypatch, frequent, words, held):
    for name, value in {"FREQUENT": frequent, "WORDS": words, "HELD": held, "TOKENS": 200, "ROWS": 50, "PARTNERS": 64}.items():
        monkeypatch.setattr(cooc, name, value)
    df, want, alone = _lines(spark), {}, {}
    for r in df.collect():
        s = set(r.text.split())
        for x in s:
            alone[x] = alone.get(x, 0) + 1
            for y in s - {x}:
                want[x, y] = want.get((x, y), 0) + 1
    want = {(x, y): (c, alone[x], alone[y]) for (x, y), c in want.items() if c >= 3}
    how = {"line": "text", "key": ("docno",)}
    assert {(r.left, r.right): tuple(r)[2:] for r in cooc.pairs(df, 3, **how).collect()} == want
    striped = cooc.stripes(df, 3, **how).collect()
    assert {(r.term, y): (c, r.cnt) for r in striped for y, c in r.stripe.items()} == {k: v[:2] for k, v in want.items()}
    assert len(striped) == len({(r.term, r.part) for r in striped})
    a, b = (as_dict(f(df, 3, **how), 2) for f in (cooc.pmi, cooc.pmi_stripes))
    assert a.keys() == want.keys() and a == pytest.approx(b)


def test_a_pair_is_shuffled_in_few_bytes(spark, monkeypatch):
    """Pairs were shuffled at some twelve bytes each."""
    monkeypatch.setattr(cooc, "FREQUENT", 2)
    df = _lines(spark, 4000).coalesce(1)
    terms = cooc._numbered(df, 1, "text")
    packets, _, _ = cooc._summing(df, terms, "text", ("docno",))
    n, size = packets.selectExpr("sum(n)", "sum(length(keys) + length(cnts))").first()
    assert n > 100_000 and size < 3 * n


@pytest.mark.parametrize("words", [1 << 22, 0])
def test_pairs_are_shuffled_in_rounds(spark, monkeypatch, words):
    """All pairs were shuffled at once, which took more disk than the lines' own growth."""
    for name, value in {"FREQUENT": 20, "WORDS": words, "HELD": 4000, "SHARE": 2, "PARTNERS": 64}.items():
        monkeypatch.setattr(cooc, name, value)
    df, how = _lines(spark, 1500), {"line": "text", "key": ("docno",)}
    first, later, _ = cooc._summing(df, cooc._numbered(df, 1, "text"), "text", ("docno",))
    sizes = [sum(r.n for r in part.where("dense < 0").select("n").collect()) for part in (first, *later)]
    assert len(sizes) > 3 and max(sizes) < 2 * sum(sizes) / len(sizes)
    want, alone = {}, {}
    for r in df.collect():
        s = set(r.text.split())
        for x in s:
            alone[x] = alone.get(x, 0) + 1
            for y in s - {x}:
                want[x, y] = want.get((x, y), 0) + 1
    want = {(x, y): (c, alone[x], alone[y]) for (x, y), c in want.items() if c >= 3}
    rows = cooc.pairs(df, 3, **how).collect()
    assert len(rows) == len(want) and {(r.left, r.right): tuple(r)[2:] for r in rows} == want
    rows = cooc.stripe_pairs(cooc.stripes(df, 3, **how)).collect()
    assert len(rows) == len(want) and {(r.left, r.right): r.cnt for r in rows} == {k: v[0] for k, v in want.items()}


def test_empty_partners_are_the_line_itself():
    """They were null, which Spark wrote to Python in a time that grew with the square of a batch's rows."""
    kind = pa.list_(pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.array([[0, 2, 5], [2, 5]], kind), pa.array([[], []], kind), pa.array([True, True])], names=["left", "right", "same"])
    out = list(cooc._paired(1, 1, 0, 6, 0, 100)(iter([batch])))
    key, cnt = cooc._read(iter(out), 100, {})
    assert [(int(k) >> 32, int(k) & 0xFFFFFFFF, int(c)) for k, c in zip(key, cnt, strict=True)] == [(2, 0, 1), (5, 0, 1), (5, 2, 2)]


def _shuffles(spark):
    ids = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keysIterator()
    found = set()
    while ids.hasNext():
        found.add(ids.next())
    return found


def test_a_round_deletes_its_shuffle(spark, monkeypatch):
    """The files of a round stayed until the driver collected its garbage, mostly through the next one."""
    for name, value in {"FREQUENT": 20, "HELD": 4000, "SHARE": 2, "released": lambda spark: None}.items():
        monkeypatch.setattr(cooc, name, value)
    df = _lines(spark, 1500)
    before = _shuffles(spark)
    terms = cooc._numbered(df, 3, "text")
    counted, tasks = cooc._counted(df, terms, 3, "text", ("docno",))
    assert tasks > 3 * spark.sparkContext.defaultParallelism  # more than three rounds
    assert len(_shuffles(spark) - before) <= 2  # the two counts of rows
    assert counted.count() > 0 and spark.conf.get(lineage.CLEANED) == "false"
    df.groupBy("docno").count().collect()
    assert _shuffles(spark) - before  # other frames keep theirs


def _rows_of(monkeypatch):
    """The numbers of terms whose pairs are counted from now on."""
    sizes, counted = [], cooc._counted
    monkeypatch.setattr(cooc, "_counted", lambda lines, terms, *how: sizes.append(terms.size) or counted(lines, terms, *how))
    return sizes


COMMON = [f"a{k % 2} b{k % 3} c{k % 5} d" for k in range(60)]
BEST = [
    ([f"{t} x y" if k % 10 == 0 else t for k, t in enumerate(COMMON)], 3, 1 << 22, 8, 1),  # two rare terms, always together
    ([f"{t} r{k % 12}" for k, t in enumerate(COMMON)], 3, 0, 8, 2),  # rare terms, none of which meets another
    (["x y"] * 9 + ["x", "y"] * 9 + ["a b"] * 36 + ["o"] * 50, 1, 1 << 22, 4, 2),  # 9 / (18 * 18) is 36 / (36 * 36), and a, b come first
]


@pytest.mark.parametrize("texts, least, words, rare, passes", BEST)
def test_the_best_pair_is_found_from_the_rare_terms_on(spark, monkeypatch, texts, least, words, rare, passes):
    """All pairs were counted for one row."""
    monkeypatch.setattr(cooc, "WORDS", words)
    monkeypatch.setattr(cooc, "RARE", rare)
    sizes, alone, both = _rows_of(monkeypatch), {}, {}
    for s in (set(t.split()) for t in texts):
        for x in s:
            alone[x] = alone.get(x, 0) + 1
            for y in s - {x}:
                both[x, y] = both.get((x, y), 0) + 1
    want = min((-round(math.log(c / (alone[x] * alone[y]) * len(texts)), 6), x, y) for (x, y), c in both.items() if c >= least)
    df = spark.createDataFrame(list(enumerate(texts)), "docno long, text string").coalesce(2)
    assert [(-r.pmi, r.left, r.right) for r in cooc.pmi_best(df, least, line="text", key=("docno",)).collect()] == [want]
    assert len(sizes) == passes and sizes[0] < len(alone)


def test_partners_of_a_word_need_no_other_pairs(spark, monkeypatch):
    """All pairs were counted for one word."""
    df, how = _lines(spark).coalesce(2), {"line": "text", "key": ("docno",)}
    df = df.unionAll(spark.createDataFrame([(-1, None), (-2, ""), (-3, "w1 w1 alone w2")], df.schema))
    all_pairs = {(r.left, r.right): r.pmi for r in cooc.pmi(df, 3, **how).collect()}
    sizes = _rows_of(monkeypatch)
    for word in ("w1", "alone", "absent"):
        got = cooc.pmi_of(df, word, 3, line="text").collect()
        assert {(r.left, r.right): r.pmi for r in got} == {k: v for k, v in all_pairs.items() if k[0] == word}
        assert len({r.right for r in got}) == len(got) and (got or word in ("alone", "absent"))
    assert not sizes


def test_counted_rows_are_sent_by_bounded_batches(monkeypatch):
    monkeypatch.setattr(index, "ROWS", 100)
    texts = [" ".join(f"t{j}" for j in range(30))] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(texts)], names=["docno", "text"])
    sizes = [b.num_rows for b in index._counted(iter([batch]))]
    assert sum(sizes) == 1500 and max(sizes) < 130


def test_documents_reach_python_line_by_line(spark, monkeypatch):
    """A batch held some thousand whole documents."""

    def sizes(batches):
        import pyarrow

        for b in batches:
            yield pyarrow.RecordBatch.from_pydict({"term": ["size"], "docno": [b.nbytes], "tf": pyarrow.array([1], pyarrow.int32())})

    df = spark.createDataFrame([(k, "a b c d e f g h\n" * 2000) for k in range(200)], "docno long, text string").coalesce(1)
    got = index.term_frequencies(df).where("docno % 50 = 7")
    assert {(r.term, r.docno, r.tf) for r in got.collect()} == {(t, k, 2000) for t in "abcdefgh" for k in (7, 57, 107, 157)} and got.count() == 32
    monkeypatch.setattr(index, "_counted", sizes)
    assert max(r.docno for r in index.term_frequencies(df).collect()) < 1 << 20


def test_lists_are_coded_by_bounded_slices(spark, monkeypatch):
    held = []
    for name in ("encode_lists", "decode_lists"):
        real = getattr(codec, name)
        monkeypatch.setattr(codec, name, lambda *a, f=real: (held.append(len(a[0]) if len(a) > 1 else sum(map(len, a[0]))), f(*a))[1])
    monkeypatch.setattr(codec, "TOGETHER", 100)
    monkeypatch.setattr(codec.F, "arrow_udf", lambda f, kind: lambda column: f(column))
    kind = pa.list_(pa.struct([("docno", pa.int64()), ("tf", pa.int32())]))
    lists = pa.array([None if k % 7 == 3 else [{"docno": 5 * j, "tf": j + 1} for j in range(k % 40)] for k in range(300)], kind)
    assert codec.decoded(codec.encoded(lists)).to_pylist() == lists.to_pylist()
    assert len(held) > 50 and max(held) <= 100
    assert codec.decoded(codec.encoded(lists[:0])).to_pylist() == []


def test_rows_of_one_document_are_counted_together(spark):
    rows = [(k % 40, f"a b{k % 3} a") for k in range(200)] + [(None, "a"), (7, None), (7, "")]
    df = spark.createDataFrame(rows, "docno long, text string").repartition(5)
    want = {}
    for d, t in rows:
        for w in (t or "").split():
            want[w, d] = want.get((w, d), 0) + 1
    got = index.term_frequencies(df, unique=False)
    assert {(r.term, r.docno): r.tf for r in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan  # texts are shuffled, not a row for each token


def test_ranks_go_through_lists_of_targets(spark, monkeypatch):
    links = {k: [(k * j + 1) % 60 for j in range(1, 1 + k % 23)] for k in range(60)}
    t = made(spark, links)
    want = as_dict(pagerank.pagerank(*t, iterations=6))
    monkeypatch.setattr(pagerank, "LINKS", 4)
    shares = pagerank.shared_edges(t[1]).collect()
    assert len(shares) < sum(map(len, links.values())) and max(len(r.dsts) for r in shares) < 14
    assert sorted((r.src, d) for r in shares for d in r.dsts) == sorted((k, d) for k, ds in links.items() for d in ds)
    assert as_dict(pagerank.pagerank(*t, iterations=6)) == pytest.approx(want, abs=1e-12)
    exact = as_dict(pagerank.pagerank(*t, tolerance=1e-9))
    assert exact == pytest.approx(as_dict(pagerank.pagerank(*t, iterations=150)), abs=1e-8)


def test_a_line_is_split_once(spark):
    df = spark.createDataFrame([("a b c",)], "line string")
    plan = counts.bigram_count(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1, plan


def test_checkpoints_of_a_cluster_need_a_shared_folder(spark):
    class Cluster:
        master = "spark://far:7077"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    fake = type("F", (), {"sparkContext": Cluster, "conf": type("C", (), {"get": staticmethod(lambda *a: None)})})
    with pytest.raises(RuntimeError, match="checkpoint"):
        lineage.folder(fake)


def test_partitions_keep_the_nodes(spark):
    nodes = spark.range(100).toDF("id")
    for mode in ("hash", "range", "sampled"):
        out = graph.partitioned(nodes, 4, mode).select("id", F.spark_partition_id().alias("part"))
        assert {r.id for r in out.collect()} == set(range(100)) and out.select("part").distinct().count() == 4


def test_adjacency_files(spark, tmp_path):
    (tmp_path / "g.txt").write_text("1\t2\t3\n 2  3 \n3\n\n")
    nodes, edges = graph.from_adjacency(readers.adjacency(spark, str(tmp_path / "g.txt")))
    assert {r.id for r in nodes.collect()} == {1, 2, 3} and {tuple(r) for r in edges.collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {tuple(r) for r in readers.tab_edges(spark, str(tmp_path / "g.txt")).collect()} == {(1, 2), (1, 3)}
    (tmp_path / "odd.txt").write_text("x 1\n7 y\n8 9\n4\tz\t5\n")
    assert {tuple(r) for r in graph.from_adjacency(readers.adjacency(spark, str(tmp_path / "odd.txt")))[1].collect()} == {(8, 9)}
    assert {tuple(r) for r in readers.tab_edges(spark, str(tmp_path / "odd.txt")).collect()} == {(4, 5)}
    lists = graph.to_adjacency(nodes, edges)
    assert as_dict(lists) == {1: [2, 3], 2: [3], 3: []}


def test_events(spark, tmp_path):
    rows = ["1\tSun Jan 23 00:00:00 +0000 2011\tu\tto EgYPT", "2\tSun Jan 23 00:59:59 +0000 2011\tu\tCAIRO\tmore", "3\tnot a time\tu\tegypt", "4\tSun Jan 23 01:00:00 +0000 2011", "5\tSun Jan 23 00:10:00 +0000 2011\tu\t"]
    (tmp_path / "e.tsv").write_text("\n".join(rows) + "\n")
    events = timeseries.parsed_events(readers.events(spark, str(tmp_path / "e.tsv")))
    assert as_dict(timeseries.hourly_counts(events, F.col("ts"))) == {"1/23 00": 3, "1/23 01": 1}
    assert as_dict(timeseries.hourly_counts(events, F.col("ts"), "yyyyMMddHH", "America/New_York")) == {"2011012219": 3, "2011012220": 1}
    assert as_dict(timeseries.hourly_counts(timeseries.with_keyword(events, "text", ["egypt", "cairo"]), F.col("ts"))) == {"1/23 00": 2}
    assert timeseries.matching(events, "text", ["egypt", "cairo"]).count() == 2
    assert {tuple(r) for r in timeseries.month_day_hour_counts(events, F.col("ts")).collect()} == {(1, 23, 0, 3), (1, 23, 1, 1)}
    assert readers.events_csv(spark, str(tmp_path / "e.tsv")).where("id = '4' and text is null").count() == 1
    assert spark.range(1).select(bucket(parsed(F.lit("Sun Jan 23 00:00:00 +0000 2011")), "M/dd HH")).first()[0] == "1/23 00"


def test_sinks_and_programs(spark, corpus, tmp_path, docs):
    sinks.write_tuples(spark.createDataFrame([("&c", "x", 1.5)], "left string, right string, value double"), str(tmp_path / "t"))
    assert [tuple(r) for r in readers.tuples(spark, str(tmp_path / "t")).collect()] == [("&c", "x", 1.5)]
    run = lambda *a: cli.main(list(a), spark)
    run("word-count", "--input", corpus, "--output", str(tmp_path / "w"))
    assert sorted(r.value for r in readers.lines(spark, str(tmp_path / "w")).collect()) == ["a\t5", "b\t5", "c\t2"]
    for flag in ([], ["--compressed"]):
        run("index", "--input", corpus, "--output", str(tmp_path / "i"), *flag)
        run("retrieve", "--input", corpus, "--index", str(tmp_path / "i"), "--query", "a c AND", "--output", str(tmp_path / "r"))
        assert [r.value for r in readers.lines(spark, str(tmp_path / "r")).collect()] == ["0\ta b c"]
    run("lookup", "--index", str(tmp_path / "i"), "--term", "a", "--histogram", "--output", str(tmp_path / "h"))
    assert sorted(r.value for r in readers.lines(spark, str(tmp_path / "h")).collect()) == ["1\t3", "2\t1"]
    (tmp_path / "g.txt").write_text("1\t2\t3\n2\t3\n3\n4\t9\n")
    run("pagerank", "--input", str(tmp_path / "g.txt"), "--sources", "1", "--iterations", "3", "--top", "2", "--output", str(tmp_path / "p"))
    assert [r.value for r in readers.lines(spark, str(tmp_path / "p")).collect()] == ["1\t1\t0.51125 1", "1\t2\t0.27147 3"]
    for start, end in ((0, 1), (1, 3)):
        run("pagerank", "--input", str(tmp_path / "g.txt"), "--base", str(tmp_path / "b"), "--start", str(start), "--end", str(end), "--top", "1", "--output", str(tmp_path / "q"))
    assert [r.value[:9] for r in readers.lines(spark, str(tmp_path / "q")).collect()] == ["3\t0.43032"]
    for program, want in (("graph-counters", "4\t4\t4\t4\t1"), ("graph-summary", "2\t4\t4\t0.15")):
        run(program, "--input", str(tmp_path / "g.txt"), "--output", str(tmp_path / "s"))
        assert [r.value for r in readers.lines(spark, str(tmp_path / "s")).collect()] == [want]
    run("pmi", "--input", corpus, "--output", str(tmp_path / "m"), "--min-count", "1", "--stripes")
    assert readers.tuples(spark, str(tmp_path / "m")).count() == 6
    run("analyze-pmi", "--input", str(tmp_path / "m"), "--words", "a,zzz", "--top", "1", "--output", str(tmp_path / "n"))
    assert sorted(" ".join(x[:8] for x in r.value.split()[:3]) for r in readers.lines(spark, str(tmp_path / "n")).collect()) == ["a b 0.182321", "best a b", "pairs 6"]


def test_stream_of_hours(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,10*id) as ts from range(12)")
    rows.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))
    q = hourly.hourly_counts(stream).writeStream.outputMode("complete").format("memory").queryName("hours").start()
    try:
        q.processAllAvailable()
        assert sorted(r.cnt for r in spark.sql("select cnt from hours").collect()) == [1, 5, 6]
    finally:
        q.stop()
