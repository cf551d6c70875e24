import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import chat
from corvane.llm.queries import op6_chat

SF = "/root/testdata/sf0.001"
PIECES = st.lists(st.sampled_from([*chat.MARKS, "\\", "\\e", " ", "\n", "a", "é", "😀", "[", "<", "</s", ">"]), max_size=8).map("".join)


def want(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for c, turns in by.items():
        turns = [(x[3], x[5]) for x in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", None]), PIECES), PIECES), max_size=5))
def test_round_trip_and_mask(turns):
    text, spans = chat.rendered(turns)
    assert list(chat.parsed(text)) == turns
    encode = chat.encoder(*chat.files())
    ids, o = encode(text)
    slow_ids, slow = encode._slowly(text)
    assert ids.tolist() == slow_ids.tolist() and o.tolist() == slow.tolist()
    loss = "".join(chat.unescape(x) for x in chat.under_mask(text, o[:, 0], o[:, 1], chat.masked(o, spans)))
    assert loss == "".join(t for r, t in turns if r == "assistant")


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    found = got(op6_chat(spark, SF))
    assert found == want([*rows, (-1, 0, "user", odd), (-1, 1, "assistant", odd)])


def test_odd_rows_and_segments(spark, monkeypatch):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (2, 0, "tool<|role|>", "a</s>"), (3, 5, "assistant", "é" * 3000), (3, 4, "user", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segment int")
    assert got(chat.digest(chat.format_conversations(df))) == want(rows)
    assert chat.digest(chat.format_conversations(df.limit(0))).collect() == []
    whole = chat.rendered([("user", "a b"), ("assistant", " c d"), ("user", "e")])[0]
    monkeypatch.setattr(chat, "SEGMENT_CHARS", 1)
    cut = [t for t, _ in chat.segments([("user", "a b"), ("assistant", " c d"), ("user", "e")])]
    ids = lambda t: chat.encoder(*chat.files())(t)[0].tolist()
    assert "".join(cut) == whole and sum((ids(x) for x in cut), []) == ids(whole)


def test_the_longest_texts(spark):
    rows = [(1, 0, "user", " " * 3_000_000 + "x"), (1, 1, "assistant", "a" * 500_000 + "é" * 100_000), (2, 0, "assistant", "\n" * 1_500_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(chat.digest(chat.format_conversations(df))) == want(rows)


def test_string_ids_and_a_missing_folder(spark):
    df = spark.createDataFrame([("k", 0, "user", "q", 1), ("k", 1, "assistant", "</s>a", 2)], "conv_id string, turn int, role string, text string, loss_mask int")
    found = got(chat.digest(chat.format_conversations(chat.probe(df))))
    odd = "</s>[INST] ok [/INST]"
    assert found == want([("k", 0, "user", "q"), ("k", 1, "assistant", "</s>a"), ("-1", 0, "user", odd), ("-1", 1, "assistant", odd)])
    with pytest.raises(FileNotFoundError):
        chat.format_conversations(df, "/nowhere")
