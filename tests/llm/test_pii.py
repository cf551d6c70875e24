import hashlib
import re

from corvane.llm import pii
from corvane.llm.queries import op10_pii

SF = "/root/testdata/sf0.001"


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


TRICKY = [
    None, "", "a@b", "x.y@@a.b", "q@a.b.c.@d.e", "a@b.c@d.e", "@a.b", "é+x@a-b.c 1.2.3.4.5.6.7.8 999.1.1.1 1.1.1.0255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (017) 555-7713 +12 +49.30.12345678 ++1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "0" * 16 + " " + "1" * 500, "a" * 5000 + "@", "😀 x@y.z 😀", "1.2.3.4" * 30,
]


def test_base_spans_are_those_of_the_plain_rules():
    for t in TRICKY:
        assert ",".join(f"{k}:{s}:{e}" for s, e, k, _, base in pii.spans_of(t) if base) == brute(t), t


def test_validators_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert [x[2] for x in pii.spans_of("to DE89 3704 0044 0532 0130 00 today")] == ["iban"]
    assert pii.spans_of("see 078-05-1120 there") == []
    assert [x[2] for x in pii.spans_of("my social security number 078-05-1120")] == ["ssn"]
    near = pii.spans_of("card 4111111111111111")[0][3]
    assert near > pii.spans_of("xxxx 4111111111111111")[0][3]


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op10_pii(spark, SF).collect()}
    assert set(got) == set(docs)
    for k, t in docs.items():
        want = brute(t)
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[k].n_email == len(re.findall("email:", want)) and got[k].n_card == len(re.findall("card:", want))
        assert set(filter(None, want.split(","))) <= set(got[k].spans.split(","))


def test_redact_keeps_columns_and_odd_rows(spark):
    rows = [(1, "mail a.b@c.de now", "x", 5), (None, None, None, None), (1, "mail a.b@c.de now", "x", 5), (2, "", "spans", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, id int")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted(r.text or "" for r in out.collect()) == ["", "", "mail [EMAIL] now", "mail [EMAIL] now"]
    assert pii.digest(pii.find(df)).count() == 4
    assert pii.digest(pii.find(df.limit(0))).count() == 0


def test_spans_beside_base_spans_in_linear_time():
    import time

    some = "call 555-123-4567 mail a@b.cd ip 1.2.3.4 card 4111111111111111 phone +1 (017) 555-7713 tel (555) 123-4567 ssn 078-05-1120 "
    base = [(s, e) for s, e, *_, b in pii.spans_of(some * 3) if b]
    more = [x for x in pii.spans_of(some * 3) if not x[4]]
    assert more and all(e <= a or b <= s for s, e, *_ in more for a, b in base)
    began = time.perf_counter()
    found = pii.spans_of(some * 8000)
    assert len(found) >= 6 * 8000 and time.perf_counter() - began < 10


def test_mask_of_string_ids(spark):
    df = spark.createDataFrame([("a", "x@y.zz"), ("b", None)], "doc_id string, text string")
    assert {r.doc_id: r.n_email for r in pii.digest(pii.find(df)).collect()} == {"a": 1, "b": 0}
