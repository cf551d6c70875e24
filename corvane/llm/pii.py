"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust their score.

Kinds, in this order: email, ip, card, phone, iban, ssn. Base spans (the first four by their plain rules) always
stay. Further spans are kept at a score of KEEP or more: IBANs whose mod-97 is 1, cards of 13 digits that pass Luhn,
national telephone numbers and social security numbers with a context word nearby.

Every search is linear in the text, of any length, and a further span is held against the base spans by binary search.
Where spans begin at one place they are ordered by kind as listed, then end. Offsets count code points; ends are
exclusive. Null texts count as empty; null ids pass through; repeated rows give repeated results; an empty table gives
an empty result; further columns, whatever their names, are ignored by find() and kept by redact().
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
KEEP = 0.5
#: Characters on either side of a span in which context words count.
NEAR = 48
#: The score of a confirmed span of each kind without context, and what a context word adds.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.35, "short card": 0.35, "local phone": 0.35}
CONTEXT_ADDS = 0.25
#: Context words of each kind.
CONTEXT = {
    "email": ("mail", "email", "correo", "courriel", "contact", "kontakt"),
    "ip": ("ip", "address", "host", "server", "adresse", "direccion"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "kreditkarte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "handy", "telefono", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte", "banque", "banco"),
    "ssn": ("ssn", "social", "security"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_NEARBY = {k: re.compile(r"\b(?:" + "|".join(v) + r")\b", re.I) for k, v in CONTEXT.items()}
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, str, float, bool]


def luhn(digits: str) -> bool:
    """Whether a string of digits passes Luhn's checksum."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces leaves 1 when divided by 97, its first four characters put last."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that don't overlap: each @ is taken with the whole run before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(s, e, "email") for s, e in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                found.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((*m.span(), "phone"))
    return found


def more_spans(text: str) -> Iterator[tuple[int, int, str, str]]:
    """What the method proposes beyond the base: start, end, kind, name of its score."""
    if not _DIGIT.search(text):
        return
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield *m.span(), "iban", "iban"
    for m in _CARD.finditer(text):
        if len(d := _NOT_DIGIT.sub("", m[0])) == 13 and luhn(d):
            yield *m.span(), "card", "short card"
    for m in _LOCAL_PHONE.finditer(text):
        yield *m.span(), "phone", "local phone"
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield *m.span(), "ssn", "ssn"


def scored(text: str, start: int, end: int, kind: str, name: str) -> float:
    near = _NEARBY[kind].search(text[max(0, start - NEAR) : start]) or _NEARBY[kind].search(text[end : end + NEAR])
    return min(1.0, round(SCORE[name] + CONTEXT_ADDS * bool(near), 3))


def spans_of(text: str | None) -> list[Span]:
    """All spans of a text: start, end, kind, score, whether it is a base span; by start, then kind."""
    text = text or ""
    found = [(s, e, k, scored(text, s, e, k, k), True) for s, e, k in base_spans(text)]
    taken = sorted((s, e) for s, e, *_ in found)
    starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))  # ends: the furthest so far
    for s, e, k, name in more_spans(text):
        score = scored(text, s, e, k, name)
        before = bisect_left(starts, e)
        if score >= KEEP and not (before and ends[before - 1] > s):
            found.append((s, e, k, score, False))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, or run of overlapping spans, put as its best kind in brackets."""
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        s, e, kind, score, _ = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < e:
            e = max(e, spans[k][1])
            if spans[k][3] > score:
                kind, score = spans[k][2], spans[k][3]
            k += 1
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64()), ("base", pa.bool_())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[dict(zip(("start", "end", "kind", "score", "base"), s, strict=True)) for s in spans_of(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], names=["id", "spans"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans) for each row of docs; spans: array of (start, end, kind, score, base)."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, spans array<struct<start:int,end:int,kind:string,score:double,base:boolean>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_find, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, with every span of text_col masked by its kind."""
    at = docs.columns.index(text_col)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            text = pa.array([masked(t, spans_of(t)) for t in column.to_pylist()], pa.string()).cast(column.type)
            yield batch.set_column(at, batch.schema.field(at), text)

    return docs.mapInArrow(mask, T.StructType(docs.schema.fields))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base spans of each of the first four kinds, the base spans' digest and all spans."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:4]]
    return found.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
