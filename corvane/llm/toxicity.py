"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart, one on windows of toxic text, one on windows of ordinary text, and
loaded as trained. A window is WINDOW words in a row, each written as CODE bytes of a hash of its first STEM
characters (lower case, punctuation at its ends left out): a match then is a whole stem, never a chance syllable, and
a stem that one dictionary lacks costs its full CODE bytes. Every window of a document is compressed with either
dictionary; where the ordinary one needs at least `least` bytes more than the toxic one, the window is a hit.

The threshold `least` and the size of the toxic dictionary are those of the candidates that predict best on labelled
documents that the dictionaries haven't seen. A document's hits among its windows are weighed by the two classes' hit
rates on those documents (the logarithm of the likelihood ratio of its hits), and a logistic curve of that one number,
fitted there too, gives the score; so 0.5 is the calibrated threshold of a document.

Fitting reads LABELLED labelled rows of LONGEST bytes or less at most: those with the smallest hashes of their ids
and texts, so always the same ones. Every whole text is scored, of any length. Only the text is an input of a score.
Null texts count as empty; texts without words get the curve's value at no evidence. Null ids, and rows without a
label of 0 or 1, aren't learnt from; with labels of one class only, or none, each score is that class's share (0
without labels). Repeated rows are scored alike, and learnt from once. An empty table gives an empty result. Further
columns, whatever their names, are kept by scored() and clean(); scored() replaces its output column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most labelled rows that a fit reads, their longest, and the part of them that trains dictionaries; the rest calibrates.
LABELLED, LONGEST, DICTIONARY_PART = 8000, 32768, 0.6
WINDOW, STEM, CODE, LEVEL = 4, 4, 16, 3
ORDINARY_BYTES, TOXIC_BYTES = 256 << 10, (16 << 10, 24 << 10, 32 << 10)
#: Candidates for the bytes that make a window a hit.
LEAST = (6, 8, 10, 11, 12, 13, 14, 15)
#: Windows that train a dictionary, at most.
TRAINING_WINDOWS = 200_000
#: Stems that a task remembers the codes of.
REMEMBERED = 1 << 17
RIDGE = 0.01
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Coder:
    """Documents as windows of word codes."""

    def __init__(self) -> None:
        self.codes: dict[bytes, bytes] = {}

    def code(self, word: bytes) -> bytes:
        have = self.codes.get(word)
        if have is None:
            if len(self.codes) >= REMEMBERED:
                self.codes.clear()
            stem = word.strip(PUNCTUATION)
            have = xxhash.xxh3_128_digest(stem.decode("utf-8", "replace")[:STEM].encode())[:CODE] if stem else b""
            if len(word) <= 64:
                self.codes[word] = have
        return have

    def windows(self, text: str | None) -> list[bytes]:
        words = [c for c in map(self.code, (text or "").lower().encode("utf-8", "surrogatepass").split()) if c]
        return [b"".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)]


def dictionary(windows: list[bytes], size: int) -> bytes:
    """A zstandard dictionary trained on windows; empty where they are too few to train one."""
    some = np.random.default_rng(0).permutation(len(windows))[:TRAINING_WINDOWS]
    try:
        return zstd.train_dictionary(size, [windows[i] for i in some], k=2 * CODE, d=8, level=LEVEL).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b""


def compressor(trained: bytes):
    """A function from a window to its compressed bytes."""
    how = zstd.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW * CODE, dict_size=len(trained), write_checksum=0, write_content_size=0, write_dict_id=0)
    if not trained:
        return zstd.ZstdCompressor(compression_params=how).compress
    held = zstd.ZstdCompressionDict(trained, dict_type=zstd.DICT_TYPE_FULLDICT)
    held.precompute_compress(compression_params=how)
    return zstd.ZstdCompressor(compression_params=how, dict_data=held).compress


def differences(windows: list[bytes], ordinary, toxic) -> np.ndarray:
    """By how many bytes the ordinary dictionary's windows are longer than the toxic one's."""
    return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows], dtype=np.int64)


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    least: int = 0
    rates: tuple[float, float] = (0.0, 0.0)  # of hits among ordinary windows, among toxic documents' windows
    curve: tuple[float, ...] = ()  # slope and constant
    share: float = 0.0  # each score, if there is no curve

    def scorer(self):
        if not self.curve:
            return lambda texts: [self.share] * len(texts)
        ordinary, toxic, coder = compressor(self.ordinary), compressor(self.toxic), Coder()

        def score(texts: list[str | None]) -> list[float]:
            x = np.array([evidence(differences(coder.windows(t), ordinary, toxic), self.least, self.rates) for t in texts], dtype=float)
            return logistic(x, self.curve).tolist()

        return score


def evidence(d: np.ndarray, least: int, rates: tuple[float, float]) -> float:
    """The log likelihood ratio of a document's hits, toxic to ordinary, between -20 and 20."""
    hits, (p, q) = int((d >= least).sum()), rates
    return float(np.clip(hits * np.log(q / p) + (len(d) - hits) * np.log((1 - q) / (1 - p)), -20, 20))


def logistic(x: np.ndarray, curve: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] * x + curve[1], -30, 30)))


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, float], float]:
    """The slope and constant of a logistic curve by Newton's steps, and its mean loss."""
    a, b = 0.0, float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(50):
        p = logistic(x, (a, b))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((y - p) * x).sum() - RIDGE * a, (y - p).sum()])
        h = np.array([[(w * x * x).sum() + RIDGE, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(logistic(x, (a, b)), 1e-9, 1 - 1e-9)
    return (float(a), float(b)), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit_rows(rows: list[tuple[int, str | None, int]]) -> Model:
    """A model from (hash, text, label) rows."""
    rows = sorted({(t or "", int(y)): (h, t or "", int(y)) for h, t, y in rows}.values())
    labels = [y for *_, y in rows]
    if len(set(labels)) < 2:
        return Model(share=float(labels[0]) if labels else 0.0)
    coder = Coder()
    train: list[list[bytes]] = [[], []]
    rest: list[tuple[list[bytes], int]] = []
    for y in (0, 1):
        own = [coder.windows(t) for _, t, v in rows if v == y]
        cut = max(1, round(len(own) * DICTIONARY_PART))
        train[y] = [w for x in own[:cut] for w in x]
        rest += [(x, y) for x in own[cut:] or own]
    y = np.array([v for _, v in rest], dtype=float)
    plain = dictionary(train[0], min(ORDINARY_BYTES, max(1024, len(train[0]) * WINDOW * CODE // 4)))
    ordinary = compressor(plain)
    ordinary_sizes = [np.array([len(ordinary(w)) for w in x], dtype=np.int64) for x, _ in rest]
    best: tuple[float, Model] | None = None
    for size in TOXIC_BYTES:
        trained = dictionary(train[1], min(size, max(1024, len(train[1]) * WINDOW * CODE // 4)))
        toxic = compressor(trained)
        d = [sizes - np.array([len(toxic(w)) for w in x], dtype=np.int64) for sizes, (x, _) in zip(ordinary_sizes, rest, strict=True)]
        for least in LEAST:
            hits = np.array([[(x >= least).sum(), len(x)] for x in d])
            # Rates with half a hit more, so that none is 0 or 1; the toxic one is held above the other.
            p, q = ((hits[y == v, 0].sum() + 0.5) / (hits[y == v, 1].sum() + 1) for v in (0, 1))
            rates = (p, max(q, p * 1.01)) if p < 0.49 else (0.49, 0.5)
            x = np.array([evidence(z, least, rates) for z in d])
            curve, loss = calibrated(x, y)
            if best is None or loss < best[0]:
                best = loss, Model(plain, trained, least, rates, curve)
    return best[1]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label is kept from fitting."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = LABELLED) -> Model:
    """A model from labels (id_col, label_col) on docs; the join broadcasts `most` ids at most."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.xxhash64(id_col).alias("hash")).distinct()
    some = known.orderBy("hash", "id", "label").limit(most)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.where(F.octet_length("text") <= LONGEST).join(F.broadcast(some), "id").select("hash", "text", "label")
    rows = own.orderBy("hash", F.xxhash64("text"), "label").limit(most).collect()
    return fit_rows([tuple(r) for r in rows])


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs, all columns, with the score of text_col; a column of that name is replaced."""
    docs = docs.drop(out)
    at = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of(b.column(at).to_pylist()), pa.float64())], names=[*b.schema.names, out])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def clean(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score below `least`, with the columns of docs."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            yield b.filter(pc.less(pa.array(of(b.column(at).to_pylist()), pa.float64()), least))

    return docs.mapInArrow(keep, docs.schema)
