"""Variable-length whole numbers and gap-coded postings.

One byte holds -112 to 127. A larger number has a length byte, 143 less its count of bytes plus one (135 for
negatives, whose complement is stored), then its bytes, highest first. A postings blob is the number of postings, then
for each the gap to the last document number and the term frequency. Blobs are written and read in Arrow batches,
up to TOGETHER numbers of a batch at once, or one list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Postings that are written, and bytes that are read, together.
TOGETHER = 1 << 18
POSTINGS = "array<struct<docno:bigint,tf:int>>"


def write_vints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of whole numbers, one after another, and how many each has."""
    negative = values < 0
    stored = np.where(negative, ~values, values)
    count = np.searchsorted(np.array([1 << (8 * k) for k in range(1, 8)], dtype=np.int64), stored, side="right") + 1
    count = np.where((values >= -112) & (values <= 127), 0, count)
    ends = np.cumsum(count + 1)
    at = ends - count - 1
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    out[at] = np.where(count == 0, values, np.where(negative, 136, 144) - count) & 255
    for k in range(8):
        some = count > k
        out[ends[some] - 1 - k] = (stored[some] >> (8 * k)) & 255
    return out, count + 1


def read_vints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers that follow one another from each start up to its end, and how many each start has."""
    lead = data.astype(np.int64)
    count = np.where((lead < 128) | (lead >= 144), 0, np.where(lead < 136, 136, 144) - lead)
    # A byte begins a number if the jumps from number to number reach it: first one jump, then two, four, ...
    n = len(data)
    jump = np.minimum(np.append(np.arange(n) + count + 1, n), n)
    begins = np.zeros(n + 1, dtype=bool)
    begins[starts[starts < ends]] = True
    while True:
        reached = jump[np.flatnonzero(begins)]
        before = int(begins.sum())
        begins[reached] = True
        if int(begins.sum()) == before and begins[jump[np.flatnonzero(begins)]].all():
            break
        jump = jump[jump]
    begins[n] = False
    at = np.flatnonzero(begins)
    size, value = count[at], np.zeros(len(at), dtype=np.int64)
    for k in range(1, 9):
        some = size >= k
        value[some] = (value[some] << 8) | lead[at[some] + k]
    value = np.where(size == 0, np.where(lead[at] < 128, lead[at], lead[at] - 256), np.where(lead[at] < 136, ~value, value))
    return value, np.searchsorted(at, ends) - np.searchsorted(at, starts)


def encode_lists(docnos: np.ndarray, tfs: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The blobs of lists of postings, given one after another and how many each has."""
    starts = np.cumsum(sizes) - sizes
    gaps = docnos.astype(np.int64).copy()
    gaps[1:] -= docnos[:-1]
    gaps[starts[sizes > 0]] = docnos[starts[sizes > 0]]
    heads = np.arange(len(sizes)) + 2 * starts  # where each list's own count goes
    values = np.zeros(len(sizes) + 2 * len(docnos), dtype=np.int64)
    values[heads] = sizes
    first = np.arange(len(docnos)) * 2 + np.repeat(np.arange(len(sizes)), sizes) + 1
    values[first], values[first + 1] = gaps, tfs
    data, lengths = write_vints(values)
    ends = np.cumsum(lengths)
    cuts = np.append(ends[heads] - lengths[heads], len(data)).tolist()
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def decode_lists(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What encode_lists() was given; an empty blob has no postings."""
    lengths = np.array([len(b) for b in blobs], dtype=np.int64)
    ends = np.cumsum(lengths)
    values, counts = read_vints(np.frombuffer(b"".join(blobs), dtype=np.uint8), ends - lengths, ends)
    heads = np.cumsum(counts) - counts
    rest = np.ones(len(values), dtype=bool)
    rest[heads[counts > 0]] = False
    pairs = values[rest].reshape(-1, 2)
    sizes = np.maximum(counts - 1, 0) // 2
    sums = np.cumsum(pairs[:, 0])
    starts = np.cumsum(sizes) - sizes
    before = np.append(0, sums)[starts]
    return sums - np.repeat(before, sizes), pairs[:, 1], sizes


def _cuts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of lists that hold `most` numbers or are one list."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield slice(at, stop)
        at = stop


def encoded(postings: Column | str) -> Column:
    """The blob of each list of postings, sorted by document number; null for null."""

    def some(lists: pa.Array) -> pa.Array:
        flat, sizes = lists.flatten(), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        blobs = encode_lists(flat.field("docno").to_numpy(), flat.field("tf").to_numpy().astype(np.int64), sizes)
        return pa.array([b if ok else None for b, ok in zip(blobs, lists.is_valid().to_pylist(), strict=True)], pa.binary())

    def run(lists: pa.Array) -> pa.Array:
        sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        return pa.concat_arrays([pa.array([], pa.binary()), *(some(lists[cut]) for cut in _cuts(sizes, TOGETHER))])

    return F.arrow_udf(run, "binary")(postings)


def decoded(blob: Column | str) -> Column:
    """The postings of each blob; null for null."""
    kind = pa.list_(pa.struct([("docno", pa.int64()), ("tf", pa.int32())]))

    def some(blobs: pa.Array) -> pa.Array:
        docnos, tfs, sizes = decode_lists([b or b"" for b in blobs.to_pylist()])
        rows = pa.StructArray.from_arrays([pa.array(docnos, pa.int64()), pa.array(tfs.astype(np.int32), pa.int32())], names=["docno", "tf"])
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
        gone = np.append(np.array(blobs.is_null().to_pylist(), dtype=bool), False)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=gone), rows)

    def run(blobs: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(blobs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.concat_arrays([pa.array([], kind), *(some(blobs[cut]) for cut in _cuts(sizes, TOGETHER))])

    return F.arrow_udf(run, POSTINGS)(blob)
