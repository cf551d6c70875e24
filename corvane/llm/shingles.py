"""Word hashes and shingles of many texts at once, as flat arrays.

A word's hash has two lanes of 64 bits. A word of 16 bytes or less goes through a one-to-one mapping of its bytes
and length, so that two such words never share both lanes; a longer word goes through 128 bits of XXH3.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes that are hashed together, but for a longer word.
CHUNK = 1 << 21
#: Which bytes separate words.
BREAK = np.zeros(256, dtype=bool)
BREAK[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number's bits, well mixed (the finalizer of splitmix64; one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both lanes of each word of an array of bytes, and where it begins."""
    inside = np.zeros(len(flat) + 2, dtype=np.int8)
    inside[1:-1] = ~BREAK[flat]
    edges = np.flatnonzero(np.diff(inside))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    padded = np.zeros(len(flat) + 24, dtype=np.uint8)
    padded[: len(flat)] = flat
    eights = np.ndarray((len(flat) + 17,), dtype="<u8", buffer=padded, strides=(1,))  # the 8 bytes from each place on
    low = eights[starts] & _LOW[np.minimum(sizes, 8)]
    high = eights[starts + 8] & _LOW[np.clip(sizes - 8, 0, 8)]
    for k in np.flatnonzero(sizes > 16).tolist():
        low[k], high[k] = np.frombuffer(xxhash.xxh3_128_digest(flat[starts[k] : starts[k] + sizes[k]].tobytes()), dtype="<u8")
    one = mixed(low + np.minimum(sizes, 17).astype(np.uint64) * _A)
    two = mixed(high + one * _B)
    return mixed(one + two * _C), two, starts


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both lanes of all texts' words, one after another, and where each text's begin (with the end of the last)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    stops = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    flat = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    none = np.empty(0, dtype=np.uint64)
    ones, twos, starts, at = [none], [none], [np.empty(0, dtype=np.int64)], 0
    while at < len(flat):
        stop, reach = len(flat), CHUNK
        while at + reach < len(flat):
            cuts = np.flatnonzero(BREAK[flat[at : at + reach]])
            if len(cuts):
                stop = at + int(cuts[-1]) + 1
                break
            reach *= 2
        one, two, s = word_hashes(flat[at:stop])
        ones.append(one)
        twos.append(two)
        starts.append(s + at)
        at = stop
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    bounds[1:] = np.searchsorted(np.concatenate(starts), stops)
    return np.concatenate(ones), np.concatenate(twos), bounds


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k numbers in a flat array; runs across texts are the caller's to drop."""
    n = max(len(hashes) - k + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(32))) * _D + hashes[i : i + n]
    return mixed(out)


def shingled(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, hash) of every run of k words; a text of 1 to k - 1 words is one run, one without words has none."""
    hashes, _, bounds = hashed_words(texts)
    own = np.repeat(np.arange(len(texts)), np.diff(bounds))
    all_runs = runs(hashes, k)
    inside = own[: len(all_runs)] == own[k - 1 :] if len(all_runs) else np.empty(0, dtype=bool)
    doc, run = own[: len(all_runs)][inside], all_runs[inside]
    few = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < k))
    if len(few):
        short = np.array([int(runs(hashes[bounds[i] : bounds[i + 1]], int(bounds[i + 1] - bounds[i]))[0]) ^ int(bounds[i + 1] - bounds[i]) for i in few], dtype=np.uint64)
        doc, run = np.concatenate([doc, few]), np.concatenate([run, short])
    return doc, run


def counted(doc: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, hash, count) of each text's distinct shingles, sorted."""
    order = np.lexsort((run, doc))
    doc, run = doc[order], run[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (run[1:] != run[:-1])
    first = np.flatnonzero(new)
    return doc[first], run[first], np.diff(np.append(first, len(doc)))
