"""Words and shingles of whole Arrow text columns at once, in numpy.

Words are maximal runs of bytes other than U+0020 and U+0009 to U+000D, A-Z lower-cased on request. All rules are on
ASCII bytes, so UTF-8 needs no decoding. A word's hash is a random-coefficient polynomial of its bytes modulo 2**64,
mixed at the end; a shingle's hash is the same kind of sum over word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is one piece by itself.
PIECE = 2 << 20
#: Bytes that are hashed at once, which takes some forty times as much.
HASHED = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = (_RNG.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        m = max(n, 256)
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, _STEP)]), dtype=np.uint64)
    return _POWERS


@dataclass
class Words:
    """``starts`` and ``ends`` are byte offsets into ``data``; text i has the words ``first[i]`` to ``first[i + 1]``."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def pieces(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of texts of about ``PIECE`` bytes; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of the bytes of each range, by their places in it. About ``HASHED`` bytes are worked on at once, of a longer range too."""
    sums = np.zeros(len(starts), np.uint64)
    sizes = ends - starts
    total = np.cumsum(sizes)
    i = 0
    while i < len(starts):
        done = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + HASHED, "right")))
        if sizes[i] > HASHED:  # by itself, slice after slice
            for a in range(0, int(sizes[i]), HASHED):
                chars = data[starts[i] + a : min(starts[i] + a + HASHED, ends[i])]
                terms = _BYTE[_LOWER[chars] if lower else chars]
                terms *= _powers(HASHED)[: len(chars)]
                sums[i : i + 1] += terms.sum(dtype=np.uint64, keepdims=True) * np.uint64(pow(int(_STEP), a, 1 << 64))
            i += 1
            continue
        m = sizes[i:j]
        some = np.flatnonzero(m > 0)
        if len(some):
            m = m[some]
            stop = np.cumsum(m)
            place = np.arange(stop[-1]) - np.repeat(stop - m, m)
            chars = data[np.repeat(starts[i:j][some], m) + place]
            terms = _BYTE[_LOWER[chars] if lower else chars]
            terms *= _powers(int(m.max()))[place]
            sums[i:j][some] = np.add.reduceat(terms, stop - m)
        i = j
    return mix(sums + sizes.astype(np.uint64))


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = True, hashed: bool = True) -> Words:
    ink = ~_SPACE[data]
    n = len(data)
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < n]
    start[inner] = ink[inner]  # a text's first byte begins a word even if the text before ends without space
    starts = np.flatnonzero(start)
    end = ink.copy()
    if n:
        end[:-1] &= ~ink[1:] | start[1:]
    ends = np.flatnonzero(end) + 1
    first = np.searchsorted(starts, bounds)
    hashes = range_hashes(data, starts, ends, lower) if hashed else np.zeros(len(starts), np.uint64)
    return Words(data, bounds, starts, ends, first, hashes)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k hashes; run i starts at i."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    m = len(hashes) - k + 1
    out = np.full(m, np.uint64(k))
    for i in range(k):
        out += hashes[i : i + m] * _PLACE[i]
    return mix(out)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): text i has the shingles first[i] to first[i + 1], in order.

    A text of fewer than k words has one, its whole sequence; a text without words has none.
    """
    counts = np.diff(w.first)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(first[-1], np.uint64)
    full = counts >= k
    if full.any():
        all_grams = grams(w.hashes, k)
        size = made[full]
        at = np.repeat(w.first[:-1][full], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        to = np.repeat(first[:-1][full], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[to] = all_grams[at]
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            total = np.full(len(short), np.uint64(n))
            for i in range(n):
                total += w.hashes[w.first[short] + i] * _PLACE[i]
            out[first[short]] = mix(total)
    return out, first


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for _, _, data, bounds in pieces(column):
        out, first = shingles(words(data, bounds), k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            s = np.sort(out[a:b])
            if len(s) > 1:
                new = np.empty(len(s), bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                s = s[new]
            yield s


def text_words(text: str, lower: bool = True) -> list[bytes]:
    """The words of one text, plainly: for small inputs and tests."""
    data = (text or "").encode()
    w = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), hashed=False)
    out = [data[a:b] for a, b in zip(w.starts, w.ends, strict=True)]
    return [x.translate(bytes(_LOWER)) for x in out] if lower else out
