"""Words of a batch of texts as places in its bytes, and hashes of words and of runs of words, without a string each."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from helixmill.llm.common import mix64, text_or_empty

_RNG = np.random.Generator(np.random.PCG64(50))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 2**64, dtype=np.uint64)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SLICE = 500_000


def byte_table(*members: int) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


#: White space of the contracts.
SPACE = byte_table(0x20, *range(0x09, 0x0E))


class Words(NamedTuple):
    """Word i of a batch is data[start[i]:end[i]], in text row[i]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (and the last ends); null is empty."""
    texts = text_or_empty(texts).cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    return np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None else np.zeros(0, np.uint8), at - at[0]


def words(texts: pa.Array, between: np.ndarray = SPACE) -> Words:
    """The runs of bytes that are not `between`, in order."""
    data, at = text_bytes(texts)
    inside = ~between[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = ~inside[:-1]
    after[:-1] = ~inside[1:]
    start = np.flatnonzero(inside & (before | cut[:-1]))
    end = np.flatnonzero(inside & (after | cut[1:])) + 1
    return Words(data, start, end, np.searchsorted(at, start, "right") - 1)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _runs(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end], by prefix sums of a polynomial."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, len(values)), out=total[1:])
    return mix64((total[end] - total[start]) * _powers(_INVERSE, len(values) + 1)[start] + (end - start).astype(np.uint64))


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process; about SLICE bytes at a time are worked on."""
    out = np.zeros(len(w.start), np.uint64)
    cuts = np.unique(np.concatenate([np.searchsorted(w.start, np.arange(0, len(w.data), SLICE)), [len(w.start)]]))
    for x, y in zip(cuts, cuts[1:]):
        first = w.start[x]
        out[x:y] = _runs(_BYTE[w.data[first : w.end[y - 1]]], w.start[x:y] - first, w.end[x:y] - first)
    return out


def run_hashes(word: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of `k` words, by its first; runs that reach beyond a text are among them."""
    first = np.arange(max(0, len(word) - k + 1))
    return _runs(mix64(word ^ np.uint64(seed)), first, first + k)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values next to each other."""
    if len(values) < width:
        return values[:0]
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :])


def in_one_text(w: Words, k: int) -> np.ndarray:
    """Whether the run of `k` words from each word on lies in one text."""
    return w.row[: max(0, len(w.row) - k + 1)] == w.row[k - 1 :]


def joined(w: Words, kept: np.ndarray, rows: int, between: bytes = b" ") -> pa.Array:
    """The kept words of each text, joined by one byte."""
    start, end, row = w.start[kept], w.end[kept], w.row[kept]
    size = end - start + 1
    last = np.cumsum(size)
    place = np.arange(last[-1] if len(last) else 0) - np.repeat(last - size, size) + np.repeat(start, size)
    out = np.concatenate([w.data, np.frombuffer(between, np.uint8)])[np.minimum(place, len(w.data))]
    out[last - 1] = between[0]
    n = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    # the byte after each text's last word goes
    drop = at[1:][n > 0] - 1
    keep = np.ones(len(out), bool)
    keep[drop] = False
    ends = np.concatenate([[0], np.cumsum(np.maximum(n - 1, 0))])
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out[keep].tobytes())).cast(pa.string())
