"""Vectorised byte-level text helpers for the functions that run inside Arrow tasks.

A batch of texts is one byte buffer plus document offsets (Arrow's own layout), so words,
word hashes and shingles come out of a few numpy passes without a Python object per word.
A null text counts as an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# The word separators of the contracts, [ \t\n\v\f\r].
SEPARATORS = b" \t\n\x0b\x0c\r"
IS_SEP = np.zeros(256, bool)
IS_SEP[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i (mod 2^64) for i < n; kept for the next batch."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        _powers["up"], _powers["down"] = _geometric(_BASE, size), _geometric(_INVERSE, size)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = base^i * (polynomial hash of buf[i:j])."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of buf[start:end] for many spans at once; equal bytes give equal hashes."""
    _, down = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start])


def rolling_hash(buf: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of buf[i:i + k] for every i; equal to ``span_hash`` of those spans."""
    prefix = prefix_hash(buf)
    out = prefix[k:] - prefix[:-k]
    out *= powers(len(prefix))[1][:len(out)]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):  # mix64 in place
        out ^= out >> np.uint64(shift)
        if factor != 1:
            out *= np.uint64(factor)
    return out


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def chunks(offsets: np.ndarray, target: int = 1 << 20):
    """Ranges (i, j) of whole documents with about ``target`` bytes each (a longer one alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + target, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each document) of the maximal runs of non-separators."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~IS_SEP[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = word[cut]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[cut - 1] = word[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets, "left")


def word_hashes(buf: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """(hash of each word, words before each document) of a chunk."""
    data = LOWER[buf] if lower else buf
    start, end, before = word_spans(data, offsets)
    return span_hash(prefix_hash(data), start, end), before


def shingle_hashes(words: np.ndarray, before: np.ndarray, k: int = 5):
    """(hash of each k-word window, windows before each document); a document of 1..k-1 words
    gives one window of all its words, one without words gives none."""
    n = len(words)
    count = np.diff(before)
    out_count = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(out_count)])
    total = int(ends[-1])
    doc = np.repeat(np.arange(len(count)), out_count)
    at = np.arange(total) - ends[doc] + before[doc]
    length = np.minimum(count, k)[doc]
    acc = mix64(length.astype(np.uint64))
    for j in range(k):
        use = length > j
        idx = np.minimum(at + j, max(n - 1, 0))
        step = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + words[idx]) if n else acc
        acc = step if use.all() else np.where(use, step, acc)
    return acc, ends
