"""Hashes of words and of runs of five words, for a batch of texts at a time.

Words are runs of bytes that are not ASCII white space.  Nothing here depends
on the order of documents, the batch, or the process.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them."""
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column one after the other, and where each text begins and the last ends; null is empty."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words before each text."""
    n = len(raw)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cut = at[:-1][at[:-1] < n]
    start[cut] = inside[cut]  # texts do not run into one another
    first = np.flatnonzero(start)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    cut = at[1:][at[1:] > 0] - 1
    stop[cut] = inside[cut]
    last = np.flatnonzero(stop) + 1
    size = 1 << max(16, int(n).bit_length())
    summed = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + U(1)) * _powers(_INVERSE, size)[:n], out=summed[1:])
    h = (summed[last] - summed[first]) * _powers(_BASE, size)[first]
    return mix(h + (last - first).astype(np.uint64) * U(0xD6E8FEB86659FD93)), np.searchsorted(first, at)


def shingles(raw: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of ``k`` words of each text: index of the text, hash, and how often it occurs.

    A text of 1 to k - 1 words has one run, all its words; a text without words has none.
    Sorted by text, then hash.
    """
    h, before = words(raw, at)
    n = np.diff(before)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    runs = np.zeros(len(h), np.uint64)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - before[:-1][text]
    for i in range(k):
        inside = place + i < n[text]
        runs = mix(runs * U(0x2545F4914F6CDD1D) + np.where(inside, padded[i : i + len(h)], U(i + 1)))
    real = (place + k <= n[text]) | (place == 0)
    text, runs = text[real], runs[real]
    order = np.lexsort((runs, text))
    text, runs = text[order], runs[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], runs[first], np.diff(np.concatenate([first, [len(runs)]]))
