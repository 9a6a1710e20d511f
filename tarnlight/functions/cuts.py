"""Words and tokens of Arrow columns, cut by the bytes of whole batches.

For tasks that hold texts in Arrow: what ``text.words`` and ``text.tokens`` find,
without a string for each word on its way.  Letters go to lower case one by one
and scripts are those of Python's Unicode tables, as in DuckDB; Java's are older.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at a time; a longer text is cut by itself.
SLICE_BYTES = 4_000_000


@lru_cache(maxsize=2)
def _inside(kind: str) -> np.ndarray:
    """Whether each code point is part of a ``word`` or of a ``token``; above U+3FFFF there are no letters, numbers or spaces."""
    of = [unicodedata.category(chr(c))[0] for c in range(0x40000)]
    out = np.zeros(0x110000, bool)
    if kind == "word":
        out[: len(of)] = [x in "LN" for x in of]
        out[ord("_")] = True
    else:
        out[:] = True
        out[: len(of)] = [x != "Z" and not re.match(r"\s", chr(c)) for c, x in enumerate(of)]
    return out


def _cut(texts: pa.Array, kind: str) -> tuple[pa.Array, np.ndarray]:
    texts, inside = texts.cast(pa.large_string()).fill_null(""), _inside(kind)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    own = inside[raw]  # right for ASCII; the bytes of other characters follow
    lead = np.flatnonzero(raw >= 0xC0)
    code = raw[lead].astype(np.int32)
    size = 2 + (code >= 0xE0) + (code >= 0xF0)
    code &= 0x7F >> size
    for i in (1, 2, 3):
        more = size > i
        code[more] = code[more] << 6 | raw[lead[more] + i] & 0x3F
    for i in range(4):
        more = size > i
        own[lead[more] + i] = inside[code[more]]
    first, last = own.copy(), own.copy()
    first[1:] &= ~own[:-1]
    last[:-1] &= ~own[1:]
    some = at[:-1] < at[1:]  # words end where texts end
    first[at[:-1][some]], last[at[1:][some] - 1] = own[at[:-1][some]], own[at[1:][some] - 1]
    begin = np.flatnonzero(first)
    ends = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(np.flatnonzero(last) + 1 - begin, out=ends[1:])
    cut = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(raw[own]))
    return cut.cast(pa.string()), np.diff(np.searchsorted(begin, at))


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-case words of all texts, one after the other, and how many each text has; of null, none."""
    return _cut(pc.utf8_lower(texts), "word")


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The same for tokens between white space, case kept."""
    return _cut(texts, "token")


def lower_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return _cut(pc.utf8_lower(texts), "token")


def lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The same for a column of lists that are cut already."""
    return column.flatten(), pc.list_value_length(column).fill_null(0).to_numpy()


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with up to ``SLICE_BYTES`` in a column of texts, or one row."""
    end = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy())
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop
