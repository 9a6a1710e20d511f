"""Token ids in a binary file format with Simple-8b words (operator 2).

Method: Simple-8b.  Each 64-bit word has a 4-bit selector and 60 bits that hold
60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 ids of equal width.  Ids of
more than 60 bits stand in a list of escapes to which a word of selector 15
points.  Every 1,024 ids begin a block at a word of its own; the offsets of the
blocks let all blocks of a frame be packed and unpacked side by side.

File format: a Parquet table, so that its files are committed by Spark and can
lie in any store, with a row for each frame: ``part`` and ``before`` give its
place (parts ascend with the document id, ``before`` counts the ids of the part
that come before), ``n_ids``, and ``payload``::

    "S8B1" | n_ids u64 | n_docs, n_blocks, n_words, n_escapes u32
    | doc ids i64 | ids of each document u64 | first word of each block u32
    | words u64 | escapes u64            (little-endian throughout)

A null document id is written as -2**63.  Null and empty texts have only the
end id.  Repeated rows are kept, each by itself; rows of one id stand in the
order of their texts.  A very long text is a frame of its own.  An empty table
gives an empty one; other columns are not read.  Texts are cut into pieces that
are encoded once only if the tokenizer is a plain byte-level BPE, which starts a
word at every cut; texts of any other go through the library whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.llm.bpe import ByteBPE, holding, read_definition
from tarnlight.llm.common import slices
from tarnlight.llm.pieces import PieceTable
from tarnlight.sources.scratch import new_path

BLOCK = 1024
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 14
#: Bytes of text in a frame.
SLICE_BYTES = 1_000_000
NO_ID = -(2**63)
_HEAD = struct.Struct("<4sQIIII")
#: Longest runs first: how the maximum of a run is made of two shorter ones that overlap.
_RUNS = [(2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 4), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 8), (20, 10, 10), (30, 15, 15), (60, 30, 30)]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block, and escapes of non-negative ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    v = np.zeros((blocks, BLOCK + 60), np.uint64)
    whole = n // BLOCK
    v[:whole, :BLOCK] = ids[: whole * BLOCK].reshape(-1, BLOCK)
    if whole < blocks:
        v[whole, : n - whole * BLOCK] = ids[whole * BLOCK :]
    kind = np.searchsorted((np.uint64(1) << WIDTHS.astype(np.uint64)) - np.uint64(1), v.ravel()).astype(np.uint8).reshape(v.shape)
    most = {1: kind}
    for size, a, b in _RUNS:  # most[size][i]: the widest kind among ids i to i + size - 1, zeros past the end
        m = most[a].copy()
        np.maximum(m[:, : -(size - b)], most[b][:, size - b :], out=m[:, : -(size - b)])
        most[size] = m
    choice = kind.clip(13)  # one id of 60 bits, or an escape
    for s in range(12, -1, -1):
        np.copyto(choice, np.uint8(s), where=most[int(COUNTS[s])] <= s)
    end = np.full(blocks, BLOCK)
    if blocks:
        end[-1] = n - (blocks - 1) * BLOCK
    at, row = np.zeros(blocks, np.int64), np.arange(blocks)
    picks, places = [], []
    while (at < end).any():
        sel = np.where(at < end, choice[row, np.minimum(at, BLOCK - 1)], 255)
        picks.append(sel)
        places.append(at + row * (BLOCK + 60))
        at = at + np.where(sel == 255, 0, COUNTS[np.minimum(sel, 14)])
    if not picks:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint64)
    sel, place = np.array(picks).T, np.array(places).T
    there = sel != 255
    first = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.uint32)
    sel, place = sel[there], place[there]
    words, flat = np.zeros(len(sel), np.uint64), v.ravel()
    for s in range(14):
        own = np.flatnonzero(sel == s)
        if len(own):
            k = np.arange(COUNTS[s])
            got = flat[place[own][:, None] + k] << (k * WIDTHS[s]).astype(np.uint64)
            words[own] = np.bitwise_or.reduce(got, axis=1) | np.uint64(s) << np.uint64(60)
    own = np.flatnonzero(sel == ESCAPE)
    words[own] = np.arange(len(own), dtype=np.uint64) | np.uint64(15) << np.uint64(60)
    return words, first, flat[place[own]]


def unpack(words: np.ndarray, first: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids that ``pack`` wrote."""
    blocks = len(first) - 1
    sel = (words >> np.uint64(60)).astype(np.int64)
    sel[sel == 15] = ESCAPE
    many = COUNTS[sel]
    before = np.cumsum(many) - many
    block = np.repeat(np.arange(blocks), np.diff(first.astype(np.int64)))
    place = before - before[first[:-1].astype(np.int64)][block] + block * (BLOCK + 60) if len(words) else before
    out = np.zeros(blocks * (BLOCK + 60), np.uint64)
    for s in range(14):
        own = np.flatnonzero(sel == s)
        if len(own):
            k = np.arange(COUNTS[s])
            out[place[own][:, None] + k] = words[own][:, None] >> (k * WIDTHS[s]).astype(np.uint64) & (np.uint64(1) << np.uint64(WIDTHS[s])) - np.uint64(1)
    own = np.flatnonzero(sel == ESCAPE)
    out[place[own]] = escapes[(words[own] & (np.uint64(1) << np.uint64(60)) - np.uint64(1)).astype(np.int64)]
    return out.reshape(blocks, BLOCK + 60)[:, :BLOCK].ravel()[:n]


def to_frame(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, first, escapes = pack(ids)
    head = _HEAD.pack(b"S8B1", len(ids), len(doc_ids), len(first) - 1, len(words), len(escapes))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), first.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def from_frame(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, ids of each document, and the ids."""
    magic, n, docs, blocks, words, escapes = _HEAD.unpack_from(payload)
    if magic != b"S8B1":
        raise ValueError("not a frame of token ids")
    at, got = _HEAD.size, []
    for kind, many in (("<i8", docs), ("<u8", docs), ("<u4", blocks + 1), ("<u8", words), ("<u8", escapes)):
        got.append(np.frombuffer(payload, kind, many, at))
        at += got[-1].nbytes
    return got[0], got[1].astype(np.int64), unpack(got[3], got[2], got[4], n)


def whole_texts(tokenizer, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts by the library, and where those of each begin and the last end."""
    got = [e.ids for e in tokenizer.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)]
    return np.array([i for ids in got for i in ids], "<u4"), np.cumsum([0, *map(len, got)])


@lru_cache(maxsize=2)
def _table(definition: str) -> tuple:
    """The tokenizer, the strings of its added tokens, and a table of pieces, if it always starts words where pieces are cut."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    t.no_truncation()
    t.no_padding()
    added = [a.content for a in t.get_added_tokens_decoder().values()]
    try:
        ByteBPE(definition)
    except (KeyError, TypeError, ValueError):
        return t, added, None
    size = np.zeros(t.get_vocab_size(), np.int64)  # bytes of each token: a letter of the vocabulary is a byte
    for token, i in t.get_vocab().items():
        size[i] = len(token)

    def fill(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    return t, added, PieceTable(fill, size)


def write_ids(docs: DataFrame, tokenizer_path: str, out_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text with the tokenizers library and write the ids, by ascending document id."""
    import os

    definition = docs.sparkSession.sparkContext.broadcast(read_definition(tokenizer_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, added, pieces = _table(definition.value)
        part, before = TaskContext.get().partitionId(), 0
        for b in slices(batches, SLICE_BYTES):
            # Texts with an added token's string go through the library whole, those of other tokenizers too.
            if pieces is None or holding(b.column(1), added):
                got, ends = whole_texts(tokenizer, b.column(1))
            else:
                got, ends = pieces.encode(b.column(1))
            counts = np.diff(ends) + 1
            ids = np.insert(got, ends[1:], end_id)
            doc_ids = np.array([NO_ID if i is None else i for i in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "payload": pa.array([to_frame(doc_ids, counts, ids)], pa.binary())})
            before += len(ids)

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = picked.repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(work, "part int, before long, n_ids long, payload binary").write.option("compression", "zstd").parquet(out_path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """The frames with ``start``, the number of ids before each in the whole table.

    Only one row for each part (a written partition) meets in one task, and these
    rows go to the frames: no frame is shuffled, however large the table.
    """
    frames = spark.read.schema("part int, before long, n_ids long, payload binary").parquet(path)
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    return frames.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("before")).alias("start"), "payload")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids)`` of every document written."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs, counts, ids = from_frame(payload)
                ends = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=docs == NO_ID), pa.array(start + ends[:-1]), pa.ListArray.from_arrays(ends.astype(np.int32), ids.astype(np.int64))], names=["doc_id", "start", "ids"])

    return read_frames(spark, path).mapInArrow(work, "doc_id long, start long, ids array<long>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs, counts, ids = from_frame(payload)
                ends, raw = np.concatenate([[0], np.cumsum(counts)]), memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=docs == NO_ID), pa.array(start + ends[:-1]), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_frames(spark, path).mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def scratch_path(spark: SparkSession) -> str:
    return new_path(spark, "ids")
