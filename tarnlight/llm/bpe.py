"""Byte-pair encoding and decoding of whole texts (operator 10).

Method: a contiguous array of part boundaries with the rank of each adjacent
pair.  The smallest rank is found by a scan, its boundary is deleted, and the
ranks of the two neighbours are refreshed, until no pair has a rank.  Words of
one length are worked side by side as the rows of a numpy matrix.

Texts: null counts as empty; an empty text has no ids.  Repeated rows are
encoded each by itself; a very long text is worked whole, its pieces once each.
Of equal ranks in a word the leftmost pair is merged first.  An empty table
gives an empty one; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.common import slices
from tarnlight.llm.pieces import PieceTable
from tarnlight.llm.shingles import utf8

#: Fixed value: the word pattern of the byte-level pre-tokenizer.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more bytes than this are merged with a heap instead of a row of a matrix.
SHORT = 128
#: Bytes of text that are worked at a time.
SLICE_BYTES = 1_000_000
NONE = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    keep = set(printable)
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class ByteBPE:
    """Vocabulary and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, definition: str):
        d = json.loads(definition)
        model, pre = d["model"], d["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or d["normalizer"] or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE")
        vocab, letters = model["vocab"], byte_alphabet()
        to_byte = {c: b for b, c in enumerate(letters)}
        if len(vocab) > 1 << 16:
            raise ValueError("more than 65,536 ids")
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in d["added_tokens"])])
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        self.added: dict[str, int] = {}
        for t in d["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError("added tokens that take white space along are not supported")
            self.added[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = t["content"].encode()
        self.width = np.array([*map(len, self.bytes_of), 0], np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self.pool = np.frombuffer(b"".join(self.bytes_of) + b"\0", np.uint8)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.word = regex.compile(WORD)
        # The pairs by open addressing, for lookups of many at a time.
        bits = max(4, (4 * len(self.pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        keys = np.array([a << 16 | b for a, b in self.pairs], dtype=np.int64)
        ranks = np.array([r for r, _ in self.pairs.values()], dtype=np.int32)
        into = np.array([m for _, m in self.pairs.values()], dtype=np.int32)
        n = (1 << bits) + 64
        self.key, self.rank, self.into = np.full(n, -1, np.int64), np.full(n, NONE, np.int32), np.zeros(n, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.key[slot[left]] < 0
            _, winners = np.unique(np.where(free, slot[left], -1 - left), return_index=True)
            put = left[winners[free[winners]]]
            self.key[slot[put]], self.rank[slot[put]], self.into[slot[put]] = keys[put], ranks[put], into[put]
            left = np.setdiff1d(left, put)
            slot[left] += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE without one) and merged id of each pair of ids; negative ids have none."""
        key = np.where((a < 0) | (b < 0), -2, a << 16 | b)
        slot = self._slot(key)
        rank, into = np.full(len(key), NONE, np.int32), np.zeros(len(key), np.int64)
        open_ = np.arange(len(key))
        for _ in range(self.probes):
            there = self.key[slot[open_]]
            hit = there == key[open_]
            rank[open_[hit]], into[open_[hit]] = self.rank[slot[open_[hit]]], self.into[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
            if not len(open_):
                break
            slot[open_] += 1
        return rank, into

    def merge_rows(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words of one length: a row of ids each.  Returns the rows and how many ids each has left."""
        n, width = part.shape
        if not n or width == 1:
            return part, np.full(n, width)
        out, left = part.copy(), np.full(n, width)
        ranks = np.full((n, width), NONE, np.int32)
        rank, into = self.find(part[:, :-1].ravel(), part[:, 1:].ravel())
        ranks[:, :-1] = rank.reshape(n, -1)
        merged = np.zeros((n, width), np.int64)
        merged[:, :-1] = into.reshape(n, -1)
        rows, at = np.arange(n), np.arange(width)
        while len(rows):
            best = ranks.argmin(axis=1)
            own = np.arange(len(rows))
            more = ranks[own, best] != NONE
            if not more.all():
                out[rows[~more]] = part[~more]
                rows, part, ranks, merged, best = rows[more], part[more], ranks[more], merged[more], best[more]
                own = np.arange(len(rows))
                if not len(rows):
                    break
            part[own, best] = merged[own, best]
            src = np.minimum(at + (at > best[:, None]), width - 1)  # the boundary after best goes
            part = np.take_along_axis(part, src, 1)
            part[:, -1] = -1
            src = np.minimum(at + (at >= best[:, None]), width - 1)
            ranks, merged = np.take_along_axis(ranks, src, 1), np.take_along_axis(merged, src, 1)
            ranks[:, -1] = NONE
            left[rows] -= 1
            nxt = np.where(best + 1 < width, part[own, np.minimum(best + 1, width - 1)], -1)
            rank, into = self.find(part[own, best], nxt)
            ranks[own, best], merged[own, best] = rank, into
            back = np.maximum(best - 1, 0)
            rank, into = self.find(np.where(best > 0, part[own, back], -1), part[own, best])
            has = best > 0
            ranks[own[has], back[has]], merged[own[has], back[has]] = rank[has], into[has]
        return out, left

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for one long word, with a heap in place of the scan."""
        nxt, prev, alive = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], [True] * len(ids)
        heap = [(self.pairs[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = nxt[i] if alive[i] else -1
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], alive[j], nxt[i] = self.pairs[pair][1], False, nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            for a, b in ((prev[i], i), (i, nxt[i])):
                if a >= 0 and b >= 0 and (p := (ids[a], ids[b])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[p][0], a, p))
        return [x for x, ok in zip(ids, alive) if ok]

    def fill(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        words: dict[str, int] = {}
        spelled = [[words.setdefault(w, len(words)) for w in self.word.findall(t)] for t in texts]
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        done: list[bytes] = [b""] * len(raw)
        for width in np.unique(length).tolist():
            if width > SHORT:
                for i in np.flatnonzero(length == width).tolist():
                    done[i] = np.array(self.merge_long(self.first[np.frombuffer(raw[i], np.uint8)].tolist()), "<u4").tobytes()
                continue
            which = np.flatnonzero(length == width)
            for at in range(0, len(which), 20_000):
                some = which[at : at + 20_000].tolist()
                part = self.first[np.frombuffer(b"".join(raw[i] for i in some), np.uint8)].reshape(-1, width)
                ids, left = self.merge_rows(part)
                for i, row, n in zip(some, ids.astype("<u4"), left.tolist()):
                    done[i] = row[:n].tobytes()
        return [np.frombuffer(b"".join([done[i] for i in s]), "<u4") for s in spelled]

    def encode(self, pieces: PieceTable, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where those of each begin and the last end; strings of added tokens become those tokens."""
        if not holding(texts, self.added):
            return pieces.encode(texts)
        between, found, upto = [], [], [0]
        for t in texts.fill_null("").to_pylist():
            between += self.special.split(t)
            found += [*self.special.findall(t), None]
            upto.append(len(between))
        ids, ends = pieces.encode(pa.array(between, pa.string()))
        there = [i for i, f in enumerate(found) if f]
        ids = np.insert(ids, ends[1:][there], [self.added[found[i]] for i in there])
        more = np.cumsum([0, *(f is not None for f in found)])
        return ids, (ends + more)[upto]

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids one after the other; unknown ids have none."""
        ids = np.where(ids < self.size, ids, self.size)
        many = self.width[ids]
        before = np.cumsum(many) - many
        return self.pool[np.repeat(self.begin[ids] - before, many) + np.arange(many.sum())]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD, unknown ids nothing."""
        known = np.array([i for i in ids if 0 <= i < self.size], np.int64)
        return self.decode_bytes(known).tobytes().decode("utf-8", "replace")


def holding(texts: pa.Array, strings: Iterable[str]) -> bool:
    """Whether a text may hold one of the strings."""
    raw, _ = utf8(texts)
    data = raw.tobytes()
    return any(x.encode() in data for x in strings)


def decimal(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below ``size`` in decimal with a comma behind, each padded to 8 bytes, and their lengths."""
    text = [f"{i}," for i in range(size)]
    return np.array(text, "S8").view(np.uint64), np.array(list(map(len, text)))


@lru_cache(maxsize=2)
def _loaded(definition: str) -> tuple[ByteBPE, PieceTable, tuple[np.ndarray, np.ndarray]]:
    bpe = ByteBPE(definition)
    return bpe, PieceTable(bpe.fill, bpe.width), decimal(bpe.size)


def read_definition(path: str) -> str:
    """The tokenizer file, read on the driver; it goes to the executors with the task."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: the ids of every whole text; null and empty texts have no ids."""
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pieces, _ = _loaded(definition.value)
        for b in slices(batches, SLICE_BYTES):
            ids, ends = bpe.encode(pieces, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))], names=["id", "ids"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(work, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(id, text)`` of ``(id, ids)``; null ids give an empty text."""
    definition = encoded.sparkSession.sparkContext.broadcast(read_definition(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, *_ = _loaded(definition.value)
        for b in slices(batches, SLICE_BYTES):
            texts = [bpe.decode([i for i in ids or () if i is not None]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select("id", "ids").mapInArrow(work, "id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids, and return digests of both.

    ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``; both steps share a task,
    so neither ids nor texts travel.  Null and empty texts have 0 ids.
    """
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pieces, (digits, length) = _loaded(definition.value)
        sha, place = hashlib.sha256, np.arange(8)
        for b in slices(batches, SLICE_BYTES):
            ids, ends = bpe.encode(pieces, b.column(1))
            many = length[ids]
            spelled = memoryview(digits[ids].view(np.uint8).reshape(-1, 8)[place < many[:, None]])
            text = memoryview(bpe.decode_bytes(ids))
            of_ids, of_text = [], []
            upto, done = (np.concatenate([[0], np.cumsum(x)])[ends].tolist() for x in (many, bpe.width[ids]))
            for k in range(b.num_rows):
                of_ids.append(sha(spelled[upto[k] : max(upto[k], upto[k + 1] - 1)]).hexdigest())
                raw = bytes(text[done[k] : done[k + 1]])
                of_text.append(sha(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
