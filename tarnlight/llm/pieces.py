"""Cut text at places where a byte-level BPE always starts a new word.

The pre-tokenizer of a byte-level BPE starts a new word at a single space or
line feed that stands between two characters that are not white space, and at a
mark such as a comma behind a letter from a to z.  Cutting there gives short
pieces that recur all the time, so that most of a text is
found in a table of pieces seen before; pieces are looked up many at a time, by
a hash and then by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tarnlight.llm.shingles import U, mix, utf8

#: Pieces of more bytes than this are looked up one by one.
WIDTH = 32
#: New pieces that are encoded as one string.
JOINED = 2048
#: Marks that never belong to the word of the letter before them.
MARKS = np.isin(np.arange(256), list(b",.;:!?)"))
_WORD = np.dtype(f"V{WIDTH}")


def white(raw: np.ndarray) -> np.ndarray:
    """Bytes of white space: of ASCII, with the separators 28 to 31, and of Unicode."""
    out = (raw == 32) | ((raw >= 9) & (raw <= 13)) | ((raw >= 28) & (raw <= 31))
    if (raw >= 0xC2).any():
        after = lambda at, k: raw[np.minimum(at + k, len(raw) - 1)]
        two = np.flatnonzero(raw == 0xC2)
        two = two[(after(two, 1) == 0x85) | (after(two, 1) == 0xA0)]
        three = np.flatnonzero((raw >= 0xE1) & (raw <= 0xE3))
        b, c = after(three, 1), after(three, 2)
        first = raw[three]
        hit = (first == 0xE1) & (b == 0x9A) & (c == 0x80)
        hit |= (first == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        hit |= (first == 0xE2) & (b == 0x81) & (c == 0x9F)
        hit |= (first == 0xE3) & (b == 0x80) & (c == 0x80)
        three = three[hit]
        for at in (two, two + 1, three, three + 1, three + 2):
            out[np.minimum(at, len(raw) - 1)] = True
    return out


def cuts(raw: np.ndarray, at: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, which stand one after the other from the places ``at``; with the end of all."""
    n = len(raw)
    begin = np.zeros(n + 1, bool)
    if n > 2:
        here = raw[1 : n - 1]
        begin[1 : n - 1] = ((here == 32) | (here == 10)) & ~space[: n - 2] & ~space[2:]
        lower = raw[: n - 2] | 32
        begin[1 : n - 1] |= MARKS[here] & (lower >= 97) & (lower <= 122)
    starts = at[:-1][np.diff(at) > 0]
    begin[np.maximum(at[1:] - 1, 0)] &= ~space[np.maximum(at[1:] - 1, 0)]  # not at a space that ends a text
    begin[starts] = True
    begin[n] = True
    return np.flatnonzero(begin)


def parted(ids: np.ndarray, width: np.ndarray, size: np.ndarray) -> np.ndarray | None:
    """How many of the ids, of ``width`` bytes each by id, each of the pieces of ``size`` bytes has; None if an id runs over a seam."""
    ends, tops = np.cumsum(size), np.cumsum(width[ids])
    last = np.searchsorted(tops, ends)
    if not len(tops) or tops[-1] != ends[-1] or (tops[last] != ends).any():
        return None
    return np.diff(last, prepend=-1)


class PieceTable:
    """The ids of pieces, for about ``most`` pieces at a time.

    ``fill`` turns a list of strings into the list of their ids (arrays).  New
    pieces that begin a word and end in one are given to it as one string, and
    the ids are parted by their bytes, ``width`` by id.  A piece is found only if
    all its bytes are those of the piece in the table.
    """

    def __init__(self, fill: Callable[[list[str]], list[np.ndarray]], width: np.ndarray, most: int = 600_000):
        self.fill, self.width, self.most = fill, width, most
        self.bits = (4 * most).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.n, room = 0, 1 << 14
        self.words = np.zeros((room, WIDTH // 8), np.uint64)
        self.key = np.zeros(room, np.uint64)
        self.first = np.zeros(room + 1, np.int64)  # the ids of piece i are those from first[i] to first[i + 1]
        self.ids = np.zeros(4 * room, "<u4")
        self.long: dict[bytes, int] = {}

    def _find(self, key: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Numbers of pieces in the table; -1 for those that are not there."""
        out = np.full(len(key), -1, np.int64)
        at = (key >> U(64 - self.bits)).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            there = self.slot[at]
            known = there >= 0
            same = known & (self.key[there] == key[left])
            out[left[same]] = there[same]
            go = known & ~same
            left, at = left[go], (at[go] + 1) & (len(self.slot) - 1)
        hit = out >= 0
        hit[hit] = (self.words[out[hit]] == words[hit]).all(axis=1)
        return np.where(hit, out, -1)

    def _room(self, name: str, n: int) -> None:
        a = getattr(self, name)
        if len(a) < n:
            setattr(self, name, np.concatenate([a, np.zeros((max(n, 2 * len(a)) - len(a), *a.shape[1:]), a.dtype)]))

    def _add(self, ids: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Numbers of new pieces, whose ids stand one after the other."""
        a, z = self.n, self.n + len(many)
        self._room("first", z + 1)
        self.first[a + 1 : z + 1] = self.first[a] + np.cumsum(many)
        self._room("ids", int(self.first[z]))
        self.ids[self.first[a] : self.first[z]] = ids
        self.n = z
        self._room("words", z)
        self._room("key", z)
        return np.arange(a, z)

    def _each(self, texts: list[str]) -> np.ndarray:
        got = self.fill(texts) if texts else []
        return self._add(np.concatenate([*got, np.zeros(0, "<u4")]), np.array(list(map(len, got)), np.int64))

    def _new(self, raw: np.ndarray, space: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of new pieces."""
        out = np.zeros(len(begin), np.int64)
        head = raw[begin]
        whole = ((head == 32) | (head == 10)) & (size > 1) & ~space[np.minimum(begin + 1, len(raw) - 1)] & ~space[begin + size - 1]
        runs = [x for x in np.array_split(np.flatnonzero(whole), -(-int(whole.sum()) // JOINED) or 1) if len(x)]
        alone = [np.flatnonzero(~whole)]
        texts = []
        for run in runs:
            upto = np.cumsum(size[run])
            texts.append(raw[np.repeat(begin[run] - (upto - size[run]), size[run]) + np.arange(upto[-1])].tobytes().decode())
        for run, ids in zip(runs, self.fill(texts) if texts else [], strict=True):
            many = parted(ids, self.width, size[run])
            if many is None:
                alone.append(run)
            else:
                out[run] = self._add(ids, many)
        rest = np.concatenate(alone)
        out[rest] = self._each([raw[a:z].tobytes().decode() for a, z in zip(begin[rest].tolist(), (begin[rest] + size[rest]).tolist())])
        return out

    def _numbers(self, raw: np.ndarray, space: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The number of each piece, new ones put into the table."""
        size = np.diff(begin)
        if self.n > self.most:
            self._clear()
        padded = np.concatenate([raw, np.zeros(WIDTH, np.uint8)])
        every = np.ndarray((len(raw) + 1,), _WORD, padded.data, strides=(1,))
        short = np.flatnonzero(size <= WIDTH)
        words = every[begin[short]].view(np.uint64).reshape(-1, WIDTH // 8)
        for k in range(WIDTH // 8):  # zeros behind the piece
            own = (size[short] - 8 * k).clip(0, 8)
            words[:, k] &= np.where(own == 8, U(2**64 - 1), (U(1) << (8 * np.minimum(own, 7)).astype(np.uint64)) - U(1))
        key = size[short].astype(np.uint64)
        for k in range(WIDTH // 8):
            key = (key ^ words[:, k]) * U(0x9E3779B97F4A7C15)
            key ^= key >> U(29)
        key = mix(key)
        number = np.full(len(size), -1, np.int64)
        found = self._find(key, words)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            _, some, back = np.unique(key[miss], return_index=True, return_inverse=True)
            which = miss[some]  # one place for each new key
            new = self._new(raw, space, begin[short[which]], size[short[which]])
            self.words[new], self.key[new] = words[which], key[which]
            self._insert(key[which], new)
            found[miss] = new[back]
            odd = miss[(words[miss] != words[which][back]).any(axis=1)]  # equal keys of different pieces
            for i in odd.tolist():
                found[i] = self._one(raw[begin[short[i]] : begin[short[i]] + size[short[i]]].tobytes())
        number[short] = found
        long = np.flatnonzero(size > WIDTH)
        if len(long):
            text = [raw[a:z].tobytes() for a, z in zip(begin[long].tolist(), begin[long + 1].tolist())]
            new = [x for x in dict.fromkeys(text) if x not in self.long]
            self.long.update(zip(new, self._each([x.decode() for x in new]).tolist()))
            number[long] = [self.long[x] for x in text]
        return number

    def _one(self, piece: bytes) -> int:
        if piece not in self.long:
            self.long[piece] = int(self._each([piece.decode()])[0])
        return self.long[piece]

    def _insert(self, key: np.ndarray, number: np.ndarray) -> None:
        at = (key >> U(64 - self.bits)).astype(np.int64)
        while len(at):
            free = self.slot[at] < 0
            _, winner = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = winner[free[winner]]
            self.slot[at[put]] = number[put]
            left = np.ones(len(at), bool)
            left[put] = False
            at, number = (at[left] + ~free[left]) & (len(self.slot) - 1), number[left]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where those of each text begin and the last end; null is empty."""
        raw, at = utf8(texts)
        if not len(raw):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        space = white(raw)
        begin = cuts(raw, at, space)
        number = self._numbers(raw, space, begin)
        many = self.first[number + 1] - self.first[number]
        upto = np.concatenate([[0], np.cumsum(many)])
        ids = self.ids[np.repeat(self.first[number] - upto[:-1], many) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(begin, at)]
