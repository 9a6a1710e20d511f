"""Remove byte strings that stand more than once, by suffix arrays (operator 8).

Every byte covered by a string of ``least`` bytes that also starts anywhere
else, in the same document too, is removed; strings are judged on the input.

Method: suffix arrays of shards by Larsson-Sadakane refinement in numpy, common
prefixes by Kasai's algorithm, and merging across shards by binary search.
What makes it one pass over a large corpus is how text is dealt to shards:

1. Each string of ``least`` bytes is known by the smallest hash of its 32-byte
   grams (the rightmost of equal ones), its anchor.  The strings of a document
   that share an anchor begin in one run of places; the bytes they cover are a
   segment.  Equal strings have equal anchors, so segments whose anchor hash
   occurs once hold nothing that repeats, and go no further.
2. Equal segments become one, with a count (pre-aggregated before the shuffle).
   All strings of a hash that stands for copies of one segment alone repeat.
3. Different segments of an anchor hash meet in one shard.  Its suffix array
   and common prefixes give the classes of equal strings; a class that stands
   for two or more places is repeated.
4. An anchor hash of more than ``HOT`` different segments is refined: strings
   are told apart by how far in the anchor stands, in blocks of ``WIDTHS``
   places, and by the hash of the bytes that all strings of a block share (all
   but the width of the block).  Equal strings agree in both, so blocks become
   segments of a new, more selective hash, and those that occur once go.
5. What is still hot after the narrowest blocks is dealt to several shards.
   They pass on one key for each class, at most a block's width for a segment,
   and the keys are merged by binary search in ranges of keys.

Texts: null and empty texts and those shorter than ``least`` lose nothing.
Rows that repeat are documents of their own, so their strings repeat.  A null
id is one id.  A very long text is a batch of its own; an empty table gives an
empty one.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.common import over_salts, salt, slices, stored
from tarnlight.llm.shingles import U, _powers, mix, utf8

LEAST = 400
GRAM = 32  # short grams recur by chance, and would make candidates of most of a corpus
HOT = 1500
WIDTHS = (64, 8)
SLICE_BYTES, SHARD_BYTES = 100_000, 400_000  # some 30 arrays of 8 bytes a byte are held
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Places in a batch of texts; no text of a table has more bytes.
_INDEX = U((1 << 31) - 1)
_STEPS = U(1) << np.arange(0, 64, 8, dtype=np.uint64)


def grams(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian integer; zeros past the end."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    out = np.empty(n + 8, ">u8")
    for o in range(8):
        part = padded[o : o + (len(padded) - o) // 8 * 8].view(">u8")
        out[o::8] = part[: len(out[o::8])]
    return out[:n].astype(np.uint64)


class Hasher:
    """Two 64-bit hashes of any stretch of ``raw``, from running sums of a polynomial."""

    def __init__(self, raw: np.ndarray):
        size = 1 << max(18, int(len(raw)).bit_length())
        values = mix(raw.astype(np.uint64) + U(1))
        self.sums, self.powers = [], []
        for base in _BASES:
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(values * _powers(pow(base, -1, 1 << 64), size)[: len(raw)], out=total[1:])
            self.sums.append(total)
            self.powers.append(_powers(base, size))

    def of(self, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [mix((s[end] - s[first]) * p[first] + (end - first).astype(np.uint64)).view(np.int64) for s, p in zip(self.sums, self.powers)]


def anchored(raw: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Anchors: index of the document, hash of the anchor's gram, its place, first and last place of the strings it stands for."""
    n = len(raw)
    long_enough = np.flatnonzero(np.diff(at) >= least)
    none = np.zeros(0, np.int64)
    if not len(long_enough):
        return none, none, none, none, none
    first = grams(raw)
    g = np.zeros(n, np.uint64)
    for o in range(0, GRAM, 8):
        g = mix(g * U(0x2545F4914F6CDD1D) + np.concatenate([first[o:], np.zeros(min(o, n), np.uint64)]))
    key = (g & ~_INDEX) | (_INDEX - np.arange(n, dtype=np.uint64))
    width, done = least - GRAM + 1, 1
    low = key
    while done * 2 <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < width:
        low = np.minimum(low[: n - width + 1], low[width - done : n - done + 1])
    many = at[long_enough + 1] - least - at[long_enough] + 1
    before = np.cumsum(many) - many
    doc = np.repeat(long_enough, many)
    start = np.arange(many.sum()) - np.repeat(before, many) + np.repeat(at[long_enough], many)
    place = (_INDEX - (low[start] & _INDEX)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return doc[first], g[place[first]].view(np.int64), place[first], start[first], start[last]


def anchors(docs: DataFrame, least: int) -> DataFrame:
    """``(id, th, g, h1, h2, s, n, o)``: a row for each segment: its anchor hash, its own hashes, first place, number of strings, and place of the anchor in the segment."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_BYTES):
            raw, at = utf8(b.column(2))
            doc, g, place, s, last = anchored(raw, at, least)
            if not len(doc):
                continue
            h1, h2 = Hasher(raw).of(s, last + least)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(g), pa.array(h1), pa.array(h2), pa.array((s - at[doc]).astype(np.int64)), pa.array((last - s + 1).astype(np.int32)), pa.array((place - s).astype(np.int32))], names=["id", "th", "g", "h1", "h2", "s", "n", "o"])

    return docs.mapInArrow(work, "id long, th long, g long, h1 long, h2 long, s long, n int, o int")


_BLOCK = "g long, h1 long, h2 long, count int, bytes binary, o int, rg long, rh1 long, rh2 long, shift int"


def _blocks(width: int, least: int):
    """Cut segments into blocks of strings whose anchors stand at ``width`` neighbouring places."""
    names = [f.split()[0] for f in _BLOCK.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_BYTES):
            segments = b.column(4).to_pylist()
            raw = np.frombuffer(b"".join(segments), np.uint8)
            size = np.array([len(x) for x in segments])
            base = np.cumsum(size) - size
            o = b.column(5).to_numpy().astype(np.int64)
            low, high = (o - (size - least)) // width, o // width  # blocks of the last and the first string
            many = high - low + 1
            row = np.repeat(np.arange(len(size)), many)
            block = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[row]
            near = block * width
            far = np.minimum(near + width - 1, least - GRAM)
            first = np.maximum(0, o[row] - far)
            end = np.minimum(size[row] - least, o[row] - near) + least
            hasher, anchor = Hasher(raw), base[row] + o[row]
            core = hasher.of(anchor - near, anchor - far + least)[0].view(np.uint64)
            g = mix(core + mix(b.column(0).to_numpy().view(np.uint64)[row] + (block * least + width).astype(np.uint64))).view(np.int64)
            h1, h2 = hasher.of(base[row] + first, base[row] + end)
            take = pa.array(row)
            parts = pa.array([segments[r][x:y] for r, x, y in zip(row.tolist(), first.tolist(), end.tolist())], pa.binary())
            root = [b.column(i).take(take) for i in (6, 7, 8)]
            shift = pa.array((b.column(9).to_numpy()[row] + first).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(h1), pa.array(h2), b.column(3).take(take), parts, pa.array((o[row] - first).astype(np.int32)), *root, shift], names=names)

    return work


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and rank of every suffix, by Larsson-Sadakane refinement.

    Suffixes start in groups of equal 8-byte prefixes; each round sorts the
    groups that have two members or more by the rank ``h`` further on, and
    doubles ``h``.  The end of the text is smaller than any byte.
    """
    n = len(text)
    first = grams(text)
    tail = np.minimum(n - np.arange(n), 8)  # zeros past the end are smaller than the byte zero
    order = np.lexsort((tail, first)) if n < 16 or (text == 0).any() else np.argsort(first)
    new = np.ones(n, bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (tail[order][1:] != tail[order][:-1])
    head = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))  # a group's rank is its first place
    h = 8
    size = np.diff(np.append(head, n))
    open_ = np.flatnonzero(np.repeat(size > 1, size))  # places in the array still to be sorted
    while len(open_):
        who = order[open_]
        here, further = rank[who], rank[np.minimum(who + h, n)]
        by = np.argsort(here << 31 | further + 1)  # both are below 2**31
        who, here, further = who[by], here[by], further[by]
        order[open_] = who
        new = np.ones(len(who), bool)
        new[1:] = (here[1:] != here[:-1]) | (further[1:] != further[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(who)))
        rank[who] = np.repeat(open_[head], size)
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    return order, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, stripe: int = 64) -> np.ndarray:
    """Kasai's algorithm: bytes that each suffix shares with the one before it in the array.

    The text is cut into stripes that are walked side by side: each keeps the
    length found for the last place less one and extends it, 8 bytes at a time
    and then byte by byte.
    """
    n = len(text)
    words = grams(text)
    before = np.where(rank > 0, order[np.maximum(rank - 1, 0)], n)
    out = np.zeros(n, np.int64)
    place = np.arange(0, n, stripe)
    stop = np.minimum(place + stripe, n)
    length = np.zeros(len(place), np.int64)
    while len(place):
        other = before[place]
        length = np.where(other < n, length, 0)
        busy = np.flatnonzero(other < n)
        while len(busy):
            a, b = place[busy] + length[busy], other[busy] + length[busy]
            fit = np.minimum(n - np.maximum(a, b), 8)
            x = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
            same = 8 - np.searchsorted(_STEPS, x, "right")  # leading bytes that are equal
            same = np.minimum(same, np.maximum(fit, 0))
            length[busy] += same
            busy = busy[same == 8]
        out[rank[place]] = length
        length = np.maximum(length - 1, 0)
        place = place + 1
        go = place < stop
        place, stop, length = place[go], stop[go], length[go]
    return out


def repeated_in_shard(segments: list[bytes], counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every string of the segments: segment, place, class, and whether it repeats; and the text."""
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)  # no UTF-8 text has that byte
    size = np.array([len(s) for s in segments])
    base = np.cumsum(size + 1) - size - 1
    order, rank = suffix_array(text)
    shared = common_prefixes(text, order, rank)
    many = size - least + 1
    seg = np.repeat(np.arange(len(size)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = base[seg] + place
    group = np.cumsum(shared < least)[rank[start]]  # places of the array between two short common prefixes
    _, group = np.unique(group, return_inverse=True)
    weight = np.bincount(group, counts[seg])
    return seg, place, group, weight[group] >= 2, start


def _runs(seg: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive places inside a segment; the input is sorted."""
    if not len(seg):
        return seg, place, place
    new = np.ones(len(seg), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    return seg[first], place[first], place[np.append(first[1:], len(seg)) - 1]


_FOUND = "g long, h1 long, h2 long, a int, z int, k1 long, k2 long, weight int, shard long"


def _shards(least: int):
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        g, h1, h2 = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2))
        hot, shard = np.array([r[6] for r in rows], bool), np.array([r[5] for r in rows], np.int64)
        counts = np.array([r[3] for r in rows], np.int64)
        seg, place, group, twice, start = repeated_in_shard([r[4] for r in rows], counts, least)
        s, a, z = _runs(seg[twice], place[twice])
        out = [g[s], h1[s], h2[s], a, z, np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), np.full(len(s), -1)]
        if hot.any():  # a key for each class: of a repeated one once, of a single string with its place
            text = np.frombuffer(b"\xff".join(r[4] for r in rows) + b"\xff", np.uint8)
            _, one = np.unique(group, return_index=True)
            one = one[hot[seg[one]]]
            k1, k2 = Hasher(text).of(start[one], start[one] + least)
            more = [g[seg[one]], h1[seg[one]], h2[seg[one]], place[one], place[one], k1, k2, np.where(twice[one], 2, 1), shard[seg[one]]]
            out = [np.concatenate(p) for p in zip(out, more)]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[f.split()[0] for f in _FOUND.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(7))):
                if held >= SHARD_BYTES and (row[0], row[5]) != (rows[-1][0], rows[-1][5]):
                    yield flush(rows)
                    rows, held = [], 0
                if not rows or row[:3] != rows[-1][:3]:  # rows equal in id and text cut the same segment twice
                    rows.append(row)
                    held += len(row[4])
        if rows:
            yield flush(rows)

    return work


def _merged(_: tuple, group: pa.Table) -> pa.Table:
    """Keys of one range from several shards: the single strings whose class another shard holds too.

    Each shard's keys are a sorted run; every other run is searched for them.
    """
    k1, k2, shard = (group.column(c).to_numpy() for c in ("k1", "k2", "shard"))
    pair = np.rec.fromarrays([k1, k2], names="a,b")
    keys, slot = np.unique(pair, return_inverse=True)
    single = group.column("weight").to_numpy() == 1
    elsewhere = np.zeros(len(k1), bool)
    runs = [(s, np.unique(slot[shard == s])) for s in np.unique(shard)]
    held = np.sort(np.concatenate([r for _, r in runs]))  # how many runs hold a key: its extent in the merged run
    extent = np.searchsorted(held, slot, "right") - np.searchsorted(held, slot, "left")
    elsewhere = extent >= 2
    return group.filter(pa.array(single & elsewhere)).select(["g", "h1", "h2", "a", "z"])


def _recurring(per: DataFrame) -> DataFrame:
    """``per(g, h1, h2, count)`` with ``kinds``, how many different segments a hash stands for, where they are two or stand twice.

    Different segments of one hash, however many, are dealt to salts.
    """
    salted = per.withColumn("salt", salt("h1", "h2"))
    each = over_salts(salted, ["g"], all=(F.sum, F.sum("count")), kinds=(F.sum, F.count("*")))
    return salted.join(each.where("`all` > 1").select("g", "salt", "kinds"), ["g", "salt"]).drop("salt")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(id, th, text, spans)``: every row with the places where its repeated strings begin, as runs."""
    picked = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    every = stored(anchors(picked, least), "anchors")
    per = every.groupBy("g", "h1", "h2").agg(F.count("*").alias("count"), F.min(F.struct("id", "th", "s", "n", "o")).alias("one"))
    same = stored(_recurring(per), "segments")
    spans = same.where("kinds = 1").select("g", "h1", "h2", F.lit(0).alias("a"), (F.col("one.n") - 1).alias("z"))
    wanted = same.where("kinds > 1").select("one.*", "g", "h1", "h2", F.least("count", F.lit(2)).cast("int").alias("count"), (F.col("kinds") > HOT).alias("hot"))
    by_doc = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("g", "h1", "h2", "count", "s", "n", "o", "hot")).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1_000_000):
            rows = []
            for text, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                rows += [(p["g"], p["h1"], p["h2"], p["count"], raw[p["s"] : p["s"] + p["n"] + least - 1], p["o"], p["hot"]) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 3 + [pa.int32(), pa.binary(), pa.int32(), pa.bool_()])], names=["g", "h1", "h2", "count", "bytes", "o", "hot"])

    cuts = stored(picked.join(by_doc, ["id", "th"]).select("text", "parts").mapInArrow(cut, "g long, h1 long, h2 long, count int, bytes binary, o int, hot boolean"), "cuts")
    key = ["g", "h1", "h2"]
    ready = cuts.where("NOT hot").select(*key, "count", "bytes", F.lit(0).alias("parts"))
    hot, links = cuts.where("hot").select(*key, "count", "bytes", "o", F.col("g").alias("rg"), F.col("h1").alias("rh1"), F.col("h2").alias("rh2"), F.lit(0).alias("shift")), None
    for width in WIDTHS:
        blocks = stored(hot.mapInArrow(_blocks(width, least), _BLOCK), "blocks")
        recurring = _recurring(blocks.groupBy(key).agg(F.sum("count").alias("count"))).select(*key, "kinds")
        kept = stored(blocks.join(recurring, key), "blocks")
        parts = F.when(F.col("kinds") > HOT, F.ceil(F.col("kinds") / HOT)).otherwise(0).cast("int").alias("parts")
        done = kept if width == WIDTHS[-1] else kept.where(F.col("kinds") <= HOT)
        spans = spans.union(done.where("kinds = 1").select(*key, F.lit(0), F.octet_length("bytes") - least).distinct())
        hot = kept.where(F.col("kinds") > HOT).select(*blocks.columns)
        ready = ready.union(done.where("kinds > 1").groupBy(*key, parts).agg(F.least(F.sum("count"), F.lit(2)).cast("int").alias("count"), F.first("bytes").alias("bytes")).select(*key, "count", "bytes", "parts"))
        of_root = done.select(*key, "rg", "rh1", "rh2", "shift")
        links = of_root if links is None else links.union(of_root)
    salt = F.when(F.col("parts") > 0, F.pmod("h1", "parts")).otherwise(0).cast("long")
    dealt = ready.select(*key, "count", "bytes", salt.alias("salt"), (F.col("parts") > 0).alias("hot")).repartition("g", "salt").sortWithinPartitions("g", "salt", "h1", "h2")
    found = stored(dealt.mapInArrow(_shards(least), _FOUND), "repeats")
    merged = found.where("weight > 0").groupBy("g", F.shiftright("k1", 56).alias("range")).applyInArrow(_merged, "g long, h1 long, h2 long, a int, z int")
    spans = spans.union(found.where("weight = 0").select(*key, "a", "z")).union(merged)
    rooted = links.distinct().join(spans, key).select(F.col("rg").alias("g"), F.col("rh1").alias("h1"), F.col("rh2").alias("h2"), (F.col("a") + F.col("shift")).alias("a"), (F.col("z") + F.col("shift")).alias("z"))
    of = stored(spans.union(rooted).groupBy(key).agg(F.collect_list(F.struct("a", "z")).alias("spans")), "spans")  # read again, so that the join can split a frequent segment
    own = every.join(of, key).select("id", "th", F.transform("spans", lambda p: F.struct((p["a"] + F.col("s")).alias("a"), (p["z"] + F.col("s")).alias("z"))).alias("spans"))
    by_doc = own.groupBy("id", "th").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    return picked.join(by_doc, ["id", "th"], "left")


def _cut(raw: bytes, spans: list | None, least: int) -> tuple[bytes, int]:
    """What is left of the bytes, and the number of maximal runs that went."""
    kept, n, upto, end = [], 0, 0, -1
    for a, z in sorted((s["a"], s["z"]) for s in spans or ()):
        if a > end:
            kept.append(raw[upto:a])
            n += 1
        upto = end = max(end, z + least)
    return b"".join([*kept, raw[upto:]]), n


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``; ``kept`` as bytes, since a cut may fall inside a character."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            got = [_cut(r, s, least) for r, s in zip(raw, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array([len(r) - len(k) for r, (k, _) in zip(raw, got)], pa.int64()), pa.array([n for _, n in got], pa.int64()), pa.array([k for k, _ in got], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = removed(docs, id_col, text_col, least).select(F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id"), "text", "spans")
    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
