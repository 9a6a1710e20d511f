"""Remove passages that an earlier document has, by fixed-block anchors (operator 12).

Every word covered by ``least`` consecutive words that also start in a document
of a smaller id goes; windows are judged on the input.  Words are runs of
characters other than ASCII white space.

Method: a document is cut into reference blocks of half a window that do not
overlap, so that every window holds a whole one.  Blocks are indexed by hash
with the smallest document that has them.  Every rolling run of as many words
probes the index; a hit in an earlier document is extended, at each of the
places it can take in a window, to the windows around it, which are looked up
among those around the blocks that were hit (128 bits).  Windows found overlap
to maximal runs, and these are cut out.

Three steps keep that small.  Copies of a whole text need no search: all of a
copy is in the smallest document that has the text.  Only text around a run of
``GRAM`` words that is the minimum of a window and stands in several texts can
hold a repeat, so blocks and probes are made there alone.  And texts without
such a run are finished in the first pass and never shuffled again.

Scale: blocks and windows are aggregated to the smallest document before they
are shuffled; what is looked up in them is joined row by row, so a passage that
a third of all documents has is a skewed side of a join, which is split.

A null id is later than none and earlier than none, so such rows lose nothing
and take nothing.  Rows that repeat an id are one document's.  Null and empty
texts have no words.  A very long text is a batch of its own; an empty table
gives an empty one.  Other columns are not looked at; ``dedup`` returns those of
its input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.common import free, over_salts, salt, slices, stored
from tarnlight.llm.shingles import U, _powers, mix, utf8, words

LEAST = 50
GRAM = 10
SLICE_BYTES = 1_000_000
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Words in a batch of texts.
_INDEX = U((1 << 31) - 1)


class Runs:
    """Hashes of runs of words, from running sums of a polynomial."""

    def __init__(self, h: np.ndarray, many: int = 1):
        size, self.parts = 1 << max(16, len(h).bit_length()), []
        for base in _BASES[:many]:
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(mix(h + U(base)) * _powers(pow(base, -1, 1 << 64), size)[: len(h)], out=total[1:])
            self.parts.append((total, _powers(base, size)))

    def of(self, first: np.ndarray, k: int) -> list[np.ndarray]:
        """The hashes of the ``k`` words from each place on, which must be there."""
        return [mix((s[first + k] - s[first]) * p[first] + U(k)) for s, p in self.parts]


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers of each interval, ends included, one interval after the other; and the interval of each."""
    many = np.maximum(last - first + 1, 0)
    of = np.repeat(np.arange(len(many)), many)
    return np.arange(many.sum()) - (np.cumsum(many) - many)[of] + first[of], of


def minima(h: np.ndarray, before: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Minimal runs of ``gram`` words of the windows of each text: text, hash, first window (a place in the text), and windows."""
    none = np.zeros(0, np.int64)
    n = np.diff(before)
    start, text = spread(before[:-1], before[1:] - least)
    if not len(start):
        return none, none.astype(np.uint64), none, none
    g = Runs(h).of(np.arange(len(h) - gram + 1), gram)[0]
    low = (g & ~_INDEX) | (_INDEX - np.arange(len(g), dtype=np.uint64))  # the rightmost of equal ones
    width, done = least - gram + 1, 1
    while done * 2 <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < width:
        low = np.minimum(low[: len(g) - width + 1], low[width - done : len(g) - done + 1])
    at = (_INDEX - (low[start] & _INDEX)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], g[at[first]], start[first] - before[text[first]], np.diff(np.append(first, len(start)))


def _batches(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in slices(batches, SLICE_BYTES):
        yield b, *words(*utf8(b.column(text_at)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchors(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """``(g, id, th, s, n)``: a run of ``gram`` words that is the minimum of ``n`` windows from place ``s`` on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, h, before in _batches(batches, 2):
            text, g, s, n = minima(h, before, least, gram)
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([_signed(g), b.column(0).take(take), b.column(1).take(take), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], names=["g", "id", "th", "s", "n"])

    return docs.mapInArrow(work, "g long, id long, th long, s int, n int")


def merged(row: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of each row's intervals as intervals that do not touch; rows and places are below 2**31."""
    if not len(row):
        return row, a, z
    order = np.lexsort((a, row))
    row, a, z = row[order], a[order], z[order]
    upto = np.maximum.accumulate((row << 32) + z)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] << 32) + a[1:] > upto[:-1] + 1
    first = np.flatnonzero(new)
    return row[first], a[first], np.maximum.reduceat(z, first)


def _listed(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a column of lists, and the elements."""
    many = pc.list_value_length(column).fill_null(0).to_numpy()
    return np.repeat(np.arange(len(many)), many), column.flatten()


def _blocks(least: int, reference: bool):
    """Reference blocks, or rolling runs of as many words, of the windows in a text's regions."""
    block = least // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, h, before in _batches(batches, 2):
            row, parts = _listed(b.column(3))
            s, n, wanted = (parts.field(f).to_numpy(zero_copy_only=False) for f in ("s", "n", "ref" if reference else "probe"))
            s, n = s.astype(np.int64), n.astype(np.int64)
            # A window at s holds the blocks from s to s + least - block.
            row, a, z = merged(row[wanted], s[wanted], (s + n - 1 + least - block)[wanted])
            if reference:
                o, of = spread(-(-a // block), z // block)
                o = o * block
            else:
                o, of = spread(a, z)
            take = pa.array(row[of])
            key = Runs(h).of(before[:-1][row[of]] + o, block)[0]
            yield pa.RecordBatch.from_arrays([_signed(key), b.column(0).take(take), b.column(1).take(take), pa.array(o.astype(np.int32))], names=["h", "id", "th", "p"])

    return work


def _windows(least: int):
    """Windows around the blocks at a text's places."""
    block = least // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, h, before in _batches(batches, 2):
            row, p = _listed(b.column(3))
            p = p.to_numpy().astype(np.int64)
            row, a, z = merged(row, np.maximum(p - (least - block), 0), np.minimum(p, np.diff(before)[row] - least))
            s, of = spread(a, z)
            w1, w2 = Runs(h, 2).of(before[:-1][row[of]] + s, least)
            take = pa.array(row[of])
            yield pa.RecordBatch.from_arrays([_signed(w1), _signed(w2), b.column(0).take(take), b.column(1).take(take), pa.array(s.astype(np.int32))], names=["w1", "w2", "id", "th", "s"])

    return work


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``copies(id, th)``, texts that a smaller id has whole; and ``found(id, th, text, windows)`` of the others that hold repeated windows, with their places.

    ``th`` is a hash of the text, which tells the rows of a repeated id apart.
    """
    if least < 2 or not 0 < gram <= least:
        raise ValueError("least must be at least 2, and gram between 1 and least")
    picked = _picked(docs, id_col, text_col).where("id IS NOT NULL")
    small = picked.select("id", "th", F.xxhash64(F.lit(1), "text").alias("th2")).withColumn("salt", salt("id"))
    of = over_salts(small, ["th", "th2"], rep=(F.min, F.min("id")))
    copies = stored(small.join(of, ["th", "th2", "salt"]).where("id > rep").select("id", "th").distinct(), "copies")

    every = stored(anchors(picked, least, gram), "anchors")
    # In different texts: what only copies of one text share is known already.
    several = every.groupBy("g").agg(F.min("th").alias("a"), F.max("th").alias("z"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("a < z AND lo < hi")
    # What is joined back is written and read again, so that the join can split the rows of a frequent key.
    near = every.join(stored(several.select("g", "lo", "hi"), "several"), "g")
    part = F.struct("s", "n", (F.col("lo") < F.col("id")).alias("probe"), (F.col("hi") > F.col("id")).alias("ref"))
    regions = near.groupBy("id", "th").agg(F.collect_set(part).alias("regions")).join(copies, ["id", "th"], "left_anti")
    cand = stored(picked.join(regions, ["id", "th"]).select("id", "th", "text", "regions"), "candidates")

    row = "h long, id long, th long, p int"
    blocks = stored(cand.mapInArrow(_blocks(least, True), row), "blocks")
    index = stored(blocks.groupBy("h").agg(F.min("id").alias("lo")), "index")
    probes = cand.mapInArrow(_blocks(least, False), row)
    hits = stored(probes.join(index, "h").where("lo < id").select("h", "id", "th", "p"), "hits")
    hit = blocks.join(stored(hits.select("h").distinct(), "hit"), "h", "left_semi")

    def around(places: DataFrame) -> DataFrame:
        by_doc = places.groupBy("id", "th").agg(F.collect_set("p").alias("places"))
        return cand.select("id", "th", "text").join(by_doc, ["id", "th"]).mapInArrow(_windows(least), "w1 long, w2 long, id long, th long, s int")

    earliest = stored(around(hit).groupBy("w1", "w2").agg(F.min("id").alias("lo")), "earliest")
    found = around(hits).join(earliest, ["w1", "w2"]).where("lo < id").groupBy("id", "th").agg(F.collect_set("s").alias("windows"))
    return copies, cand.select("id", "th", "text").join(found, ["id", "th"])


def _kept(text: str, windows: list[int], least: int) -> tuple[str, int]:
    """The words left, joined by one space, and the number of those that went."""
    w, kept, upto = text.encode().split(), [], 0
    gone = 0
    for s in sorted(windows):
        if s > upto:
            kept += w[upto:s]
        gone += s + least - max(s, upto)
        upto = s + least
    return b" ".join(kept + w[upto:]).decode(), gone


def cut(found: DataFrame, least: int = LEAST) -> DataFrame:
    """``(id, th, n_removed, kept)`` of the texts that hold repeated windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_BYTES):
            got = [_kept(t, s, least) for t, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([n for _, n in got], pa.int64()), pa.array([k for k, _ in got], pa.string())], names=["id", "th", "n_removed", "kept"])

    return found.select("id", "th", "text", "windows").mapInArrow(work, "id long, th long, n_removed long, kept string")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        w = [(t or "").encode().split() for t in b.column(2).to_pylist()]
        digest = [hashlib.sha256(b" ".join(x)).hexdigest() for x in w]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, w), pa.int64()), pa.array(digest, pa.string())], names=["id", "th", "n_words", "whole"])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row, without moving texts that lose nothing."""
    copies, found = repeats(docs, id_col, text_col, least, gram)
    rows = _picked(docs, id_col, text_col).mapInArrow(_whole, "id long, th long, n_words long, whole string")
    partly = cut(found, least).select("id", "th", "n_removed", F.sha2("kept", 256).alias("kept")).dropDuplicates(["id", "th"])
    changed = partly.union(copies.select("id", "th", F.lit(None).cast("long"), F.sha2(F.lit(""), 256)))
    both = rows.join(changed.withColumn("changed", F.lit(True)), ["id", "th"], "left")
    gone = F.when(F.col("changed") & (F.col("n_words") >= least), F.coalesce("n_removed", "n_words")).otherwise(F.lit(0))
    return both.select(F.col("id").alias("doc_id"), "n_words", gone.alias("n_removed"), F.when(gone > 0, F.col("kept")).otherwise(F.col("whole")).alias("kept_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs``, columns unchanged; texts that lose words are what is left, joined by one space."""
    copies, found = repeats(docs, id_col, text_col, least, gram)
    key, th, left = (free(docs, c) for c in ("__id", "__th", "__left"))
    changed = cut(found, least).select("id", "th", "kept").dropDuplicates(["id", "th"]).union(copies.select("id", "th", F.lit("")))
    changed = changed.toDF(key, th, left)
    text = F.coalesce(docs[text_col], F.lit(""))
    joined = docs.join(changed, (docs[id_col].cast("long") == changed[key]) & (F.xxhash64(text) == changed[th]), "left")
    enough = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")) >= least
    new = F.when(changed[left].isNotNull() & enough, changed[left]).otherwise(docs[text_col])
    return joined.select(*[new.alias(c) if c == text_col else docs[c] for c in docs.columns])


#: The same in DuckDB's SQL.
SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)
), first_ AS (
  SELECT key, min(doc_id) AS lo FROM windows GROUP BY key HAVING count(*) > 1
), hit AS (
  SELECT doc_id, list(i) AS hits FROM windows JOIN first_ USING (key) WHERE lo < doc_id GROUP BY doc_id
), gone AS (
  SELECT doc_id, list_distinct(flatten(list_transform(hits, lambda i: range(i, i + 50)))) AS places FROM hit
), kept AS (
  SELECT doc_id, len(w) AS n, w, coalesce(places, []) AS places FROM w LEFT JOIN gone USING (doc_id)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, n + 1)) AS i FROM kept WHERE len(places) > 0
), out_ AS (
  SELECT k.doc_id, string_agg(word, ' ' ORDER BY x.i) AS text
  FROM kept k JOIN words x USING (doc_id) LEFT JOIN (SELECT doc_id, unnest(places) AS i FROM kept) g ON g.doc_id = x.doc_id AND g.i = x.i
  WHERE g.i IS NULL GROUP BY k.doc_id
)
SELECT doc_id, n::BIGINT AS n_words, len(places)::BIGINT AS n_removed, sha256(CASE WHEN len(places) = 0 THEN array_to_string(w, ' ') ELSE coalesce(out_.text, '') END) AS kept_sha256
FROM kept LEFT JOIN out_ USING (doc_id)
"""
