"""Draw documents that look like a target, by importance resampling (operator 11).

Features of a text are its runs of 1 to ``order`` words, hashed to ``buckets``
buckets by CRC-32.  The gain of a bucket is the rounded log ratio of its
smoothed shares in the target and in the corpus; the weight of a document is the
sum of the gains of its features.  A Gumbel variate from a hash of the id is
added, and the documents of the highest scores are drawn, which samples without
replacement in proportion to the weights.

Method: a byte automaton over Arrow's UTF-8 buffers.  One table lower-cases A-Z
and classifies every byte of a batch; words begin and end where the class
differs from its neighbour; and the CRCs of all words of the batch advance
together, a byte a step, by the table of the polynomial.  A run of two words
goes on from the CRC of the first: a space, then the bytes of the second.  Words
of over ``LONG`` bytes end in the library's CRC, so that one of them does not
make a step for every byte it has.

Scale: the texts are read twice and never shuffled.  A task sends at most one
row for each bucket, and the driver holds three numbers a bucket.  Ranks come
from a range sort of ids and scores alone: places inside a part of it, plus the
sizes of the parts before it, one row a part.

Null and empty texts have no features and a weight of 0.  A null id counts as
the text "null" and comes last among equal scores; rows that repeat are
documents of their own.  A very long text is a batch of its own.  An empty table
gives an empty one; an empty target is only smoothing.  Other columns are not
looked at; ``resample`` returns those of its input.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tarnlight.llm.common import free, slices, stored
from tarnlight.llm.shingles import utf8

BUCKETS, ORDER = 10_000, 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
LONG = 64
SLICE_BYTES = 1_000_000


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case of each byte, whether it is part of a word, and the steps of CRC-32."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    inside = ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128)
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
    return low, inside, step


_LOW, _INSIDE, _STEP = _tables()


def boundaries(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and length of each word, and the number of words before each text; ``at`` is where texts begin and the last ends."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _INSIDE[raw]
    turn = np.diff(inside)
    first, end = turn[:-1] == 1, turn[1:] == -1
    cut = np.unique(at[1:-1])
    cut = cut[(cut > 0) & (cut < len(raw))]
    cut = cut[(inside[cut] & inside[cut + 1]) == 1]  # texts do not run into one another
    first[cut], end[cut - 1] = True, True
    start = np.flatnonzero(first)
    return start, np.flatnonzero(end) + 1 - start, np.searchsorted(start, at)


def advance(crc: np.ndarray, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each register after the ``length`` bytes from ``start`` on; all of them take a step at a time."""
    order = np.argsort(-length, kind="stable")
    crc, place = crc[order], start[order]
    upto = np.searchsorted(-length[order], -np.arange(1, min(int(length.max(initial=0)), LONG) + 1), "right")
    for i, m in enumerate(upto.tolist()):  # the first m words have more than i bytes
        crc[:m] = _STEP[(crc[:m] ^ raw[place[:m] + i]) & 255] ^ crc[:m] >> 8
    out = np.empty_like(crc)
    out[order] = crc
    for w in np.flatnonzero(length > LONG).tolist():
        rest = raw[start[w] + LONG : start[w] + length[w]].tobytes()
        out[w] = zlib.crc32(rest, int(out[w]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def features(raw: np.ndarray, at: np.ndarray, buckets: int = BUCKETS, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of every feature, and the number of words of each text."""
    raw = _LOW[raw]
    start, length, before = boundaries(raw, at)
    n = np.diff(before)
    text = np.repeat(np.arange(len(n)), n)
    left = before[1:][text] - np.arange(len(start))  # words from each on to the end of its text
    crc, some = np.full(len(start), 0xFFFFFFFF, np.uint32), np.arange(len(start))
    texts, found = [], []
    for k in range(order):
        if k:
            go = left[some] > k
            some, crc = some[go], crc[go]
            crc = _STEP[(crc ^ np.uint32(32)) & 255] ^ crc >> 8
        crc = advance(crc, raw, start[some + k], length[some + k])
        texts.append(text[some])
        found.append(((crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64))
    return np.concatenate(texts), np.concatenate(found), n


def counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """Features in each bucket, over all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in slices(batches, SLICE_BYTES):
            total += np.bincount(features(*utf8(b.column(0)), buckets, order)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # at most a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    size, s, t = float(len(corpus)), corpus.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variate from a hash of the id, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, seed: int = SEED, names: tuple[str, ...] = ("n_words", "n_features", "weight", "score")) -> DataFrame:
    """``docs`` with the numbers of words and features, the weight and the score of each row, in columns of these names."""
    fields = docs.columns
    i, t, buckets = fields.index(id_col), fields.index(text_col), len(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_BYTES):
            text, bucket, words = features(*utf8(b.column(t)), buckets, order)
            many = np.bincount(text, minlength=b.num_rows)
            weight = np.zeros(b.num_rows, np.int64)
            np.add.at(weight, text, gain[bucket])
            score = weight + np.array([gumbel(x, seed) for x in b.column(i).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x.astype(np.int64)) for x in (words, many, weight, score))], names=[*fields, *names])

    return docs.mapInArrow(work, StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names)]))


def ranked(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``rows(doc_id, n_words, n_features, weight, score)`` with ``rank``, 1 for the highest score; null if not drawn.

    Of the rows with enough words so many per cent are drawn.
    """
    every = stored(rows.withColumn("tie", F.monotonically_increasing_id()), "scores")
    enough = F.col("n_words") >= least_words
    draw = every.where(enough).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the count of rows in the task
    parts = every.where(enough).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", within)
    parts = stored(parts, "ranks")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    earlier = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))  # a row for each part
    place = F.col("earlier") + F.col("at") + 1
    got = parts.join(F.broadcast(earlier), "part").withColumn("rank", F.when(place <= draw, place))
    rest = every.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    columns = [*rows.columns, "rank"]
    return got.select(*columns).union(rest.select(*columns))


def draws(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every row of ``docs``; ``target`` has texts in a column of the same name."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(counts(picked), counts(target, text_col))
    return ranked(scored(picked, gain).drop("text"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are drawn, columns unchanged; rows of one id and score share one fate, so repeated rows may exceed the share."""
    names = tuple(free(docs, f"__{c}") for c in ("words", "features", "weight", "score"))
    gain = gains(counts(docs, text_col), counts(target, text_col))
    rows = scored(docs, gain, id_col, text_col, names=names)
    numbers = rows.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(n).alias(c) for n, c in zip(names, ("n_words", "n_features", "weight", "score"))])
    last = ranked(numbers, least_words, percent).where("rank IS NOT NULL").orderBy(F.desc("rank")).select("score", "doc_id").first()
    if last is None:
        return docs.limit(0)
    score, key = F.col(names[3]), F.col(id_col).cast("long")
    same = F.lit(True) if last["doc_id"] is None else key <= last["doc_id"]  # null comes last
    keep = (F.col(names[0]) >= least_words) & ((score > last["score"]) | ((score == last["score"]) & F.coalesce(same, F.lit(False))))
    return rows.where(keep).select(*docs.columns)
