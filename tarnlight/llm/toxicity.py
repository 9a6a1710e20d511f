"""Toxicity by a factorization machine over hashed terms (operator 3).

Method: score = sigmoid(w0 + sum of the weights of the terms present + sum over
pairs of the inner products of their factors), so that a pair such as an insult
and the name of a group can weigh more than both alone.  Terms are the words
of a text, each once, in lower case without the punctuation around them, and
the first 4 and 5 letters of longer words, for stems that take many endings;
a hash deals each term to one of 2**``BITS`` buckets.

Nothing is chosen beforehand: every bucket of ``least_docs`` learnt rows or more
takes part, and learning itself decides what stays.  Weights follow the
regularised leader with an L1 penalty, factors with the same penalty on the
length of a bucket's whole vector, measured from a small random start.  So a
bucket gets factors if its pairs go with a class, whether or not it stands out
by itself, and neither weight nor factors if what it tells is no more than
chance: both penalties are what a single row can add in all passes, and
``PENALTY`` standard deviations of the sum of the gradients of a term that stands
in all rows and means nothing.

Learning uses at most ``most_rows`` labelled rows, those of smallest id hash, as
many of them as hold ``most_entries`` terms together, and never a row whose
crc32(id as text) mod 5 is 0.  Both bounds are applied before anything reaches
the driver, and hold too where one labelled id stands on any number of rows.
Every whole text is scored.

Null and empty texts have no terms and get the score of the bias.  Null labels
are not learnt from; a document with several labels has the largest.  Rows that
repeat an id are learnt and scored each by itself; ties of the id hash go by id.
A very long text is a set of terms like any other.  Without labels, or with one
class only, the score is the smoothed share of that class; an empty table has no
scores.  Other columns are never looked at; ``keep_clean`` returns them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.common import give_back, slices, stored, trimmed

FACTORS = 8
BITS = 20
PENALTY = 0.35
#: Entries that are counted at a time, so that the driver holds what is learnt from once.
PART = 1_000_000
#: Length of the sum of the random factors of a text of mean size.
START = 0.25
PREFIXES = (4, 5)
_AROUND = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—*_/\\"


def terms_of(word: str) -> list[str]:
    w = word.strip(_AROUND).lower()
    return [w, *(w[:k] + "*" for k in PREFIXES if len(w) > k)] if w else []


def bucket(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term) >> (64 - BITS)


class Terms:
    """Rows of the model (or buckets, without one) for the words of a text."""

    def __init__(self, row_of: dict[int, int] | None, most: int = 300_000):
        self.row_of, self.most, self.seen = row_of, most, {}

    def rows(self, text: str) -> set[int]:
        if len(self.seen) > self.most:
            self.seen = {}
        found, seen, row_of = set(text.split()), self.seen, self.row_of
        for w in found:
            if w not in seen:
                hashed = map(bucket, terms_of(w))
                seen[w] = tuple(hashed if row_of is None else [row_of[h] for h in hashed if h in row_of])
        return set().union(*map(seen.__getitem__, found))


class FM:
    """Buckets that have a weight or factors, and those."""

    def __init__(self, bias: float, known: np.ndarray | None = None, w: np.ndarray | None = None, v: np.ndarray | None = None):
        self.w0 = bias
        self.known = np.zeros(0, np.int64) if known is None else known
        self.w = np.zeros(0) if w is None else w
        self.v = np.zeros((0, FACTORS)) if v is None else v

    def score(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.w0 + _margins(self.w[rows], self.v[rows], at)[0]).clip(-700, 700)))


def _margins(w: np.ndarray, v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Margin of each text without the bias, the text of each entry, and the sums of the factors; ``at``: where the entries of each text begin."""
    n = len(at) - 1
    text = np.repeat(np.arange(n), np.diff(at))
    total = np.stack([np.bincount(text, v[:, f], n) for f in range(FACTORS)], 1)
    own = np.bincount(text, (v * v).sum(1), n)
    return np.bincount(text, w, n) + 0.5 * ((total * total).sum(1) - own), text, total


def learn(rows: np.ndarray, at: np.ndarray, y: np.ndarray, least_docs: int = 3, epochs: int = 6, batch: int = 128, rate: float = 0.5, factor_rate: float = 0.3, pairs: bool = True) -> FM:
    """The machine of sets of buckets: those of text i are ``rows[at[i]:at[i + 1]]``; ``pairs=False`` leaves the factors out."""
    n, share = len(y), (y.sum() + 1) / (len(y) + 2)
    many = np.zeros(1 << BITS, np.int64)
    for k in range(0, len(rows), PART):
        many += np.bincount(rows[k : k + PART], minlength=1 << BITS)
    frequent = many >= least_docs
    known, slot = np.flatnonzero(frequent), np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32)
    d, mean_terms = len(known), max(1.0, int(many[frequent].sum()) / n)
    chance = epochs + PENALTY * math.sqrt(n * share * (1 - share))
    start, rng = np.empty((d, FACTORS), np.float32), np.random.default_rng(7)
    for k in range(0, 1 << BITS, 1 << 16):  # the same numbers as at once
        a, b = np.searchsorted(known, (k, k + (1 << 16)))
        start[a:b] = rng.normal(0, START / math.sqrt(FACTORS * mean_terms), (1 << 16, FACTORS))[known[a:b] - k]
    least = chance * START  # the gradient of factors is that of weights times the sum of a text's other factors, here START long at most
    z, seen = np.zeros(d), np.zeros(d)  # sums of gradients and of their squares
    fz, fseen = np.zeros((d, FACTORS), np.float32), np.zeros(d)
    w0, s0 = math.log(share / (1 - share)), 1.0

    def weights(i: np.ndarray) -> np.ndarray:
        return np.sign(z[i]) * np.minimum(chance - np.abs(z[i]), 0) * rate / (1 + np.sqrt(seen[i]))

    def factors(i: np.ndarray) -> np.ndarray:
        size = np.sqrt((fz[i] * fz[i]).sum(1))
        kept = np.maximum(1 - least / np.maximum(size, 1e-30), 0)
        return -fz[i] * (kept * factor_rate / (1 + np.sqrt(fseen[i])))[:, None]

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            some = order[k : k + batch]
            size = at[some + 1] - at[some]
            ends = np.concatenate([[0], np.cumsum(size)])
            here = slot[rows[np.repeat(at[some] - ends[:-1], size) + np.arange(ends[-1])]]
            ends = np.concatenate([[0], np.cumsum(here >= 0)])[ends]
            used, own = np.unique(here[here >= 0], return_inverse=True)
            w, moved = weights(used), factors(used)
            v = moved + start[used] if pairs else np.zeros_like(moved)
            margin, text, total = _margins(w[own], v[own], ends)
            g = 1 / (1 + np.exp(-(w0 + margin).clip(-30, 30))) - y[some]
            gw = np.bincount(own, g[text], len(used))
            z[used] += gw - (np.sqrt(seen[used] + gw * gw) - np.sqrt(seen[used])) / rate * w
            seen[used] += gw * gw
            if pairs:
                part = total[text] - v[own]
                part *= (g[text] * np.minimum(1, START / np.maximum(np.sqrt((part * part).sum(1)), 1e-30)))[:, None]
                gv = np.stack([np.bincount(own, part[:, f], len(used)) for f in range(FACTORS)], 1)
                squares = (gv * gv).sum(1)
                fz[used] += gv - ((np.sqrt(fseen[used] + squares) - np.sqrt(fseen[used])) / factor_rate)[:, None] * moved
                fseen[used] += squares
            s0 += g.sum() ** 2
            w0 -= rate * g.sum() / math.sqrt(s0)
    every = np.arange(d)
    w, v = weights(every), factors(every)
    paired = v.any(axis=1)
    v[paired] += start[paired]
    kept = (w != 0) | paired
    return FM(w0, known[kept], w[kept], v[kept])


def _ragged(sets: list[set[int]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.fromiter((r for s in sets for r in sorted(s)), np.int64, at[-1]), at


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 20_000, most_entries: int = 30_000_000, least_docs: int = 3) -> FM:
    """Learn from at most ``most_rows`` labelled rows that are not held out, and ``most_entries`` terms of theirs.

    The labelled ids are bounded by ``most_rows``, so they are broadcast to the
    documents and no text is shuffled.  The driver gets 4 bytes for each entry.
    """
    some = (
        labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("long").alias("__id"))
        .agg(F.max("toxic").cast("int").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(most_rows)
    )
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("t")).join(F.broadcast(some), "__id").select(F.xxhash64("__id").alias("h"), "__y", "t")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(None)
        for b in slices(batches):
            sets = [sorted(terms.rows(t or "")) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, sets), pa.int32()), pa.array(sets, pa.list_(pa.int32()))], names=["h", "y", "n", "terms"])

    made = rows.mapInArrow(work, "h long, y int, n int, terms array<int>").withColumn("x", F.xxhash64("terms"))
    made = stored(made.withColumn("r", F.monotonically_increasing_id()), "terms")
    order = ["h", "n", "x", "r"]
    sizes = made.select(*order, "y").orderBy(*order).limit(most_rows).toArrow()  # an id may stand on any number of rows
    sizes = sizes.filter(pc.less_equal(pc.cumulative_sum(pc.cast(sizes.column("n"), pa.int64())), most_entries))
    n, toxic = sizes.num_rows, pc.sum(sizes.column("y")).as_py() or 0
    if toxic in (0, n):
        return FM(math.log((toxic + 1) / (n - toxic + 1)))
    last = F.struct(*[F.lit(sizes.column(c)[-1].as_py()).cast(kind).alias(c) for c, kind in zip(order, ("long", "int", "long", "long"))])
    model = learn(*_in_order(made.where(F.struct(*order) <= last).select(*order, "y", "terms").toArrow(), order), least_docs)
    give_back()
    return model


def _in_order(got: pa.Table, order: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of all rows one after the other, where those of each begin, and the classes; rows go by ``order``, their terms are copied once."""
    by = pc.sort_indices(got.select(order), [(c, "ascending") for c in order]).to_numpy()
    n = got.column("n").to_numpy()
    at = np.concatenate([[0], np.cumsum(n[by], dtype=np.int64)])
    begin = np.empty(len(n), np.int64)
    begin[by] = at[:-1]
    flat, row = np.empty(at[-1], np.int32), 0
    for chunk in got.column("terms").chunks:
        terms, ends = chunk.flatten().to_numpy(), 0
        for size in n[row : row + len(chunk)].tolist():
            flat[begin[row] : begin[row] + size] = terms[ends : ends + size]
            row, ends = row + 1, ends + size
    return flat, at, got.column("y").to_numpy()[by].astype(np.float64)


def _scorer(model: FM, docs: DataFrame):
    shared = docs.sparkSession.sparkContext.broadcast((model.w0, model.known, model.w, model.v))

    def scores() -> Callable[[list[str | None]], np.ndarray]:
        fm = FM(*shared.value)
        terms = Terms(dict(zip(fm.known.tolist(), range(len(fm.known)))))
        return lambda texts: fm.score(*_ragged([terms.rows(t or "") for t in texts]))

    return scores


def score(docs: DataFrame, model: FM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every whole text."""
    make = _scorer(model, docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of(b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(work, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: FM, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns."""
    make, schema = _scorer(model, docs), docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in trimmed(batches):
            yield b.filter(pa.array(of(b.column(text_col).to_pylist()) < threshold))

    return docs.mapInArrow(work, schema)


def predictions(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``."""
    scored = score(docs, train(docs, labels, **options))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
