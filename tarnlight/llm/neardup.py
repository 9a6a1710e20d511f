"""Near-duplicates by weighted MinHash (operator 9).

Method: BagMinHash.  A text is the multiset of its runs of five words.  Each run
that occurs c times owns a Poisson process of rate 1 over each unit of [0, c);
the units are grouped in blocks [0,1), [1,2), [2,4), [4,8), ..., a block is one
process of the block's rate, and points above c are thinned out, so a count
costs its logarithm.  Every point falls on one of ``M`` components; a component
keeps the earliest point of all runs.  Two texts agree in a component with the
probability of their weighted Jaccard similarity.

``BANDS`` bands of ``ROWS`` components give candidates: a pair of similarity
0.8 shares no band with a probability of 5e-8.  Candidates are verified by
multiset overlap of the runs themselves.

Equal multisets are one class from the start.  Of each bucket, every class is
first verified against the one that meets most others, which is linear in the
bucket.  Buckets that then still hold several components are cut into tiles of
bounded rows and bytes; a task holds two tiles, verifies there every pair of
different components whose signatures agree enough, and returns at most one
link for each component.  So no link between different texts is lost, whatever
the size of a bucket, and no pair leaves its task.

Texts of one to four words are one run; texts without words (null and empty
ones too) are similar to nothing, not even one another.  Rows with a null id
are classes of their own id, null.  Rows that repeat an id with other text link
through that id, with all that is like either text.  Other columns are not looked at; ``keep_one`` returns those
of its input.  An empty table gives an empty one; a very long text is one
multiset, worked by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.common import connected_components, free, give_back, over_salts, salt, stored, trimmed
from tarnlight.llm.shingles import U, mix, shingles, utf8

M, BANDS, ROWS = 128, 32, 4
SIMILAR = 0.8
#: Components in which a pair of similarity 0.8 agrees, less six standard deviations.
LEAST_AGREEING = int(M * SIMILAR - 6 * (M * SIMILAR * (1 - SIMILAR)) ** 0.5)
TILE, TILE_BYTES = 1024, 2_000_000


def signatures(text: np.ndarray, run: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """BagMinHash signature, ``M`` 32-bit values, of each of ``n`` texts; all ones without runs."""
    sig = np.full(n * M, U(2**64 - 1))
    total = np.bincount(text, count, n)
    blocks = np.zeros(len(count), np.int64)
    np.ceil(np.log2(np.maximum(count, 1)), out=(bits := np.zeros(len(count))))
    blocks += 1 + bits.astype(np.int64)
    element = np.repeat(np.arange(len(run)), blocks)
    block = np.arange(len(element)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0).astype(np.float64)
    rate = np.where(block > 0, low, 1.0)
    seed = mix(run[element] + block.astype(np.uint64) * U(0xA0761D6478BD642F))
    most, text, count = count[element].astype(np.float64), text[element], count
    until = np.divide(M * (np.log(M) + 2.5), total, out=np.zeros(n), where=total > 0)
    todo = np.flatnonzero(total > 0)
    own = np.arange(len(element))
    while len(todo):
        at, state, left = np.zeros(len(own)), seed[own], own
        while len(left):
            state = mix(state + U(0x9E3779B97F4A7C15))
            at = at - np.log(((state >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[left]
            inside = at < until[text[left]]
            left, at, state = left[inside], at[inside], state[inside]
            other = mix(state ^ U(0xE7037ED1A0B428DB))
            level = low[left] + (other >> U(40)).astype(np.float64) * 2.0**-24 * rate[left]
            real = level < most[left]
            point = at[real].astype(np.float32).view(np.uint32).astype(np.uint64) << U(32) | mix(other[real]) >> U(32)
            np.minimum.at(sig, text[left[real]] * M + (other[real] & U(M - 1)).astype(np.int64), point)
        short = (sig.reshape(n, M)[todo] == U(2**64 - 1)).any(axis=1)
        todo = todo[short]
        until[todo] *= 2  # from the start again: the points seen before come out the same
        again = np.zeros(n, bool)
        again[todo] = True
        own = own[again[text[own]]]
    return (sig & U(2**32 - 1)).astype(np.uint32).reshape(n, M)


def _signed(b: pa.RecordBatch, of: int) -> tuple:
    raw, at = utf8(b.column(of))
    text, run, count = shingles(raw, at)
    sig = signatures(text, run, count, b.num_rows)
    ends = np.searchsorted(text, np.arange(b.num_rows + 1))
    both = np.stack([run, count.astype(np.uint64)], 1)
    digest = [xxhash.xxh3_128_digest(both[a:z].tobytes()) if z > a else None for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return sig, digest


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, th, digest, sig, bytes)`` of every row: hash of the text, class of equal multisets (null without words), signature, and size of the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches, 1_000_000):
            sig, digest = _signed(b, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(np.diff(utf8(b.column(2))[1]))], names=["id", "th", "digest", "sig", "bytes"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).mapInArrow(work, "id long, th long, digest binary, sig binary, bytes long")


def _keys(sig: np.ndarray) -> np.ndarray:
    """The key of each band of each signature."""
    sig = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2])
    for r in range(ROWS):
        key = mix(key * U(0x2545F4914F6CDD1D) + sig[:, :, r])
    return key


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s in trimmed(batches):
        key = _keys(np.frombuffer(b"".join(s.column(1).to_pylist()), np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(s.column(0).to_numpy(), BANDS))], names=["key", "c"])


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted runs and counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return both / (a[1].sum() + b[1].sum() - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, b, text of a, text of b: those similar enough."""
    for s in trimmed(batches, 1_000_000):
        sides = []
        for k in (2, 3):
            raw, at = utf8(s.column(k))
            text, run, count = shingles(raw, at)
            sides.append((run, count, np.searchsorted(text, np.arange(s.num_rows + 1))))
        (ra, ca, ea), (rb, cb, eb) = sides
        ok = [overlap((ra[ea[i] : ea[i + 1]], ca[ea[i] : ea[i + 1]]), (rb[eb[i] : eb[i + 1]], cb[eb[i] : eb[i + 1]])) >= SIMILAR for i in range(s.num_rows)]
        yield pa.RecordBatch.from_arrays([s.column(0), s.column(1)], names=["src", "dst"]).filter(pa.array(ok))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose multisets overlap enough; ``texts`` is ``(id, text)``, one row for each id."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_verify, "src long, dst long")


def _joined(key: tuple, group: pa.Table) -> pa.Table:
    """Links between components, found in one bucket inside a tile or between two; a forest of them."""
    give_back()
    own_class, comps = group.column("c").to_numpy(), group.column("component").to_numpy().copy()
    tile, t, u = group.column("tile").to_numpy(), key[1].as_py(), key[2].as_py()
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, M)
    band = int(np.flatnonzero(_keys(sig[:1])[0].view(np.int64) == key[0].as_py())[0])
    text, run, count = shingles(*utf8(group.column("text").combine_chunks()))
    ends, total = np.searchsorted(text, np.arange(len(comps) + 1)), np.bincount(text, count, len(comps))
    distinct, run = np.unique(run, return_inverse=True)
    held = np.zeros(len(distinct), np.int64)  # the counts of one text
    left, right, src, dst = np.flatnonzero(tile == t), np.flatnonzero(tile == u), [], []
    for i in left.tolist():
        j = right[(comps[right] != comps[i]) & ((own_class[right] > own_class[i]) if t == u else True)]
        same = sig[j] == sig[i]
        # A pair that also meets in a band before this one is left to that one.
        first = same[:, : band * ROWS].reshape(len(j), band, ROWS).all(axis=2).any(axis=1) if band else np.zeros(len(j), bool)
        j = j[(same.sum(axis=1) >= LEAST_AGREEING) & ~first & (total[j] > 0)]
        if not len(j):
            continue
        own = slice(ends[i], ends[i + 1])
        held[run[own]] = count[own]
        many = ends[j + 1] - ends[j]
        before = np.cumsum(many) - many
        at = np.arange(many.sum()) + np.repeat(ends[j] - before, many)
        both = np.add.reduceat(np.minimum(held[run[at]], count[at]), before)
        held[run[own]] = 0
        other = np.unique(comps[j[both / (total[i] + total[j] - both) >= SIMILAR]])
        src += [comps[i]] * len(other)
        dst += other.tolist()
        comps[np.isin(comps, other)] = comps[i]
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, component_id)`` of every row: the smallest id reachable by links of similarity 0.8 or more.

    From signatures to links a class goes by its number ``c``, never by an id,
    which may have several texts; ids come in again at the end.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    every = stored(classes(picked, "id", "text"), "signatures")
    # A third of all rows may be copies of one text, so the smallest id of a digest is dealt to salts.
    known = every.where("id IS NOT NULL AND digest IS NOT NULL").withColumn("salt", salt("id", "sig"))
    salted = stored(over_salts(known, ["digest"], rep=(F.min, F.min("id"))), "salted")
    numbers = stored(salted.select("digest", "rep").distinct().select("digest", F.monotonically_increasing_id().alias("c")), "numbers")
    classed = stored(known.join(salted.join(numbers, "digest"), ["digest", "salt"]).select("id", "th", "c", "rep", "sig", "bytes"), "classes")
    # One row for each class: a row of its smallest id.
    reps = classed.where("id = rep").groupBy("c").agg(F.first(F.struct("rep", "th", "sig", "bytes")).alias("r"))
    reps = stored(reps.select("c", "r.*"), "representatives")
    bands = reps.select("c", "sig").mapInArrow(lambda it: _bands(b.select(["c", "sig"]) for b in it), "key long, c long")
    many = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = stored(bands.join(many, "key"), "buckets")
    weight = buckets.groupBy("c").agg(F.sum("n").alias("weight"))
    weighed = buckets.join(weight, "c").select("key", "c", "weight")
    centre = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("c")).alias("minus"))).alias("m")).select("key", (-F.col("m.minus")).alias("centre"))
    star = buckets.join(centre, "key").where("c <> centre").select(F.least("c", "centre").alias("a"), F.greatest("c", "centre").alias("b")).distinct()
    star = stored(star, "pairs")
    wanted = reps.join(buckets.select("c").distinct(), "c", "left_semi").select("c", F.col("rep").alias("id"), "th")
    texts = picked.withColumn("th", F.xxhash64("text")).join(wanted, ["id", "th"]).groupBy("c").agg(F.first("text").alias("text"))
    texts = stored(texts, "texts")
    links = stored(verified(star, texts.withColumnRenamed("c", "id")), "links")
    found = connected_components(links)

    # Buckets that hold several components, in tiles.
    inside = buckets.where("n > 2").join(found.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    inside = inside.join(reps.select("c", "bytes"), "c")
    mixed = inside.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.sum("bytes").alias("held")).where("lo <> hi")
    tiles = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("held") / TILE_BYTES), F.lit(1)).cast("int")
    rest = inside.select("key", "c", "component").join(mixed.select("key", F.least(tiles, F.col("size").cast("int")).alias("tiles")), "key")
    rest = rest.join(reps.select("c", "sig"), "c").join(texts, "c")
    rest = rest.withColumn("tile", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rest = rest.select("key", "c", "component", "sig", "text", "tile", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"))
    more = stored(rest.groupBy("key", "t", "u").applyInArrow(_joined, "src long, dst long"), "links")
    of = classed.select("id", "c").join(found.withColumnRenamed("id", "c"), "c", "left")
    of = stored(of.select("id", F.coalesce("component", "c").alias("component")).distinct(), "members")
    # An id of several texts links their components.
    several = of.groupBy("id").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    through = of.join(several.select("id", "lo"), "id").select(F.col("lo").alias("src"), F.col("component").alias("dst"))
    wider = connected_components(more.union(through)).select(F.col("id").alias("component"), F.col("component").alias("root"))
    of = of.join(wider, "component", "left").select("id", F.coalesce("root", "component").alias("root"))
    least = stored(of.groupBy("root").agg(F.min("id").alias("component")), "roots")
    of = of.join(least, "root").select("id", "component").distinct()
    return every.select("id").join(of, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, columns unchanged; rows with a null id stay."""
    key = free(docs, "__id")
    gone = components(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone[key], "left_anti")


#: The same in DuckDB's SQL.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
  SELECT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), bags AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL
), sizes AS (
  SELECT doc_id, sum(n) AS n FROM bags GROUP BY ALL
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS n
  FROM bags a JOIN bags b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM both_ JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE both_.n / (x.n + y.n - both_.n) >= 0.8
), ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS id, doc_id AS root FROM documents
  UNION
  SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.id
)
SELECT id AS doc_id, min(root) AS component_id, id = min(root) AS kept FROM reach GROUP BY id
"""
