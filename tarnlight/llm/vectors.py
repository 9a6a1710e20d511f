"""Near-duplicates among embeddings by an exact metric range join (operator 6).

Vectors of one label and one length are linked if their cosine, in double
precision, is at least ``LEAST``: if their angle is at most A = acos(LEAST).
Angles are a metric, so the triangle inequality decides who must meet whom.

Method: pivots.  A label with more than ``CELL`` vectors is parted among pivots
drawn by hash; a vector lives in the cell of its nearest pivot, and visits each
later cell that may hold a partner: whose pivot is at most 2A further away than
its own, and no more than A outside the cell's radius.  A cell is a block, or
several if it has over ``TILE`` vectors, of which earlier ones visit later ones;
so each pair meets once.

A task holds one block at a time, compares its members with one another and
then lets the visitors pass by, so blocks stay in bounded memory, no pair leaves
a task, and a vector is shuffled once for its own block and once for each that it
visits: once in all where a label has no more than ``CELL``.  Each block returns
the number of links of its vectors and a forest of edges.  Vectors travel as the
bytes they have in the table, and rows are told apart by 128-bit hashes of them.

Equal vectors become one with a count.  Vectors that are null, empty, zero, or
hold null or non-finite components, and rows with a null label or null id link
with nothing and are components of their own id.  Rows that repeat id, label
and vector count once.  Vectors of any length are compared with those of their
length; an empty table gives an empty one.  Other columns are not looked at.

The pivots are bounded by ``MOST_PIVOTS`` whatever the table's size (the cells
grow instead), so they may be broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tarnlight.llm.common import bound_batches, connected_components, stored

LEAST = 0.93
CELL, TILE, MOST_PIVOTS = 32_768, 32_768, 20_000
#: Numbers of a block that are held in memory, and vectors that are compared at a time.
ROOM, STEP = 4_000_000, 1024
#: Room for rounding where the triangle inequality decides.
EPS = 1e-6
_BLOCK = ["label", "size", "cell", "part"]
_MEMBER = "label long, size int, cell int, part int, visit boolean, rep long, n long, raw binary"


def _units(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of unit length, in double precision, from the bytes of single or double ones."""
    data = b"".join(column.to_pylist())
    v = np.frombuffer(data, np.float64 if len(data) == 8 * size * len(column) else np.float32).astype(np.float64).reshape(-1, size)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(id, label, size, raw, hash)`` of the usable rows; ``raw`` has the numbers as bytes."""
    kind = vectors.schema[vector_col].dataType.elementType
    x = F.col(vector_col) if isinstance(kind, FloatType) else F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(F.coalesce(fine, F.lit(False)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many = pc.list_value_length(b.column(2)).to_numpy()
            numbers = b.column(2).flatten().to_numpy() + 0  # no negative zeros
            ends = np.concatenate([[0], np.cumsum(many)]) * numbers.itemsize
            raw = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(numbers)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(many.astype(np.int32)), raw], names=["id", "label", "size", "raw"])

    return rows.mapInArrow(work, "id long, label long, size int, raw binary").withColumn("hash", F.unhex(F.md5("raw")))


def pivots(each: DataFrame, cell: int = CELL, most: int = MOST_PIVOTS) -> dict[tuple[int, int], np.ndarray]:
    """Pivots of each (label, length) that has more than ``cell`` vectors; ``most`` in all."""
    rows = each.count()
    cell = max(cell, -(-rows // most))
    big = each.groupBy("label", "size").agg(F.count("*").alias("rows")).where(F.col("rows") > cell)
    wanted = big.withColumn("k", F.ceil(F.col("rows") / cell))
    # Some rows more than wanted by a threshold on the hash, then the first of them: no window over a label.
    hashed = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) / float(1 << 30)
    some = each.join(F.broadcast(wanted), ["label", "size"]).where(hashed < (4 * F.col("k") + 16) / F.col("rows"))
    nth = F.row_number().over(Window.partitionBy("label", "size").orderBy(F.xxhash64("rep"), "rep"))
    got: dict[tuple[int, int], list[bytes]] = {}
    for r in some.withColumn("nth", nth).where("nth <= k").select("label", "size", "raw").toLocalIterator():
        got.setdefault((r["label"], r["size"]), []).append(bytes(r["raw"]))
    return {k: _units(pa.array(v, pa.binary()), k[1]) for k, v in got.items()}


def members(each: DataFrame, of: dict[tuple[int, int], np.ndarray], angle: float) -> DataFrame:
    """Who is in which block, at home or on a visit."""
    sc = each.sparkSession.sparkContext
    shared = sc.broadcast(of)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                label, size = b.column("label").to_numpy(), b.column("size").to_numpy()
                cell, far = np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
                for key in {*zip(label.tolist(), size.tolist())} & shared.value.keys():
                    own = np.flatnonzero((label == key[0]) & (size == key[1]))
                    a = _angles(_units(b.column("raw").take(pa.array(own)), key[1]), shared.value[key])
                    cell[own], far[own] = a.argmin(axis=1), a.min(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("label"), b.column("size"), pa.array(cell), pa.array(far)], names=["label", "size", "cell", "far"])

    tile, room = TILE, ROOM
    own = each.select("label", "size", "raw").mapInArrow(homes, "label long, size int, cell int, far double") if of else each.select("label", "size", F.lit(-1).alias("cell"), F.lit(0.0).alias("far"))
    most = F.least(F.lit(tile), F.greatest(F.floor(F.lit(room) / F.greatest("size", F.lit(1))), F.lit(1)))
    cells = own.groupBy("label", "size", "cell").agg(F.max("far").alias("far"), F.ceil(F.count("*") / most).alias("parts"))
    radius: dict[tuple[int, int], dict[int, float]] = {}
    parts: dict[tuple[int, int], dict[int, int]] = {}
    for r in cells.where("cell >= 0 OR parts > 1").toLocalIterator():  # two numbers for each cell; labels of one block have none
        radius.setdefault((r["label"], r["size"]), {})[r["cell"]] = r["far"]
        parts.setdefault((r["label"], r["size"]), {})[r["cell"]] = r["parts"]
    bounds = {k: np.array([radius.get(k, {}).get(i, -10.0) for i in range(len(p))]) for k, p in of.items()}
    cut = {k: np.array([p.get(i, 1) for i in range(len(of[k]))] if k in of else [p.get(-1, 1)]) for k, p in parts.items()}
    given = sc.broadcast((bounds, cut))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, cut = given.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                label, size, salt = (b.column(c).to_numpy() for c in ("label", "size", "salt"))
                rows, cells, blocks, visits = [np.arange(b.num_rows)], [np.zeros(b.num_rows, np.int64)], [np.zeros(b.num_rows, np.int64)], [np.zeros(b.num_rows, bool)]
                for key in {*zip(label.tolist(), size.tolist())} & cut.keys():
                    own, many = np.flatnonzero((label == key[0]) & (size == key[1])), cut[key]
                    near = np.zeros(len(own), np.int64)
                    met = np.zeros((len(own), len(many)), bool)
                    if key in bounds:
                        a = _angles(_units(b.column("raw").take(pa.array(own)), key[1]), shared.value[key])
                        near = a.argmin(axis=1)
                        met = (a <= a.min(axis=1)[:, None] + 2 * angle + EPS) & (a <= bounds[key] + angle + EPS)
                        met &= np.arange(len(many)) > near[:, None]
                    home = salt[own] % many[near]
                    cells[0][own], blocks[0][own] = near, home
                    i, j = np.nonzero(met)
                    i, j = np.concatenate([i, np.arange(len(own))]), np.concatenate([j, near])  # its own cell's later blocks, too
                    from_ = np.where(j == near[i], home[i] + 1, 0)
                    n = many[j] - from_
                    i, j, from_ = np.repeat(i, n), np.repeat(j, n), np.repeat(from_, n)
                    place = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                    rows.append(own[i]), cells.append(j), blocks.append(from_ + place), visits.append(np.ones(len(i), bool))
                t = pa.array(np.concatenate(rows))
                ints = [pa.array(np.concatenate(x).astype(np.int32)) for x in (cells, blocks)]
                yield pa.RecordBatch.from_arrays([b.column("label").take(t), b.column("size").take(t), *ints, pa.array(np.concatenate(visits)), b.column("rep").take(t), b.column("n").take(t), b.column("raw").take(t)], names=[f.split()[0] for f in _MEMBER.split(", ")])

    return each.select("rep", "n", "label", "size", "raw", F.xxhash64("rep").alias("salt")).mapInArrow(work, _MEMBER)


class _Block:
    """Vectors that share a block, their links so far, and for each the first place that it is known to be connected with."""

    def __init__(self, size: int, least: float):
        self.size, self.least, self.waiting, self.units = size, least, [], None

    def add(self, b: pa.RecordBatch) -> None:
        self.waiting.append((b.column("rep").to_numpy(), b.column("n").to_numpy(), _units(b.column("raw"), self.size)))

    def close(self) -> None:
        """All have come: they meet one another."""
        if self.units is not None:
            return
        self.rep, self.n, self.units = (np.concatenate(x) for x in zip(*self.waiting)) if self.waiting else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, self.size)))
        self.waiting = []
        self.links, self.root = np.zeros(len(self.rep), np.int64), np.arange(len(self.rep))
        for at in range(0, len(self.rep), STEP):
            own = slice(at, at + STEP)
            for i, j in self._near(self.rep[own], self.units[own], at):
                i = i + at
                i, j = i[i < j], j[i < j]
                np.add.at(self.links, i, self.n[j])
                np.add.at(self.links, j, self.n[i])
                self.root = _joined(self.root, i, j)

    def _near(self, rep: np.ndarray, units: np.ndarray, first: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of some vectors and of the block's, from ``first`` on, that are linked."""
        for at in range(first, len(self.rep), STEP):
            i, j = np.nonzero(units @ self.units[at : at + STEP].T >= self.least)
            j = j + at
            other = rep[i] != self.rep[j]
            if other.any():
                yield i[other], j[other]

    def meet(self, b: pa.RecordBatch) -> pa.RecordBatch:
        """Visitors pass by; what they found."""
        self.close()
        rep, n, units, k = b.column("rep").to_numpy(), b.column("n").to_numpy(), _units(b.column("raw"), self.size), len(self.rep)
        links, root = np.zeros(len(rep), np.int64), np.concatenate([self.root, k + np.arange(len(rep))])
        for i, j in self._near(rep, units):
            np.add.at(links, i, self.n[j])
            np.add.at(self.links, j, n[i])
            root = _joined(root, j, i + k)
        self.root = root[:k]
        some = np.flatnonzero(links)
        return _found(rep[some], links[some], self.rep[root[k + some]])

    def leave(self) -> pa.RecordBatch:
        self.close()
        some = np.flatnonzero(self.links)
        return _found(self.rep[some], self.links[some], self.rep[self.root[some]])


def _found(rep: np.ndarray, links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(root)], names=["rep", "links", "root"])


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place reachable, with some edges more."""
    apart = root[i] != root[j]
    i, j = i[apart], j[apart]
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for x in (root[i], root[j], i, j):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def met(all_: DataFrame, least: float) -> DataFrame:
    """``(rep, links, root)`` found in each block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for whole in batches:
            keys = [whole.column(c).to_numpy(zero_copy_only=False) for c in (*_BLOCK, "visit")]
            turn = np.any([x[1:] != x[:-1] for x in keys], axis=0) if whole.num_rows else np.zeros(0, bool)
            edges = [0, *(np.flatnonzero(turn) + 1).tolist(), whole.num_rows]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                key = tuple(x[begin].item() for x in keys[:-1])
                if key != now:
                    if block is not None:
                        yield block.leave()
                    now, block = key, _Block(key[1], least)
                for at in range(begin, end, STEP):
                    b = whole.slice(at, min(STEP, end - at))
                    if keys[-1][begin]:
                        yield block.meet(b)
                    else:
                        block.add(b)
        if block is not None:
            yield block.leave()

    dealt = all_.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "visit")
    return dealt.mapInArrow(work, "rep long, links long, root long")


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST, cell: int = CELL) -> DataFrame:
    """``(id, rep, n_links, component)`` of the ids that have a usable vector."""
    bound_batches(vectors.sparkSession)
    rows, one = usable(vectors, id_col, vector_col, label_col), ["label", "hash"]
    ids = rows.groupBy("id", *one).agg(F.count("*").alias("times"))
    ids = stored(ids.join(ids.groupBy(*one).agg(F.min("id").alias("rep"), F.count("*").alias("n")), one), "ids")
    # Vectors without a copy stay where they are read; only copies are brought together.
    copies = stored(ids.where("n > 1 OR times > 1").select("id", *one, "rep", "n"), "copies")
    both = rows.join(copies, ["id", *one], "left")
    first = both.where("id = rep").groupBy("rep", *one).agg(*[F.first(c).alias(c) for c in ("n", "size", "raw")])
    alone = both.where("rep IS NULL").select(F.col("id").alias("rep"), F.lit(1).cast("long").alias("n"), "label", "size", "raw")
    each = stored(alone.union(first.select(*alone.columns)), "vectors")
    found = stored(met(members(each, pivots(each, cell), math.acos(least)), least), "links")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    out = ids.join(totals, "rep", "left").join(components.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("id", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))


def near_dups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST, cell: int = CELL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row; an id with several vectors has the sums and the smallest component."""
    found = links(vectors, id_col, vector_col, label_col, least, cell).groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component").alias("component"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id")).join(found, "id", "left")
    component = F.coalesce("component", "id")
    return rows.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


#: The same in DuckDB's SQL.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT vec_id AS id, vec_id AS root FROM v
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id
), n AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT id AS vec_id, coalesce(max(n.n), 0)::BIGINT AS n_links, min(root) AS component_id, id = min(root) AS kept
FROM reach LEFT JOIN n ON n.a = reach.id GROUP BY id
"""
