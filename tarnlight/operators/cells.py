"""Approximate inner-product search over inverted lists of k-means cells.

An index is a table of vectors in files by cell.  Cells are learnt by Spark's
k-means from at most ``most_sample`` vectors (a documented bound; every vector is
put in a cell) and assigned by products of matrices.  A query looks only into the
``probe`` cells whose centres have the largest inner product with it.  ``probe`` is
not a guess: ``tuned`` takes the smallest for which a sample of the indexed vectors,
asked as queries, finds the wanted share of what an exact search finds.

A cell may hold a third of all vectors, so cells are cut into tiles of ``TILE``
vectors; a task has one tile and the queries of its cell, in blocks, and returns
the best ``k`` of the tile for each.  Vectors that are null, hold null or
non-finite entries, or have another length than most, are not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tarnlight.operators import dense
from tarnlight.sources.scratch import new_path

TILE = 8192
BLOCK = 1024


def _nearest(centres: np.ndarray, many: int, size: int):
    """``(row id, cell)`` of the ``many`` cells of largest inner product; the smaller cell of equal ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, x = dense.vectors(b.column(b.num_columns - 1), size)
            best = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :many]
            rows = b.take(pa.array(np.repeat(own, best.shape[1])))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(best.ravel().astype(np.int32))], names=[*b.schema.names, "cell"])

    return work


def _with_cells(df: DataFrame, centres: np.ndarray, many: int) -> DataFrame:
    """``df``, whose last column is a vector, with ``cell``: a row for each of the ``many`` nearest cells."""
    schema = StructType([*df.schema.fields]).add("cell", "integer")
    return df.mapInArrow(_nearest(centres, many, centres.shape[1]), schema)


def build(vectors: DataFrame, path: str, cells: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", most_sample: int = 100_000, seed: int = 7) -> Cells:
    """Learn ``cells`` cells and write ``(id, embedding, cell)`` by cell, and the centres."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    usable = rows.where("embedding IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))")
    common = usable.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        raise ValueError("no vectors to index")
    usable = usable.where(F.size("embedding") == common["size"])
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(most_sample).select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=max(1, min(cells, common["count"])), seed=seed, maxIter=20).fit(sample)
    centres = np.array(model.clusterCenters())
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    put = _with_cells(usable, centres, 1)
    put.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    return Cells(spark, path)


class Cells:
    """An opened index; the driver holds the centres, ``cells`` times the dimensions."""

    def __init__(self, spark: SparkSession, path: str):
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        self.centres = np.array([r["centre"] for r in rows])
        self.table = spark.read.parquet(f"{path}/vectors")

    def top_k(self, queries: DataFrame, k: int = 10, probe: int = 4, id_col: str = "vec_id") -> DataFrame:
        """``(query_id, rank, <id_col>, score)`` among the vectors of the ``probe`` nearest cells, by descending inner product, then id."""
        if k < 1 or probe < 1:
            raise ValueError("k and probe must be at least 1")
        spark, size = queries.sparkSession, self.centres.shape[1]
        q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        q = _with_cells(q, self.centres, min(probe, len(self.centres)))
        at = new_path(spark, "probes")
        q.withColumn("block", F.floor(F.row_number().over(Window.partitionBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(64))).orderBy("query_id")) / BLOCK).cast("int") * 64 + F.pmod(F.xxhash64("query_id"), F.lit(64)).cast("int")).write.parquet(at)
        q = spark.read.schema(StructType([*q.schema.fields]).add("block", "integer")).parquet(at)
        sizes = self.table.groupBy("cell").count().select("cell", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
        tiled = self.table.join(F.broadcast(sizes), "cell").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
        # A row for each cell and block of its queries; the tiles of a cell meet each of them.
        lists = q.groupBy("cell", "block").agg(F.collect_list(F.struct("query_id", "embedding")).alias("asked"))
        lists = lists.join(F.broadcast(sizes), "cell").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
        kind, own = queries.schema["query_id"].dataType, self.table.schema["id"].dataType
        schema = StructType([StructField("query_id", kind), StructField(id_col, own), StructField("raw", DoubleType())])

        def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            ids, out = left.column("id").combine_chunks() if left.num_rows else None, []
            if left.num_rows and right.num_rows:
                _, x = dense.vectors(left.column("embedding").combine_chunks(), size)
                for asked in right.column("asked").combine_chunks():
                    rows = asked.values
                    _, y = dense.vectors(rows.field("embedding"), size)
                    scores = x @ y.T
                    row, column = dense._best(scores, k)
                    out.append(pa.table([rows.field("query_id").take(pa.array(column)), ids.take(pa.array(row)), pa.array(scores[row, column])], names=schema.names))
            return pa.concat_tables(out) if out else pa.table({f.name: pa.array([], f.type) for f in to_arrow(schema)})

        from pyspark.sql.pandas.types import to_arrow_schema as to_arrow

        found = tiled.select("cell", "tile", "id", "embedding").groupBy("cell", "tile").cogroup(lists.groupBy("cell", "tile")).applyInArrow(meet, schema)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
        scored = found.select("query_id", id_col, F.round("raw", 6).alias("score"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")

    def exact(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return dense.top_k(self.table.select(F.col("id").alias("vec_id"), "embedding"), queries, k, "vec_id")

    def recall(self, queries: DataFrame, k: int, probe: int) -> float:
        """Share of the exact results that a search finds."""
        want = self.exact(queries, k).select("query_id", "vec_id")
        got = self.top_k(queries, k, probe).select("query_id", "vec_id", F.lit(1).alias("hit"))
        return want.join(got, ["query_id", "vec_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 1.0

    def tuned(self, k: int = 10, wanted: float = 0.95, sample: int = 200) -> int:
        """The smallest number of cells, doubled from 1, for which ``sample`` indexed vectors find the wanted share; all cells find everything."""
        some = self.table.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample).select(F.col("id").alias("query_id"), "embedding")
        probe = 1
        while probe < len(self.centres) and self.recall(some, k, probe) < wanted:
            probe *= 2
        return min(probe, len(self.centres))
