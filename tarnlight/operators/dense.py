"""Exact inner-product search, and embedding with pluggable encoders."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tarnlight.operators.chunking import chunks as make_chunks

Encode = Callable[[list[str]], np.ndarray]


def vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a column of lists that hold ``size`` finite numbers, and their matrix."""
    column = column.cast(pa.list_(pa.float64()))
    many = pc.list_value_length(column).fill_null(0).to_numpy()
    entry = pc.fill_null(column.flatten(), float("nan")).to_numpy()
    good = many == size
    good[np.repeat(np.arange(len(many)), many)[~np.isfinite(entry)]] = False
    return np.flatnonzero(good), entry[np.repeat(good, many)].reshape(-1, size)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best of each column, and of what may tie with them when rounded to six places."""
    if len(scores) <= k:
        return np.nonzero(np.ones(scores.shape, bool))
    least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
    return np.nonzero(scores >= least - 2e-6)


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "chunk_id", most_queries: int = 20_000) -> DataFrame:
    """``(query_id, rank, <id_col>, score)`` by descending inner product, then id.

    Queries are a matrix, sent to every task once for each block of at most
    ``most_queries`` of them; a batch of the index is another, and their product
    in double precision has all scores of the batch.  A batch passes on its best
    ``k`` for each query and what ties with them, and one merge ranks those.
    Vectors that are null, hold null or non-finite entries, or have another
    length than a query, do not meet it.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q"))
    sized = q.groupBy(F.size("q").alias("size")).count().where("size > 0").collect()  # a row for each length
    spark, kind = index.sparkSession, queries.schema["query_id"].dataType
    schema = StructType([StructField("query_id", kind), index.select(id_col).schema[0], StructField("raw", DoubleType())])
    found = None
    for size, blocks, i in [(r["size"], -(-r["count"] // most_queries), i) for r in sized for i in range(-(-r["count"] // most_queries))]:
        part = q.where((F.size("q") == size) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).toArrow().combine_chunks()
        rows, matrix = vectors(part.column("q").combine_chunks(), size)
        ids = part.column("query_id").combine_chunks().take(pa.array(rows))
        shared = spark.sparkContext.broadcast((ids, np.ascontiguousarray(matrix.T)))

        def work(batches: Iterator[pa.RecordBatch], shared=shared, size=size) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            step = max(1, 8_000_000 // max(1, matrix.shape[1]))  # scores held at a time
            for b in batches:
                for at in range(0, b.num_rows, step):
                    s = b.slice(at, step)
                    own, x = vectors(s.column(1), size)
                    scores = x @ matrix
                    row, column = _best(scores, k)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(column)), s.column(0).take(pa.array(own[row])), pa.array(scores[row, column])], names=schema.names)

        one = index.select(id_col, "embedding").mapInArrow(work, schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], schema)
    scored = found.select("query_id", id_col, F.round("raw", 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def _counted(texts: list[str], parts: Callable[[str], Iterable[str]], size: int) -> np.ndarray:
    """Signed counts of hashed parts of each text, of unit length."""
    out = np.zeros((len(texts), size), np.float32)
    for i, t in enumerate(texts):
        for x in parts(t.lower()):
            h = int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
            out[i, h % size] += 1 if h >> 63 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n == 0, 1, n)


def word_encoder(model: str | None = None) -> Encode:
    """A deterministic toy encoder of words; ``model`` is its number of dimensions, 64 by default."""
    return lambda texts: _counted(texts, str.split, int(model or 64))


def trigram_encoder(model: str | None = None) -> Encode:
    """The same of runs of three characters, so that words of one stem are alike."""
    return lambda texts: _counted(texts, lambda t: (t[i : i + 3] for i in range(len(t) - 2)), int(model or 64))


def sentence_encoder(model: str | None = None) -> Encode:
    """A model of the sentence-transformers library, from a folder or a hub id; vectors of unit length."""
    from sentence_transformers import SentenceTransformer

    if not model:
        raise ValueError("a model is needed")
    net = SentenceTransformer(model)
    return lambda texts: np.asarray(net.encode(texts, normalize_embeddings=True, show_progress_bar=False), np.float32)


#: Encoders by name; each is called with a model, once in a Python worker.
ENCODERS: dict[str, Callable[[str | None], Encode]] = {"hash": word_encoder, "trigram": trigram_encoder, "sentence-transformers": sentence_encoder}


@lru_cache(maxsize=4)
def _loaded(factory: Callable[[str | None], Encode], model: str | None) -> Encode:
    return factory(model)


class Embedder:
    """Embeds texts with a registered encoder and its model."""

    def __init__(self, backend: str = "hash", model: str | None = None):
        if backend not in ENCODERS:
            raise ValueError(f"unknown embedding backend: {backend}")
        self.backend, self.model = backend, model

    def embed(self, df: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        factory, model = ENCODERS[self.backend], self.model

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = _loaded(factory, model)
            for s in batches:
                yield pd.Series(list(encode(s.fillna("").tolist())), dtype=object)

        return df.withColumn(out_col, F.pandas_udf(run, "array<float>")(F.col(text_col)))


def build_index(docs: DataFrame, embedder: Embedder, size: int = 512, overlap: int = 50) -> DataFrame:
    """``(chunk_id, doc_id, chunk_no, text, embedding)``; no documents make an empty index."""
    return embedder.embed(make_chunks(docs, size, overlap))
