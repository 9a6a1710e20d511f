"""Retrievers: anything that ranks documents for a table of queries."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from tarnlight.operators import bm25, dense, metrics, overlap, postings
from tarnlight.sources.scratch import new_path


@runtime_checkable
class Retriever(Protocol):
    """``retrieve`` returns ``(query_id, doc_id, score)``, at most ``k`` results a query before pooling.

    A column ``rank``, if there is one, is the order of results; else equal scores go by ``doc_id``.
    """

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame: ...


class Okapi:
    """BM25 over an index: one that is opened (inverted, or that of ``bm25``), or an inverted one of a corpus, built once when the retriever is."""

    def __init__(self, corpus: DataFrame | None = None, index: postings.Postings | bm25.Index | None = None, path: str | None = None):
        if index is None and corpus is None:
            raise ValueError("a corpus or an index is needed")
        self.index = index or postings.build(corpus, path or new_path(corpus.sparkSession, "postings"))

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return self.index.top_k(queries, k).select("query_id", "rank", "doc_id", "score")


class Keywords:
    """Share of a query's tokens that a document has."""

    def __init__(self, corpus: DataFrame):
        self.corpus = corpus

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return overlap.top_k(self.corpus, queries, k).select("query_id", "rank", "doc_id", "score")


class Dense:
    """The best chunks of an index, pooled to their documents."""

    def __init__(self, embedder: dense.Embedder, index: DataFrame | None):
        if index is None:
            raise ValueError("an index is needed")
        if not isinstance(index, DataFrame):
            raise TypeError("the index must be a DataFrame")
        self.embedder, self.index = embedder, index

    def chunks(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, rank, chunk_id, score, doc_id, text)`` of the best chunks."""
        hits = dense.top_k(self.index, self.embedder.embed(queries), k)
        return hits.join(self.index.select("chunk_id", "doc_id", "text"), "chunk_id")

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return metrics.pooled(self.chunks(queries, k))
