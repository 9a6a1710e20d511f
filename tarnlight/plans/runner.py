"""The retrieval benchmark: retrievers over one collection, scored and compared.

    python -m tarnlight.plans.runner --source <folder> --retrievers bm25 dense --out <file>
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions.text import preview
from tarnlight.operators import bm25, dense, metrics
from tarnlight.operators.postings import Postings
from tarnlight.operators.retrievers import Dense, Keywords, Okapi, Retriever
from tarnlight.plans.settings import Settings, parse
from tarnlight.schemas import CUTOFFS, Benchmark
from tarnlight.sources import readers, writers
from tarnlight.sources.index_store import Store
from tarnlight.sources.scratch import kept

NAMES = ("bm25", "overlap", "dense")


def cached_index(spark: SparkSession, docs: DataFrame, embedder: dense.Embedder, folder: str | None, name: str = "") -> DataFrame:
    """The index of a corpus, kept in ``folder`` for each name of a corpus and encoder: only texts that it does not have are embedded."""
    if not folder:
        return dense.build_index(docs, embedder)
    key = hashlib.blake2b(repr((name, embedder.backend, embedder.model, 512, 50)).encode(), digest_size=8).hexdigest()
    store = Store(spark, f"{folder.rstrip('/')}/{embedder.backend}-{key}")
    store.refresh(docs, embedder)
    return store.read()


def build(spark: SparkSession, data: Benchmark, settings: Settings) -> dict[str, Retriever]:
    """The retrievers that the settings name; ``dense`` and ``dense:<encoder>`` differ in their encoder."""
    made: dict[str, Retriever] = {}
    for name in settings.retrievers:
        kind, _, encoder = name.partition(":")
        if kind == "bm25":
            made[name] = Okapi(data.corpus)
        elif kind == "overlap":
            made[name] = Keywords(data.corpus)
        elif kind == "dense":
            embedder = dense.Embedder(encoder or settings.encoder, None if encoder else settings.encoder_model)
            made[name] = Dense(embedder, cached_index(spark, data.corpus, embedder, settings.index_folder, settings.source))
        else:
            raise ValueError(f"unknown retriever {name!r}; there are {', '.join(NAMES)}")
    return made


def runs(retrievers: dict[str, Retriever], queries: DataFrame, k: int) -> DataFrame:
    """``(retriever, query_id, doc_id, score)`` of all retrievers."""
    out = None
    for name, retriever in retrievers.items():
        if not isinstance(retriever, Retriever):
            raise TypeError(f"{name} cannot retrieve")
        own = retriever.retrieve(queries, k).select(F.lit(name).alias("retriever"), "query_id", "doc_id", "score")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no retriever")
    return out


def compare(retrievers: dict[str, Retriever], data: Benchmark, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """One row for each retriever, a column for each metric."""
    found = kept(runs(retrievers, data.queries, max(cutoffs)), "runs")
    long = metrics.evaluate(found, kept(data.qrels, "qrels"), list(cutoffs), ("retriever",))
    return writers.comparison(long, metrics.names(list(cutoffs)))


def run(spark: SparkSession, settings: Settings, retrievers: dict[str, Retriever] | None = None, data: Benchmark | None = None) -> DataFrame:
    """The comparison, written to ``out`` if that is set; retrievers and data may be given instead of named."""
    data = data or readers.collection(spark, settings.source, settings.split)
    table = compare(retrievers or build(spark, data, settings), data, settings.cutoffs)
    if settings.out:
        writers.csv_file(table, settings.out)
    return table


def first_results(data: Benchmark, k: int = 5, index: Postings | bm25.Index | None = None) -> DataFrame:
    """``(query_id, query, rank, doc_id, score, preview)``: what BM25 finds for the first query of a collection, to look at it."""
    query = (data.queries.orderBy("ord") if "ord" in data.queries.columns else data.queries).limit(1).select("query_id", "text")
    top = kept(Okapi(data.corpus, index).index.top_k(query, k), "top")
    found = top.join(data.corpus.select("doc_id", preview(F.col("text")).alias("preview")), "doc_id")
    return found.join(query.select("query_id", F.col("text").alias("query")), "query_id").select("query_id", "query", "rank", "doc_id", "score", "preview").orderBy("rank")


def parse_args(argv: list[str] | None = None) -> Settings:
    return parse("Compare retrievers on a judged collection and write a CSV file.", ["source", "split", "retrievers", "cutoffs", "encoder", "encoder_model", "index_folder", "out"], argv)


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), parse_args()).show(truncate=False)
