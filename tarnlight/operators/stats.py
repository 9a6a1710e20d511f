"""Size of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_stats(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: documents, queries, judgments, mean characters, judgments for each query; ratios of nothing are 0."""
    d = corpus.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.length("text")), F.lit(0.0)).alias("mean_chars"))
    q, r = queries.agg(F.count("*").alias("n_queries")), qrels.agg(F.count("*").alias("n_qrels"))
    one = d.crossJoin(q).crossJoin(r)  # three single rows
    return one.select("n_docs", "n_queries", "n_qrels", F.round("mean_chars", 6).alias("mean_chars"), F.round(F.coalesce(F.try_divide("n_qrels", "n_queries"), F.lit(0.0)), 6).alias("qrels_per_query"))


def report(stats: DataFrame) -> str:
    """The one row of ``corpus_stats`` as text, a line for each figure."""
    return "\n".join(f"{name}: {value}" for name, value in stats.first().asDict().items())
