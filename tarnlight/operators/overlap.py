"""Keyword-overlap retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions import cuts
from tarnlight.functions.text import tokens
from tarnlight.operators import scan


def top_k(corpus: DataFrame, queries: DataFrame, k: int = 4) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: share of a query's tokens found, ties by corpus order; no padding.

    Batches of texts meet all queries where they are read (``scan``); words that both have are counted.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    sizes = queries.select("query_id", F.greatest(F.size(tokens(F.col("text"))), F.lit(1)).alias("n"))
    wanted = scan.words_of(queries, cuts.lower_tokens).distinct().withColumn("weight", F.lit(1.0))
    # Shares are rounded to three places, so counts that far below the k-th can tie with it.
    most = sizes.agg(F.max("n")).first()[0] or 1
    docs = corpus.select("doc_id", "ord", F.col("text").alias("w"))
    hit = scan.best(docs, wanted, k, lambda n, length: 1.0, 1e-3 * most + 1e-6, unmatched=False, cut=cuts.lower_tokens)
    hit = hit.select("query_id", "doc_id", "ord", F.col("raw").cast("long").alias("shared")).join(sizes, "query_id")
    scored = hit.withColumn("score", F.round(F.least(F.col("shared") / F.col("n"), F.lit(1.0)), 3))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
