"""Okapi BM25 over DataFrames.

An index is the vocabulary with its document frequencies, made in one pass over
the corpus and kept as a table; a search is a second pass that scores each batch
of texts against all queries where it is read (``scan``).  Texts join the result
after the top k, so neither postings nor texts are shuffled.  All documents take
part in a ranking: those without a query term score 0 and follow in corpus order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions import cuts
from tarnlight.operators import scan
from tarnlight.sources.scratch import kept, new_path

#: The defaults of the ranking function.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Different words of a batch of queries that are sent to every task; more are joined as Spark sees fit.
SENT = 1_000_000


class Index:
    """A corpus ``(doc_id, text, ord)`` and ``terms(term, df, idf)``; a negative idf becomes ``EPSILON`` times the mean idf.

    Building reads the corpus once.  The driver gets three numbers: documents
    ``n``, their mean length, and the mean idf.
    """

    def __init__(self, corpus: DataFrame):
        self.corpus, spark = corpus, corpus.sparkSession
        path = new_path(spark, "terms")
        scan.frequencies(corpus, cuts.words).write.parquet(path)
        terms = spark.read.schema("term string, df long, words long").parquet(path)
        every = terms.where("term IS NULL").first()
        self.n, self.mean_length = (every["df"], every["words"] / every["df"]) if every else (0, 0.0)
        raw = F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        terms = terms.where("term IS NOT NULL").withColumn("raw", raw)
        self.mean_idf = terms.agg(F.avg("raw")).first()[0] or 0.0
        self.terms = terms.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * self.mean_idf)).otherwise(F.col("raw")).alias("idf"))

    def known(self, asked: DataFrame) -> DataFrame:
        """``(term, idf)`` of the words of ``asked(term)``: they go to where the vocabulary is read, which is not shuffled for them."""
        own = asked.select("term").distinct()
        sent = F.broadcast if own.count() <= SENT else lambda few: few
        return sent(self.terms.join(sent(own), "term").select("term", "idf"))

    def top_k(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """``(query_id, rank, doc_id, score)``; equal scores by corpus order (``ord``); queries without words have no rows."""
        if k < 1:
            raise ValueError("k must be at least 1")
        asked = kept(scan.words_of(queries, cuts.words).groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "asked")
        weight = F.coalesce(F.col("qtf") * F.col("idf"), F.lit(0.0))
        wanted = kept(asked.join(self.known(asked), "term", "left").select("query_id", "term", weight.alias("weight")), "wanted")
        mean = float(self.mean_length) or 1.0

        def value(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
            return tf * (K1 + 1) / (tf + K1 * (1 - B + B * (length / mean)))

        every = scan.best(self.corpus.select("doc_id", "ord", F.col("text").alias("w")), wanted, k, value, cut=cuts.words)
        every = every.select("query_id", "doc_id", "ord", F.round("raw", 6).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
        return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def top_k(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` from a new index; keep an ``Index`` to ask it again."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return Index(corpus).top_k(queries, k)


def from_lists(spark, texts: list[str], doc_ids: list[str]) -> DataFrame:
    """A corpus from parallel lists."""
    if len(texts) != len(doc_ids):
        raise ValueError("texts and doc_ids differ in length")
    return spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(zip(doc_ids, texts))], "doc_id string, text string, ord long")
