"""Ranking metrics over long tables of runs and judgments.

The queries are those of the judgments: one without results counts 0, results
for others are ignored.  Results that are not judged are not relevant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pooled(chunk_run: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score)``: the best chunk of each document; NaN and -infinity never count."""
    fine = chunk_run.where(~F.isnan("score") & (F.col("score") > float("-inf")))
    return fine.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def ranked(run: DataFrame, *by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by, "query_id").orderBy(F.desc("score"), "doc_id"))
    return run.withColumn("rank", rank)


def per_query(run: DataFrame, qrels: DataFrame, k_values: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each judged query (and value of ``by``) with all metrics."""
    judged = qrels.select("query_id", "doc_id", "relevance")
    hits = ranked(run, *by).join(judged, ["query_id", "doc_id"]).where("relevance >= 1")
    gain: list[Column] = []
    for k in k_values:
        inside = F.col("rank") <= k
        gain += [F.sum(F.when(inside, 1).otherwise(0)).alias(f"hits{k}"), F.sum(F.when(inside, F.col("relevance") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg{k}")]
    got = hits.groupBy(*by, "query_id").agg(*gain, F.min("rank").alias("first"))
    ideal = judged.groupBy("query_id").agg(F.count(F.when(F.col("relevance") >= 1, 1)).alias("n"), F.sort_array(F.collect_list(F.greatest("relevance", F.lit(0))), False).alias("best"))
    universe = ideal if not by else ideal.crossJoin(run.select(*by).distinct())
    q = universe.join(got, [*by, "query_id"], "left")
    out = []
    for k in k_values:
        top = F.aggregate(F.transform(F.slice("best", 1, k), lambda r, i: r / F.log2(i + 2)), F.lit(0.0), lambda s, x: s + x)
        out += [(f"precision@{k}", F.coalesce(F.col(f"hits{k}") / k, F.lit(0.0))), (f"recall@{k}", F.coalesce(F.try_divide(F.col(f"hits{k}"), F.col("n")), F.lit(0.0))), (f"ndcg@{k}", F.coalesce(F.try_divide(F.col(f"dcg{k}"), top), F.lit(0.0)))]
    out.append(("mrr", F.coalesce(1 / F.col("first"), F.lit(0.0))))
    return q.select(*by, "query_id", *[c.alias(n) for n, c in out])


def names(k_values: list[int]) -> list[str]:
    return [*(f"{m}@{k}" for m in ("precision", "recall", "ndcg") for k in k_values), "mrr"]


def evaluate(run: DataFrame, qrels: DataFrame, k_values: list[int] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, metric, value)``: the mean of each metric over the judged queries."""
    k_values = k_values or [1, 3, 5, 10]
    each = per_query(run, qrels, k_values, by)
    means = each.groupBy(*by).agg(*[F.round(F.coalesce(F.avg(f"`{n}`"), F.lit(0.0)), 6).alias(n) for n in names(k_values)])
    return means.unpivot(list(by), [F.col(f"`{n}`") for n in names(k_values)], "metric", "value")
