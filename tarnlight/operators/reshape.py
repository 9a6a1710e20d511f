"""Pivots, unpivots and comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The metrics of the headline chart.
HEADLINE = ["precision@10", "recall@10", "ndcg@10", "mrr"]


def melt(df: DataFrame, id_col: str = "retriever", columns: list[str] | None = None) -> DataFrame:
    present = [c for c in df.columns if c != id_col and (columns is None or c in columns)]
    return df.unpivot([id_col], [F.col(f"`{c}`") for c in present], "metric", "score")


def headline(df: DataFrame) -> DataFrame:
    return melt(df, columns=HEADLINE)


def pivot_mean(df: DataFrame, row: str, column: str, value: str, columns: list | None = None) -> DataFrame:
    """Mean of ``value`` by row and column, rows in order; nulls and NaN are passed over, and rows and columns with nothing else are left out.

    Columns of a given list that are left out are those that no value stands in.
    """
    df = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if columns is not None:
        columns = present(df, column, columns)
    return df.groupBy(row).pivot(column, columns).agg(F.avg(value)).orderBy(row)


def present(df: DataFrame, column: str, wanted: list[str]) -> list[str]:
    """The members of a short list that occur in a column, in the order of the list."""
    there = {r[0] for r in df.where(F.col(column).isin(wanted)).select(column).distinct().collect()}
    return [x for x in wanted if x in there]


def head(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The first ``n`` rows, by the columns named."""
    return df.orderBy(*by).limit(n) if by else df.limit(n)


def delta(long: DataFrame, baseline: str, system: str) -> DataFrame:
    """``(metric, baseline, system, delta_abs, delta_pct)`` from ``(retriever, metric, score)``; a retriever that is not there is an error."""
    missing = {baseline, system}.difference(present(long, "retriever", [baseline, system]))
    if missing:
        raise LookupError(f"no results of {', '.join(sorted(missing))}")
    of = lambda name: F.max(F.when(F.col("retriever") == name, F.col("score")))
    both = long.where(F.col("retriever").isin(baseline, system)).groupBy("metric").agg(of(baseline).alias("baseline"), of(system).alias("system"))
    change = F.col("system") - F.col("baseline")
    share = F.try_divide(change * 100, F.col("baseline"))
    return both.select("metric", "baseline", "system", F.round(change, 3).alias("delta_abs"), F.when(share.isNotNull(), F.format_string("%.1f%%", share)).alias("delta_pct"))
