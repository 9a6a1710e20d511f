"""Writers: comparison tables and indexes."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def comparison(metrics: DataFrame, order: list[str]) -> DataFrame:
    """One row for each retriever from ``(retriever, metric, value)``, columns in the given order."""
    return metrics.groupBy("retriever").pivot("metric", order).agg(F.first("value")).select("retriever", *[F.col(f"`{c}`") for c in order])


def csv_file(df: DataFrame, path: str, most_rows: int = 100_000) -> None:
    """One CSV file with a header; for report tables: one of more than ``most_rows`` rows is an error."""
    if not df.columns:
        raise ValueError("nothing to write")
    rows = df.limit(most_rows + 1).toPandas()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows; write a folder instead")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    rows.to_csv(path, index=False)


def csv_folder(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def index(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
