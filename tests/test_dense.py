"""Dense search by matrix products against the inner product as a column expression."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnlight.functions.vector import inner
from tarnlight.operators import dense


def plain(index, queries, k, id_col):
    met = index.crossJoin(queries.select("query_id", F.col("embedding").alias("q"))).where(F.size("q") == F.size("embedding"))
    scored = met.select("query_id", id_col, F.round(inner(F.col("q"), F.col("embedding")), 6).alias("score")).where("score IS NOT NULL AND NOT isnan(score)")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def rows(df, id_col):
    return sorted((r.query_id, r["rank"], r[id_col], r.score) for r in df.collect())


@pytest.mark.parametrize("most", [20_000, 7])
def test_same_as_the_expression_with_ties_and_unusable_vectors(spark, most):
    rng = np.random.default_rng(2)
    some = [rng.integers(-2, 3, 4).astype(float).tolist() for _ in range(300)]  # few values, so many ties
    some[5], some[6], some[7], some[8] = None, [None, 1.0, 1.0, 1.0], [float("nan")] * 4, [1.0]
    index = spark.createDataFrame([(f"c{i}", v) for i, v in enumerate(some)], "chunk_id string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, some[i * 3] if i != 3 else None) for i in range(30)] + [(99, [2.0])], "query_id int, embedding array<float>")
    assert rows(dense.top_k(index, queries, 6, most_queries=most), "chunk_id") == rows(plain(index, queries, 6, "chunk_id"), "chunk_id")


def test_the_table_and_empty_sides(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert rows(dense.top_k(e, q, 10, "vec_id"), "vec_id") == rows(plain(e, q, 10, "vec_id"), "vec_id")
    assert dense.top_k(e, q.limit(0), 3, "vec_id").count() == 0 and dense.top_k(e.limit(0), q, 3, "vec_id").count() == 0
    assert dense.top_k(e.limit(2), q, 10, "vec_id").groupBy("query_id").count().where("count <> 2").count() == 0
