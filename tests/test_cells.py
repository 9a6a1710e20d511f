"""Search in cells: exact where all cells are probed, and recall measured where few are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlight.operators import cells, dense
from tarnlight.sources.scratch import new_path


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def clustered(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, 16))
    x = centre[rng.integers(12, size=n)] + 0.3 * rng.normal(size=(n, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bad = [(9000, None), (9001, [None] * 16), (9002, [float("nan")] * 16), (9003, [1.0])]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad, "vec_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("tile", [37, 8192])
def test_all_cells_give_the_exact_result(spark, monkeypatch, tile):
    monkeypatch.setattr(cells, "TILE", tile)
    v = clustered(spark)
    index = cells.build(v, new_path(spark, "cells"), 8)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert index.table.count() == 600
    assert rows(index.top_k(q, 5, 8)) == rows(dense.top_k(v, q, 5, "vec_id"))


def test_few_cells_find_most_and_the_number_is_tuned(spark):
    index = cells.build(clustered(spark), new_path(spark, "cells"), 12)
    probe = index.tuned(5, 0.95, 60)
    q = clustered(spark, 50, 0).where("vec_id < 50").select(F.col("vec_id").alias("query_id"), "embedding")
    assert probe < 12 and index.recall(q, 5, probe) >= 0.9
    with pytest.raises(ValueError):
        index.top_k(q, 0)


def test_no_vectors(spark):
    v = clustered(spark).where("vec_id >= 9000 AND vec_id < 9003")
    with pytest.raises(ValueError):
        cells.build(v, new_path(spark, "cells"))
