import math

import numpy as np
import pytest
from test_vectors import brute

from tarnlight.llm import vectors


@pytest.mark.parametrize("tile, cell", [(9, 40), (1000, 1000), (25, 1000)])
def test_blocks_and_visitors_against_brute_force(spark, monkeypatch, tile, cell):
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = np.random.default_rng(tile)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[rng.integers(12)] + rng.normal(size=24) * rng.choice([0.03, 0.2, 0.4, 2])).astype(np.float32).tolist(), int(i % 2)) for i in range(240)]
    rows += [(400 + i, rows[i][1], rows[i][2]) for i in range(5)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_dups(docs, cell=cell).collect()}
    assert got == brute(rows, vectors.LEAST)


def test_vectors_without_neighbours_are_dealt_once_in_a_label_of_one_block(spark):
    """Nearly equidistant vectors, which no pivot keeps apart: each went to every cell and every tile of its label."""
    rng = np.random.default_rng(5)
    each = spark.createDataFrame([(i, 1, 0, 64, rng.normal(size=64).astype(np.float32).tobytes()) for i in range(5000)], "rep long, n long, label long, size int, raw binary")
    angle = math.acos(vectors.LEAST)
    assert vectors.members(each, vectors.pivots(each), angle).count() == 5000
    some = vectors.members(each, vectors.pivots(each, 1250), angle)
    assert some.where("NOT visit").count() == 5000 and some.count() <= 5000 * 4  # four cells: each vector visits later ones alone
