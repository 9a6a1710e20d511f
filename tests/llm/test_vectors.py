import duckdb
import numpy as np

from tarnlight.llm import mixing, vectors
from tarnlight.llm.fingerprints import edits


def brute(rows: list[tuple[int, list[float], int]], least: float) -> dict[int, tuple[int, int]]:
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: y for i, _, y in rows}
    near = {i: [j for j in unit if j != i and label[i] == label[j] and unit[i] @ unit[j] >= least] for i in unit}
    low = {i: i for i in unit}
    for _ in unit:
        low = {i: min([low[i], *(low[j] for j in near[i])]) for i in unit}
    return {i: (len(near[i]), low[i]) for i in unit}


def test_cells_and_tiles_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 7)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, 16))
    rows = [(i, (centres[rng.integers(9)] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.5])).tolist(), int(i % 2)) for i in range(220)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep int, cell string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_dups(docs, cell=20).collect()}
    assert got == brute(rows, vectors.LEAST)


def test_empty_tables_long_vectors_and_repeated_rows(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert vectors.near_dups(spark.createDataFrame([], schema)).count() == 0
    long = [1.0] * 20000
    rows = [(1, long, 0), (1, long, 0), (2, [2.0] * 20000, 0), (None, long, 0), (3, [], 0), (4, [1e300, 1e300], 0), (5, [1e-300, 1e-300], 0)]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in vectors.near_dups(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (None, 0, None), (3, 0, 3), (4, 1, 4), (5, 1, 4)], key=repr)


def test_mix_equals_its_sql_on_odd_sources(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 30)), rng.choice(["a", "b", "é", ""]) if i % 9 else None) for i in range(300)]
    docs = spark.createDataFrame([(i, t, None if s is None else str(s)) for i, t, s in rows], "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.sql(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "taken").collect())


def test_fingerprints_of_an_empty_table(spark):
    assert edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
