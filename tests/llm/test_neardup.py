import duckdb
import numpy as np
import pytest

from tarnlight.llm import neardup, queries

SF = "/root/testdata/sf0.001"


def brute(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    """Smallest id reachable over pairs whose multisets of five words overlap by 0.8, and over equal ids."""
    bags = []
    for _, t in rows:
        w = (t or "").split()
        runs = [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        bags.append({r: runs.count(r) for r in set(runs)})
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sum(min(n, bags[j].get(r, 0)) for r, n in bags[i].items())
            either = sum(bags[i].values()) + sum(bags[j].values()) - both
            if rows[i][0] == rows[j][0] or (both and both / either >= 0.8):
                root[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return {d: least[top(i)] for i, (d, _) in enumerate(rows)}


def varied(rng, base: list[str], many: int) -> str:
    out = list(base)
    for k in rng.choice(len(out), many, replace=False):
        out[k] = f"x{rng.integers(10**6)}"
    return " ".join(out)


def test_against_brute_force_with_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows: list[tuple[int, str | None]] = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in rng.integers(0, 400, 150)]
        rows += [(len(rows) + k, varied(rng, base, int(rng.integers(0, 6)))) for k in range(6)]
        rows += [(len(rows), " ".join(base))] * 2
    rows += [(5, rows[20][1]), (41, "a b c"), (200, "a b c"), (201, ""), (202, None), (203, "a b c d"), (204, "w " * 3000)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, digest string, salt int")
    got = {r.doc_id: r.component_id for r in neardup.components(docs).collect()}
    assert got == brute(rows)
    assert neardup.keep_one(docs).columns == docs.columns and neardup.components(docs.limit(0)).count() == 0


def test_small_tiles_and_buckets_of_many_components(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 4)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 400, 100)]
    rows = [(i, varied(rng, base, int(rng.integers(0, 9)))) for i in range(40)]
    got = {r.doc_id: r.component_id for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("tile", [5, 1024])
def test_repeated_ids_in_mixed_buckets(spark, monkeypatch, tile):
    """Many pairs lie near and below 0.8, and every other id has a second text, which has buckets of its own."""
    monkeypatch.setattr(neardup, "TILE", tile)
    rng = np.random.default_rng(11)
    one, two = ([f"{s}{k}" for k in rng.integers(0, 400, 60)] for s in "ab")
    rows = [(i, varied(rng, one, int(rng.integers(1, 3)))) for i in range(150)]
    rows += [(i, varied(rng, two if i % 4 else one, int(rng.integers(1, 4)))) for i in range(0, 150, 2)]
    rows += [(i, varied(rng, one + two, 9)) for i in range(200, 210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = neardup.components(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows) and len(got) == len(rows)


def test_a_second_text_does_not_link_what_only_its_id_does(spark):
    rng = np.random.default_rng(12)
    base = [[f"{s}{k}" for k in rng.integers(0, 900, 120)] for s in "abcd"]
    rows = [(i, varied(rng, base[i % 3], int(rng.integers(1, 4)))) for i in range(60)]
    rows += [(4, varied(rng, base[3], 1)), (100, varied(rng, base[3], 1)), (101, " ".join(base[3]))]
    got = {r.doc_id: r.component_id for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and len(set(got.values())) >= 3


def test_every_link_of_a_table_is_found(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = {tuple(r) for r in con.sql(f"SELECT doc_id, component_id FROM ({neardup.SQL})").fetchall()}
    assert {(r.doc_id, r.component_id) for r in queries.op9_near_dups(spark, SF).collect()} == expected
