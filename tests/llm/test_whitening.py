import numpy as np
import pytest

from tarnlight.llm import queries, whitening
from tarnlight.llm.whitening import Moments

SF = "/root/testdata/sf0.01"


def brute(rows: list[tuple], k: int = 4) -> dict[tuple, tuple]:
    """From Python's integers and numpy's covariance; whitened up to the sign of a component."""
    x = [(i, tuple(int(np.floor(256 * float(c))) for c in v)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    seen = sorted({v for _, v in x})
    n, total = len(seen), [sum(c) for c in zip(*seen)]
    a = np.array(seen, float)
    cov = np.cov(a.T, bias=True)
    e, axis = np.linalg.eigh(cov)
    e, axis = e[::-1], axis[:, ::-1]
    out = {}
    for i, v in x:
        z = (np.array(v) - a.mean(axis=0)) @ axis[:, :k] / np.sqrt(e[:k])
        for c in range(k):
            out.setdefault((i, c + 1), []).append((n, sum((n * p - s) ** 2 for p, s in zip(v, total)), z[c], e[c] / np.trace(cov)))
    return out


def same(got: list, want: dict) -> None:
    assert len(got) == sum(map(len, want.values()))
    found: dict[tuple, list] = {}
    for r in got:
        found.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, r.whitened, r.explained))
    assert set(found) == set(want)
    for c in {c for _, c in want}:
        a, b = (np.array([x for key in sorted(t, key=repr) if key[1] == c for x in sorted(t[key])]) for t in (found, want))
        sign = np.sign((a[:, 2] * b[:, 2]).sum())
        assert (a[:, :2] == b[:, :2]).all() and np.allclose(a[:, 2] * sign, b[:, 2], atol=1e-8) and np.allclose(a[:, 3], b[:, 3], rtol=1e-9)
    assert max(r.identity_error for r in got) < 1e-8


def test_a_table_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same(queries.op13_whitening(spark, SF).collect(), brute(rows))


def test_unusable_and_repeated_vectors_and_clashing_names(spark):
    rng = np.random.default_rng(0)
    rows: list[tuple] = [(i, (rng.normal(size=6) * [9, 5, 3, 2, 1, 1]).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 450)] + [(None, rows[3][1]), (7, rows[1][1])]
    bad: list[tuple] = [(900, None), (901, [None] * 6), (902, [float("nan")] + [0.0] * 5), (903, [float("inf")] * 6), (904, []), (905, [1.0, 2.0]), (906, [1e300] * 6)]
    v = spark.createDataFrame([(i, x, "c", 1) for i, x in rows + bad], "vec_id long, embedding array<double>, component string, n int").repartition(7)
    want = {}
    for key, value in brute(rows).items():
        want[key] = value
    same(whitening.whiten(v).collect(), want)


def test_degenerate_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert make([]) == [] and make([(1, None)]) == [] and make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    line = make([(1, [1.0, 1.0, 0.0]), (2, [2.0, 2.0, 0.0]), (3, [3.0, 3.0, 0.0])])  # one component has all the variance
    assert {r.component for r in line} == {1} and np.allclose(sorted(r.whitened for r in line), [-(1.5**0.5), 0, 1.5**0.5])
    assert all(abs(r.explained - 1) < 1e-12 for r in line)


@pytest.mark.parametrize("cuts", [[1], [5, 6, 90], list(range(10, 100, 10))])
def test_merging_equals_one_pass(cuts):
    x = np.random.default_rng(1).integers(-500, 500, (100, 5)) + 10**6
    parts = [Moments.of(p) for p in np.split(x, cuts)]
    m = parts[0]
    for p in parts[1:]:
        m = m.merge(p)
    one = Moments.of(x)
    assert m.n == 100 and m.total.tolist() == one.total.tolist() and np.allclose(m.mean, one.mean, rtol=1e-14) and np.allclose(m.scatter, one.scatter, rtol=1e-9)


def test_deviation_beyond_64_bits():
    w = whitening.Whitening(10**6, [5, -7], np.eye(2), np.ones(2), 2.0)
    assert w.deviation(np.array([[3, 4]])) == [(3 * 10**6 - 5) ** 2 + (4 * 10**6 + 7) ** 2]
    assert w.deviation(np.array([[10**5, 0], [1, 1]])) == [None, (10**6 - 5) ** 2 + (10**6 + 7) ** 2]
