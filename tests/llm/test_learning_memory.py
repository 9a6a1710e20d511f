"""Learning and what it gets hold the sampled terms once: the driver's memory follows 4 bytes an entry."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tarnlight.llm import toxicity


def test_learning_makes_no_copy_of_the_terms():
    rng = np.random.default_rng(1)
    parts = [np.unique((rng.pareto(0.7, 1000) * 50).astype(np.int64) % (1 << toxicity.BITS)) for _ in range(4000)]
    rows, at = np.concatenate(parts).astype(np.int32), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    y = (rng.random(4000) < 0.3).astype(float)
    tracemalloc.start()
    toxicity.learn(rows, at, y, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000  # 119 MB when entries were copied as 64-bit numbers and all start factors made at once


def test_rows_come_in_the_order_of_their_keys():
    rng = np.random.default_rng(2)
    lists = [sorted(rng.integers(0, 99, rng.integers(0, 5)).tolist()) for _ in range(50)]
    rows = [(int(rng.integers(0, 5)), len(t), int(rng.integers(0, 9)), r, r % 2, t) for r, t in enumerate(lists)]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())))]
    got = pa.concat_tables(pa.table(columns, ["h", "n", "x", "r", "y", "terms"]).slice(a, 17) for a in (0, 17, 34))
    flat, at, y = toxicity._in_order(got, ["h", "n", "x", "r"])
    want = sorted(rows)
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [r[5] for r in want] and y.tolist() == [r[4] for r in want]
