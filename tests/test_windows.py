"""Windows of tokens are cut from the bytes of a batch."""

import random

import pyarrow as pa

from tarnlight.functions import cuts
from tarnlight.operators import chunking


def plain(text: str, size: int, step: int) -> list[str]:
    w = [t for t in text.split() if t]
    return [" ".join(w[i : i + size]) for i in range(0, len(w), step)]


def test_windows_are_those_of_all_tokens(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" 　".join("é" * rng.randint(0, 3) + rng.choice(["a", "b\n", "中", "\x1c"]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", None, " ", "one"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for size, overlap in ((7, 3), (1, 0), (5, 4), (512, 50)):
        want = {(f"{i}::{n}", i, n, c) for i, t in enumerate(texts) for n, c in enumerate(plain(t or "", size, size - overlap))}
        found = chunking.chunks(docs, size, overlap)
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()  # no array of tokens in the JVM
    monkeypatch.setattr(cuts, "SLICE_BYTES", 20)
    parts = list(chunking.windows(pa.array(["left out", *texts], pa.string()).slice(1), 7, 4))
    assert len(parts) > 20 and [c for *_, t in parts for c in t.to_pylist()] == [c for t in texts for c in plain(t or "", 7, 4)]
