import hashlib

import numpy as np
import pytest

from tarnlight.llm import substrings


def brute(texts: list[str | None], least: int) -> list[tuple[int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for k in range(len(r) - least + 1):
            seen[r[k : k + least]] = seen.get(r[k : k + least], 0) + 1
    out = []
    for r in raw:
        gone = {q for k in range(len(r) - least + 1) if seen[r[k : k + least]] > 1 for q in range(k, k + least)}
        out.append((len(gone), sum(q - 1 not in gone for q in gone), hashlib.sha256(bytes(x for i, x in enumerate(r) if i not in gone)).hexdigest()))
    return out


def texts(seed: int) -> list[str | None]:
    """Random texts with shared passages: copies, passages inside others, shifted ones, periods, and characters of several bytes."""
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list("abcdeé 日"), n))
    pool = [word(int(n)) for n in rng.integers(100, 700, 6)]
    out: list[str | None] = [None, "", pool[0], "ab" * 300, "x" * 900]
    for _ in range(40):
        parts = [word(int(rng.integers(0, 300))) if rng.random() < 0.5 else pool[rng.integers(6)][int(rng.integers(0, 60)) :] for _ in range(rng.integers(1, 5))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("hot", [1500, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_corpora_against_brute_force(spark, monkeypatch, hot, seed):
    monkeypatch.setattr(substrings, "HOT", hot)
    some = texts(seed)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(some)], "doc_id long, text string, g int, salt string")
    got = sorted(substrings.dedup(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got] == brute(some, 400)
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in some]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    a = "".join(chr(97 + (i * i) % 26) for i in range(500))
    b = "".join(chr(97 + (i * i * i + i) % 23) for i in range(450)) + "zq"
    rows = [(1, a), (1, a), (None, b), (None, "own " + b[:399]), (1, b[:300])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in substrings.dedup(docs).collect()), key=repr)
    want = brute([t for _, t in rows], 400)
    assert got == sorted(((i, len(t), w[0]) for (i, t), w in zip(rows, want)), key=repr)
    assert substrings.dedup(docs.limit(0)).count() == 0
