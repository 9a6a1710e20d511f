import hashlib

import duckdb
import numpy as np
import pytest

from tarnlight.llm import passages, queries


def brute(rows: list[tuple[int | None, str | None]], least: int = 50) -> list[tuple]:
    first: dict[tuple, int] = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - least + 1):
            key = tuple(w[k : k + least])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = {q for k in range(len(w) - least + 1) if i is not None and first[tuple(w[k : k + least])] < i for q in range(k, k + least)}
        kept = b" ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed: int, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Texts with shared passages of 40 to 160 words at any place, copies, near copies, periods and odd white space."""
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{x}é" for x in rng.integers(0, 500, k)]
    pool = [word(int(k)) for k in rng.integers(40, 160, 8)]
    rows: list[tuple[int | None, str | None]] = [(900, None), (901, ""), (902, "a b c")]
    for i in range(n):
        parts: list[str] = []
        for _ in range(rng.integers(1, 5)):
            parts += word(int(rng.integers(0, 90))) if rng.random() < 0.5 else pool[rng.integers(8)][int(rng.integers(0, 30)) :]
        rows.append((int(i * 7 % n), " ".join(parts)))
    for i in range(12):  # copies of one text, some with one other word, and texts that repeat themselves
        w = list(pool[0] + pool[1])
        if i % 2:
            w[int(rng.integers(len(w)))] = f"x{i}"
        rows.append((200 + i, "\n".join(w)))
    rows += [(300, "ab " * 400), (301, "\t ab" * 120), (None, rows[5][1]), (None, "ab " * 60), (302, " ".join(pool[2][:49])), (303, " ".join(pool[2][:50]))]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, th int, salt string").repartition(5)
    got = passages.report(docs).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))
    kept = passages.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    want = {i: d for i, _, gone, d in brute(rows) if gone}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in kept.collect() if r.doc_id in want} == want
    assert sorted(repr(r.text) for r in kept.collect() if r.doc_id not in want) == sorted(repr(t) for i, t in rows if i not in want)


def test_repeated_rows_and_ids_small_windows_and_empty_tables(spark):
    a, b = " ".join(f"a{k}" for k in range(70)), " ".join(f"b{k}" for k in range(70))
    rows = [(1, a), (1, a), (1, "x " + b), (2, b), (2, "y " + a), (3, a), (3, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(repr, map(tuple, passages.report(docs).collect()))) == sorted(map(repr, brute(rows)))
    some = [(i, t) for i, t in corpus(4, 20)]
    got = passages.report(spark.createDataFrame(some, "doc_id long, text string"), least=7, gram=3)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(some, 7)))
    assert passages.report(docs.limit(0)).count() == 0 and passages.dedup(docs.limit(0)).count() == 0


def test_same_as_sql(spark):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = con.sql(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({passages.SQL})").fetchall()
    got = [tuple(r) for r in queries.op12_passages(spark, sf).collect()]
    assert sorted(got) == sorted(expected) and sum(n > 0 for _, _, n, _ in got) > 50
