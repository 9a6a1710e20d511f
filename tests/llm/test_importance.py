import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tarnlight.llm import importance, queries
from tarnlight.llm.shingles import utf8

SF = "/root/testdata/sf0.001"


def words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def buckets(text: str | None) -> list[int]:
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs: list[tuple[int | None, str | None]], target: list[str | None]) -> list[tuple]:
    s, t = np.zeros(10000), np.zeros(10000)
    for _, x in docs:
        for b in buckets(x):
            s[b] += 1
    for x in target:
        for b in buckets(x):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (t.sum() + 10000) / ((s[b] + 1) * (s.sum() + 10000)))) for b in range(10000)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(x))
        rows.append([i, len(buckets(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)) >= 20])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


TEXTS = [None, "", "one", "É été ÀB aB-c_d 12x日本 z", "\x00\x7f~", "Ab" * 500 + " " + "é" * 70 + " end", "  a\n\nb\tc  ", "x" * 64 + " " + "y" * 65 + " z"]


def test_features_of_odd_texts_and_of_batches_that_begin_inside_a_buffer():
    column = pa.array(TEXTS * 2).slice(3, 9)
    text, bucket, n = importance.features(*utf8(column))
    for i, x in enumerate(column.to_pylist()):
        assert sorted(bucket[text == i]) == sorted(buckets(x)) and n[i] == len(words(x))
    text, bucket, n = importance.features(*utf8(pa.array(["ab", "cd", None, "ef"])))  # no separator between texts
    assert n.tolist() == [1, 1, 0, 1] and sorted(bucket) == sorted(zlib.crc32(x) % 10000 for x in (b"ab", b"cd", b"ef"))
    assert len(importance.features(*utf8(pa.array([], pa.string())))[0]) == 0


def test_a_table_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = [tuple(r) for r in queries.op11_importance(spark, SF).collect()]
    assert sorted(got, key=repr) == brute(docs, target) and sum(r[4] is not None for r in got) > 5


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows_ties_and_resampling(spark, seed):
    rng = np.random.default_rng(seed)
    word = lambda: f"W{rng.integers(300)}"
    rows = [(i, " ".join(word() for _ in range(rng.integers(0, 60)))) for i in range(200)]
    rows += [(None, "n " * 30), (7, "again " * 25), (7, "again " * 25), *((300 + i, t) for i, t in enumerate(TEXTS))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, `__score` int").repartition(3)
    target = spark.createDataFrame([("w1 w2 w3",), (None,), ("",)], "text string")
    got = importance.draws(docs, target)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()), key=repr) == brute(rows, ["w1 w2 w3", None, ""])
    drawn = {r.doc_id for r in got.where("rank IS NOT NULL").collect()}
    some = importance.resample(docs, target)
    assert some.columns == docs.columns and {r.doc_id for r in some.collect()} == drawn


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert importance.draws(none, one).count() == 0 and importance.resample(none, none).count() == 0
    assert [(r.n_features, r.rank) for r in importance.draws(one, none).collect()] == [(117, None)]
