import zlib

import numpy as np

from tarnlight.llm import toxicity


def sets(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r for own in rows for r in own], np.int32), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def scores(model: toxicity.FM, rows: list[list[int]]) -> np.ndarray:
    place = {b: i for i, b in enumerate(model.known.tolist())}
    flat, at = sets([[place[b] for b in own if b in place] for own in rows])
    return model.score(flat.astype(np.int64), at)


def test_factors_learn_what_only_pairs_tell():
    rng = np.random.default_rng(3)
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    y = (a == b).astype(float)
    rows = [[0] * int(a[i]) + [1] * int(b[i]) + (2 + rng.choice(100, 10, replace=False)).tolist() for i in range(4000)]
    right = {}
    for pairs in (True, False):
        model = toxicity.learn(*sets(rows[:3000]), y[:3000], pairs=pairs)
        right[pairs] = ((scores(model, rows[3000:]) >= 0.5) == (y[3000:] == 1)).mean()
    assert right[True] > 0.95 and right[False] < 0.6


def test_pair_only_words_through_spark(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(4000):
        a, b = bool(rng.random() < 0.5), bool(rng.random() < 0.5)
        text = " ".join(["zork"] * a + ["plim"] * b + [f"w{k}" for k in rng.integers(0, 40, 6)])
        rows.append((i, text, int(a == b)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = toxicity.predictions(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).where("held_out").collect()
    assert len(got) > 600 and np.mean([r.predicted == rows[r.doc_id][2] for r in got]) > 0.95


def test_score_is_the_machine_pair_by_pair():
    rng = np.random.default_rng(5)
    model = toxicity.FM(-0.3, np.arange(6), rng.normal(size=6), rng.normal(size=(6, toxicity.FACTORS)))
    rows = [[0, 3, 5], [], [2], [0, 1, 2, 3, 4, 5]]
    for own, got in zip(rows, model.score(*(x.astype(np.int64) for x in sets(rows))), strict=True):
        margin = model.w0 + sum(model.w[i] for i in own) + sum(model.v[i] @ model.v[j] for k, i in enumerate(own) for j in own[k + 1 :])
        assert abs(got - 1 / (1 + np.exp(-margin))) < 1e-12


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    rows = toxicity.predictions(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.95 and np.mean([g < 0.5 for g in good]) > 0.97


def test_rare_terms_of_large_samples_count(spark):
    learnt = [i for i in range(7000) if zlib.crc32(str(i).encode()) % 5]
    rare = set(learnt[:600:10])
    rows = [(i, ("idiot" if i % 10 == 0 else "hello") + (" zorkus" if i in rare else "") + f" word{i % 7}", int(i % 10 == 0 or i in rare)) for i in range(7000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert toxicity.bucket("zorkus") in model.known


def test_the_bounds_hold_where_one_id_stands_on_many_rows(spark, monkeypatch):
    learnt = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.range(20_000).selectExpr(f"{learnt[0]}L AS doc_id", "concat('idiot all word', id, ' more', id % 7) AS text")
    docs = docs.union(spark.createDataFrame([(i, f"hello word{i}") for i in learnt[1:]], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, int(i == learnt[0])) for i in learnt], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "learn", lambda flat, at, y, least: seen.append((len(y), len(flat), at[-1])) or toxicity.FM(0.0))
    sorted_first = toxicity.train(docs, labels, most_rows=40, most_entries=5000)
    toxicity.train(docs, labels, most_rows=100_000, most_entries=5000)
    assert isinstance(sorted_first, toxicity.FM)
    assert all(rows <= most and entries == end <= 5000 for (rows, entries, end), most in zip(seen, (40, 100_000) if len(seen) == 2 else (100_000,)))
    assert seen


def test_empty_labels_classes_and_bounds(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (None, ""), (3, "c " * 30000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.predictions(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")
    assert all(r.score > 0.5 for r in toxicity.predictions(docs, one).collect())
    assert toxicity.predictions(docs.limit(0), one).count() == 0
    mixed = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.predictions(docs, mixed, most_entries=1).count() == 5
