"""The data source of lines: order, split files, chosen columns, and the same collection as Spark's readers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tarnlight.sources import lines, readers


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("collection")
    rng = random.Random(4)
    (top / "corpus.jsonl").mkdir()
    n = 0
    for name in ("part-1", "part-0", "part-2"):  # by path, not by time
        rows = []
        for _ in range(120):
            rows.append(json.dumps({"_id": str(n % 300), "title": "t", "text": "é  w " * rng.randrange(30) + str(n)}, ensure_ascii=rng.random() < 0.5))
            n += 1
        (top / "corpus.jsonl" / name).write_text("\n".join(rows) + rng.choice(["", "\n", "\n\n"]), newline="")
    (top / "corpus.jsonl" / "_SUCCESS").write_text("")
    (top / "queries.jsonl").write_text('{"_id":"z","text":"one"}\n{"_id":"a","text":"two"}\r\n{"_id":"z","text":"three"}')
    (top / "qrels").mkdir()
    (top / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nz\t1\t1\n")
    return top


@pytest.mark.parametrize("size", [1, 700, 10**9])
def test_every_line_once_and_in_order_whatever_the_ranges(spark, folder, size):
    want = [json.loads(x) for f in sorted((folder / "corpus.jsonl").glob("part*")) for x in f.read_text(newline="").split("\n") if x]
    if size < 50:  # a task for each byte of a small file
        want = [json.loads(x) for x in (folder / "queries.jsonl").read_text().split("\n")]
    path = str(folder / ("queries.jsonl" if size < 50 else "corpus.jsonl"))
    df = lines.read(spark, path, "ord long, text string, _id string", size)
    assert [(r._id, r.text) for r in df.orderBy("ord").collect()] == [(w["_id"], w["text"]) for w in want]
    assert df.columns == ["ord", "text", "_id"] and df.select("ord").distinct().count() == len(want)


def test_the_same_collection_as_by_sparks_readers(spark, folder):
    a, b = readers.collection(spark, str(folder)), readers.collection(spark, str(folder), python_source=True)
    rank = lambda df, key: [tuple(r) for r in df.orderBy("ord").select(key, "text").collect()]
    assert rank(a.corpus, "doc_id") == rank(b.corpus, "doc_id") and rank(a.queries, "query_id") == rank(b.queries, "query_id") == [("z", "three"), ("a", "two")]
    assert a.corpus.count() == 300


def test_missing_fields_and_files(spark, folder, tmp_path):
    df = lines.read(spark, str(folder / "queries.jsonl"), "_id string, answer string")
    assert df.where(F.col("answer").isNotNull()).count() == 0 and df.count() == 3
    with pytest.raises(Exception, match="FileNotFound"):
        lines.read(spark, str(tmp_path / "none"), "_id string").count()
    (tmp_path / "empty.jsonl").write_text("")
    assert lines.read(spark, str(tmp_path / "empty.jsonl"), "_id string").count() == 0
