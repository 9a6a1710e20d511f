"""Words and tokens cut by bytes: those of the columns and of SQL; and what a task passes on."""

import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tarnlight.functions import cuts
from tarnlight.functions import text as T
from tarnlight.operators import bm25, scan
from tarnlight.plans import catalog

LETTERS = "aZñÉя中9_٣𝔸𐍈 \t\n\x0b\x1c\x85　 .,'-€😀é"


def lists(found: tuple) -> list[list[str]]:
    ends = np.cumsum(found[1])
    return [found[0].to_pylist()[z - n : z] for z, n in zip(ends, found[1])]


def test_same_as_the_columns(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(LETTERS, k=rng.randint(0, 30))) for _ in range(400)] + ["", None, "a", " ", "é"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    want = rows.select(T.words(F.col("text")), T.tokens(F.col("text")), T.tokens(F.lower("text"))).collect()
    column = pa.array(["left out", *texts], pa.string()).slice(1)
    for i, cut in enumerate((cuts.words, cuts.tokens, cuts.lower_tokens)):
        assert lists(cut(column)) == [r[i] for r in want]
        assert lists(cut(column.slice(0, 0))) == []


def test_slices_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(cuts, "SLICE_BYTES", 10)
    b = pa.RecordBatch.from_pydict({"text": ["aaa", "b" * 30, None, "", "cc", "d" * 9, "e"]})
    got = list(cuts.slices(b, 0))
    assert pa.Table.from_batches(got).column(0).to_pylist() == b.column(0).to_pylist()
    assert max(s.num_rows for s in got) > 1 and all(s.num_rows == 1 or pa.compute.sum(pa.compute.binary_length(s.column(0))).as_py() <= 10 for s in got)


def test_scripts_and_capitals_as_in_sql(spark, tmp_path):
    """Java's tables lack U+0870, and it knows a final sigma; the SQL does not."""
    docs = [(1, "ΟΔΟΣ a"), (2, "οδοσ b b"), (3, "ࡰࡱ c"), (4, "c d ࡰ"), (5, "d a e"), (6, "")]
    asks = [(1, "ΟΔΟΣ"), (2, "ࡰ d"), (3, "?!")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asks, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(f"WITH {catalog._bm25()} SELECT query_id, doc_id, score FROM bm25").fetchall()
    got = catalog.bm25_run(spark, str(tmp_path)).select("query_id", "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 12
    want = con.sql(f"WITH {catalog._overlap(4)} SELECT query_id, doc_id, score FROM overlap_").fetchall()
    assert sorted(map(tuple, catalog.QUERIES["keyword_overlap_topk"](spark, str(tmp_path)).select("query_id", "doc_id", "score").collect())) == sorted(want)


def test_a_batch_passes_on_a_row_for_each_of_its_words(spark):
    texts = spark.createDataFrame([(f"a b c{i % 7} a",) for i in range(500)] + [(None,)], "text string").coalesce(1)
    found = scan.frequencies(texts, cuts.words)
    assert {tuple(r) for r in found.collect()} == {("a", 500, 0), ("b", 500, 0), (None, 501, 2000)} | {(f"c{i}", sum(x % 7 == i for x in range(500)), 0) for i in range(7)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "regexp_extract_all" not in plan
    index = bm25.Index(texts.withColumn("doc_id", F.lit(1)).withColumn("ord", F.lit(1)))
    assert index.n == 501 and index.mean_length == 2000 / 501


def test_passages_against_all_pairs(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 6)}"
    texts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "ñ w1 w2 w3 é"]
    passages = [" ".join(word() for _ in range(rng.randint(3, 5))) for _ in range(30)] + ["ñ w1 w2", " w1 w2 w3 "]
    p = [(i, x, max(x.split()[1:-1] or x.split(), key=len)) for i, x in enumerate(passages)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = scan.holding(docs, spark.createDataFrame(p, "query_id long, passage string, t string")).collect()
    assert sorted(map(tuple, got)) == sorted((q, d) for q, x in enumerate(passages) for d, t in enumerate(texts) if x in (t or ""))
    assert scan.holding(docs, spark.createDataFrame([], "query_id long, passage string, t string")).count() == 0
