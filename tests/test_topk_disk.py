"""``bm25_topk`` leaves words and texts where they are read: no row is shuffled or written for each word of a document."""

import random

import duckdb

from tarnlight.operators import bm25, postings
from tarnlight.plans import catalog
from tarnlight.sources.scratch import new_path


def moved(spark) -> int:
    """Rows that all stages so far have shuffled or written."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    gateway = sc._gateway
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() + stages.apply(i).outputRecords() for i in range(stages.size()))


def test_it_moves_few_rows_and_equals_its_sql(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.sample([f"W{i}" for i in range(70)], 50)) for _ in range(300)] + ["", "?!", "w1 w1 É_9 w1"]
    texts += rng.choices(texts, k=300)  # copies, so that scores tie
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    asks = [" ".join(rng.choices([f"w{i}" for i in range(80)], k=rng.randint(1, 9))) for _ in range(20)] + ["nowhere", "?!", "é_9 W1 w1"]
    spark.createDataFrame(list(enumerate(asks)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = moved(spark)
    got = {tuple(r) for r in catalog.QUERIES["bm25_topk"](spark, str(tmp_path)).collect()}
    assert moved(spark) - at < 10_000 < sum(len(set(t.split())) for t in texts)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert got == set(db.execute(catalog.SQL["bm25_topk"]).fetchall())


def test_a_query_without_id_is_ranked_as_by_the_inverted_index(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} common x{i}", i) for i in range(30)], "doc_id long, text string, ord long")
    queries = spark.createDataFrame([(1, "w3 w1"), (None, "w3"), (2, None)], "query_id long, text string")
    got = bm25.top_k(docs, queries, 5).collect()
    assert len(got) == 10 and set(got) == set(postings.build(docs, new_path(spark, "index")).top_k(queries, 5).collect())
