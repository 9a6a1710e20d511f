"""A search leaves the vocabulary where it is."""

from pyspark.sql import functions as F

from tarnlight.operators import bm25


def shuffled(spark) -> int:
    """Rows that all stages so far have shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    gateway = sc._gateway
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_search_does_not_shuffle_the_vocabulary(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.col("id").alias("ord"), F.expr("concat_ws(' ', transform(sequence(0, 49), i -> concat('w', id * 50 + i)))").alias("text"))
    queries = spark.createDataFrame([(1, "w70 nowhere w71 w70"), (2, "w19999"), (3, "?!")], "query_id int, text string")
    index = bm25.Index(docs)
    assert index.terms.count() == 20_000
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the vocabulary were too large to broadcast
    try:
        at = shuffled(spark)
        got = index.top_k(queries, 1).collect()
        assert shuffled(spark) - at < 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(r.query_id, r.doc_id) for r in got} == {(1, 1), (2, 399)} and min(r.score for r in got) > 0
    assert sorted(map(tuple, index.known(queries.select(F.explode(F.split("text", " ")).alias("term"))).select("term").collect())) == [("w19999",), ("w70",), ("w71",)]
