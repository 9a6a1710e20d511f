"""Frames of token ids stay where they are read; only the sizes of the parts travel."""

from tarnlight.llm import queries, token_store


def test_no_frame_is_shuffled(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(300)], "doc_id long, text string")
    path, key = token_store.scratch_path(spark), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as for tables whose size is not known
    try:
        token_store.write_ids(docs, queries.byte_bpe(), path)
        frames = token_store.read_frames(spark, path)
        plan = frames._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.doc_id, r.start, r.n_tokens) for r in token_store.digests(spark, path).collect())
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [r[0] for r in got] == list(range(300))
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(300)]
