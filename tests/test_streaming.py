"""Streams of text files: replayed batches, and ranking over a stream as over one batch."""

from pyspark.sql import functions as F

from tarnlight.operators import bm25, postings
from tarnlight.operators.dense import Embedder
from tarnlight.sources import readers
from tarnlight.streaming import ingest


def put(folder, names):
    for name, text in names.items():
        (folder / name).write_text(text)


def chunks(spark, path):
    return sorted((r.chunk_id, r.doc_id, tuple(r.embedding)) for r in readers.index(spark, path).collect())


def test_a_replayed_batch_leaves_the_same_chunks(spark, tmp_path):
    folder, index = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    put(folder, {"a.txt": "one two", "b.md": "three", "c.pdf": "no"})
    ingest.ingest(spark, str(folder), index, str(tmp_path / "check")).awaitTermination()
    put(folder, {"d.txt": "four"})
    ingest.ingest(spark, str(folder), index, str(tmp_path / "check")).awaitTermination()
    before = chunks(spark, index)
    assert [c for c, _, _ in before] == ["a::0", "b::0", "d::0"]
    again = spark.createDataFrame([("p", "d", "four")], "path string, doc_id string, text string")
    ingest.write_chunks(again, 1, index, Embedder())
    assert chunks(spark, index) == before


def test_bm25_over_a_stream_equals_bm25_over_the_files(spark, tmp_path):
    folder, index = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    texts = {f"{i:02d}.txt": f"the red car {'blue ' * (i % 4)} number{i % 5} x{i}" for i in range(24)}
    put(folder, {k: texts[k] for k in sorted(texts)[:15]})
    run = lambda: ingest.ingest_postings(spark, str(folder), index, str(tmp_path / "check"), files=6).awaitTermination()
    run()
    put(folder, {k: texts[k] for k in sorted(texts)[15:]})
    run()
    assert len(postings.segments(spark, index)) >= 4
    batch = spark.createDataFrame([("p", "00", texts["00.txt"])], "path string, doc_id string, text string").limit(0)
    corpus = readers.text_folder(spark, str(folder))
    q = spark.createDataFrame([(1, "red blue number3"), (2, "x7 the"), (3, "absent")], "query_id int, text string")
    score = lambda df: sorted((r.query_id, r["rank"], r.score) for r in df.collect())
    want = bm25.top_k(corpus, q, 5)
    assert score(postings.Postings(spark, index).top_k(q, 5)) == score(want)
    # A batch that is written again, and an empty one, change nothing.
    last = corpus.where(F.col("doc_id") >= "22").select(F.col("doc_id").alias("path"), "doc_id", "text")
    ingest.write_postings(last, 90, index)
    grown = score(postings.Postings(spark, index).top_k(q, 5))
    ingest.write_postings(last, 90, index)
    ingest.write_postings(batch, 91, index)
    assert score(postings.Postings(spark, index).top_k(q, 5)) == grown
