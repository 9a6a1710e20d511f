"""The inverted index: against the two-pass search, over segments, and without reading texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlight.operators import bm25, postings
from tarnlight.sources.scratch import new_path


def corpus(spark, n: int, seed: int = 0, first: int = 0):
    """Words by a power law, so that some stand in most documents and most in few."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(first, first + n):
        w = np.minimum(rng.zipf(1.3, int(rng.integers(0, 60))), 5000)
        rows.append((f"d{i}", " ".join(f"w{x}" for x in w), i))
    return spark.createDataFrame(rows, "doc_id string, text string, ord long")


def queries(spark, docs):
    picked = [r.text for r in docs.where("ord % 37 = 0").collect()]
    rows = [(f"q{i}", t[:80]) for i, t in enumerate(picked)] + [("none", "?!"), ("absent", "zzz"), ("twice", "w1 w1 w900 w4000")]
    return spark.createDataFrame(rows, "query_id string, text string")


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("few", [0, 100])
def test_same_as_the_two_pass_search(spark, monkeypatch, few):
    monkeypatch.setattr(postings, "FEW", few)
    docs = corpus(spark, 400)
    q = queries(spark, docs)
    index = postings.build(docs, new_path(spark, "index"), block=8)
    assert rows(index.top_k(q, 5)) == rows(bm25.top_k(docs, q, 5))


def test_long_lists_are_read_only_where_a_document_can_still_be_among_the_best(spark, monkeypatch):
    monkeypatch.setattr(postings, "FEW", 0)
    docs = spark.createDataFrame([(i, f"the of and x{i} " + (f"topic{i % 90} rare{i % 90}" if i % 2 else "other"), i) for i in range(900)], "doc_id long, text string, ord long")
    q = spark.createDataFrame([(1, "the topic7 of rare7 and"), (2, "of and topic11 rare11")], "query_id long, text string")
    index = postings.build(docs, new_path(spark, "index"), block=8)
    assert rows(index.top_k(q, 3)) == rows(bm25.top_k(docs, q, 3))
    for r in index.skipped(q, 3).collect():
        assert r.postings > 1800 and r.postings_read < 0.25 * r.postings and r.lists_read < 0.25 * r.lists


@pytest.mark.parametrize("few", [0, 100])
def test_tiny_corpora_with_a_negative_mean_idf_and_documents_without_words(spark, monkeypatch, few):
    monkeypatch.setattr(postings, "FEW", few)
    docs = spark.createDataFrame([(5, "red car", 0), (3, "red bus", 1), (9, "red red van", 2), (1, "", 3), (2, None, 4), (8, "red", 5)], "doc_id long, text string, ord long")
    q = spark.createDataFrame([(1, "red"), (2, "van red"), (3, "")], "query_id long, text string")
    index = postings.build(docs, new_path(spark, "index"))
    for k in (1, 3, 10):
        assert rows(index.top_k(q, k)) == rows(bm25.top_k(docs, q, k))
    with pytest.raises(ValueError):
        index.top_k(q, 0)


def test_segments_add_up_and_a_replaced_one_counts_once(spark, monkeypatch):
    monkeypatch.setattr(postings, "FEW", 0)
    path = new_path(spark, "index")
    a, b = corpus(spark, 150, 1), corpus(spark, 90, 2, 150)
    q = queries(spark, a.union(b))
    for part, name in ((a, "a"), (b, "b"), (b, "b")):
        postings.add_segment(part, path, name, block=8)
    assert rows(postings.Postings(spark, path).top_k(q, 4)) == rows(bm25.top_k(a.union(b), q, 4))


def test_an_empty_corpus_and_no_index(spark):
    none = spark.createDataFrame([], "doc_id long, text string, ord long")
    q = spark.createDataFrame([(1, "red")], "query_id long, text string")
    assert postings.build(none, new_path(spark, "index")).top_k(q).count() == 0
    with pytest.raises(ValueError):
        postings.Postings(spark, new_path(spark, "nothing"))


def test_a_search_reads_no_text(spark):
    """The plan of a search reads the index alone, and of documents only ids and lengths."""
    at = new_path(spark, "corpus")
    corpus(spark, 40).write.parquet(at)
    docs = spark.read.parquet(at)
    index = postings.build(docs, new_path(spark, "index"))
    found = index.top_k(spark.createDataFrame([(1, "w1 w2")], "query_id int, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert at not in plan and "docs" in plan
