"""The functions by their SQL names against the column expressions."""

import pytest
from pyspark.sql import functions as F

from tarnlight.functions import sql
from tarnlight.functions import text as T
from tarnlight.operators import answers, chunking, dense

TEXTS = ["Red  Apple_pie, red²", None, "", " \x1c ", "Ünï code? CODE", "a b c d e f g"]


def test_functions(spark):
    sql.register(spark)
    sql.register(spark)  # again is no error
    rows = [(a, b) for a in TEXTS for b in TEXTS]
    spark.createDataFrame(rows, "q string, t string").createOrReplaceTempView("pairs")
    q, t = F.col("q"), F.col("t")
    want = spark.table("pairs").select(T.words(t), T.tokens(t), T.keyword_overlap(q, t), T.overlap_score(q, t), T.answer_found(t, q)).collect()
    got = spark.sql("SELECT bm25_words(t), space_tokens(t), keyword_overlap(q, t), overlap_score(q, t), answer_found(t, q) FROM pairs").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_both_table_functions_chunk_like_the_expression(spark):
    sql.register(spark)
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate([*TEXTS, "w " * 1100, "x y " * 231])], "doc_id string, text string")
    docs.createOrReplaceTempView("docs")
    want = sorted((r.doc_id, r.chunk_no, r.text) for r in chunking.chunks(docs).collect())
    lateral = spark.sql("SELECT doc_id, c.chunk_no, c.text FROM docs, LATERAL chunk_document(docs.text, 512, 50) c").collect()
    batches = spark.sql("SELECT * FROM chunk_table(TABLE(SELECT doc_id, text FROM docs))").collect()
    assert sorted(map(tuple, lateral)) == want == sorted(map(tuple, batches))
    with pytest.raises(Exception, match="overlap"):
        spark.sql("SELECT c.* FROM docs, LATERAL chunk_document(docs.text, 5, 5) c").collect()


def test_spans_and_citations_by_vectors(spark):
    text = "The key is brass.  It is old! Fish\nswim. Nothing"
    got = spark.range(1).select(answers.spans(F.lit(text)).alias("s")).first().s
    assert [(text[s.start : s.end], s.answer_span) for s in got] == [(x, x) for x in ("The key is brass.", "It is old!", "Fish\nswim.", "Nothing")]
    a = spark.createDataFrame([("q", text), ("r", None), ("s", "")], "query_id string, answer string")
    c = spark.createDataFrame([("q", "c2", "the key is brass."), ("q", "c1", "The KEY is brass."), ("q", "c3", "fish swim."), ("r", "c3", "fish swim.")], "query_id string, chunk_id string, text string")
    cited = answers.citations_by_vectors(a, c, dense.Embedder(), 0.9).orderBy("span_no").collect()
    assert [(r.query_id, r.span_no, r.source_chunk_id, r.score) for r in cited] == [("q", 0, "c1", 1.0), ("q", 2, "c3", 1.0)]
