"""Approximate answers against the edit table, and contexts of exact lengths against the tokenizers themselves."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnlight.functions import fuzzy
from tarnlight.functions.text import answer_found
from tarnlight.operators import answers, lengths, needles
from tarnlight.plans import answering


def table(text: str, pattern: str) -> int:
    """Sellers' table, cell by cell."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[i - 1] + 1))
        row, best = new, min(best, new[-1])
    return best


@settings(max_examples=400, deadline=None)
@given(st.text("abc é", max_size=40), st.text("abc é", max_size=14))
def test_errors_against_the_table(text, pattern):
    assert fuzzy.least_errors(text, pattern) == table(text, pattern)


def test_errors_of_long_patterns():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    for _ in range(20):
        pattern = word(150)
        text = word(100) + "".join(c for c in pattern if rng.random() > 0.1) + word(80)
        assert fuzzy.least_errors(text, pattern) == table(text, pattern)


def test_found_columns_rates_ties_and_empty_truths(spark):
    rows = [("The key is made of bras", "made of brass"), ("x", "BRASS "), ("  made OF brass!", " Made of Brass"), ("anything", ""), ("anything", "  "), (None, "a"), ("a", None), ("", "ab"), ("abcdefghij", "abXdefghij")]
    df = spark.createDataFrame(rows, "p string, t string")
    got = df.select(fuzzy.errors(F.col("p"), F.col("t")).alias("e"), fuzzy.found(F.col("p"), F.col("t"), 0.1).alias("f"), answer_found(F.col("p"), F.col("t")).alias("exact"), answer_found(F.col("p"), F.col("t"), error_rate=0.1).alias("near")).collect()
    assert [r.e for r in got] == [1, 5, 0, None, None, None, None, 2, 1]
    assert [r.f for r in got] == [r.near for r in got] == [1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    assert [r.exact for r in got] == [0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        fuzzy.found(F.col("p"), F.col("t"), 1.0)
    some = spark.createDataFrame([("q", "bras key", "brass key", ["a bras key", "no", None]), ("r", "x", "", None)], "question_id string, prediction string, reference string, contexts array<string>")
    assert answers.evaluate(some, error_rate=0.2).first().asDict() == {"answer_correctness": 0.5, "context_precision": 0.166667, "faithfulness": 0.5}


def test_placing_equals_the_column_expression(spark):
    rng = random.Random(3)
    hay = ["".join(rng.choice(["a", "bc", " ", ". ", "! ", "\n", "é"]) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["w " * 30, "x", "One a. Two b."]
    rows = [(h.strip(" "), "N.", float(p)) for h in hay for p in (0, 30, 50, 100) if h.strip(" ")]
    df = spark.createDataFrame(rows, "h string, n string, p double").select("*", needles.inject(F.col("h"), F.col("n"), F.col("p")).alias("x"))
    for r in df.collect():
        assert lengths.place(r.h, r.n, r.p) == r.x, (r.h, r.p)


def test_contexts_have_the_asked_length_in_the_tokens_of_a_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy(F.desc("n_chars")).limit(2).select(F.col("text").alias("haystack"))
    needle = spark.createDataFrame([("The hidden word is lantern.", "Which?", "lantern"), ("Ünïcode – 日本 facts!", "What?", "facts")], "text string, question string, answer string")
    made = answering.contexts(text.withColumnRenamed("haystack", "text"), needle, (60, 400, 3000), (0, 50, 100), tokenizer="tokenizers", model=file).collect()
    t = Tokenizer.from_file(file)
    assert len(made) == 36
    for r in made:
        assert len(t.encode(r.context, add_special_tokens=False).ids) == r.n_tokens == r.context_length and r.needle in r.context
    with pytest.raises(ValueError):
        answering.contexts(text.withColumnRenamed("haystack", "text"), needle, tokenizer="none")


def test_space_tokens_give_the_contexts_of_the_column_expression(spark):
    hay = spark.createDataFrame([("One two three. Four five! Six seven eight nine ten",), ("word",), ("",)], "text string")
    needle = spark.createDataFrame([("The key is brass.", "q", "brass")], "text string, question string, answer string")
    row = lambda df: sorted((r.context_length, r.depth_percent, r.context) for r in df.collect())
    assert row(answering.contexts(hay, needle, (3, 9, 40), (0, 25, 100), tokenizer="space")) == row(answering.contexts(hay, needle, (3, 9, 40), (0, 25, 100)))
    got = answering.contexts(hay, needle, (40,), (50,), tokenizer=lambda model: lambda t: [(i, i + 1) for i in range(len(t))]).collect()
    assert {r.n_tokens for r in got if len(r.context) > 17} == {40}
