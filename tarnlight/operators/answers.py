"""Prompts, rule-based answers, answer quality and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.fuzzy import share_found
from tarnlight.functions.text import answer_found, containment, sentences
from tarnlight.functions.vector import inner
from tarnlight.operators.dense import Embedder

#: The default prompt.
PROMPT = "Answer the question using only the context below. If the answer is not contained in the context, say you don't know.\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer:"
#: Words that choose an answer, in order; the first rule with a word in the question wins.
RULES = [
    ("launch", ["secret", "code", "launch", "nightingale"]),
    ("finance", ["revenue", "financial", "q4", "margin", "profit"]),
    ("security", ["security", "audit", "vulnerability"]),
    ("model", ["ml", "machine learning", "accuracy", "embedding", "model"]),
    ("people", ["satisfaction", "employee", "survey", "hr"]),
]
NOT_FOUND = "not found"


def context(run: DataFrame, corpus: DataFrame, k: int = 4) -> DataFrame:
    """``(query_id, chunks)``: the first ``k`` texts of each query, by rank; bounded by ``k``."""
    top = run.where(F.col("rank") <= k).join(corpus.select("doc_id", "text"), "doc_id")
    return top.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "text", "score"))).alias("chunks"))


def prompts(found: DataFrame, queries: DataFrame, template: str = PROMPT) -> DataFrame:
    """``(query_id, prompt)``: numbered passages in a template; braces in the data stay as they are."""
    listed = F.array_join(F.transform(F.col("chunks"), lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["text"])), "\n\n")
    both = queries.join(found, "query_id", "left").withColumn("context", F.coalesce(listed, F.lit("")))
    parts: list[Column] = []
    rest = template
    for name in ("context", "question"):
        before, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(before), F.col("context") if name == "context" else F.col("text")]
    return both.select("query_id", F.concat(*parts, F.lit(rest)).alias("prompt"))


def rule_answer(question: Column, first_doc: Column, rules: list[tuple[str, list[str]]] | None = None) -> Column:
    """The answer of the first rule one of whose words is in the question; without any document, "not found"."""
    q = F.lower(question)
    out = F.when(first_doc.isNull(), F.lit(NOT_FOUND))
    for answer, words in rules or RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(q, F.lit(w))
        out = out.when(hit, F.lit(answer))
    return out.otherwise(F.concat(F.lit("see "), first_doc.cast("string")))


def context_precision(chunks: Column, truth: Column) -> Column:
    """Share of the chunks that hold the truth; a lexical stand-in for a judged metric."""
    hits = F.size(F.filter(chunks, lambda c: answer_found(c, truth) == 1.0))
    return F.coalesce(F.try_divide(hits, F.size(chunks)), F.lit(0.0))


def evaluate(rows: DataFrame, error_rate: float = 0.0) -> DataFrame:
    """Means over ``(question_id, prediction, reference, contexts)``: correctness, context precision, faithfulness.

    With an ``error_rate`` the first two let a reference be off by so many edits for each of its characters.
    """
    shares = share_found(F.col("contexts"), F.col("reference"), error_rate) if error_rate else context_precision(F.col("contexts"), F.col("reference"))
    each = rows.select(
        answer_found(F.col("prediction"), F.col("reference"), error_rate=error_rate).alias("answer_correctness"),
        shares.alias("context_precision"),
        containment(F.col("prediction"), F.array_join("contexts", " ")).alias("faithfulness"),
    )
    return each.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in each.columns])


def citations(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, span_no, answer_span, source_chunk_id, score)``: the chunk that holds most of each sentence's words.

    ``answers(query_id, answer)``, ``chunks(query_id, chunk_id, text)``; spans without a shared word are not cited.
    """
    spans = answers.select("query_id", F.posexplode(sentences(F.col("answer"))).alias("span_no", "answer_span"))
    met = spans.join(chunks, "query_id").withColumn("score", F.round(containment(F.col("answer_span"), F.col("text")), 6)).where("score > 0")
    best = F.row_number().over(Window.partitionBy("query_id", "span_no").orderBy(F.desc("score"), "chunk_id"))
    return met.withColumn("nth", best).where("nth = 1").select("query_id", "span_no", "answer_span", F.col("chunk_id").alias("source_chunk_id"), "score")


def spans(answer: Column) -> Column:
    """Sentences of an answer with the places of their first character and behind their last one, from 0."""
    parts = F.split(F.regexp_replace(answer, r"([.!?])(\s+)", "$1\u0001$2\u0001"), "\u0001")

    def placed(p: Column, i: Column) -> Column:
        start = F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x))
        return F.struct(start.alias("start"), (start + F.length(p)).alias("end"), p.alias("answer_span"), (i % 2 == 0).alias("own"))

    return F.filter(F.transform(parts, placed), lambda p: p["own"] & (F.trim(p["answer_span"]) != ""))


def citations_by_vectors(answers: DataFrame, chunks: DataFrame, embedder: Embedder, least: float = 0.1) -> DataFrame:
    """``(query_id, span_no, start, end, answer_span, source_chunk_id, score)``: the chunk whose vector is nearest to each sentence's.

    ``answers(query_id, answer)``, ``chunks(query_id, chunk_id, text)``; the score
    is the inner product of unit vectors to four places, equal ones go to the
    smaller chunk id, and sentences without a chunk of ``least`` are not cited.
    """
    own = answers.select("query_id", F.posexplode(spans(F.col("answer"))).alias("span_no", "s")).select("query_id", "span_no", "s.start", "s.end", "s.answer_span")
    own = embedder.embed(own, "answer_span", "v")
    texts = embedder.embed(chunks.select("chunk_id", "text").distinct(), "text", "w").select("chunk_id", "w")
    met = own.join(chunks.select("query_id", "chunk_id").distinct(), "query_id").join(texts, "chunk_id")
    met = met.withColumn("score", F.round(inner(F.col("v"), F.col("w")), 4)).where(F.col("score") >= least)
    best = F.row_number().over(Window.partitionBy("query_id", "span_no").orderBy(F.desc("score"), "chunk_id"))
    return met.withColumn("nth", best).where("nth = 1").select("query_id", "span_no", "start", "end", "answer_span", F.col("chunk_id").alias("source_chunk_id"), "score")
