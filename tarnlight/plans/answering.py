"""Retrieve, prompt, generate and score answers; and the needle stress test.

    python -m tarnlight.plans.answering answers --source <folder> --out <file>
    python -m tarnlight.plans.answering needles --source <file> --needles <file> --out <file>
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions.text import answer_found
from tarnlight.operators import answers, needles
from tarnlight.operators.generation import Decoding, Generator
from tarnlight.operators.lengths import contexts as token_contexts
from tarnlight.operators.metrics import ranked
from tarnlight.operators.retrievers import Okapi, Retriever
from tarnlight.plans import runner
from tarnlight.plans.settings import Settings, parse
from tarnlight.schemas import DEPTHS, LENGTHS, PASSAGES, Benchmark
from tarnlight.sources import readers, writers
from tarnlight.sources.scratch import kept

METRICS = ("answer_correctness", "context_precision", "faithfulness")


def answer(corpus: DataFrame, queries: DataFrame, generator: Generator | None = None, k: int = PASSAGES, template: str = answers.PROMPT, retriever: Retriever | None = None) -> DataFrame:
    """``(query_id, answer, retrieved_chunks)`` of every question; passages in the retriever's order."""
    run = (retriever or Okapi(corpus)).retrieve(queries, k)
    run = run if "rank" in run.columns else ranked(run)
    found = kept(answers.context(kept(run, "run"), corpus, k), "context")
    written = (generator or Generator()).generate(answers.prompts(found, queries, template))
    return written.join(found, "query_id", "left").select("query_id", "answer", F.col("chunks").alias("retrieved_chunks"))


def evaluate(data: Benchmark, generator: Generator | None = None, k: int = PASSAGES, retriever: Retriever | None = None, error_rate: float = 0.0) -> DataFrame:
    """Means of the answer metrics; the collection must have answers, which may be off by ``error_rate`` edits a character."""
    if data.answers is None:
        raise ValueError("the collection has no answers")
    got = answer(data.corpus, data.queries, generator, k, retriever=retriever).join(data.answers.withColumnRenamed("answer", "reference"), "query_id")
    rows = got.select(F.col("query_id").alias("question_id"), F.col("answer").alias("prediction"), "reference", F.transform("retrieved_chunks", lambda c: c["text"]).alias("contexts"))
    return answers.evaluate(rows, error_rate).select(*METRICS)


def contexts(haystack: DataFrame, needle: DataFrame, lengths: tuple[int, ...] = LENGTHS, depths: tuple[float, ...] = DEPTHS, tokenizer: str | Callable | None = None, model: str | None = None) -> DataFrame:
    """``(context_length, depth_percent, question, answer, needle, context)``: a context for every cell, haystack and needle.

    Lengths are in words between white space, or in the tokens of a tokenizer of
    ``lengths.TOKENIZERS`` (then with ``n_tokens``, the length that was reached).

    The grid is a list of literals, exploded in place; needles meet haystacks in
    an all-pairs join by definition, in which no side is broadcast by force.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(int(x)).alias("context_length"), F.lit(float(d)).alias("depth_percent")) for x in lengths for d in depths])).alias("cell")
    pairs = needle.withColumnRenamed("text", "needle").crossJoin(haystack.select(F.col("text").alias("haystack")))
    each = pairs.select("*", cells).select("needle", "question", "answer", "haystack", "cell.*")
    if tokenizer is not None:
        made = token_contexts(each, tokenizer, model)
        return made.select("context_length", "depth_percent", "question", "answer", "needle", "context", "n_tokens")
    return each.select("context_length", "depth_percent", "question", "answer", "needle", needles.sample(F.col("haystack"), F.col("needle"), F.col("context_length"), F.col("depth_percent")).alias("context"))


def sweep(haystack: DataFrame, needle: DataFrame, generator: Generator | None = None, lengths: tuple[int, ...] = LENGTHS, depths: tuple[float, ...] = DEPTHS, tokenizer: str | Callable | None = None, model: str | None = None, error_rate: float = 0.0) -> DataFrame:
    """``(context_length, depth_percent, answer, score)`` of every cell and needle."""
    prompt = F.concat(F.lit("Context:\n[1] "), "context", F.lit("\n\nQuestion: "), "question", F.lit("\nAnswer:"))
    # Contexts are made before the shuffle that spreads the cells, not inside the generator's input.
    made = contexts(haystack, needle, lengths, depths, tokenizer, model).select("context_length", "depth_percent", "answer", prompt.alias("prompt")).repartition("context_length", "depth_percent", "answer")
    written = (generator or Generator()).generate(made, out_col="given")
    return written.select("context_length", "depth_percent", F.col("given").alias("answer"), answer_found(F.col("given"), F.col("answer"), error_rate=error_rate).alias("score"))


def run(spark: SparkSession, task: str, settings: Settings) -> DataFrame:
    """The table of one of the two command lines, written to ``out`` if that is set."""
    generator = Generator(settings.generator, settings.generator_model, Decoding(settings.max_new_tokens, settings.temperature, settings.top_p))
    if task == "answers":
        data = readers.collection(spark, settings.source, settings.split)
        retriever = next(iter(runner.build(spark, data, settings).values()))
        table = evaluate(data, generator, settings.passages, retriever)
    elif task == "needles":
        table = sweep(readers.text_file(spark, settings.source), readers.needles(spark, settings.needles), generator)
    else:
        raise ValueError(f"unknown task: {task}")
    if settings.out:
        writers.csv_file(table, settings.out)
    return table


def parse_args(argv: list[str]) -> tuple[str, Settings]:
    task, rest = (argv[0], argv[1:]) if argv else ("", [])
    made = ["generator", "generator_model", "max_new_tokens", "temperature", "top_p", "out"]
    if task == "answers":
        return task, parse("Answer the questions of a collection and score the answers.", ["source", "split", "retrievers", "passages", "encoder", "encoder_model", *made], rest)
    if task == "needles":
        return task, parse("Hide facts in a text at every length and depth, and ask for them.", ["source", "needles", *made], rest)
    raise SystemExit("answers or needles?")


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), *parse_args(sys.argv[1:])).show(truncate=False)
