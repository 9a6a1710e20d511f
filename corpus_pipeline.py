"""A corpus pipeline of five operators of tarnlight.llm, each stage over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlight.llm import bpe, lines, mixing, neardup, toxicity
from tarnlight.llm.common import stored, table
from tarnlight.llm.queries import byte_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learnt from ``labels`` scores below 0.5."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts; every document stays."""
    return lines.dedup(docs)


def drop_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times."""
    return mixing.mixed(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the texts decoded from them."""
    return bpe.round_trip(docs, byte_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dups", drop_near_dups),
    ("source_mix", mix_sources),
    ("bpe", encode_bpe),
]

#: The toxicity model and the tokenizer have no SQL; tests hold each stage against SQL, the library or a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
