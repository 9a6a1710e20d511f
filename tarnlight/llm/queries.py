"""The queries of this subpackage: one ``opN_<name>`` for each operator, and ``pipeline``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm import bpe, fingerprints, html, importance, lines, mixing, neardup, passages, substrings, token_store, toxicity, vectors, whitening
from tarnlight.llm.common import table


def byte_bpe() -> str:
    """Default place of the public byte-level BPE file; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup(docs, report=True).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.scratch_path(spark)
    token_store.write_ids(table(spark, sf_dir, "documents"), byte_bpe(), path)
    return token_store.digests(spark, path)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_dups(table(spark, sf_dir, "embeddings"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), byte_bpe())


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.draws(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_token_store, op3_toxicity, op4_fingerprints, op5_source_mix, op6_vector_dups, op7_main_text, op8_repeated_bytes, op9_near_dups, op10_bpe, op11_importance, op12_passages, op13_whitening, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": lines.SQL, "op5_source_mix": mixing.SQL, "op6_vector_dups": vectors.SQL, "op9_near_dups": neardup.SQL, "op12_passages": passages.SQL}
