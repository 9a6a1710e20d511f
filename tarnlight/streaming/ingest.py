"""Index new text files as they arrive.

Each micro-batch is the batch plan over its new files and is written under its
own number: a folder of chunks, or a segment of postings.  A batch that is
replayed after a failure overwrites what it wrote before, so each file counts
once.  Statistics that later batches change (documents, mean length, document
frequencies) are state of the index, not of a batch: every segment has its own
part of them, and they are added up when the index is opened.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.functions.text import stem
from tarnlight.operators import postings
from tarnlight.operators.dense import Embedder, build_index

#: Files of a micro-batch at most; they are numbered in one window.
FILES = 10_000


def documents(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """``(path, doc_id, text)`` of the .txt and .md files of a folder, as a stream."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.{txt,md}").option("maxFilesPerTrigger", files).load(folder)
    path = F.col("_metadata.file_path")
    return raw.select(path.alias("path"), stem(path).alias("doc_id"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def write_chunks(batch: DataFrame, number: int, index_path: str, embedder: Embedder) -> None:
    """The chunks of a batch under its number, in place of what was there."""
    build_index(batch.drop("path"), embedder).write.mode("overwrite").parquet(f"{index_path}/batch={number}")


def write_postings(batch: DataFrame, number: int, index_path: str) -> None:
    """A batch as the segment of its number; documents follow those of earlier batches, by path."""
    place = F.row_number().over(Window.orderBy("path")) - 1
    corpus = batch.select("doc_id", "text", (F.lit(number).cast("long") * (1 << 40) + place).alias("ord"))
    postings.add_segment(corpus, index_path, f"batch-{number:012d}")


def _started(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, folder: str, index_path: str, checkpoint: str, embedder: Embedder | None = None, files: int = FILES):
    """A query that adds the chunks of new files to a Parquet index and stops when all are read."""
    return _started(documents(spark, folder, files), lambda batch, n: write_chunks(batch, n, index_path, embedder or Embedder()), checkpoint)


def ingest_postings(spark: SparkSession, folder: str, index_path: str, checkpoint: str, files: int = FILES):
    """A query that adds new files to an inverted index and stops when all are read."""
    return _started(documents(spark, folder, files), lambda batch, n: write_postings(batch, n, index_path), checkpoint)
