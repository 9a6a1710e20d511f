"""Split documents into overlapping windows of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tarnlight.functions import cuts


def windows(texts: pa.Array, size: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Place of the text, number of the window in it, and the window's tokens joined by spaces, some megabytes at a time."""
    tokens, many = cuts.tokens(texts)
    if not len(tokens):
        return
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), tokens), " ")[0].as_buffer()
    at = np.concatenate([[0], np.cumsum(pc.binary_length(tokens).to_numpy().astype(np.int64) + 1)])  # where tokens begin
    windows = -(-many // step)
    doc = np.repeat(np.arange(len(many)), windows)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    first = np.repeat(np.cumsum(many) - many, windows) + number * step
    begin, end = at[first], at[first + np.minimum(many[doc] - number * step, size)] - 1
    part = np.cumsum(end - begin) // cuts.SLICE_BYTES
    for rows in np.split(np.arange(len(doc)), np.flatnonzero(part[1:] != part[:-1]) + 1):
        text = [joined[a:b].to_pybytes() for a, b in zip(begin[rows].tolist(), end[rows].tolist())]
        yield doc[rows], number[rows], pa.array(text, pa.string())


def chunks(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """``(chunk_id, doc_id, chunk_no, text)``; a window starts every ``size - overlap`` tokens while any are left.

    Documents without tokens have no chunks.  Windows are cut from the bytes of
    a batch: in the JVM the tokens of a text, strings all, took most of the time.
    """
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("overlap must be at least 0 and smaller than the chunk size")
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("chunk_no", IntegerType()), StructField("text", StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in cuts.slices(whole, 1):
                for doc, number, text in windows(b.column(1), size, size - overlap):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(number, pa.int32()), text], names=schema.names)

    cut = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, schema)
    return cut.select(F.concat_ws("::", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"), "doc_id", "chunk_no", "text")
