"""The text functions and the chunker by name, for ``spark.sql``."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from tarnlight.functions.text import SPACE, WORD

_TOKEN = re.compile(r"[^\s\x1c-\x1f\x85]+")


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


#: Name and parameters, type and body of each function; SQL's own expressions, which the optimizer sees through.
FUNCTIONS = {
    "bm25_words(t STRING)": ("ARRAY<STRING>", f"coalesce(regexp_extract_all(lower(t), {_literal(WORD)}, 0), array())"),
    "space_tokens(t STRING)": ("ARRAY<STRING>", f"coalesce(filter(split(t, {_literal(SPACE)}), x -> x <> ''), array())"),
    "keyword_overlap(q STRING, t STRING)": ("INT", "size(array_intersect(space_tokens(lower(q)), space_tokens(lower(t))))"),
    "overlap_score(q STRING, t STRING)": ("DOUBLE", "round(least(keyword_overlap(q, t) / greatest(size(space_tokens(q)), 1), 1.0D), 3)"),
    "answer_found(prediction STRING, truth STRING)": ("DOUBLE", "if(coalesce(contains(lower(trim(prediction)), lower(trim(truth))) AND trim(truth) <> '', false), 1.0D, 0.0D)"),
}


def windows(text: str | None, size: int, overlap: int) -> list[str]:
    """Windows of ``size`` tokens, ``overlap`` of them shared with the window before; of null, none."""
    if size is None or overlap is None or not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than the chunk size")
    tokens = _TOKEN.findall(text or "")
    return [" ".join(tokens[at : at + size]) for at in range(0, len(tokens), size - overlap)]


class ChunkDocument:
    """``chunk_document(text, size, overlap)``: ``(chunk_no, text)`` of one text, for LATERAL joins."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(windows(text, size, overlap))


class ChunkTable:
    """``chunk_table(TABLE(...))``: ``(doc_id, chunk_no, text)`` of a table with ``doc_id`` and ``text``, a batch at a time, in windows of 512 tokens that share 50."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        parts = [(d, i, w) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for i, w in enumerate(windows(t, 512, 50))]
        ids, numbers, texts = zip(*parts) if parts else ((), (), ())
        yield pa.table({"doc_id": pa.array(map(str, ids), pa.string()), "chunk_no": pa.array(numbers, pa.int32()), "text": pa.array(texts, pa.string())})


def register(spark: SparkSession) -> None:
    """Make ``bm25_words``, ``space_tokens``, ``keyword_overlap``, ``overlap_score``, ``answer_found`` and the table functions ``chunk_document`` and ``chunk_table`` known to SQL in a session.

    Functions of Arrow batches cannot stand in LATERAL, so there is one of each kind.
    """
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("chunk_document", udtf(ChunkDocument, returnType="chunk_no int, text string"))
    spark.udtf.register("chunk_table", arrow_udtf(ChunkTable, returnType="doc_id string, chunk_no int, text string"))
