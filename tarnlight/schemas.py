"""Tables that operators exchange, and the values that published results depend on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

CORPUS = "doc_id string, text string, ord long"
QUERIES = "query_id string, text string"  # and their place in the collection, ``ord``, where they are read from one
QRELS = "query_id string, doc_id string, relevance int"
RUN = "query_id string, doc_id string, score double"
CHUNK = "chunk_id string, doc_id string, chunk_no int, text string"
NEEDLES = "text string, question string, answer string"

#: Ranks at which results are scored.
CUTOFFS = (1, 3, 5, 10)
#: Passages in a prompt.
PASSAGES = 4
#: The grid of the stress test, in tokens and per cent.
LENGTHS = (1000, 2000, 4000, 8000, 16000)
DEPTHS = (0, 10, 25, 50, 75, 90, 100)


@dataclass
class Benchmark:
    """A judged collection: corpus, queries, judgments, and answers where it has them."""

    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame
    answers: DataFrame | None = None
