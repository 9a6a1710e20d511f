"""A sample of the catalogue against its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [
    "scan_documents", "chunk_documents", "bm25_topk", "bm25_term_stats", "keyword_overlap_topk", "dense_topk", "cells_topk", "text_dir_scan", "pivot_mean", "niah_grid", "mock_answer_rules",
    "rag_answers", "rag_evaluation", "first_query_results", "fuzzy_answers", "citations_by_embedding", "chunks_in_sql", "functions_in_sql", "index_refresh", "collection_lines_scan", "needle_files",
])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "events", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    expected = con.sql(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*sorted(got.columns)).collect()))) == sorted(map(repr, expected))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_one_index_for_each_table_and_application(spark):
    from tarnlight.plans import catalog

    assert catalog.index_of(spark, SF) is catalog.index_of(spark, SF)
    assert catalog.index_of(spark, SF) is not catalog.index_of(spark, "/root/testdata/sf0.01")
