"""The index kept by document: what one edit embeds, deletions, and a crash before the manifest."""

import pytest

from tarnlight.operators import chunking, dense
from tarnlight.plans import runner
from tarnlight.sources.index_store import Store

DOCS = "doc_id string, text string, ord long"


def rows(df):
    return sorted((r.chunk_id, r.text, tuple(r.embedding)) for r in df.collect())


def test_only_changed_texts_are_embedded(spark, tmp_path):
    texts = {f"d{i}": f"some words {i} " * (300 if i == 3 else 2) for i in range(12)}
    frame = lambda t: spark.createDataFrame([(d, x, i) for i, (d, x) in enumerate(t.items())], DOCS)
    store, embedder = Store(spark, str(tmp_path / "index")), dense.Embedder()
    assert store.refresh(frame(texts), embedder) == 12 and store.refresh(frame(texts), embedder) == 0 and store.version() == 1
    texts["d3"] = "an edit " * 700
    del texts["d7"]
    texts["new"] = "one more"
    assert store.refresh(frame(texts), embedder) == 2
    assert spark.read.parquet(str(tmp_path / "index" / "chunks" / "2")).select("doc_id").distinct().count() == 2
    assert rows(store.read()) == rows(dense.build_index(frame(texts), embedder))
    texts["d7"] = "some words 7 " * 2  # its chunks are gone from the manifest, so it is embedded again
    assert store.refresh(frame(texts), embedder) == 1 and rows(store.read()) == rows(dense.build_index(frame(texts), embedder))


def test_a_crash_before_the_manifest_leaves_the_old_index(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([("a", "one", 0), ("b", "two", 1)], DOCS)
    more = docs.union(spark.createDataFrame([("c", "three", 2)], DOCS))
    store, embedder = Store(spark, str(tmp_path / "index")), dense.Embedder()
    store.refresh(docs, embedder)
    before = rows(store.read())

    def fail(self, rows, version):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", fail)
        with pytest.raises(RuntimeError):
            store.refresh(more, embedder)
    assert rows(store.read()) == before and store.version() == 1
    assert store.refresh(more, embedder) == 1 and len(rows(store.read())) == 3


def test_empty_corpora_null_texts_and_the_runner(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    store = Store(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        store.read()
    assert store.refresh(none, dense.Embedder()) == 0 and store.read().count() == 0
    docs = spark.createDataFrame([("a", None, 0), ("b", "two", 1), ("b", "two", 1)], DOCS)
    index = runner.cached_index(spark, docs, dense.Embedder(), str(tmp_path / "by"))
    assert [r.chunk_id for r in index.collect()] == ["b::0"] == [r.chunk_id for r in chunking.chunks(docs.distinct()).collect()]
