"""An index of embedded chunks that is kept document by document.

A folder has versions of ``chunks`` and of ``manifest(doc_id, th, th2, version)``:
which documents, by two hashes of their texts, are in the index, and which version
of the chunks holds theirs.  A change of the corpus embeds only texts that the
manifest does not have; documents that are gone leave the manifest.  A version
counts when its manifest is complete, which is written last: what a crash leaves
before that is not read, and is overwritten by the next attempt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.operators import dense
from tarnlight.sources import readers

KEY = ["doc_id", "th", "th2"]


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"th": F.xxhash64("text"), "th2": F.xxhash64(F.lit(1), F.col("text"))})


class Store:
    """The index of one encoder and chunk size in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int | None:
        """The newest version whose manifest is complete."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [int(n) for n in names if n.isdigit() and readers.exists(self.spark, f"{self.path}/manifest/{n}/_SUCCESS")]
        return max(done, default=None)

    def manifest(self) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.path}/manifest/{v}")

    def refresh(self, docs: DataFrame, embedder: dense.Embedder, size: int = 512, overlap: int = 50) -> int:
        """Bring the index to ``docs(doc_id, text)``; returns how many documents were embedded."""
        now, old = _hashed(docs.select("doc_id", "text")).dropDuplicates(KEY), self.manifest()
        new = now if old is None else now.join(old, KEY, "left_anti")
        many = new.count()
        if old is not None and not many and old.count() == now.count():
            return 0
        version = (self.version() or 0) + 1
        parts = embedder.embed(chunked(new, size, overlap))
        parts.write.mode("overwrite").parquet(f"{self.path}/chunks/{version}")
        rows = new.select(*KEY, F.lit(version).alias("version"))
        if old is not None:
            rows = rows.unionByName(old.join(now.select(*KEY), KEY, "left_semi"))
        self._commit(rows, version)
        return many

    def _commit(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/manifest/{version}")

    def read(self) -> DataFrame:
        """``(chunk_id, doc_id, chunk_no, text, embedding)`` of the documents that the index has now."""
        m = self.manifest()
        if m is None:
            raise ValueError(f"no index in {self.path}")
        out = None
        for v in sorted(r["version"] for r in m.select("version").distinct().collect()) or [self.version()]:  # a row for each version
            if readers.exists(self.spark, f"{self.path}/chunks/{v}/_SUCCESS"):
                one = self.spark.read.parquet(f"{self.path}/chunks/{v}").withColumn("version", F.lit(v))
                out = one if out is None else out.unionByName(one)
        return out.join(m, [*KEY, "version"], "left_semi").select("chunk_id", "doc_id", "chunk_no", "text", "embedding")


def chunked(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """The chunks of ``docs``, with the hashes of the texts they are from."""
    from tarnlight.operators.chunking import chunks

    named = docs.select(F.struct("doc_id", "th", "th2").alias("doc_id"), "text")
    of = chunks(named, size, overlap)
    key = F.concat_ws("::", F.col("doc_id.doc_id").cast("string"), F.col("chunk_no").cast("string"))
    return of.select(key.alias("chunk_id"), "doc_id.doc_id", "doc_id.th", "doc_id.th2", "chunk_no", "text")
