"""Judged collections as a data source of Spark: ``spark.read.format("collection_lines")``.

Files of one JSON object a line are cut into ranges of bytes, a task each, which
begin at the first line that starts inside them.  Only the fields of the schema
that is asked for are kept.  A column ``ord`` numbers lines by their file, in the
order of paths, and their first byte, so the order of a collection needs no pass
over the others: ``ord`` of the last row of an id is the greatest.

Files are opened by Python (pyarrow's file systems: local folders, HDFS, S3,
...).  A store that only Spark can read is for ``readers.collection``, which
reads the same rows with Spark's own readers.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bits of ``ord`` that hold the place in a file; the rest number the files.
PLACE = 42
ROWS = 4096


@dataclass
class Range(InputPartition):
    path: str
    number: int
    start: int
    end: int


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class LinesReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.base = schema, options["path"]
        self.size = int(options.get("rangebytes", options.get("rangeBytes", 64_000_000)))

    def partitions(self) -> list[Range]:
        store, path = _store(self.base)
        about = store.get_file_info(path)
        if about.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.base)
        files = [about] if about.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(path))
        files = sorted((f for f in files if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        return [Range(f.path, i, at, min(at + self.size, f.size)) for i, f in enumerate(files) for at in range(0, f.size, self.size)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file has a byte
            return
        store, _ = _store(self.base)
        names, kinds = self.schema.names, to_arrow_schema(self.schema)
        rows: list[tuple] = []
        with io.BufferedReader(store.open_input_file(part.path), 1 << 20) as f:
            f.seek(max(part.start - 1, 0))
            at = part.start
            if part.start:  # the line that the byte before is in belongs to the range before
                at = part.start - 1 + len(f.readline())
            while at < part.end and (line := f.readline()):
                if line.strip():
                    row = json.loads(line)
                    row["ord"] = part.number << PLACE | at
                    rows.append(tuple(row.get(n) for n in names))
                at += len(line)
                if len(rows) == ROWS:
                    yield _batch(rows, kinds)
                    rows = []
        if rows:
            yield _batch(rows, kinds)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)


class CollectionLines(DataSource):
    """Options: the path, a file or a folder, and ``rangeBytes``, 64,000,000 by default."""

    @classmethod
    def name(cls) -> str:
        return "collection_lines"

    def schema(self) -> str:
        return "_id string, text string, ord long"

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(schema, dict(self.options))


def read(spark: SparkSession, path: str, schema: str, range_bytes: int | None = None) -> DataFrame:
    """The fields of ``schema`` of a file or folder of lines; ``ord long`` among them is the place of a line."""
    spark.dataSource.register(CollectionLines)
    reader = spark.read.format("collection_lines").schema(schema)
    return (reader.option("rangeBytes", range_bytes) if range_bytes else reader).load(path)
