"""Readers: text folders, judged collections, results, indexes, needles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.functions.text import stem
from tarnlight.schemas import CORPUS, NEEDLES, Benchmark
from tarnlight.sources.lines import read as read_lines


def text_file(spark: SparkSession, path: str) -> DataFrame:
    """``(text)``: one row, the whole file, line ends as line feeds."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, text, ord)`` of the .txt and .md files right in a folder, by path.

    The number of files bounds the one window that numbers them by path.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{txt,md}", recursiveFileLookup=False)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    return named.select(stem(F.col("path")).alias("doc_id"), "text", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("ord"))


def in_memory(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """A corpus from texts by id, in their order."""
    return spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(texts.items())], CORPUS)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def in_file_order(raw: DataFrame, name: str = "ord") -> DataFrame:
    """``raw``, which a file source reads, with ``name``: ascending by file path and by line.

    Splits of files are numbered (a row for each), and rows inside their split.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the count of rows in the task
    place = [F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start")]
    splits = raw.select(*place).distinct().withColumn("__split", F.row_number().over(Window.orderBy("__path", "__start")) - 1)
    at = raw.select("*", *place, row.alias("__row")).join(splits, ["__path", "__start"])
    return at.select(*[F.col(f"`{c}`") for c in raw.columns], (F.shiftleft(F.col("__split").cast("long"), 33) + F.col("__row")).alias(name))


def collection(spark: SparkSession, folder: str, split: str = "test", python_source: bool = False) -> Benchmark:
    """A collection of corpus.jsonl, queries.jsonl, qrels/<split>.tsv and, if it is there, answers.jsonl; the last row of an id wins.

    With ``python_source`` lines are read by the data source of ``lines``, which
    knows their order from their places in the files.
    """

    def last(df: DataFrame, keys: list[str]) -> DataFrame:
        rest = [c for c in df.columns if c not in (*keys, "ord")]
        return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ord").alias("r"), F.min("ord").alias("ord")).select(*keys, "r.*", "ord")

    def lines(name: str, key: str, value: str = "text") -> DataFrame:
        fields, path = f"_id string, {value} string", f"{folder}/{name}.jsonl"
        raw = read_lines(spark, path, f"{fields}, ord long") if python_source else in_file_order(spark.read.schema(fields).json(path))
        return last(raw.withColumnRenamed("_id", key), [key])

    judged = in_file_order(spark.read.csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True)).toDF("query_id", "doc_id", "relevance", "ord")
    judged = last(judged.withColumn("relevance", F.col("relevance").cast("int")), ["query_id", "doc_id"]).drop("ord")
    answers = lines("answers", "query_id", "answer").drop("ord") if exists(spark, f"{folder}/answers.jsonl") else None
    return Benchmark(lines("corpus", "doc_id"), lines("queries", "query_id"), judged, answers)


def results(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The first of some places of a results table that exists, or None where there is none."""
    for path in paths:
        if exists(spark, path):
            return spark.read.csv(path, header=True, inferSchema=True)
    return None


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def needles(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(NEEDLES)
    return reader.csv(path, header=True, multiLine=True, escape='"') if path.endswith(".csv") else reader.json(path, multiLine=True)
