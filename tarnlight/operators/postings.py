"""An inverted index on disk for Okapi BM25, and a search that skips blocks.

An index is a folder of segments, which are only ever added: each holds
``documents(doc_id, ord, block, words)``, ``terms(term, df)`` and
``postings(part, term, block, most, least, docs)``.  A block is a fixed share of
a segment's documents, the same for all terms; a row of postings has the
documents of one block that hold one term, with how often (``tf``), and bounds
of that: the highest ``tf`` and the smallest number of words.  Nothing in a
segment depends on the others, so a new one changes no file, and the statistics
of the whole corpus (documents, mean length, document frequencies) are sums over
segments, made when an index is opened.

Search is MaxScore by blocks.  The bounds of a query's terms in a block add up
to the most that any document in it can score.  The ``k`` blocks that promise
most are scored first; the k-th best score found there is a threshold.  Blocks
that cannot reach it stay unread.  In the others, the terms of smallest bounds
that together stay below the threshold are common: a document with no other
term cannot reach it, so the other terms are scored first, and the long lists of
common ones are read only in blocks that hold a document that still can.  Bounds
are columns of their own, read without the lists, and texts are never read.
Where there are few blocks, planning costs more than it saves, and all lists of
a query's terms are scored at once; the result is the same.

All documents take part in a ranking, as in ``bm25``: those without a query term
score 0 and follow in corpus order.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.functions.text import words
from tarnlight.operators.bm25 import EPSILON, K1, B
from tarnlight.sources import readers
from tarnlight.sources.scratch import new_path

#: Documents in a block, about.
BLOCK = 64
#: An index of no more than so many times the blocks that are scored first is scored whole.
FEW = 100
#: Files of postings hold the terms of one of so many parts.
PARTS = 16


def add_segment(corpus: DataFrame, path: str, name: str | None = None, block: int = BLOCK) -> str:
    """Index a corpus ``(doc_id, text, ord)`` as one more segment; one of the same name is replaced.  Returns its name.

    The text of a document is read once; a document counts its own words before
    the shuffle by term.  A segment without its mark of success is not read.
    """
    spark = corpus.sparkSession
    name = name or uuid.uuid4().hex
    at = f"{path}/{name}"
    w = corpus.select("doc_id", "ord", words(F.col("text")).alias("w"))
    # A document's number of words goes with a null term, so that documents without any are counted.
    tf = w.select("doc_id", "ord", F.size("w").alias("words"), F.explode_outer(F.concat("w", F.array(F.lit(None).cast("string")))).alias("term"))
    made = new_path(spark, "tf")
    tf.groupBy("doc_id", "ord", "words", "term").agg(F.count("*").cast("int").alias("tf")).write.parquet(made)
    schema = corpus.select("doc_id", "ord").schema.add("words", "integer").add("term", "string").add("tf", "integer")
    tf = spark.read.schema(schema).parquet(made)
    n = tf.where("term IS NULL").count()
    of = F.pmod(F.xxhash64("doc_id", "ord"), F.lit(max(1, -(-n // block)))).cast("int")
    tf = tf.withColumn("block", of)
    tf.where("term IS NULL").select("doc_id", "ord", "block", "words").write.mode("overwrite").parquet(f"{at}/documents")
    lists = tf.where("term IS NOT NULL").groupBy("term", "block").agg(
        F.max("tf").alias("most"), F.min("words").alias("least"), F.collect_list(F.struct("doc_id", "ord", "words", "tf")).alias("docs")
    )
    lists = lists.select(_part().alias("part"), "term", "block", "most", "least", F.size("docs").alias("n"), "docs")
    # By ranges, so that a word of most documents is dealt to several files.
    lists.repartitionByRange("part", "term", "block").sortWithinPartitions("part", "term", "block").write.mode("overwrite").partitionBy("part").parquet(f"{at}/postings")
    back = spark.read.parquet(f"{at}/postings") if n else lists
    back.groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{at}/terms")
    return name


def _part() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")


def segments(spark: SparkSession, path: str) -> list[str]:
    """Paths of the segments that are complete."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []
    return [s for s in found if readers.exists(spark, f"{s}/terms/_SUCCESS")]


@dataclass
class Plan:
    """``met``: bounds of each term in each block; ``blocks`` in the order of their bounds; ``first`` scores; ``left`` to read, by term and block."""

    met: DataFrame
    blocks: DataFrame
    first: DataFrame
    left: DataFrame


class Postings:
    """An opened index.  The driver gets three numbers: documents ``n``, their mean length, and the mean idf."""

    def __init__(self, spark: SparkSession, path: str):
        found = segments(spark, path)
        if not found:
            raise ValueError(f"no index in {path}")
        self.documents = self._read(spark, found, "documents", None)
        ids = [f"{f.name} {f.dataType.simpleString()}" for f in self.documents.schema if f.name in ("doc_id", "ord")]
        listed = f"part int, term string, block int, most int, least int, n int, docs array<struct<{', '.join(x.replace(' ', ':') for x in ids)}, words:int, tf:int>>"
        self.postings = self._read(spark, found, "postings", listed)
        sums = self.documents.agg(F.count("*").alias("n"), F.sum("words").alias("words")).first()
        self.n, self.mean_length = sums["n"], (sums["words"] / sums["n"] if sums["n"] else 0.0)
        df = self._read(spark, found, "terms", "term string, df long")
        if len(found) > 1:
            df = df.drop("segment").groupBy("term").agg(F.sum("df").alias("df"))
        if len(found) > 1:
            at = new_path(spark, "terms")
            df.write.parquet(at)
            df = spark.read.schema("term string, df long").parquet(at)
        df = df.withColumn("raw", F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        self.mean_idf = df.agg(F.avg("raw")).first()[0] or 0.0
        self.terms = df.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * self.mean_idf)).otherwise(F.col("raw")).alias("idf"))

    @staticmethod
    def _read(spark: SparkSession, found: list[str], table: str, schema: str | None) -> DataFrame:
        """A table of all segments; ``segment`` numbers them, as blocks are a segment's own."""
        out = None
        for i, s in enumerate(found):
            one = (spark.read.schema(schema) if schema else spark.read).parquet(f"{s}/{table}").withColumn("segment", F.lit(i))
            out = one if out is None else out.unionByName(one)
        return out

    def part(self, tf: Column, length: Column) -> Column:
        """What a word adds to a score for each time a query has it."""
        relative = length / F.lit(float(self.mean_length or 1))
        return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * relative))

    def _asked(self, queries: DataFrame) -> DataFrame:
        asked = queries.select("query_id", F.explode(words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        return asked.join(self.terms, "term").withColumn("part", _part())

    def _all(self, queries: DataFrame) -> DataFrame:
        """``(query_id, doc_id, ord, score)`` of all documents that have a word of a query."""
        hit = self.postings.join(self._asked(queries), ["part", "term"]).select("query_id", "qtf", "idf", F.explode("docs").alias("d"))
        part = F.col("qtf") * self.part(F.col("d.tf"), F.col("d.words"))
        return hit.groupBy("query_id", F.col("d.doc_id").alias("doc_id"), F.col("d.ord").alias("ord")).agg(F.sum(part).alias("score"))

    def _found(self, wanted: DataFrame) -> DataFrame:
        """``(query_id, segment, block, doc_id, ord, part)`` of some ``(query_id, term, part, segment, block, qtf, idf)``."""
        hit = self.postings.join(wanted, ["part", "term", "segment", "block"]).select("query_id", "segment", "block", "qtf", "idf", F.explode("docs").alias("d"))
        part = F.col("qtf") * self.part(F.col("d.tf"), F.col("d.words"))
        return hit.select("query_id", "segment", "block", F.col("d.doc_id").alias("doc_id"), F.col("d.ord").alias("ord"), part.alias("part"))

    def plan(self, queries: DataFrame, k: int) -> Plan:
        """Bounds, the scores of the blocks that promise most, and what is left to read after them."""
        spark, key = queries.sparkSession, ["query_id", "segment", "block"]

        def kept(df: DataFrame, name: str) -> DataFrame:
            at = new_path(spark, name)
            df.write.parquet(at)
            return spark.read.schema(df.schema).parquet(at)

        best = F.col("qtf") * F.greatest(self.part(F.col("most"), F.col("least")), F.lit(0.0))
        met = self.postings.select("part", "term", "segment", "block", "most", "least", "n").join(self._asked(queries), ["part", "term"])
        met = kept(met.select(*key, "part", "term", "qtf", "idf", "n", best.alias("bound")), "bounds")
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block"))
        blocks = kept(met.groupBy(*key).agg(F.sum("bound").alias("bound")).withColumn("nth", nth), "blocks")
        first = met.drop("bound").join(blocks.where(F.col("nth") <= k).select(*key), key)
        first = kept(self._found(first).groupBy("query_id", "doc_id", "ord").agg(F.sum("part").alias("score")), "first")
        at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        # Scores are rounded to six places, so what is just below the threshold can tie with it.
        least = first.select("query_id", "score", at.alias("at")).where(F.col("at") == k).select("query_id", (F.col("score") - 2e-6).alias("least_score"))
        least = queries.select("query_id").distinct().join(least, "query_id", "left").withColumn("least_score", F.coalesce("least_score", F.lit(0.0) if self.mean_idf >= 0 else F.lit(float("-inf"))))
        upto = F.sum("best").over(Window.partitionBy("query_id").orderBy("best", "term"))
        terms = met.groupBy("query_id", "term").agg(F.max("bound").alias("best")).withColumn("upto", upto).join(least, "query_id")
        terms = terms.select("query_id", "term", "least_score", (F.col("upto") < F.col("least_score")).alias("common"))
        left = blocks.where(F.col("nth") > k).select(*key, F.col("bound").alias("in_block"))
        left = kept(met.join(left, key).join(terms, ["query_id", "term"]).where(F.col("in_block") >= F.col("least_score")), "left")
        return Plan(met, blocks, first, left)

    def _skipping(self, plan: Plan) -> tuple[DataFrame, DataFrame]:
        """Scores of the documents that can be among the best, and the blocks of terms read after the first ones.

        Documents with none but common words cannot reach the threshold.  Those
        that can, with all the common words of their block on top, are completed.
        """
        key = ["query_id", "segment", "block"]
        rare, common = plan.left.where("NOT common"), plan.left.where("common")
        slack = common.groupBy(*key).agg(F.sum("bound").alias("slack"))
        partly = self._found(rare).groupBy(*key, "doc_id", "ord").agg(F.sum("part").alias("part"))
        limit = plan.left.select(*key, "least_score").distinct().join(slack, key, "left")
        can = partly.join(limit, key).where(F.col("part") + F.coalesce("slack", F.lit(0.0)) >= F.col("least_score")).select(*partly.columns)
        at = new_path(can.sparkSession, "able")
        can.write.parquet(at)
        can = can.sparkSession.read.schema(can.schema).parquet(at)
        needed = common.join(can.select(*key).distinct(), key, "left_semi")
        more = self._found(needed).join(can.select(*key, "doc_id", "ord"), [*key, "doc_id", "ord"], "left_semi")
        total = can.union(more.select(*can.columns)).groupBy("query_id", "doc_id", "ord").agg(F.sum("part").alias("score"))
        return plan.first.union(total), rare.select("query_id", "n").union(needed.select("query_id", "n"))

    def top_k(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """``(query_id, rank, doc_id, score)``; equal scores by corpus order (``ord``); queries without words have no rows."""
        if k < 1:
            raise ValueError("k must be at least 1")
        scores = self._all(queries) if self.n <= FEW * k * BLOCK else self._skipping(self.plan(queries, k))[0]
        some = self.documents.select("doc_id", "ord")
        if self.mean_idf >= 0:  # matches score above 0, so the first documents hold enough of those that score 0
            some = some.orderBy("ord").limit(2 * k)
        none = queries.where(F.size(words(F.col("text"))) > 0).select("query_id").crossJoin(some).withColumn("score", F.lit(0.0))
        every = scores.union(none).groupBy("query_id", "doc_id", "ord").agg(F.round(F.sum("score"), 6).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
        return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

    def skipped(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """``(query_id, lists, postings, lists_read, postings_read)``: blocks of terms and postings that a query has, and those that its search reads."""
        plan, key = self.plan(queries, k), ["query_id", "segment", "block"]
        begun = plan.met.join(plan.blocks.where(F.col("nth") <= k).select(*key), key).select("query_id", "n")
        read = begun.union(self._skipping(plan)[1]).groupBy("query_id").agg(F.count("*").alias("lists_read"), F.sum("n").alias("postings_read"))
        return plan.met.groupBy("query_id").agg(F.count("*").alias("lists"), F.sum("n").alias("postings")).join(read, "query_id")


def build(corpus: DataFrame, path: str, block: int = BLOCK) -> Postings:
    """An index of one segment at a new path, opened."""
    add_segment(corpus, path, "0", block)
    return Postings(corpus.sparkSession, path)
