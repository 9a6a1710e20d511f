"""Mix sources to target weights by weighted fair queueing (operator 5).

DataFrame functions only.  Documents of a source are shuffled by a hash of
their id.  The finish time of a copy is the number of words its source has
given up to and with it, divided by the source's target; the copies of all
sources are taken by ascending finish time until the budget, the words of all
documents, is spent.

Targets: the sources, in code point order with null last, weigh 5, 2, 1, 5, 2,
1, ...; they share the budget by weight, but none gets more than ``epochs``
times its own words, and the excess goes to the others by weight.

Scale: running sums over a source (a third of all rows may be of one source)
and over the whole mix are made in two steps, sums of about sqrt(rows) buckets
of the shuffled order and then windows inside a bucket, so that no task holds a
source or the mix.  Only one row for each source and bucket meets in a window.

Null and blank texts have 0 words and take none; a null source is a source of
its own; a null id counts as the text "null"; equal rows share one fate.  Long
texts count by their words only; an empty table gives an empty mix.  Other
columns are not looked at; ``mixed`` returns those of its input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.llm.common import free, stored

#: Fixed value: a word is a run of characters outside this class.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """``(skey, source_size, target)`` from ``(skey, source_size)``; one row for each source.

    Sources by ascending ratio of cap to weight: a source is held at its cap
    exactly if its cap is no more than its share of what those before it leave.
    """
    name, ratio = Window.orderBy("skey"), Window.orderBy("r", "skey")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("skey", "source_size", weight.cast("long").alias("w")).withColumn("cap", F.col("source_size") * epochs)
    s = s.withColumn("r", F.col("cap").cast("double") / F.col("w"))
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    s = s.withColumn("level", left.cast("double") / rest)
    level = F.max(F.when(F.col("r") > F.col("level"), F.col("level"))).over(every)
    target = F.when(F.col("r") <= F.col("level"), F.col("cap").cast("double")).otherwise(level * F.col("w"))
    return s.select("skey", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, copies)`` of every row."""
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("v"), F.col(source_col)), F.lit("w")).alias("skey"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("key"),
    )
    base = stored(base, "mix")
    rows = base.count()
    buckets = max(16, int(rows**0.5))
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * buckets / 2.0**32).alias("bucket")
    base = base.withColumn("bucket", at)
    sums = base.groupBy("skey", "bucket").agg(F.sum("size").alias("n"))
    shares = targets(sums.groupBy("skey").agg(F.sum("n").alias("source_size")), weights, epochs)
    earlier = sums.select("skey", "bucket", (F.sum("n").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("n")).alias("earlier"))
    inside = F.sum("size").over(Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    placed = base.withColumn("inside", inside).join(earlier, ["skey", "bucket"]).join(shares, "skey").withColumn("given", F.col("earlier") + F.col("inside")).drop("bucket", "inside", "earlier")
    placed = stored(placed, "mix")

    def finish(epoch: int | Column) -> Column:
        return (F.col("given") + F.col("source_size") * epoch).cast("double") / F.col("target")

    def place(epoch: int | Column) -> Column:
        return F.struct(finish(epoch).alias("f"), F.col("skey").alias("s"), F.lit(epoch).cast("int").alias("e") if isinstance(epoch, int) else epoch.cast("int").alias("e"), F.col("key").alias("k"), F.coalesce("doc_id", F.lit(-(2**63))).alias("d"))

    # The bucket of finish times in which the budget ends, then the last place inside it.
    copies = placed.where("target > 0").select("size", F.explode(F.array(*[place(e) for e in range(epochs)])).alias("p"))
    copies = copies.withColumn("b", F.least(F.floor(F.col("p.f") * buckets), F.lit(4 * buckets)))
    per = copies.groupBy("b").agg(F.sum("size").alias("n"))
    budget = base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget")).first()["budget"]
    running = per.select("b", F.sum("n").over(Window.orderBy("b")).alias("upto"), "n")
    last = running.where(F.col("upto") > budget).orderBy("b").select("b", (F.col("upto") - F.col("n")).alias("before")).first()
    if last is None:  # everything fits
        cut = copies.agg(F.max("p").alias("p")).first()["p"]
    else:
        order = Window.orderBy("p").rangeBetween(Window.unboundedPreceding, 0)
        near = copies.where(F.col("b") == last["b"]).withColumn("upto", F.sum("size").over(order) + last["before"])
        cut = near.where(F.col("upto") <= budget).agg(F.max("p").alias("p")).first()["p"]
        cut = cut or copies.where(F.col("b") < last["b"]).agg(F.max("p").alias("p")).first()["p"]
    if cut is None:
        n = F.lit(0)
    else:
        end = F.struct(F.lit(cut["f"]).alias("f"), F.lit(cut["s"]).alias("s"), F.lit(cut["e"]).cast("int").alias("e"), F.lit(cut["k"]).alias("k"), F.lit(cut["d"]).cast("long").alias("d"))
        n = sum((F.when((F.col("target") > 0) & (place(e) <= end), 1).otherwise(0) for e in range(1, epochs)), F.when((F.col("target") > 0) & (place(0) <= end), 1).otherwise(0))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * n).alias("taken"), n.cast("int").alias("copies"), "key")


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns unchanged."""
    key, n = free(docs, "__id"), free(docs, "__copies")
    got = mix(docs, id_col=id_col, **options).where("copies > 0").groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(n))
    joined = docs.join(got, docs[id_col].cast("long").eqNullSafe(got[key])).withColumn(free(docs, "__copy"), F.explode(F.sequence(F.lit(1), got[n])))
    return joined.select(*[docs[c] for c in docs.columns])


#: The same in DuckDB's SQL.
SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce('v' || source, 'w') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents
), sizes AS (
  SELECT skey, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w
  FROM base GROUP BY skey
), levels AS (
  SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / w AS r,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::DOUBLE
           / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS level
  FROM sizes
  WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shares AS (
  SELECT skey, source_size,
         CASE WHEN r <= level THEN cap::DOUBLE ELSE max(CASE WHEN r > level THEN level END) OVER () * w END AS target
  FROM levels
), placed AS (
  SELECT b.*, s.source_size, s.target,
         sum(b.size) OVER (PARTITION BY b.skey ORDER BY b.key, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS given
  FROM base b JOIN shares s USING (skey)
), copies AS (
  SELECT doc_id, size, skey, key, e, (given + source_size * e)::DOUBLE / target AS f
  FROM placed, (VALUES (0), (1), (2)) t(e) WHERE target > 0
), ranked AS (
  SELECT *, sum(size) OVER (ORDER BY f, skey, e, key, doc_id) AS upto FROM copies
), taken AS (
  SELECT doc_id, count(*) AS n FROM ranked WHERE upto <= (SELECT sum(size) FROM base) GROUP BY doc_id
)
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * coalesce(t.n, 0))::BIGINT AS taken
FROM placed p LEFT JOIN taken t ON p.doc_id IS NOT DISTINCT FROM t.doc_id
"""
