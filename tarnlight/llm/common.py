"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.sources.scratch import delete, new_path

#: Arrow batches of texts hold at most so many bytes, in the JVM and in Python.
BATCH_BYTES = 8_000_000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bytes per Arrow batch to ``BATCH_BYTES``; a smaller setting stays.

    The default, 64 MB, is held several times over by every task that runs Python.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage at committed files that every executor can read, so a
    lost executor costs only the tasks it was running.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more; those not discarded go when the application ends."""
    delete(df.sparkSession, df.stored_at)


#: Tasks that one key is dealt to, whatever its share of the rows.
SALTS = 64


def salt(*columns: str) -> Column:
    """One of ``SALTS`` numbers by a hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def over_salts(rows: DataFrame, keys: list[str], **totals: tuple) -> DataFrame:
    """Aggregates of each key, a row for each of its values of ``salt``, to be joined back by key and salt.

    ``totals``: name = (how partial results are put together, the aggregate of
    a key and salt).  No task gets more of a key than one salt's rows and, in
    the window over its partial results, ``SALTS`` rows.
    """
    part = rows.groupBy(*keys, "salt").agg(*[each.alias(name) for name, (_, each) in totals.items()])
    whole = Window.partitionBy(*keys)
    return part.select(*keys, "salt", *[put(name).over(whole).alias(name) for name, (put, _) in totals.items()])


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that returns freed memory to the system, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def give_back() -> None:
    """Return what a Python worker has freed; workers live as long as the executor and would keep their peak through all later stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterable, most_bytes: int = 2_000_000) -> Iterable:
    """Cut Arrow record batches into pieces of bounded size (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * most_bytes / max(batch.nbytes, 1)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def trimmed(batches: Iterable, most_bytes: int = 2_000_000) -> Iterable:
    """``slices`` that give back before the first batch, behind each of several slices, and behind the last."""
    give_back()
    for batch in batches:
        yield from slices([batch], most_bytes)
        if batch.nbytes > most_bytes:
            give_back()
    give_back()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every vertex of ``edges(src, dst)``.

    Alternating large-star and small-star rounds: each vertex links its larger
    neighbours, then its smaller ones, to the smallest id it knows, until
    nothing changes.  Every round is a join-free group-by; its output is
    written to the shared folder.  The neighbourhood of a vertex is never
    gathered: the minimum is found by an aggregate and joined back, so a hub
    with a third of all edges is only a skewed sort-merge join, which AQE splits.

    Returns ``(id, component)``; vertices without edges are absent, and null
    ends and self loops are ignored.
    """
    spark = edges.sparkSession
    e = (
        edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        .where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    e = stored(e, "cc")
    state = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v")
            .where("u <> v")
            .distinct()
        )
        before, e = e, stored(small, "cc")
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if now == state and now[0] == now[2]:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
