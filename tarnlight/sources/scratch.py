"""Folders for intermediate tables, shared by the driver and all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT_TO_EXIT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where that is unset, on one machine, a temporary folder is made once for
    each session; a cluster has no such folder, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tarnlight-"))
    return sc.getCheckpointDir().rstrip("/")


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder, which is deleted when the application ends."""
    own = f"{shared_dir(spark)}/tarnlight/{spark.sparkContext.applicationId}"
    if own not in _LEFT_TO_EXIT:
        fs, p = _store(spark, own)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _LEFT_TO_EXIT.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: nothing is made twice, and joins know its size."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _store(spark, path)
    fs.delete(p, True)
