import pytest

from tarnlight.sources import scratch


class Cluster:
    """As much of a session as tells a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        scratch.shared_dir(Cluster)


def test_paths_are_new_and_deleted(spark):
    a, b = scratch.new_path(spark, "x"), scratch.new_path(spark, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
    spark.range(3).write.parquet(a)
    assert spark.read.parquet(a).count() == 3
    scratch.delete(spark, a)
    fs, p = scratch._store(spark, a)
    assert not fs.exists(p)
