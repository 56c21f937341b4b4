"""Tables written to the shared folder that the cluster names in ``spark.checkpoint.dir``.

Iterative operators cut their lineage here instead of keeping cached blocks: a written table
survives the loss of any executor, and its file sizes tell the planner whether it may be broadcast.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset and all runs in one process (tests) a temporary one.

    On a cluster each machine would see a temporary folder of its own, so without the setting it is an error there.
    """
    global _own_root
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="grovelake-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return f"file://{_own_root}"


class Scratch:
    """Intermediate tables of one operator run, each under its own folder; ``drop`` frees those no plan reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/grovelake/{name}-{uuid.uuid4().hex}"
        self.n = 0
        fs, path = hadoop_fs(spark, self.base)
        fs.deleteOnExit(path)  # when the application ends

    def write(self, df: DataFrame) -> tuple[str, DataFrame]:
        """Write ``df`` and return (path, the table read back)."""
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str) -> None:
        delete_path(self.spark, path)


def hadoop_fs(spark: SparkSession, path: str):
    """(file system, Path) of ``path`` through Hadoop's client, so any store that Spark reads works."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file; it is deleted when the application ends."""
    fs, p = hadoop_fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()
    fs.deleteOnExit(p.getParent())
