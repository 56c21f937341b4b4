"""Append-only JSON logs: rotation by size, compaction of a ledger, the last rows of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import delete_path, hadoop_fs
from .scan import last_per_session


def folder_bytes(spark: SparkSession, path: str) -> int:
    fs, p = hadoop_fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def append_log(rows: DataFrame, path: str, most_bytes: int | None = None) -> bool:
    """Append rows to a JSON log; beyond ``most_bytes`` the log becomes ``<path>.1`` first (one generation is kept). True if it was rotated."""
    spark = rows.sparkSession
    rotate = most_bytes is not None and folder_bytes(spark, path) >= most_bytes
    if rotate:
        fs, old = hadoop_fs(spark, f"{path}.1")
        _, current = hadoop_fs(spark, path)
        fs.delete(old, True)
        fs.rename(current, old)
    rows.write.mode("append").json(path)
    return rotate


def compact_ledger(spark: SparkSession, path: str, schema: str, most_sessions: int | None = None) -> None:
    """Rewrite a ledger with one record per session, by connection time and id; the new folder takes the old one's place when it is whole."""
    rows = last_per_session(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path))
    if most_sessions is not None:
        rows = rows.orderBy(F.col("connected_at").desc(), F.col("session_id").desc()).limit(most_sessions)
    rows.orderBy("connected_at", "session_id").write.mode("overwrite").json(f"{path}.new")
    fs, new = hadoop_fs(spark, f"{path}.new")
    _, current = hadoop_fs(spark, path)
    delete_path(spark, path)
    fs.rename(new, current)


def last_rows(log: DataFrame, order: str, keep: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(the newest ``keep`` rows, one row with how many are dropped)."""
    kept = log.orderBy(F.col(order).desc()).limit(keep)
    return kept, log.agg(F.greatest(F.count("*") - keep, F.lit(0)).alias("dropped"))
