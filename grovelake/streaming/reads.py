"""Streams of reads: heat per node with state, windows with watermarks, quiet sessions, rescans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..durable import Scratch, hadoop_fs
from ..operators.heat import BOOST, RATE, START, heat_fold, heat_state
from ..session import ship


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Reads of an event table as a stream; the time becomes a timestamp with zone, which watermarks need."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    fs, at = hadoop_fs(spark, path)
    if fs.getFileStatus(at).isFile():  # a stream reads folders: the one the file is in, with the file's name as a filter
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    stream = reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    t, at, n = state.get if state.exists else (START, float("nan"), 0)
    times = pd.concat([b["at"] for b in batches]).sort_values()
    t, at = heat_state(t, None if at != at else at, times, RATE, BOOST)
    n += len(times)
    state.update((t, at, n))
    yield pd.DataFrame({"node_id": [key[0]], "reads": [n], "temperature": [t]})


def heat_stream(reads: DataFrame, node: str = "user_id", ts: str = "ts") -> DataFrame:
    """(node_id, reads, temperature): each node's heat after every batch that read it.

    State per node is a temperature, a time and a count. Reads of one batch are taken in order of time; a read older
    than the last one does not cool the node again. Null nodes and times are left out. For a table that is drained, in
    files of any order, ``heat_drained`` takes all reads in order of time.
    """
    ship(reads.sparkSession)
    kind = reads.schema[node].dataType.simpleString()
    rows = reads.where(F.col(node).isNotNull() & F.col(ts).isNotNull()).select(F.col(node).alias("node_id"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"))
    return rows.groupBy("node_id").applyInPandasWithState(
        _update, f"node_id {kind}, reads long, temperature double", "t double, at double, n long", "update", GroupStateTimeout.NoTimeout
    )


def activity(reads: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total): reads per window and type, for a stream without end: rows later than the watermark are dropped.

    For a table that is drained, in files of any order, ``activity_drained`` counts every row.
    """
    w = reads.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def quiet_sessions(reads: DataFrame, node: str = "user_id", gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """(node_id, start, end, n): bursts of reads that end with a quiet gap, for notes that wait until nothing more comes."""
    w = reads.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), F.col(node).alias("node_id"))
    return w.agg(F.count("*").alias("n")).select("node_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drain(stream: DataFrame, mode: str, name: str, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it wrote, with the number of its batch.

    Batches are written to the shared folder under their number, overwriting a batch that is run again; so is the
    stream's checkpoint. With ``each``, what it makes of a batch is written in place of the batch.
    """
    spark = stream.sparkSession
    scratch = Scratch(spark, name)
    each = each or (lambda batch: batch)

    def write(batch: DataFrame, number: int) -> None:
        each(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{scratch.base}/out/batch_no={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{scratch.base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    schema = T.StructType([*each(stream).schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{scratch.base}/out/*")


def heat_drained(reads: DataFrame, node: str = "user_id", ts: str = "ts") -> DataFrame:
    """(node_id, reads, temperature): each node's heat after all reads of a stream that is drained, whatever their order.

    Reads of one time segment may come in several batches and between each other, so batches only keep node and time;
    the whole log is folded in order of time by ``heat_fold``. Null nodes and times are left out.
    """
    kept = drain(reads.select(F.col(node).alias("node_id"), F.col(ts).alias("at")), "append", "heat-drained")
    return heat_fold(kept, "node_id", "at")


def activity_drained(reads: DataFrame, unit: str = "day") -> DataFrame:
    """(start, event_type, n, total): reads per calendar unit and type after a stream that is drained, whatever their order.

    Each batch gives partial sums, which are added up at the end: no state, no watermark, so no row is too late. Null
    times and types are groups of their own.
    """
    start = F.date_trunc(unit, F.col("ts")).alias("start")
    parts = drain(reads, "append", "activity-drained", lambda b: b.groupBy(start, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")))
    return parts.groupBy("start", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def bursts_drained(reads: DataFrame, node: str = "user_id", ts: str = "ts", hours: int = 12) -> DataFrame:
    """(node_id, start, last, n): bursts of reads between gaps of at least ``hours``, after a stream that is drained, whatever its order.

    Batches keep node and time. Reads are first summed per node and hour (no burst ends within an hour's reads), so a
    node's log is a few rows where gaps are looked for. Null nodes and times are left out.
    """
    kept = drain(reads.select(F.col(node).alias("node_id"), F.col(ts).alias("at")), "append", "bursts-drained")
    kept = kept.where(F.col("node_id").isNotNull() & F.col("at").isNotNull())
    per_hour = kept.groupBy("node_id", F.date_trunc("hour", "at").alias("hour")).agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n"))
    w = Window.partitionBy("node_id").orderBy("hour")
    before = F.lag("b").over(w)
    opens = before.isNull() | (F.unix_micros("a") - F.unix_micros(before) >= hours * 3_600_000_000)
    numbered = per_hour.withColumn("_opens", opens.cast("int")).withColumn("burst", F.sum("_opens").over(w))
    return numbered.groupBy("node_id", "burst").agg(F.min("a").alias("start"), F.max("b").alias("last"), F.sum("n").alias("n")).drop("burst")


def latest(updates: DataFrame, key: str) -> DataFrame:
    """The last update of each key."""
    rest = [c for c in updates.columns if c not in (key, "batch")]
    return updates.groupBy(key).agg(F.max(F.struct("batch", *rest)).alias("r")).select(key, *[f"r.{c}" for c in rest])


def on_new_files(spark: SparkSession, root: str, compile_batch: Callable[[DataFrame, int], None], checkpoint: str):
    """Watch a folder: each batch of new or rewritten files (path, modificationTime, length, content) is given to ``compile_batch``.

    A file counts as seen only when its batch has ended without an error. Deleted files are found by comparing listings
    (``sources.scan.deleted_paths``), which a file stream does not do.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(compile_batch)
