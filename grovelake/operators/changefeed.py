"""Applying a feed of inserts, updates and deletes: per-bucket DuckDB upserts inside Spark tasks, published atomically."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import hadoop_fs
from ..session import ship
from ..tables import exact

STATE_SCHEMA = "node_id string, snapshot_id long, diff_id long, is_removed boolean"
#: Memory of one task's embedded DuckDB; it holds one row per node of its bucket and spills beyond that.
DUCKDB_MEMORY = "256MB"
#: Rows that are upserted at once, and changes that a bucket gets on average at most.
UPSERT_ROWS, BUCKET_ROWS = 65_536, 1_000_000


def committed_changes(diffs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(node_id, snapshot_id, diff_id, is_removed): the distinct changes of committed snapshots.

    ``op`` counts without case and outer spaces; rows with another op than add, mod and rem, and rows without id, node
    or snapshot, are no changes. Rows equal in snapshot_id, node_id, op, old_hash and new_hash (nulls equal) are one change
    under its lowest id: a map-side aggregate whose key spreads even a single node's rows over all tasks.
    """
    op = F.lower(F.trim("op"))
    diffs = exact(diffs, "id", "snapshot_id", "node_id", "op", "old_hash", "new_hash")
    snapshots = exact(snapshots, "id")
    known = snapshots.where(F.col("id").isNotNull()).select(F.col("id").alias("snapshot_id")).distinct()
    feed = diffs.where(F.col("id").isNotNull() & F.col("node_id").isNotNull() & op.isin("add", "mod", "rem")).select(
        "node_id", "snapshot_id", op.alias("op"), "old_hash", "new_hash", F.col("id").alias("diff_id")
    )
    feed = feed.join(known, "snapshot_id", "left_semi")
    one = feed.groupBy("snapshot_id", "node_id", "op", "old_hash", "new_hash").agg(F.min("diff_id").alias("diff_id"))
    return one.select("node_id", "snapshot_id", "diff_id", (F.col("op") == "rem").alias("is_removed"))


def _upsert_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Upsert the changes of one bucket: a later (snapshot_id, diff_id) replaces the stored one, removals stay as tombstones."""
    import os

    import duckdb
    from pyspark import SparkFiles

    names = ["node_id", "snapshot_id", "diff_id", "is_removed"]
    con = None

    def upsert(rows: list[pa.RecordBatch]) -> None:
        # within one statement a key may be updated once, so the block's own latest row per node comes first
        con.register("block", pa.Table.from_batches(rows))
        con.execute(
            "insert into state "
            "select node_id, max((snapshot_id, diff_id))[1], max((snapshot_id, diff_id))[2], arg_max(is_removed, (snapshot_id, diff_id)) "
            "from block group by node_id "
            "on conflict (node_id) do update set snapshot_id = excluded.snapshot_id, diff_id = excluded.diff_id, is_removed = excluded.is_removed "
            "where (excluded.snapshot_id, excluded.diff_id) > (state.snapshot_id, state.diff_id)"
        )
        con.unregister("block")

    rows: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if con is None:
            # what does not fit spills into the executor's own folder, as Spark's sorts do
            spill = os.path.join(SparkFiles.getRootDirectory(), f"upsert-{os.getpid()}")
            con = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": spill})
            con.execute("create table state (node_id varchar primary key, snapshot_id bigint, diff_id bigint, is_removed boolean)")
        rows.append(batch)
        if sum(b.num_rows for b in rows) >= UPSERT_ROWS:
            upsert(rows)
            rows = []
    if con is None:
        return
    if rows:
        upsert(rows)
    result = con.sql("from state").to_arrow_reader(UPSERT_ROWS)
    schema = pa.schema([("node_id", pa.string()), ("snapshot_id", pa.int64()), ("diff_id", pa.int64()), ("is_removed", pa.bool_())])
    for out in result:
        yield pa.RecordBatch.from_arrays([out.column(n).cast(schema.field(n).type) for n in names], schema=schema)
    con.close()


def latest_state(diffs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(node_id, snapshot_id, diff_id, is_removed): the last change of each node, tombstones included.

    Two rounds of the same upsert: first over the change key's own partitioning, where a hot node's changes are spread
    over all tasks and each task keeps one row per node; then per bucket of node ids, over at most one row per node and
    task. Changes compare by (snapshot_id, diff_id), so the order in which rows arrive does not matter. The number of
    buckets grows with the changes: ``BUCKET_ROWS`` each on average.
    """
    ship(diffs.sparkSession)
    spark = diffs.sparkSession
    buckets = -(-diffs.count() // BUCKET_ROWS)  # from the files' footers
    # few changes: as many buckets as the planner finds fit
    n = [buckets] if buckets > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    changes = committed_changes(diffs, snapshots)
    if n:
        changes = changes.repartition(*n, "node_id", "snapshot_id", "diff_id")
    partial = changes.mapInArrow(_upsert_bucket, STATE_SCHEMA)
    return partial.repartition(*n, "node_id").mapInArrow(_upsert_bucket, STATE_SCHEMA)


def existing_nodes(state: DataFrame) -> DataFrame:
    """(node_id, diff_id) of the nodes whose last change is no removal."""
    return state.where(~F.col("is_removed")).select("node_id", "diff_id")


def with_content(existing: DataFrame, diffs: DataFrame) -> DataFrame:
    """(node_id, diff_id, content): contents are fetched by the winning change's id only after the winners are known; those of all other changes are not aggregated.

    Of several rows with one id the greatest content counts.
    """
    texts = exact(diffs, "id", "new_content").select(F.col("id").alias("diff_id"), F.col("new_content").alias("content"))
    return existing.join(texts, "diff_id", "left").groupBy("node_id", "diff_id").agg(F.max("content").alias("content"))


def publish(df: DataFrame, root: str) -> str:
    """Write ``df`` as a new version under ``root`` and make it current in one step; returns its folder.

    The bucket files are written to a folder of their own. Only when all of them are there does the pointer file
    ``CURRENT`` change, by a rename; a job that fails half-way leaves the former version in force.
    """
    path = f"{root}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    swap_pointer(df.sparkSession, root, path)
    return path


def swap_pointer(spark: SparkSession, root: str, version: str) -> None:
    """Make the folder ``version`` of ``root`` the one in force."""
    name = version.rsplit("/", 1)[-1]
    fs, pointer = hadoop_fs(spark, f"{root}/CURRENT")
    _, staged = hadoop_fs(spark, f"{root}/CURRENT.{name}")
    out = fs.create(staged, True)
    out.write(bytearray(name.encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark.sparkContext._gateway.new_array(options, 1)
    rename[0] = options.OVERWRITE
    context.rename(staged, pointer, rename)


def current_version(spark: SparkSession, root: str) -> str | None:
    """The folder of the version that is in force, or None."""
    fs, pointer = hadoop_fs(spark, f"{root}/CURRENT")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return f"{root}/{name}"
