"""A store as versioned folders of Parquet tables with one pointer: a commit writes new tables, then swaps the pointer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import delete_path, hadoop_fs
from ..operators import store, versions
from ..operators.changefeed import current_version, swap_pointer

# Columns of the store's tables.
NODES = "id string, parent_id string, source_file string, node_type string, depth int, label string, content string, format string, token_count int, content_hash string, temperature double, access_count int, last_accessed_at long, created_at long, updated_at long, pinned boolean"
SNAPSHOTS = "id long, cursor_hash string, parent_id long, message string, created_at long, compile_root string"
DIFFS = "id long, snapshot_id long, node_id string, op string, old_hash string, new_hash string, old_content string, new_content string, old_parent_id string, old_source_file string, old_node_type string, old_depth int, old_label string, old_format string, old_token_count int"
SCHEMAS = {"nodes": NODES, "snapshots": SNAPSHOTS, "diffs": DIFFS}


class VersionedStore:
    """Tables under ``root/v-*/`` and the file ``root/CURRENT`` that names the version in force."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> str | None:
        return current_version(self.spark, self.root)

    def read(self, name: str) -> DataFrame:
        """A table of the current version; empty before the first commit."""
        at = self.version()
        if at is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{at}/{name}")

    def commit(self, tables: dict[str, DataFrame], based_on: str | None) -> str:
        """Write all tables as a new version and make it current, if ``based_on`` still is; a stale writer gets an error and changes nothing."""
        new = f"{self.root}/v-{uuid.uuid4().hex}"
        for name in SCHEMAS:
            df = tables.get(name, self.read(name))
            df.write.parquet(f"{new}/{name}")
        if self.version() != based_on:
            delete_path(self.spark, new)
            raise RuntimeError("the store has moved on; read it again")
        swap_pointer(self.spark, self.root, new)
        return new

    def backup(self, to: str) -> None:
        """Copy the current version."""
        at = self.version()
        if at is None:
            raise FileNotFoundError(self.root)
        fs, src = hadoop_fs(self.spark, at)
        fs2, dst = hadoop_fs(self.spark, to)
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, src, fs2, dst, False, self.spark._jsc.hadoopConfiguration())


def compile_deltas(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """(node_id, op, old and new hash and content, old_*): what a compile changes.

    ``parsed`` is ``parsing.parse_files`` without errors. Previous state is every stored node of the files that were
    parsed, so a node written by a tool into such a file is seen too. Equal hashes under one id are no change.
    """
    mine = stored.join(parsed.select("source_file").distinct(), "source_file", "left_semi")
    a, b = mine.alias("a"), parsed.where(F.col("node_id").isNotNull()).alias("b")
    op = F.when(F.col("a.id").isNull(), "add").when(F.col("b.node_id").isNull(), "rem").when(~F.col("a.content_hash").eqNullSafe(F.col("b.content_hash")), "mod")
    j = a.join(b, F.col("a.id") == F.col("b.node_id"), "full_outer").withColumn("op", op).where(F.col("op").isNotNull())
    return j.select(
        F.coalesce("a.id", "b.node_id").alias("node_id"), "op", F.col("a.content_hash").alias("old_hash"), F.col("b.content_hash").alias("new_hash"),
        F.col("a.content").alias("old_content"), F.col("b.content").alias("new_content"), *[F.col(f"a.{c}").alias(f"old_{c}") for c in versions.META],
    )


def compile_into(target: VersionedStore, parsed: DataFrame, message: str, compile_root: str, now: int) -> dict[str, int]:
    """Compile parsed files into the store in one commit; without a change there is no snapshot.

    Removed nodes take everything below them along, so their diffs are complete. Returns added, modified, removed, total.
    """
    from ..durable import Scratch

    scratch, base = Scratch(target.spark, "compile"), target.version()
    bad = parsed.where(F.col("error").isNotNull()).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['source_file']}: {bad[0]['error']}")
    _, parsed = scratch.write(parsed)
    stored, snapshots, diffs = target.read("nodes"), target.read("snapshots"), target.read("diffs")
    _, deltas = scratch.write(compile_deltas(parsed, stored))
    counts = versions.change_counts(deltas).first().asDict()
    if not counts["total"]:
        return counts
    incoming = parsed.where(F.col("node_id").isNotNull()).select(
        F.col("node_id").alias("id"), "parent_id", "source_file", "node_type", "depth", "label", "content", "format", "token_count", "content_hash", F.lit(None).cast("double").alias("temperature"),
        F.lit(0).alias("access_count"), F.lit(None).cast("long").alias("last_accessed_at"), F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"), F.lit(False).alias("pinned"),
    )
    changed = incoming.join(deltas.where(F.col("op") != "rem").select(F.col("node_id").alias("id")), "id", "left_semi")
    gone = deltas.where(F.col("op") == "rem").select(F.col("node_id").alias("id"))
    nodes = store.upsert_nodes(store.delete_cascade(stored, gone), changed, now)
    last = snapshots.agg(F.max("id")).first()[0]
    new_id, first_diff = (last or 0) + 1, (diffs.agg(F.max("id")).first()[0] or 0) + 1
    hashes = versions.cursor_hash(incoming.withColumn("_all", F.lit(0)), ["_all"], F.concat("id", F.lit(":"), "content_hash")).first()
    snap = target.spark.createDataFrame([(new_id, hashes["cursor_hash"] if hashes else "", last, message, now, compile_root)], SNAPSHOTS)
    from ..operators.positions import with_position

    numbered = with_position(deltas.withColumn("_all", F.lit(0)), ["_all"], ["node_id"], "_n")
    rows = numbered.select((F.col("_n") + first_diff).alias("id"), F.lit(new_id).cast("long").alias("snapshot_id"), *[F.col(c.split()[0]) for c in DIFFS.split(", ")[2:]])
    names = [c.split()[0] for c in NODES.split(", ")]
    target.commit({"nodes": nodes.select(*names), "snapshots": snapshots.unionByName(snap), "diffs": diffs.unionByName(rows)}, base)
    return counts
