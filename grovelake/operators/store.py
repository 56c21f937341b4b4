"""The store's tables as the operators see them, and the writes that make a new version of one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import blank_to_null, current_rows
from .hierarchy import resolve_hierarchy


def nodes_now(nodes: DataFrame) -> DataFrame:
    """Current rows of all nodes with all columns; an empty parent is null. Select the columns that are needed before: the aggregate carries all it is given."""
    rest = [c for c in nodes.columns if c != "id"]
    now = current_rows(nodes, *rest)
    return now.withColumn("parent_id", blank_to_null(F.col("parent_id"))) if "parent_id" in rest else now


def snapshots_once(snapshots: DataFrame) -> DataFrame:
    """One row per snapshot id."""
    return snapshots.where(F.col("id").isNotNull()).dropDuplicates(["id"])


def changes_once(diffs: DataFrame) -> DataFrame:
    """The feed's distinct changes with all columns; op in lower case without spaces; the lowest id of equal changes."""
    key = ["snapshot_id", "node_id", "op", "old_hash", "new_hash"]
    rest = [c for c in diffs.columns if c not in (*key, "id")]
    rows = diffs.withColumn("op", F.lower(F.trim("op"))).where(F.col("op").isin("add", "mod", "rem") & F.col("node_id").isNotNull() & F.col("snapshot_id").isNotNull())
    one = rows.groupBy(*key).agg(F.min(F.struct("id", *rest)).alias("r"))
    return one.select("r.id", *key, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert_nodes(stored: DataFrame, incoming: DataFrame, now: int) -> DataFrame:
    """Incoming nodes inserted or, by id, put in the place of stored ones.

    A stored node keeps created_at, access_count, last_accessed_at and pinned, and its temperature unless the incoming
    one has one; a new node without temperature starts at 0.5. Both sides have one row per id.
    """
    kept = ["created_at", "access_count", "last_accessed_at", "pinned"]
    a, b = stored.alias("a"), incoming.alias("b")
    is_new = F.col("a.id").isNull()
    touched = F.col("b.id").isNotNull()

    def value(c):
        if c == "id":
            return F.coalesce("b.id", "a.id")
        if c == "temperature":
            return F.when(touched, F.coalesce("b.temperature", "a.temperature", F.lit(0.5))).otherwise(F.col("a.temperature"))
        if c in kept:
            return F.when(is_new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
        if c == "updated_at":
            return F.when(touched, F.lit(now)).otherwise(F.col("a.updated_at"))
        return F.when(touched, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

    return a.join(b, F.col("a.id") == F.col("b.id"), "full_outer").select(*[value(c).alias(c) for c in stored.columns])


def upsert_relations(relations: DataFrame) -> DataFrame:
    """One edge per source, target and origin: the first one's id and time with the last one's weight."""
    return relations.groupBy("source_node_id", "target_node_id", "origin").agg(
        F.min("id").alias("id"), F.max_by("weight", "id").alias("weight"), F.min_by("created_at", "id").alias("created_at")
    )


def delete_strict(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes after the deletion of ``ids`` that have no children; those with children stay."""
    parents = nodes.select(F.col("parent_id").alias("id")).where(F.col("id").isNotNull()).distinct()
    return nodes.join(ids.join(parents, "id", "left_anti"), "id", "left_anti")


def delete_cascade(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes after the deletion of ``ids`` and everything below them.

    A node goes if an id of its path does: one lookup per path element instead of a walk. Nodes on loops have no path
    and go only if they are named.
    """
    paths = resolve_hierarchy(nodes.select("id", "parent_id"))
    below = paths.select("node_id", F.explode("path").alias("id")).join(ids, "id", "left_semi").select(F.col("node_id").alias("id"))
    return nodes.join(below.unionByName(ids.select("id")).distinct(), "id", "left_anti")


def delete_reparent(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes after the deletion of ``ids`` whose children move up to the nearest ancestor that stays; depths are kept."""
    paths = resolve_hierarchy(nodes.select("id", "parent_id"))
    up = paths.select("node_id", F.posexplode("path").alias("level", "id")).join(ids, "id", "left_anti")
    own = up.join(paths.select("node_id", "steps"), "node_id").where(F.col("level") < F.col("steps"))
    nearest = own.groupBy("node_id").agg(F.max_by("id", "level").alias("_up"))
    kept = nodes.join(ids, "id", "left_anti")
    gone = F.col("_gone").isNotNull()
    marked = kept.join(ids.select(F.col("id").alias("_gone")).distinct(), F.col("parent_id") == F.col("_gone"), "left")
    moved = marked.join(nearest.withColumnRenamed("node_id", "_node"), F.col("id") == F.col("_node"), "left")
    return moved.select(*[F.when(gone, F.col("_up")).otherwise(F.col(c)).alias(c) if c == "parent_id" else F.col(c) for c in nodes.columns])


def delete_by_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes after the deletion of all nodes of ``files`` (source_file), with their children in other files."""
    return delete_cascade(nodes, nodes.join(files, "source_file", "left_semi").select("id"))


def repend(relations: DataFrame, nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges into deleted nodes as pending rows with the node's label and file; the id is not kept as a hint."""
    lost = nodes.join(gone, "id", "left_semi").select(F.col("id").alias("target_node_id"), F.col("label").alias("target_label"), F.col("source_file").alias("target_source"))
    return relations.join(lost, "target_node_id").select("source_node_id", "target_label", "target_source", F.lit(None).cast("string").alias("target_id_hint"), "weight", "origin")


def prune_after(snapshots: DataFrame, diffs: DataFrame, target: int, keep: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Snapshots and diffs without those after ``target``, but with ``keep``."""
    ok = lambda c: (F.col(c) <= target) | (F.col(c) == F.lit(keep))
    return snapshots.where(F.coalesce(ok("id"), F.lit(False))), diffs.where(F.coalesce(ok("snapshot_id"), F.lit(False)))


def purge_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source_file, purged): how many nodes of each file are gone."""
    return before.join(after.select("id"), "id", "left_anti").groupBy("source_file").agg(F.count("*").alias("purged"))


def tree_preorder(nodes: DataFrame) -> DataFrame:
    """(root_id, node_id, depth, position): each rooted tree in pre-order, children by id; positions from 0."""
    from .positions import with_position

    h = resolve_hierarchy(nodes.select("id", "parent_id")).where(F.col("status") == "rooted")
    rows = h.select("root_id", "node_id", F.col("steps").alias("depth"), "path")
    return with_position(rows, ["root_id"], ["path"]).select("root_id", "node_id", "depth", "position")


def descendants_bounded(nodes: DataFrame, anchors: DataFrame, depth: int) -> DataFrame:
    """(anchor_id, node_id, level): nodes at most ``depth`` levels below each anchor (``id``), one join per level."""
    children = nodes.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("_up"), F.col("id").alias("node_id"))
    level = anchors.select(F.col("id").alias("anchor_id"), F.col("id").alias("at"))
    out = None
    for n in range(1, depth + 1):
        level = level.join(children, F.col("at") == F.col("_up")).select("anchor_id", F.col("node_id").alias("at"))
        rows = level.select("anchor_id", F.col("at").alias("node_id"), F.lit(n).alias("level"))
        out = rows if out is None else out.unionByName(rows)
    return out


def sibling_counts(nodes: DataFrame) -> DataFrame:
    """(node_id, siblings): how many other nodes have the same parent; none for roots."""
    per = nodes.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg((F.count("*") - 1).alias("n"))
    return nodes.join(per, "parent_id", "left").select(F.col("id").alias("node_id"), F.coalesce("n", F.lit(0)).alias("siblings"))


def latest_touch(diffs: DataFrame) -> DataFrame:
    """(node_id, snapshot_id): the last snapshot that touched each node."""
    return diffs.groupBy("node_id").agg(F.max("snapshot_id").alias("snapshot_id"))


def nodes_by_compile_root(nodes: DataFrame, diffs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(node_id, compile_root): each node with the root of the last snapshot that touched it."""
    last = latest_touch(diffs).join(snapshots.select(F.col("id").alias("snapshot_id"), "compile_root"), "snapshot_id")
    return nodes.select(F.col("id").alias("node_id")).join(last, "node_id").select("node_id", "compile_root")


def file_summaries(nodes: DataFrame, diffs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(source_file, nodes, tokens, compile_root): per file, with the root of the last snapshot that touched it ('' for none).

    Touches are reduced to one row per node before they meet the files.
    """
    touched = nodes.select("source_file", F.col("id").alias("node_id")).join(latest_touch(diffs), "node_id").groupBy("source_file").agg(F.max("snapshot_id").alias("sid"))
    sums = nodes.groupBy("source_file").agg(F.count("*").alias("nodes"), F.sum(F.col("token_count").cast("long")).alias("tokens"))
    roots = snapshots.select(F.col("id").alias("sid"), "compile_root")
    joined = sums.join(touched, "source_file", "left").join(roots, "sid", "left")
    return joined.select("source_file", "nodes", "tokens", F.coalesce("compile_root", F.lit("")).alias("compile_root"))


def latest_root(snapshots: DataFrame) -> DataFrame:
    """(compile_root): the root of the last snapshot that names one, null if none does."""
    return snapshots.where(F.col("compile_root") != "").agg(F.max_by("compile_root", "id").alias("compile_root"))
