"""Text and JSON forms of results, as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import human_age, human_bytes
from .hierarchy import resolve_hierarchy
from .positions import with_position
from .versions import unified_diff


def compact_lines(rows: DataFrame) -> DataFrame:
    """rows (node_id, node_type, depth, label, token_count, ...) with ``line``: indented label with id, type and size."""
    indent = F.repeat(F.lit("  "), F.greatest(F.col("depth") - 1, F.lit(0)))
    line = F.concat(indent, F.lit("["), "node_id", F.lit("] "), "node_type", F.lit(": "), F.coalesce("label", F.lit("")), F.lit(" ("), F.coalesce("token_count", F.lit(0)).cast("string"), F.lit(" tok)"))
    return rows.withColumn("line", line)


def full_text(rows: DataFrame) -> DataFrame:
    """rows with ``text``: a header of id, file and type, then the content."""
    head = F.concat(F.lit("## ["), "node_id", F.lit("] "), F.coalesce("source_file", F.lit("")), F.lit(" · "), "node_type")
    return rows.withColumn("text", F.concat(head, F.lit("\n"), F.coalesce("content", F.lit(""))))


def tree_lines(nodes: DataFrame, depth: int = 5) -> DataFrame:
    """(root_id, node_id, path, line): the tree down to ``depth`` levels; sorted by (root_id, path) it reads in pre-order. A file is named only where it differs from the parent's."""
    h = resolve_hierarchy(nodes.select("id", "parent_id")).where((F.col("status") == "rooted") & (F.col("steps") < depth))
    n = nodes.select(F.col("id").alias("node_id"), "node_type", "label", "source_file", "token_count")
    up = nodes.select(F.col("id").alias("parent_id"), F.col("source_file").alias("_file"))
    rows = h.select("node_id", "parent_id", "root_id", "path", (F.col("steps") + 1).alias("depth")).join(n, "node_id").join(up, "parent_id", "left")
    file = F.when(F.col("_file").eqNullSafe(F.col("source_file")), "").otherwise(F.concat(F.lit("  "), F.coalesce("source_file", F.lit(""))))
    lines = compact_lines(rows)
    return lines.select("root_id", "node_id", "path", F.concat("line", file).alias("line"))


def diff_texts(deltas: DataFrame) -> DataFrame:
    """deltas (node_id, op, old_content, new_content) with ``text``: a mark, the id and the hunks."""
    mark = F.create_map(F.lit("add"), F.lit("+"), F.lit("mod"), F.lit("~"), F.lit("rem"), F.lit("-"))[F.col("op")]
    return deltas.select("node_id", "op", F.concat(mark, F.lit(" "), "node_id", F.lit("\n"), unified_diff(F.col("old_content"), F.col("new_content"))).alias("text"))


def stats_text(stats: DataFrame, now: int, last_created_at: int | None, size_bytes: int | None = None) -> DataFrame:
    """One line per figure of ``stats.global_stats``: (name, value)."""
    names = [c for c in stats.columns]
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names])
    rows = stats.select(F.inline(pairs))
    extra = rows.sparkSession.range(1)
    if last_created_at is not None:
        rows = rows.unionByName(extra.select(F.lit("last snapshot").alias("name"), F.concat(human_age(F.lit(now - last_created_at)), F.lit(" ago")).alias("value")))
    if size_bytes is not None:
        rows = rows.unionByName(extra.select(F.lit("size").alias("name"), human_bytes(F.lit(size_bytes)).alias("value")))
    return rows


def json_rows(df: DataFrame, kind: str) -> DataFrame:
    """(kind, body): each row as JSON, nulls kept, for resource bodies that are read row by row."""
    return df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("body"))


def snapshot_list(snapshots: DataFrame, head: int | None, limit: int = -1) -> DataFrame:
    """Snapshots, the newest first, with ``is_head``; a limit below 0 means all, 0 is an error."""
    if limit == 0:
        raise ValueError("limit must not be 0")
    rows = snapshots.withColumn("is_head", F.col("id").eqNullSafe(F.lit(head))).orderBy(F.col("id").desc())
    return rows if limit < 0 else rows.limit(limit)


def files_by_root(summaries: DataFrame) -> DataFrame:
    """(compile_root, files, nodes, tokens) of ``store.file_summaries``; files without a root last."""
    g = summaries.groupBy("compile_root").agg(F.count("*").alias("files"), F.sum("nodes").alias("nodes"), F.sum("tokens").alias("tokens"))
    return g.orderBy(F.col("compile_root") == "", "compile_root")


def mid_size_nodes(nodes: DataFrame) -> DataFrame:
    """(source_file, node_id, token_count): of the file with the most tokens the nodes between the first quartile and the median by size."""
    top = nodes.groupBy("source_file").agg(F.sum(F.col("token_count").cast("long")).alias("n")).orderBy(F.col("n").desc(), "source_file").limit(1)
    rows = nodes.join(F.broadcast(top.select("source_file")), "source_file", "left_semi")
    placed = with_position(rows.select("source_file", "id", "token_count"), ["source_file"], ["token_count", "id"], "_at")
    middle = (F.col("_at") / F.lit(max(placed.count() - 1, 1))).between(0.25, 0.5)
    return placed.where(middle).select("source_file", F.col("id").alias("node_id"), "token_count")
