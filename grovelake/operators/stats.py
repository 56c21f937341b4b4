"""Statistics, integrity checks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import blank_to_null
from .heat import COLD
from .positions import with_position

HOT = 0.5


def upper_median(df: DataFrame, column: str):
    """The value at place count // 2 (from 0) of the sorted column, nulls left out; None of nothing.

    Exact without sorting everything in one place: counts per distinct value are summed over value ranges first.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).count()
    n = counts.agg(F.sum("count")).first()[0]
    if not n:
        return None
    place, low, high = n // 2, None, None
    span = counts.agg(F.min("v"), F.max("v")).first()
    low, high, below = float(span[0]), float(span[1]), 0
    # narrow the range that holds the place: 1,024 equal parts at a time
    while True:
        width = (high - low) / 1024
        if width <= 0 or low + width == low:
            return low
        inside = counts.where((F.col("v") >= low) & (F.col("v") <= high))
        part = F.least(F.floor((F.col("v") - low) / width), F.lit(1023))
        bars = inside.groupBy(part.alias("p")).agg(F.sum("count").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("p").collect()
        for b in bars:
            if below + b["n"] > place:
                if b["lo"] == b["hi"]:
                    return b["lo"]
                low, high = float(b["lo"]), float(b["hi"])
                break
            below += b["n"]


def upper_medians(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """(group..., median): the value at place count // 2 (from 0) of each group's sorted values, nulls left out. A group may hold any part of all rows."""
    placed = with_position(df.where(F.col(column).isNotNull()).select(*group, column), group, [column], "_at")
    middle = placed.groupBy(*group).agg(F.floor(F.count("*") / 2).alias("_middle"))
    same = F.col("a._at") == F.col("b._middle")
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return placed.alias("a").join(middle.alias("b"), same).select(*[f"a.{g}" for g in group], F.col(f"a.{column}").alias("median"))


def global_stats(nodes: DataFrame, snapshots: DataFrame, pending: DataFrame, cold: float = COLD) -> DataFrame:
    """One row: counts, mean and upper median temperature, hot, cold and pinned nodes, tokens, snapshots, pending references."""
    median = upper_median(nodes, "temperature")
    others = {"snapshots": snapshots.count(), "pending": pending.count()}
    t = F.col("temperature")
    return nodes.agg(
        F.count("*").alias("nodes"), F.coalesce(F.avg(t), F.lit(0.0)).alias("avg_temperature"), F.lit(float(median or 0.0)).alias("median_temperature"),
        F.count_if(t >= HOT).alias("hot"), F.count_if(t < cold).alias("cold"), F.count_if(F.col("pinned")).alias("pinned"),
        F.coalesce(F.sum(F.col("token_count").cast("long")), F.lit(0)).alias("tokens"), *[F.lit(n).cast("long").alias(c) for c, n in others.items()],
    )


def counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n)."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def doctor(nodes: DataFrame, diffs: DataFrame, snapshots: DataFrame, head: int | None = None) -> DataFrame:
    """(check, status, n): orphan parents, dangling diffs, the head pointer, and the worst of them as ``overall``."""
    ids, known = nodes.select(F.col("id").alias("parent_id")), snapshots.select(F.col("id").alias("snapshot_id"))
    parents = nodes.where(blank_to_null(F.col("parent_id")).isNotNull()).select("parent_id")
    rows = parents.join(ids, "parent_id", "left_anti").agg(F.lit("orphan_parent_id").alias("check"), F.count("*").alias("n"))
    rows = rows.unionByName(diffs.select("snapshot_id").join(known, "snapshot_id", "left_anti").agg(F.lit("dangling_diffs").alias("check"), F.count("*").alias("n")))
    here = F.count_if(F.col("id") == F.lit(head)) if head is not None else F.count("*")
    rows = rows.unionByName(snapshots.agg(F.lit("head_cursor").alias("check"), F.when(here > 0, 0).otherwise(1).cast("long").alias("n")))
    rows = rows.withColumn("status", F.when(F.col("n") > 0, "fail").otherwise("pass"))
    worst = rows.agg(F.lit("overall").alias("check"), F.sum("n").alias("n"), F.max(F.when(F.col("status") == "fail", 2).otherwise(0)).alias("rank"))
    worst = worst.select("check", "n", F.when(F.col("rank") == 2, "fail").otherwise("pass").alias("status"))
    return rows.unionByName(worst).select("check", "status", "n")


def promote_orphans(nodes: DataFrame) -> DataFrame:
    """Nodes whose parents do not exist become roots."""
    ids = nodes.select(F.col("id").alias("_known")).distinct()
    j = nodes.join(ids, F.col("parent_id") == F.col("_known"), "left")
    return j.select(*[F.col("_known").alias("parent_id") if c == "parent_id" else F.col(c) for c in nodes.columns])


def index_differences(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Postings (term, node_id, at) that only one side has or whose places differ: the check of an index against its content."""
    a, b = stored.alias("a"), computed.alias("b")
    j = a.join(b, F.col("a.term").eqNullSafe(F.col("b.term")) & (F.col("a.node_id") == F.col("b.node_id")), "full_outer")
    wrong = j.where(~F.col("a.at").eqNullSafe(F.col("b.at")))
    return wrong.select(F.coalesce("a.term", "b.term").alias("term"), F.coalesce("a.node_id", "b.node_id").alias("node_id"), F.col("a.at").alias("stored"), F.col("b.at").alias("computed"))


def client_rollup(sessions: DataFrame) -> DataFrame:
    """(client, sessions, seconds, tool_calls, last_seen) of a ledger with session_id, client, connected_at, ended_at, tool_calls: the last record of a session counts."""
    last = sessions.groupBy("session_id").agg(F.max(F.struct("ended_at", "connected_at", "client", "tool_calls")).alias("s")).select("s.*")
    seconds = F.greatest(F.col("ended_at") - F.col("connected_at"), F.lit(0))
    return last.groupBy("client").agg(F.count("*").alias("sessions"), F.sum(seconds).alias("seconds"), F.sum("tool_calls").alias("tool_calls"), F.max("ended_at").alias("last_seen"))


def grep_lines(documents: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, line, text): lines that contain any of the words, whatever the case; lines from 1."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower("text"), F.lit(w.lower()))
    return lines.where(hit).select("doc_id", (F.col("line") + 1).alias("line"), "text")


def saving_percent(ours, naive):
    """100 x (1 - ours / naive), null where there is nothing to compare with."""
    return F.when(naive > 0, 100.0 * (1.0 - ours / naive))
