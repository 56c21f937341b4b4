"""Versions: deltas, net differences, history, past states, rollback, cursor hashes. ``diffs`` is ``store.changes_once``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

META = ["parent_id", "source_file", "node_type", "depth", "label", "format", "token_count"]
#: Entries of a node's history, by default.
HISTORY = 10


def delta_since(diffs: DataFrame, after: int) -> DataFrame:
    """All changes of snapshots later than ``after``, one by one."""
    return diffs.where(F.col("snapshot_id") > after)


def delta_between(diffs: DataFrame, after: int, upto: int) -> DataFrame:
    """All changes of snapshots later than ``after`` and not later than ``upto``."""
    if after > upto:
        raise ValueError("the range ends before it begins")
    return diffs.where((F.col("snapshot_id") > after) & (F.col("snapshot_id") <= upto))


def net_diff(diffs: DataFrame, after: int, upto: int) -> DataFrame:
    """(node_id, snapshot_id, op, old_hash, new_hash, old_content, new_content): one record per node that differs.

    Only the first and the last change of a node in the range count: added and removed within it is nothing, an add
    first is an add of the last content, a rem last is a rem of the first content, equal contents are nothing (a change
    of place alone vanishes), everything else is a mod. Null contents equal each other and the empty text.
    """
    at = F.struct("snapshot_id", "id")
    kept = F.struct("op", "snapshot_id", "old_hash", "new_hash", "old_content", "new_content")
    g = delta_between(diffs, after, upto).groupBy("node_id").agg(F.min_by(kept, at).alias("f"), F.max_by(kept, at).alias("l"))
    was, is_ = F.col("f.op") != "add", F.col("l.op") != "rem"
    same = F.coalesce("f.old_content", F.lit("")) == F.coalesce("l.new_content", F.lit(""))
    op = F.when(~was & is_, "add").when(was & ~is_, "rem").when(was & is_ & ~same, "mod")
    r = g.withColumn("op", op).where(F.col("op").isNotNull())
    old = lambda c: F.when(F.col("op") != "add", F.col(f"f.{c}")).alias(c)
    new = lambda c: F.when(F.col("op") != "rem", F.col(f"l.{c}")).alias(c)
    return r.select("node_id", F.col("l.snapshot_id").alias("snapshot_id"), "op", old("old_hash"), new("new_hash"), old("old_content"), new("new_content"))


def history(diffs: DataFrame, limit: int = HISTORY, newest_first: bool = False) -> DataFrame:
    """Each node's first ``limit`` changes with their rank from 1, oldest first unless told otherwise.

    The limit is applied before the shuffle as well (Spark keeps at most ``limit`` rows per node and task), so a node
    with a large part of all changes is no hot task.
    """
    order = [F.col("snapshot_id").desc(), F.col("id").desc()] if newest_first else ["snapshot_id", "id"]
    ranked = diffs.withColumn("rank", F.row_number().over(Window.partitionBy("node_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= limit)


def state_at(diffs: DataFrame, snapshot: int) -> DataFrame:
    """(node_id, snapshot_id, hash, content): nodes that exist after ``snapshot``, by their last change up to it."""
    last = diffs.where(F.col("snapshot_id") <= snapshot).groupBy("node_id").agg(
        F.max_by(F.struct("op", "snapshot_id", F.col("new_hash").alias("hash"), F.col("new_content").alias("content")), F.struct("snapshot_id", "id")).alias("l")
    )
    return last.where(F.col("l.op") != "rem").select("node_id", "l.snapshot_id", "l.hash", "l.content")


def diff_states(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = ("hash",)) -> DataFrame:
    """(node_id, op): add, rem, or mod where one of ``columns`` differs (nulls equal), by a full outer join."""
    a, b = before.alias("a"), after.alias("b")
    j = a.join(b, F.col("a.node_id") == F.col("b.node_id"), "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    op = F.when(F.col("a.node_id").isNull(), "add").when(F.col("b.node_id").isNull(), "rem").when(~same, "mod")
    return j.select(F.coalesce("a.node_id", "b.node_id").alias("node_id"), op.alias("op")).where(F.col("op").isNotNull())


def restore_at(head: DataFrame, diffs: DataFrame, target: int) -> DataFrame:
    """Nodes as they were after snapshot ``target``, from the current ones and each node's earliest later change.

    ``head`` has node_id, hash, content and the columns of ``META``. The old side of the earliest change after the
    target is the state at the target: an add means the node was absent. A change that kept no old metadata cannot bring
    a removed node back: such nodes come with ``restored`` = false; where the node still exists, its present metadata stands in.
    """
    first = diffs.where(F.col("snapshot_id") > target).groupBy("node_id").agg(
        F.min_by(F.struct("op", "old_hash", "old_content", *[f"old_{c}" for c in META]), F.struct("snapshot_id", "id")).alias("c")
    )
    j = head.alias("h").join(first.alias("f"), "node_id", "full_outer")
    changed, has_meta, here = F.col("c").isNotNull(), F.col("c.old_source_file").isNotNull(), F.col("h.source_file").isNotNull()
    absent = F.coalesce(F.col("c.op") == "add", F.lit(False))
    value = lambda old, now: F.when(changed, old).otherwise(now)
    meta = [F.when(changed & has_meta, F.col(f"c.old_{c}")).otherwise(F.col(f"h.{c}")).alias(c) for c in META]
    return j.where(~absent).select(
        "node_id", value(F.col("c.old_hash"), F.col("h.hash")).alias("hash"), value(F.col("c.old_content"), F.col("h.content")).alias("content"), *meta, (~changed | has_meta | here).alias("restored")
    )


def rollback_target(target: int, head: int) -> int:
    """The snapshot to go back to: it must be a positive number and not lie after ``head``."""
    if target <= 0:
        raise ValueError(f"no snapshot {target}")
    if target > head:
        raise ValueError(f"snapshot {target} is after the present one, {head}")
    return target


def rollback_deltas(head: DataFrame, diffs: DataFrame, target: int) -> DataFrame:
    """(node_id, op): the changes that lead from the current nodes back to snapshot ``target``: content and all of ``META`` count."""
    past = restore_at(head, diffs, target).where("restored")
    return diff_states(head, past, ("hash", *META))


def change_counts(deltas: DataFrame) -> DataFrame:
    """(added, modified, removed, total) of rows with an op."""
    n = lambda op: F.count_if(F.col("op") == op)
    return deltas.agg(n("add").alias("added"), n("mod").alias("modified"), n("rem").alias("removed"), F.count("*").alias("total"))


def _running_hashes(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (names..., _part): one digest per group; only that of the group at hand is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        key, digest, done, types = None, None, [], None
        for b in batches:
            types = types or [b.schema.field(n).type for n in names]
            keys = zip(*(b.column(n).to_pylist() for n in names))
            for k, rows in groupby(zip(keys, b.column("_part").to_pylist()), key=lambda r: r[0]):
                if digest is None or k != key:
                    if digest is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = k, xxhash.xxh64()
                digest.update("".join(p for _, p in rows if p is not None).encode())
            if len(done) > 10_000:
                yield _hash_rows(done, names, types)
                done = []
        if digest is not None:
            yield _hash_rows([*done, (*key, digest.hexdigest())], names, types)

    return run


def _hash_rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    kinds = [*types, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=[*names, "cursor_hash"])


def cursor_hash(rows: DataFrame, group: list[str], part) -> DataFrame:
    """(group..., cursor_hash): xxh64 over the sorted ``part`` texts of each group, joined without separator; null texts are left out.

    Groups are snapshots or compiles: what one transaction wrote. A group of any size is sorted in one task (which
    spills to disk) and hashed as it streams by, so memory does not grow with it.
    """
    ship(rows.sparkSession)
    kept = rows.select(*group, part.alias("_part"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    return kept.repartition(*group).sortWithinPartitions(*group, "_part").mapInArrow(_running_hashes(group), ", ".join([*fields, "cursor_hash string"]))


def delta_hashes(diffs: DataFrame) -> DataFrame:
    """(snapshot_id, cursor_hash) over the sorted ``op:id:old:new`` of each snapshot's changes."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return cursor_hash(diffs, ["snapshot_id"], F.concat_ws(":", "op", "node_id", text("old_hash"), text("new_hash")))


def _unified(old: pd.Series, new: pd.Series) -> pd.Series:
    import difflib

    out = []
    for a, b in zip(old, new):
        lines = list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="", n=3))
        out.append("\n".join(lines[2:]))
    return pd.Series(out, dtype="object")


def unified_diff(old, new):
    """Hunks of the unified difference of two texts, without the header."""
    return F.pandas_udf(_unified, "string")(old, new)
