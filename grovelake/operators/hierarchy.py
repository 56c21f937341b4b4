"""Parent-child rows to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..durable import Scratch
from ..tables import blank_to_null, exact

ROOTED, BROKEN, CYCLIC = "rooted", "broken", "cyclic"


def resolve_hierarchy(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", extra: tuple[str, ...] = (), paths: bool = True) -> DataFrame:
    """Path, depth, root and state of each node of a forest of unknown depth.

    ``nodes`` holds one row per id (see ``tables.current_rows``). Result columns:

    * ``node_id``, ``parent_id`` (null for a root), then the columns named in ``extra`` as they are
    * ``status``: ``rooted``; ``broken`` (the chain of parents ends at an id without a row);
      ``cyclic`` (the chain never ends: the node is on a loop or below one)
    * ``root_id``: the root, of a broken chain its topmost node, null for cyclic nodes
    * ``steps``: number of steps to ``root_id`` (0 for itself), null for cyclic nodes
    * ``path``: ids from ``root_id`` down to the node, null for cyclic nodes; only with ``paths``
    * ``anchor_id``: ``root_id``, or for cyclic nodes the smallest id on the loop, compared byte by byte

    Each round joins the unresolved nodes' pointers with all nodes, so jump distances double and path segments are
    concatenated. If a round resolves nobody, nobody that is left has a root: a node of depth d has ancestors of every
    smaller depth, and one of them would have been resolved. Those go on doubling among themselves, without paths,
    until jumps are longer than their number, which leaves each pointer on its loop.

    Every round is a written table: the unresolved side shrinks, and the planner broadcasts it once its file size
    allows, otherwise both sides are shuffled on the id. All nodes meet it with their pointer, steps and state only;
    paths are carried only if they are asked for, parents and ``extra`` only by the unresolved side. Empty input gives
    an empty result; null and empty parents mean none; ids that are null are left out; columns beyond those named are
    ignored.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "hierarchy")
    given = exact(nodes, *dict.fromkeys([id_col, parent_col, *extra])).where(F.col(id_col).isNotNull())
    given = given.select(F.col(id_col).alias("node_id"), blank_to_null(F.col(parent_col)).alias("parent_id"), *[F.col(c).alias(f"_x_{c}") for c in extra])
    _, base = scratch.write(given)
    known = base.select(F.col("node_id").alias("_known"))
    start = base.join(known, F.col("parent_id") == F.col("_known"), "left")
    is_top = F.col("_known").isNull()
    kept = ["parent_id", *[f"_x_{c}" for c in extra]]
    tail = {"path": F.array("node_id")} if paths else {}
    # is_rooted is null while a node is unresolved; low, the smallest id on the way, only counts for loops
    state = start.select(
        "node_id",
        *kept,
        F.when(is_top, F.col("parent_id").isNull()).alias("is_rooted"),
        F.when(is_top, F.col("node_id")).otherwise(F.col("parent_id")).alias("ptr"),
        F.when(is_top, 0).otherwise(1).cast("long").alias("steps"),
        F.when(~is_top, F.col("node_id")).alias("low"),
        *[c.alias(n) for n, c in tail.items()],
    )
    pending, jump = _Round(scratch, state), 1
    rounds = [pending.path]

    def resolved_so_far() -> DataFrame:
        # one scan of all rounds' folders; unresolved rows of a round are in the next one again
        return spark.read.schema(state.schema).parquet(*rounds).where(F.col("is_rooted").isNotNull())

    while pending.n_open:
        table = resolved_so_far().unionByName(pending.open).select(*[F.col(c).alias(f"{c}_t") for c in ("node_id", "is_rooted", "ptr", "steps", "low", *tail)])
        # unresolved pointers meet all nodes; a resolved target resolves, an unresolved one doubles the jump
        doubled = pending.open.join(table, F.col("ptr") == F.col("node_id_t")).select(
            "node_id",
            *kept,
            F.col("is_rooted_t").alias("is_rooted"),
            F.col("ptr_t").alias("ptr"),
            (F.col("steps") + F.col("steps_t")).alias("steps"),
            F.when(F.col("is_rooted_t").isNull(), F.least("low", "low_t")).alias("low"),
            *[F.concat(f"{c}_t", c).alias(c) for c in tail],
        )
        nxt, jump = _Round(scratch, doubled), jump * 2
        if not nxt.n_done:
            scratch.drop(nxt.path)
            break
        rounds.append(nxt.path)
        pending = nxt
    done = resolved_so_far().select("node_id", *kept, F.when(F.col("is_rooted"), ROOTED).otherwise(BROKEN).alias("status"), F.col("ptr").alias("root_id"), "steps", *tail, F.col("ptr").alias("anchor_id"))
    if pending.n_open:
        anchors = _loops(scratch, pending.open, pending.n_open, jump)
        none = {c: F.lit(None).cast(kind).alias(c) for c, kind in done.dtypes if c in ("root_id", "steps", "path")}
        cyclic = pending.open.select("node_id", *kept).join(anchors, "node_id").withColumn("status", F.lit(CYCLIC))
        done = done.unionByName(cyclic.select(*[none.get(c, F.col(c)) for c in done.columns]))
    return done.select("node_id", "parent_id", *[F.col(f"_x_{c}").alias(c) for c in extra], "status", "root_id", "steps", *tail, "anchor_id")


class _Round:
    """One written round: rows that are rooted or not are resolved, the others still point somewhere."""

    def __init__(self, scratch: Scratch, df: DataFrame):
        seen = Observation()
        self.path, table = scratch.write(
            df.observe(seen, F.count(F.col("is_rooted")).alias("done"), F.count(F.when(F.col("is_rooted").isNull(), 1)).alias("open"))
        )
        self.n_done, self.n_open = seen.get["done"] or 0, seen.get["open"] or 0
        self.open = table.where(F.col("is_rooted").isNull())


def _loops(scratch: Scratch, unresolved: DataFrame, n: int, jump: int) -> DataFrame:
    """(node_id, anchor_id) of nodes whose chains never end: the smallest id of the loop each one runs into."""
    path, loop = scratch.write(unresolved.select("node_id", "ptr", "low"))
    target = lambda t: t.select(F.col("node_id").alias("_id"), F.col("ptr").alias("_ptr"), F.col("low").alias("_low"))
    jump //= 2

    def doubled(t: DataFrame) -> DataFrame:
        return t.join(target(t), F.col("ptr") == F.col("_id")).select("node_id", F.col("_ptr").alias("ptr"), F.least("low", "_low").alias("low"))

    while jump < n:
        # two doublings between writes: these tables are small beside the jobs that write them
        old, (path, loop) = path, scratch.write(doubled(doubled(loop)))
        scratch.drop(old)
        jump *= 4
    return loop.join(target(loop), F.col("ptr") == F.col("_id")).select("node_id", F.col("_low").alias("anchor_id"))


def descendants(hierarchy: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance): each node under each of its ancestors, from the paths; nodes on loops have none."""
    up = hierarchy.where(F.col("path").isNotNull()).select("node_id", "steps", F.posexplode("path").alias("level", "ancestor_id"))
    return up.where(F.col("level") < F.col("steps")).select("ancestor_id", "node_id", (F.col("steps") - F.col("level")).alias("distance"))


def wrong_depths_and_loops(hierarchy: DataFrame, depth_col: str = "depth") -> DataFrame:
    """(node_id, anchor_id) of rooted nodes whose stored depth is not their steps to the root (null counts as wrong) and of all cyclic nodes."""
    wrong = (F.col("status") == ROOTED) & ~F.col(depth_col).cast("long").eqNullSafe(F.col("steps"))
    return hierarchy.where(wrong | (F.col("status") == CYCLIC)).select("node_id", "anchor_id")
