"""Scores, budgets and contexts: what of the tree goes into an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..durable import Scratch
from .hierarchy import resolve_hierarchy
from .positions import with_position, with_running_sum

#: Candidates that a budget is filled from at a time; see ``greedy_budget``.
BLOCK = 1_024
#: Ids of one batch at most, rows that are numbered in one task, and ancestors that are looked up one by one.
MOST_IDS, FEW_ROWS, LOOKUPS = 256, 100_000, 64


def recency(last_accessed_at, now: int) -> Column:
    """1 for what was never read, else 1 / (1 + days since), counted in hours / 24."""
    hours = F.greatest((F.lit(now) - last_accessed_at) / F.lit(3600.0), F.lit(0.0))
    return F.when(last_accessed_at.isNull(), F.lit(1.0)).otherwise(1.0 / (1.0 + hours / 24.0))


def score(relevance, temperature, last_accessed_at, now: int) -> Column:
    """relevance x (0.3 + 0.7 x temperature, cut to 0..1) x recency."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(temperature, F.lit(0.0))))
    return relevance * (0.3 + 0.7 * t) * recency(last_accessed_at, now)


def greedy_budget(candidates: DataFrame, budget: int, tokens: str = "token_count", by: str = "score", key: str = "node_id") -> DataFrame:
    """The candidates that fit, in order of score: one that does not fit is skipped and the filling goes on.

    The rule is sequential, so it runs in blocks: of the candidates that fit the room left, the best ``BLOCK`` come to
    the driver (key, score, tokens only) and are folded in order; then the room is smaller and the next block follows,
    until nothing fits. A block's first row always fits, and at most ``budget`` rows with tokens are kept; rows without
    tokens always fit and are not folded. ``budget`` <= 0 keeps all. Ties go by key; null scores come last; null tokens
    count as 0.
    """
    if budget <= 0:
        return candidates
    spark = candidates.sparkSession
    size = F.coalesce(F.col(tokens), F.lit(0)).cast("long")
    slim = candidates.select(F.col(key).alias("k"), F.col(by).alias("s"), size.alias("n")).where(F.col("n") > 0)
    left, kept, last = budget, [], None
    while left > 0:
        rest = slim.where(F.col("n") <= left)
        if last is not None:
            s, k = last
            after = (F.col("s") < s) | ((F.col("s") == s) & (F.col("k") > k)) | F.col("s").isNull() if s is not None else F.col("s").isNull() & (F.col("k") > k)
            rest = rest.where(after)
        block = rest.orderBy(F.col("s").desc_nulls_last(), "k").limit(BLOCK).collect()
        for r in block:
            if r["n"] <= left:
                left -= r["n"]
                kept.append((r["k"],))
        if len(block) < BLOCK:
            break
        if last is None:
            _, slim = Scratch(spark, "budget").write(slim)  # what the next blocks are taken from
        last = (block[-1]["s"], block[-1]["k"])
    kinds = candidates.schema[key].dataType.simpleString()
    chosen = spark.createDataFrame(kept, f"{key} {kinds}")  # at most one row per token of the budget
    return candidates.where(size == 0).unionByName(candidates.where(size > 0).join(F.broadcast(chosen), key, "left_semi"))


def prefix_budget(candidates: DataFrame, budget: int, order: list, tokens: str = "token_count", group: list[str] | None = None) -> DataFrame:
    """The longest prefix of each group, in ``order`` (total), whose tokens fit: it stops at the first overflow. <= 0 keeps all."""
    if budget <= 0:
        return candidates
    rows = candidates if group else candidates.withColumn("_all", F.lit(0))
    kept = with_running_sum(rows, group or ["_all"], order, tokens, "_sum").where(F.col("_sum") <= budget)
    return kept.select(*candidates.columns)


def clamp_depth(asked: int, default: int, most: int = 0) -> int:
    """The depth that a request means: ``default`` for none (0 or less), at most ``most`` where that is above 0."""
    if asked <= 0:
        return default
    return min(asked, most) if most > 0 else asked


def context(nodes: DataFrame, anchor: str, depth: int = 32) -> DataFrame:
    """(node_id, relation): ancestors, descendants up to ``depth`` levels and siblings of one node, each node once under the first that applies; without the anchor. Siblings of a root are none.

    A node on a loop has neither ancestors nor descendants. The answer is reached from the anchor: one look-up per
    ancestor (from ``LOOKUPS`` on, pointer doubling), one join per level below with the level before, a written table
    which the planner broadcasts if its size allows. Nothing is computed for the rest of the forest but a scan of id and
    parent per level.
    """
    _, links = Scratch(nodes.sparkSession, "links").write(nodes.select("id", "parent_id"))
    return _reach(links, anchor, depth)


def _reach(links: DataFrame, anchor: str, depth: int) -> DataFrame:
    """``context`` over a written table of id and parent_id."""
    spark = links.sparkSession
    scratch = Scratch(spark, "context")
    up, at, loop = [], anchor, False
    while at is not None and not loop:
        row = links.where(F.col("id") == at).select("parent_id").first()
        at = row[0] if row else None
        if row and at is not None:
            loop = at == anchor or at in up
            up.append(at)
        if len(up) == LOOKUPS and not loop:
            own = resolve_hierarchy(links).where(F.col("node_id") == anchor).select("path").first()
            loop, up = own["path"] is None, up[:1] if own["path"] is None else own["path"][-2::-1]
            break
    parent = up[0] if up else None
    if up and not loop and row is None:
        up.pop()  # the chain ends at an id without a row
    levels = []
    children = links.select(F.col("parent_id").alias("_up"), F.col("id").alias("node_id"))
    front = None
    for _ in range(0 if loop else depth):
        seen = Observation()
        step = children.where(F.col("_up") == anchor) if front is None else children.join(front.select(F.col("node_id").alias("_up")), "_up")
        path, front = scratch.write(step.select("node_id").observe(seen, F.count("*").alias("n")))
        if not seen.get["n"]:
            break
        levels.append(path)
    rows = spark.createDataFrame([(i, 0) for i in ([] if loop else up)], "node_id string, r int")
    if levels:
        rows = rows.unionByName(spark.read.schema("node_id string").parquet(*levels).withColumn("r", F.lit(1)))
    if parent is not None:
        rows = rows.unionByName(links.where(F.col("parent_id") == parent).select(F.col("id").alias("node_id"), F.lit(2).alias("r")))
    names = F.element_at(F.array(F.lit("ancestor"), F.lit("descendant"), F.lit("sibling")), F.min("r") + 1)
    return rows.where(F.col("node_id") != anchor).groupBy("node_id").agg(names.alias("relation"))


def fetch(nodes: DataFrame, anchor: str, budget: int, now: int, depth: int = 32) -> DataFrame:
    """(node_id, relation, score, token_count, position): the anchor with its context under a token budget, best last.

    The anchor is always there and comes last, even over budget; the rest has what it leaves (nothing is kept of the
    rest where it leaves nothing).
    """
    scratch = Scratch(nodes.sparkSession, "fetch")
    _, nodes = scratch.write(nodes.select("id", "parent_id", "temperature", "last_accessed_at", "token_count"))
    own = nodes.where(F.col("id") == anchor).select(F.col("id").alias("node_id"), F.lit("anchor").alias("relation"), F.lit(None).cast("double").alias("score"), "token_count")
    head = own.select("token_count").collect()
    if not head:
        raise KeyError(anchor)
    rest = nodes.withColumnRenamed("id", "node_id").join(_reach(nodes.select("id", "parent_id"), anchor, depth), "node_id")
    rest = rest.select("node_id", "relation", score(F.lit(1.0), F.col("temperature"), F.col("last_accessed_at"), now).alias("score"), "token_count")
    if budget > 0:
        room = budget - (head[0][0] or 0)
        rest = greedy_budget(scratch.write(rest)[1], room) if room > 0 else rest.limit(0)
    seen = Observation()
    _, kept = scratch.write(rest.unionByName(own).observe(seen, F.count("*").alias("n")))
    best_last = [F.col("score").asc_nulls_last(), F.col("node_id").desc()]
    if seen.get["n"] <= FEW_ROWS:
        return kept.withColumn("position", F.row_number().over(Window.orderBy(*best_last)) - 1)
    placed = with_position(kept.withColumn("_all", F.lit(0)), ["_all"], best_last)
    return placed.select("node_id", "relation", "score", "token_count", "position")


def fetch_batch(nodes: DataFrame, ids: list[str], budget: int) -> DataFrame:
    """(position, node_id, status, token_count): the asked ids in their order, each once: kept, over_budget or missing.

    At most ``MOST_IDS`` ids, so the fold over them is one small row.
    """
    if not 0 < len(ids) <= MOST_IDS:
        raise ValueError(f"1 to {MOST_IDS} ids")
    spark = nodes.sparkSession
    once = list(dict.fromkeys(ids))
    asked = spark.createDataFrame(list(enumerate(once)), "position int, node_id string")
    found = nodes.select(F.col("id").alias("node_id"), F.lit(True).alias("here"), F.col("token_count").cast("long").alias("n")).join(F.broadcast(asked), "node_id", "left_semi")
    rows = asked.join(F.broadcast(found), "node_id", "left")
    queue = F.array_sort(F.collect_list(F.struct("position", "node_id", "here", "n")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<position:int,node_id:string,status:string,token_count:bigint>>").alias("out"))

    def step(acc, x):
        n = F.coalesce(x["n"], F.lit(0).cast("long"))
        fits = x["here"].isNotNull() & ((F.lit(budget) <= 0) | (acc["used"] + n <= budget))
        status = F.when(x["here"].isNull(), "missing").when(fits, "kept").otherwise("over_budget")
        row = F.struct(x["position"].alias("position"), x["node_id"].alias("node_id"), status.alias("status"), x["n"].alias("token_count"))
        return F.struct((acc["used"] + F.when(fits, n).otherwise(F.lit(0).cast("long"))).alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    done = rows.agg(F.aggregate(queue, start, step)["out"].alias("out"))
    return done.select(F.inline("out"))
