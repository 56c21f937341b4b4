"""Heat of nodes: decay over time, boosts by reads, cold nodes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Decay per hour, hours of a tick, what a read adds, temperature of a new node.
RATE, TICK_HOURS, BOOST, START = 0.05, 5 / 60, 0.15, 0.5
#: Below this a node is cold, below that it is notified; nodes of one report; seconds between notes of one node.
COLD, NOTIFY, COLD_LIMIT, NOTIFY_TTL = 0.1, 0.05, 50, 3600


def decay_factor(rate: float, hours: float) -> float:
    return 1.0 if rate == 0 or hours == 0 else math.exp(-rate * hours)


def clamp(t) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def decay_tick(nodes: DataFrame, rate: float = RATE, hours: float = TICK_HOURS) -> DataFrame:
    """Nodes with the temperature after one tick: unpinned ones above 0 cool down."""
    cools = (F.col("temperature") > 0) & ~F.col("pinned")
    return nodes.withColumn("temperature", F.when(cools, clamp(F.col("temperature") * decay_factor(rate, hours))).otherwise(F.col("temperature")))


def boost(nodes: DataFrame, read: DataFrame, now: int, by: float = BOOST) -> DataFrame:
    """Nodes after a read of ``read`` (id, each once): warmer, counted, stamped."""
    hit = F.col("_read").isNotNull()
    marked = nodes.join(read.select("id", F.lit(True).alias("_read")).distinct(), "id", "left")
    new = {
        "temperature": F.when(hit, clamp(F.col("temperature") + by)).otherwise(F.col("temperature")),
        "access_count": F.when(hit, F.col("access_count") + 1).otherwise(F.col("access_count")),
        "last_accessed_at": F.when(hit, F.lit(now)).otherwise(F.col("last_accessed_at")),
    }
    return marked.select(*[new[c].alias(c) if c in new else F.col(c) for c in nodes.columns])


def cold_nodes(nodes: DataFrame, threshold: float = COLD, limit: int = COLD_LIMIT) -> DataFrame:
    """The ``limit`` coldest unpinned nodes below the threshold; ties by id."""
    return nodes.where((F.col("temperature") < threshold) & ~F.col("pinned")).orderBy("temperature", "id").limit(limit)


def to_notify(nodes: DataFrame, notified: DataFrame, now: int, threshold: float = NOTIFY, ttl: int = NOTIFY_TTL) -> DataFrame:
    """(id, temperature): cold unpinned nodes that were not notified (id, notified_at) within ``ttl`` seconds."""
    recent = notified.where(F.col("notified_at") > now - ttl).select("id").distinct()
    return nodes.where((F.col("temperature") < threshold) & ~F.col("pinned")).select("id", "temperature").join(recent, "id", "left_anti")


def heat_state(t: float, at: float | None, times, rate: float = RATE, by: float = BOOST) -> tuple[float, float | None]:
    """Temperature after reads at ``times`` (seconds, in order): it decays up to each read, then rises and is cut to 1."""
    for x in times:
        if at is not None and x > at:
            t *= math.exp(-rate * (x - at) / 3600)
        t, at = min(1.0, t + by), x if at is None else max(at, x)
    return t, at


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads sorted by (node, segment, time): each segment as a function t -> min(cap, a * t + b)."""
    key, state, out = None, None, []
    for b in batches:
        for node, seg, x in zip(b["node"], b["segment"], b["at"]):
            if (node, seg) != key:
                if key is not None:
                    out.append((*key, *state))
                key, state = (node, seg), [x, x, 1.0, BOOST, 1.0, 0]
            else:
                f = math.exp(-RATE * (x - state[1]) / 3600)
                state[1], state[2], state[3], state[4] = x, state[2] * f, state[3] * f + BOOST, min(1.0, state[4] * f + BOOST)
            state[5] += 1
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=_SEGMENT)
            out = []
    if key is not None:
        out.append((*key, *state))
    yield pd.DataFrame(out, columns=_SEGMENT)


_SEGMENT = ["node", "segment", "first", "last", "a", "b", "cap", "n"]


def heat_fold(reads: DataFrame, node: str, ts: str, start: float = START, segment_hours: int = 24 * 7) -> DataFrame:
    """(node_id, reads, temperature): heat at each node's last read, from a log of reads.

    Decay and the cut at 1 do not commute, so the order counts; but a run of reads is a function
    t -> min(cap, a * t + b), and such functions compose. Reads are folded per node and time segment (sorted within
    partitions, so one node's log is spread over its segments), and the few segments of a node are composed in order.
    Repeated reads count each; null nodes and times are left out.
    """
    ship(reads.sparkSession)
    kind = reads.schema[node].dataType.simpleString()
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    rows = reads.where(F.col(node).isNotNull() & F.col(ts).isNotNull()).select(F.col(node).alias("node"), at.alias("at"))
    rows = rows.withColumn("segment", F.floor(F.col("at") / (segment_hours * 3600)))
    folded = rows.repartition("node", "segment").sortWithinPartitions("node", "segment", "at").mapInPandas(
        _fold, f"node {kind}, segment long, first double, last double, a double, b double, cap double, n long"
    )
    parts = F.array_sort(F.collect_list(F.struct("segment", "first", "last", "a", "b", "cap", "n")))
    begin = F.struct(F.lit(float(start)).alias("t"), F.lit(None).cast("double").alias("at"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        cooled = acc["t"] * F.coalesce(F.exp(-RATE * (x["first"] - acc["at"]) / 3600), F.lit(1.0))
        return F.struct(F.least(x["cap"], x["a"] * cooled + x["b"]).alias("t"), x["last"].alias("at"), (acc["n"] + x["n"]).alias("n"))

    done = folded.groupBy("node").agg(F.aggregate(parts, begin, step).alias("s"))
    return done.select(F.col("node").alias("node_id"), F.col("s.n").alias("reads"), F.col("s.t").alias("temperature"))
