"""Rebuilding conversations from message rows: Kahn's order of the reply graph, then completeness."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import Scratch
from ..operators.positions import with_position
from ..session import ship
from ..tables import exact

# Role names and the kind of speaker each stands for.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "model": "assistant", "ai": "assistant", "tool": "tool", "function": "tool", "system": "system", "developer": "system"}
#: Order of the kinds of speakers within a turn that is a whole exchange.
KINDS = ["system", "user", "assistant", "tool"]
USER_PARTS = ["text", "input_text"]
REPLY_PARTS = ["text", "output_text"]
#: Turn numbers per segment of a session; a segment is ordered in one task, whatever the session's length.
SEGMENT_TURNS = 1_000


def _strip(column) -> F.Column:
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def speaker(role) -> F.Column:
    """user, assistant, tool or system; null for a role that is not in the list. Case and outer spaces do not count."""
    r = F.lower(_strip(role))
    return F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[r]


def _says(content, kinds: list[str]) -> F.Column:
    """Does a part of one of these types hold more than white space (Unicode's too)?"""
    return F.coalesce(F.exists(content, lambda p: p["type"].isin(kinds) & F.coalesce(p["text"].rlike(r"(?U)\S"), F.lit(False))), F.lit(False))


def turn_kinds(messages: DataFrame) -> DataFrame:
    """One row per session, turn and kind of speaker: what its rows hold together. Combines on the map side.

    Columns session_id, turn, kind (null for an unknown role), says (a user message or a reply is among them), first_ts.
    Rows delivered again change nothing. Rows without a session are left out.
    """
    messages = exact(messages, "session_id", "turn", "role", "ts", "content")
    kind = speaker(F.col("role"))
    says = F.when(kind == "user", _says(F.col("content"), USER_PARTS)).when(kind == "assistant", _says(F.col("content"), REPLY_PARTS)).otherwise(False)
    rows = messages.where(F.col("session_id").isNotNull()).select("session_id", F.col("turn").cast("long").alias("turn"), kind.alias("kind"), says.alias("says"), "ts")
    return rows.groupBy("session_id", "turn", "kind").agg(F.max("says").alias("says"), F.min("ts").alias("first_ts"))


def kahn(n: int, edges: list[tuple[int, int]], key: list) -> tuple[list[int], list[int]]:
    """Kahn's algorithm: (order, leftover). Of the nodes that are free, the one with the least key comes next; leftovers are on cycles or behind them."""
    waiting, after = [0] * n, [[] for _ in range(n)]
    for a, b in edges:
        waiting[b] += 1
        after[a].append(b)
    free = [(key[i], i) for i in range(n) if not waiting[i]]
    heapq.heapify(free)
    order = []
    while free:
        _, i = heapq.heappop(free)
        order.append(i)
        for b in after[i]:
            waiting[b] -= 1
            if not waiting[b]:
                heapq.heappush(free, (key[b], b))
    return order, [i for i in range(n) if waiting[i]]


def reply_graph(turns: list[int], kinds: list[int]) -> list[tuple[int, int]]:
    """Edges between the (turn, kind) nodes of a segment: within a turn system and user before assistant and tool, and all of a turn before the next turn's."""
    by_turn: dict[int, list[int]] = {}
    for i, t in enumerate(turns):
        by_turn.setdefault(t, []).append(i)
    edges, before = [], []
    for t in sorted(by_turn):
        here = by_turn[t]
        opening = [i for i in here if kinds[i] <= 1] or here
        rest = [i for i in here if i not in opening]
        edges += [(a, b) for a in before for b in opening] + [(a, b) for a in opening for b in rest]
        before = rest or opening
    return edges


SEGMENT_SCHEMA = (
    "session_id string, segment long, ranks array<struct<turn:long,kind:string,rank:int>>, n_turns int, low long, high long, "
    "has_user boolean, has_reply boolean, opened boolean, opens_with_user boolean, reply_first boolean, unanswered boolean, open_end boolean, cyclic boolean"
)


def _order_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Order each segment's reply graph and say what is known about it from inside."""
    code = {k: i for i, k in enumerate(KINDS)}
    for b in batches:
        out = []
        for session, segment, nodes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            turns, kinds = [x["turn"] for x in nodes], [code[x["kind"]] for x in nodes]
            key = [(x["first_ts"] is None, x["first_ts"] or 0, k) for x, k in zip(nodes, kinds)]
            order, left = kahn(len(nodes), reply_graph(turns, kinds), key)
            # walk the conversation turn by turn in that order
            users = {turns[i] for i in order if kinds[i] == 1 and nodes[i]["says"]}
            replies = {turns[i] for i in order if kinds[i] == 2 and nodes[i]["says"]}
            pending = unanswered = reply_first = False
            seen_user, opened, opens_with_user, last = False, False, False, None
            for i in order:
                t = turns[i]
                if kinds[i] != 0 and not opened:
                    opened, opens_with_user = True, t in users
                if t == last:
                    continue
                last = t
                if t in users:
                    unanswered |= pending
                    pending, seen_user = True, True
                if t in replies:
                    reply_first |= not seen_user
                    pending = False
            out.append(
                {
                    "session_id": session,
                    "segment": segment,
                    "ranks": [{"turn": turns[i], "kind": KINDS[kinds[i]], "rank": r} for r, i in enumerate(order)],
                    "n_turns": len(set(turns)),
                    "low": min(turns),
                    "high": max(turns),
                    "has_user": bool(users),
                    "has_reply": bool(replies),
                    "opened": opened,
                    "opens_with_user": opens_with_user,
                    "reply_first": reply_first,
                    "unanswered": unanswered,
                    "open_end": pending,
                    "cyclic": bool(left),
                }
            )
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW_SEGMENT)


_ARROW_SEGMENT = pa.schema(
    [
        ("session_id", pa.string()),
        ("segment", pa.int64()),
        ("ranks", pa.list_(pa.struct([("turn", pa.int64()), ("kind", pa.string()), ("rank", pa.int32())]))),
        ("n_turns", pa.int32()),
        ("low", pa.int64()),
        ("high", pa.int64()),
        *[(c, pa.bool_()) for c in ("has_user", "has_reply", "opened", "opens_with_user", "reply_first", "unanswered", "open_end", "cyclic")],
    ]
)


def order_segments(kinds: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """Each session's (turn, kind) nodes in Kahn's order, segment by segment of ``segment_turns`` turn numbers.

    A group holds at most four nodes per turn number of the segment, however many rows they stand for.
    """
    ship(kinds.sparkSession)
    known = kinds.where(F.col("turn").isNotNull() & F.col("kind").isNotNull())
    grouped = known.groupBy("session_id", F.floor(F.col("turn") / segment_turns).alias("segment")).agg(
        F.collect_list(F.struct("turn", "kind", "says", F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_ts"))).alias("nodes")
    )
    return grouped.select(F.col("session_id").cast("string"), "segment", "nodes").mapInArrow(_order_segments, SEGMENT_SCHEMA)


def session_verdicts(kinds: DataFrame, segments: DataFrame) -> DataFrame:
    """(session_id, reason): every session with the first reason to drop it, or null.

    ``empty`` no user message or no reply; ``broken`` a row without turn or known role; ``gaps`` turns that do not start
    at 0 or 1 or leave out a number; ``no_opening`` the first turn of another speaker than system holds no user message;
    ``unanswered`` a turn with a user message and no reply before the next one; ``cyclic`` its reply graph has a cycle.
    The window runs over a session's segments (one row per ``SEGMENT_TURNS`` turns), not over its messages.
    """
    broken = kinds.groupBy("session_id").agg(
        F.max(F.col("turn").isNull() | F.col("kind").isNull()).alias("broken"),
        F.max((F.col("kind") == "user") & F.col("says")).alias("has_user"),
        F.max((F.col("kind") == "assistant") & F.col("says")).alias("has_reply"),
    )
    later = Window.partitionBy("session_id").orderBy("segment").rowsBetween(1, Window.unboundedFollowing)
    # what ends the wait of an unanswered user at the end of a segment: a reply, or the next user
    event = F.when(F.col("reply_first"), "reply").when(F.col("has_user"), "user").when(F.col("has_reply"), "reply")
    s = segments.withColumn("event", event).withColumn("next_event", F.first("event", ignorenulls=True).over(later))
    left_open = F.col("open_end") & ~F.coalesce(F.col("next_event") == "reply", F.lit(False))
    whole = s.groupBy("session_id").agg(
        F.min("low").alias("low"),
        (F.max("high") - F.min("low") + 1 - F.sum("n_turns")).alias("missing"),
        F.min_by("opens_with_user", F.when(F.col("opened"), F.col("segment"))).alias("opens_with_user"),
        F.max(F.col("unanswered") | left_open).alias("unanswered"),
        F.max("cyclic").alias("cyclic"),
    )
    both = broken.join(whole, "session_id", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(no("has_user") | no("has_reply"), "empty")
        .when(F.col("broken"), "broken")
        .when(~F.col("low").isin(0, 1) | (F.col("missing") > 0), "gaps")
        .when(no("opens_with_user"), "no_opening")
        .when(F.col("unanswered"), "unanswered")
        .when(F.col("cyclic"), "cyclic")
    )
    return both.select("session_id", reason.alias("reason"))


def dropped_sessions(messages: DataFrame) -> DataFrame:
    """(session_id, reason) of the sessions to drop."""
    scratch = Scratch(messages.sparkSession, "conversations")
    _, kinds = scratch.write(turn_kinds(messages))
    return session_verdicts(kinds, order_segments(kinds)).where(F.col("reason").isNotNull())


def conversations(messages: DataFrame) -> DataFrame:
    """(session_id, position, message_id, kind, turn, text): the ordered messages of every session that is whole.

    Position counts from 0 in Kahn's order of (turn, kind), within it by timestamp (nulls last), then message_id. Rows
    delivered again (same session, turn, kind, timestamp and content) are one message under its lowest id; text is the
    parts' texts, one per line. The sort is range-partitioned over all sessions, so one of any length is spread over tasks.
    """
    spark = messages.sparkSession
    scratch = Scratch(spark, "conversations")
    _, kinds = scratch.write(turn_kinds(messages))
    _, segments = scratch.write(order_segments(kinds))
    good = session_verdicts(kinds, segments).where(F.col("reason").isNull()).select("session_id")
    # sessions are sorted out while they are a row per segment; messages meet them by session, turn and kind, so a long one is spread
    ranks = segments.join(good, "session_id", "left_semi").select("session_id", "segment", F.explode("ranks").alias("r")).select("session_id", "segment", "r.turn", "r.kind", "r.rank")
    text = F.array_join(F.filter(F.transform("content", lambda p: p["text"]), lambda t: t.isNotNull()), "\n")
    messages = exact(messages, "session_id", "turn", "role", "ts", "content", "message_id")
    rows = messages.select("session_id", F.col("turn").cast("long").alias("turn"), speaker(F.col("role")).alias("kind"), "ts", "message_id", F.to_json("content").alias("_content"), text.alias("text"))
    once = rows.groupBy("session_id", "turn", "kind", "ts", F.xxhash64("_content").alias("_hash"), "_content").agg(F.min("message_id").alias("message_id"), F.first("text").alias("text"))
    placed = once.join(ranks, ["session_id", "turn", "kind"])
    order = ["segment", "rank", F.col("ts").asc_nulls_last(), "message_id"]
    return with_position(placed, ["session_id"], order).select("session_id", "position", "message_id", "kind", "turn", "text")
