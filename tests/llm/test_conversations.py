import random
from datetime import datetime

from grovelake.llm import conversations as c

SCHEMA = "message_id long, session_id string, role string, turn int, ts timestamp, content array<struct<type:string,text:string,name:string>>"
T0 = datetime(2025, 1, 1)


def msg(i, s, role, turn, text="hi", kind="text", ts=T0):
    return (i, s, role, turn, ts, None if text is None and kind is None else [(kind, text, None)])


def verdict(rows):
    """Reason to drop one session, by plain reading of the rules."""
    roles = {"user": "u", "human": "u", "assistant": "a", "model": "a", "ai": "a", "tool": "t", "function": "t", "system": "s", "developer": "s"}
    seen = [(roles.get((r[2] or "").strip().lower()), r[3], any(p[0] in kinds and p[1] is not None and p[1].strip() for kinds in [("text", "input_text") if roles.get((r[2] or "").strip().lower()) == "u" else ("text", "output_text")] for p in r[5] or [])) for r in rows]
    users = {t for k, t, ok in seen if k == "u" and ok}
    replies = {t for k, t, ok in seen if k == "a" and ok}
    if not users or not replies:
        return "empty"
    if any(k is None or t is None for k, t, _ in seen):
        return "broken"
    turns = sorted({t for _, t, _ in seen})
    if turns[0] not in (0, 1) or turns != list(range(turns[0], turns[-1] + 1)):
        return "gaps"
    if min(t for k, t, _ in seen if k != "s") not in users:
        return "no_opening"
    u = sorted(users)
    for a, b in zip(u, [*u[1:], 10**9]):
        if not any(a <= r < b for r in replies):
            return "unanswered"
    return None


def test_random_sessions_against_the_rules(spark):
    rng = random.Random(11)
    rows, n = [], 0
    for s in range(150):
        turn = rng.choice([0, 1, 1, 1, 2])
        for _ in range(rng.randint(1, 9)):
            for role in rng.choice([["user", "assistant"], [" User "], ["AI"], ["Model", "tool"], ["human"], ["system"], ["function"]]):
                text = rng.choice(["x", "x", "x", "x", " 　", None])
                rows.append(msg(n, f"s{s}", role if rng.random() > 0.02 else rng.choice([None, "bot"]), turn if rng.random() > 0.02 else None, text, rng.choice(["text", "text", "input_text", "output_text", "tool_use"])))
                n += 1
            turn += rng.choice([1, 1, 1, 1, 1, 2]) if rng.random() < 0.1 else 1
    rng.shuffle(rows)
    want = {}
    for s in {r[1] for r in rows}:
        v = verdict([r for r in rows if r[1] == s])
        if v:
            want[s] = v
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.session_id: r.reason for r in c.dropped_sessions(df).collect()} == want
    # segments of two turns give the same: what one leaves open the next ones close
    kinds = c.turn_kinds(df).cache()
    got = c.session_verdicts(kinds, c.order_segments(kinds, 2)).where("reason is not null")
    assert {r.session_id: r.reason for r in got.collect()} == want


def test_kahn_orders_and_leaves_cycles():
    assert c.kahn(4, [(0, 2), (1, 2), (2, 3)], [5, 1, 0, 0]) == ([1, 0, 2, 3], [])
    assert c.kahn(4, [(0, 1), (1, 2), (2, 1), (2, 3)], [0, 0, 0, 0]) == ([0], [1, 2, 3])


def test_ordered_conversations(spark):
    later = datetime(2025, 1, 2)
    rows = [msg(3, "s", "assistant", 1, "b", ts=T0), msg(1, "s", "user", 1, "a", ts=later), msg(9, "s", "user", 1, "a", ts=later), msg(4, "s", "user", 2, "c", ts=T0), msg(6, "s", "ai", 2, "e", ts=later), msg(5, "s", "ai", 2, "d", ts=None), msg(7, "x", "user", 1)]
    got = c.conversations(spark.createDataFrame(rows, SCHEMA)).orderBy("session_id", "position").collect()
    assert [(r.session_id, r.position, r.message_id, r.text) for r in got] == [("s", 0, 1, "a"), ("s", 1, 3, "b"), ("s", 2, 4, "c"), ("s", 3, 6, "e"), ("s", 4, 5, "d")]


def test_nulls_empty_and_clashing_columns(spark):
    assert c.dropped_sessions(spark.createDataFrame([], SCHEMA)).count() == 0
    assert c.conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, None, "user", 1, T0, None, "k"), (2, "s", None, None, None, None, "k")], SCHEMA + ", Kind string")
    assert [tuple(r) for r in c.dropped_sessions(df).collect()] == [("s", "empty")]
