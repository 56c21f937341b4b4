import random

from grovelake.durable import shared_root
from grovelake.operators import changefeed as c

DIFFS = "id long, snapshot_id long, node_id string, op string, old_hash string, new_hash string, new_content string"


def brute(rows, snaps):
    one = {}
    for i, s, n, op, a, b, _ in rows:
        op = op.strip(" ").lower() if op else None
        if s in snaps and n is not None and i is not None and op in ("add", "mod", "rem"):
            k = (s, n, op, a, b)
            one[k] = min(i, one.get(k, i))
    last = {}
    for (s, n, op, _, _), i in one.items():
        last[n] = max(last.get(n, (-1, -1, "")), (s, i, op))
    return {(n, i) for n, (s, i, op) in last.items() if op != "rem"}


def run(spark, rows, snaps):
    state = c.latest_state(spark.createDataFrame(rows, DIFFS), spark.createDataFrame([(s,) for s in snaps], "id long"))
    return {tuple(r) for r in c.existing_nodes(state).collect()}


def test_random_feeds_with_a_hot_node(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        node = "hot" if rng.random() < 0.4 else f"n{rng.randrange(40)}"
        row = (i, rng.randrange(12), node, rng.choice(["add", " MOD", "rem ", "Rem", "mod"]), rng.choice([None, "a"]), rng.choice([None, "b", "c"]), "t")
        rows.append(row)
        if rng.random() < 0.2:
            rows.append((i + 1000, *row[1:]))
    rng.shuffle(rows)
    snaps = [0, 1, 2, 3, 5, 6, 8, 9, 9, 10]
    assert run(spark, rows, snaps) == brute(rows, set(snaps))


def test_repeated_change_counts_under_its_lowest_id(spark):
    rows = [(10, 5, "n", "add", None, "h", "x"), (11, 5, "n", "rem", "h", None, None), (12, 5, "n", "ADD", None, "h", "x")]
    assert run(spark, rows, [5]) == set()
    assert run(spark, rows[::2], [5]) == {("n", 10)}


def test_nulls_unknown_ops_and_empty_tables(spark):
    rows = [(1, 1, None, "add", None, None, None), (2, None, "a", "add", None, None, None), (3, 1, "a", None, None, None, None), (4, 1, "a", "drop", None, None, None), (None, 1, "b", "add", None, None, None)]
    assert run(spark, rows, [1]) == set()
    assert run(spark, [], []) == set()
    assert run(spark, [(1, 1, "a", "add", None, None, None)], []) == set()


def test_content_and_clashing_columns(spark):
    rows = [(1, 1, "a", "add", None, "h", "one", 5, "x"), (2, 2, "a", "mod", "h", "i", "x" * 200_000, 5, "x")]
    diffs = spark.createDataFrame(rows, DIFFS + ", diff_id long, OP string")
    state = c.latest_state(diffs, spark.createDataFrame([(1,), (2,)], "id long"))
    got = c.with_content(c.existing_nodes(state), diffs).collect()
    assert [(r.node_id, r.diff_id, len(r.content)) for r in got] == [("a", 2, 200_000)]


def test_publish_swaps_in_one_step(spark):
    root = f"{shared_root(spark)}/test-publish-{random.random()}"
    assert c.current_version(spark, root) is None
    first = c.publish(spark.range(3), root)
    assert c.current_version(spark, root) == first
    second = c.publish(spark.range(5), root)
    assert c.current_version(spark, root) == second != first
    assert spark.read.parquet(second).count() == 5 and spark.read.parquet(first).count() == 3
