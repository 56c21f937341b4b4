import random

from grovelake.operators import hierarchy as h
from grovelake.operators.store import delete_cascade, delete_reparent, tree_preorder
from grovelake.tables import current_rows, exact

SCHEMA = "id string, parent_id string, depth int"


def brute(rows):
    """id -> (status, root, steps, anchor) by walking up."""
    parent = {i: p or None for i, p, _ in rows if i is not None}
    out = {}
    for i in parent:
        seen, at = [], i
        while True:
            if at in seen:
                out[i] = ("cyclic", None, None, min(seen[seen.index(at) :]))
                break
            seen.append(at)
            if parent[at] is None or parent[at] not in parent:
                out[i] = ("rooted" if parent[at] is None else "broken", at, len(seen) - 1, at)
                break
            at = parent[at]
    return out


def solve(spark, rows):
    got = h.resolve_hierarchy(spark.createDataFrame(rows, SCHEMA), extra=("depth",)).collect()
    return {r.node_id: (r.status, r.root_id, r.steps, r.anchor_id) for r in got}, got


def test_random_forests_with_loops(spark):
    rng = random.Random(5)
    for n in (1, 40, 150):
        ids = [f"n{i}" for i in range(n)]
        rows = [(i, rng.choice([None, "", "gone", *ids, *ids]), 0) for i in ids]
        got, all_ = solve(spark, rows)
        assert got == brute(rows)
        for r in all_:
            if r.status != "cyclic":
                assert r.path[0] == r.root_id and r.path[-1] == r.node_id and len(r.path) == r.steps + 1


def test_long_chain_self_loop_and_two_loops(spark):
    rows = [("c0", None, 0)] + [(f"c{i}", f"c{i - 1}", i) for i in range(1, 70)]
    rows += [("s", "s", 1), ("a", "b", 1), ("b", "a", 1), ("t", "a", 1), ("u", "t", 9), (None, "a", 1)]
    got, _ = solve(spark, rows)
    assert got["c69"] == ("rooted", "c0", 69, "c0")
    assert got["s"][3] == "s" and got["u"] == ("cyclic", None, None, "a")
    found = h.wrong_depths_and_loops(h.resolve_hierarchy(spark.createDataFrame(rows, SCHEMA), extra=("depth",))).collect()
    assert {tuple(r) for r in found} == {("s", "s"), ("a", "a"), ("b", "a"), ("t", "a"), ("u", "a")}


def test_empty_null_depth_and_clashing_columns(spark):
    assert h.resolve_hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([("r", None, None, "x", "y"), ("k", "r", 1, "x", "y")], SCHEMA + ", ID string, path string")
    got = h.resolve_hierarchy(df, extra=("depth",))
    assert [tuple(r) for r in h.wrong_depths_and_loops(got).collect()] == [("r", "r")]
    assert exact(df, "id").columns == ["id"]


def test_descendants_and_versions(spark):
    rows = [("r", "", 0), ("a", "r", 1), ("b", "a", 2)]
    d = h.descendants(h.resolve_hierarchy(spark.createDataFrame(rows, SCHEMA)))
    assert {tuple(r) for r in d.collect()} == {("r", "a", 1), ("r", "b", 2), ("a", "b", 1)}
    v = spark.createDataFrame([("x", "old", 1), ("x", "new", 5), ("x", "new", 5), ("y", None, None), (None, "z", 1)], "id string, parent_id string, updated_at long")
    assert {tuple(r) for r in current_rows(v, "parent_id").collect()} == {("x", "new"), ("y", None)}


def test_deletes_and_preorder(spark):
    rows = [("r", None, 0), ("a", "r", 1), ("b", "a", 2), ("c", "b", 3), ("d", "r", 1)]
    nodes, ids = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a",), ("b",)], "id string")
    assert {r.id for r in delete_cascade(nodes, ids).collect()} == {"r", "d"}
    assert {(r.id, r.parent_id) for r in delete_reparent(nodes, ids).collect()} == {("r", None), ("c", "r"), ("d", "r")}
    assert [r.node_id for r in tree_preorder(nodes).orderBy("position").collect()] == ["r", "a", "b", "c", "d"]
