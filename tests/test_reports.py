import random

import pytest

from grovelake.durable import shared_root
from grovelake.operators import render, store
from grovelake.sources import logs

NODES = "id string, parent_id string, node_type string, label string, source_file string, token_count int, depth int"


def test_tree_lines_and_texts(spark):
    nodes = spark.createDataFrame([("r", None, "heading", "Top", "a.md", 3, 0), ("k", "r", "text", None, "a.md", 1, 1), ("m", "r", "text", "far", "b.md", None, 1)], NODES)
    got = [r.line for r in render.tree_lines(nodes).orderBy("root_id", "path").collect()]
    assert got == ["[r] heading: Top (3 tok)  a.md", "  [k] text:  (1 tok)", "  [m] text: far (0 tok)  b.md"]
    assert render.tree_lines(nodes, 1).count() == 1
    d = spark.createDataFrame([("n", "mod", "a", "b"), ("o", "rem", "x", None)], "node_id string, op string, old_content string, new_content string")
    assert {r.text for r in render.diff_texts(d).collect()} == {"~ n\n@@ -1 +1 @@\n-a\n+b", "- o\n@@ -1 +0,0 @@\n-x"}
    body = render.json_rows(nodes.select("id", "label"), "node").where("body like '%null%'").collect()
    assert [r.body for r in body] == ['{"id":"k","label":null}']


def test_snapshot_list_and_prune(spark):
    s = spark.createDataFrame([(1,), (2,), (4,)], "id long")
    assert [(r.id, r.is_head) for r in render.snapshot_list(s, 4, 2).collect()] == [(4, True), (2, False)]
    with pytest.raises(ValueError):
        render.snapshot_list(s, 4, 0)
    d = spark.createDataFrame([(1, 1), (2, 2), (3, 4)], "id long, snapshot_id long")
    a, b = store.prune_after(s, d, 1, 4)
    assert sorted(r.id for r in a.collect()) == [1, 4] and b.count() == 2


def test_log_rotation_and_compaction(spark):
    path = f"{shared_root(spark)}/test-log-{random.random()}"
    rows = spark.createDataFrame([("s", 1, 5), ("s", 1, 9), ("t", 0, 2)], "session_id string, connected_at long, last_seen long")
    assert not logs.append_log(rows, path, 10**6)
    assert logs.append_log(rows, path, 1)
    assert spark.read.json(path).count() == 3 and spark.read.json(f"{path}.1").count() == 3
    logs.compact_ledger(spark, path, "session_id string, connected_at long, last_seen long")
    assert [(r.session_id, r.last_seen) for r in spark.read.json(path).orderBy("connected_at").collect()] == [("t", 2), ("s", 9)]
    kept, dropped = logs.last_rows(spark.range(12), "id", 5)
    assert kept.count() == 5 and dropped.first().dropped == 7
