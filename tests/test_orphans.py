from unittest import mock

from grovelake.operators import orphans as o

NODES = "id string, parent_id string, node_type string, label string, source_file string, created_at long, updated_at long"
RELATIONS = "id long, target_node_id string, created_at long"
PENDING = "id long, target_label string, target_source string, target_id_hint string, created_at long"
JAN, FEB = 1735689600, 1738367999 + 1


def run(spark, nodes, relations, pending):
    got = o.orphan_records(spark.createDataFrame(nodes, NODES), spark.createDataFrame(relations, RELATIONS), spark.createDataFrame(pending, PENDING))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


NODE_ROWS = [
    ("a", None, "heading", " Über Uns ", "/v/x/notes.md", JAN, 1),
    ("b", "a", "text", "t", "/v/x/notes.md", JAN, 1),
    ("c", "zz", "text", "t", "/v/x/other.md", FEB, 1),
    ("d", "zz", "text", "t", "f", JAN, 1),
    ("d", "a", "text", "t", "f", JAN, 2),
    ("e", "", "heading", "Plan", "plan.md", JAN, 1),
    ("e", "", "heading", "Old name", "plan.md", JAN, 0),
]


def test_all_kinds(spark):
    rel = [(1, "a", JAN), (2, "A", FEB), (3, "gone", None), (3, "gone", None), (4, None, JAN)]
    pend = [
        (1, "über uns", None, None, JAN),
        (2, "ÜBER UNS ", "notes.md", "", JAN),
        (3, "über uns", "x/notes.md", None, JAN),
        (4, "über uns", "otes.md", None, JAN),
        (5, "nothing", None, "a", JAN),
        (6, "plan", None, "gone", FEB),
        (7, "Old name", "", None, JAN),
        (8, None, None, None, JAN),
        (9, "plan", "plan.md", None, JAN),
        (10, "plan", "/v/x/notes.md", None, JAN),
        (10, "plan", "/v/x/notes.md", None, JAN),
    ]
    want = {("nodes", "2025-02", "c"), ("relations", "2025-02", "2"), ("relations", None, "3"), ("relations", "2025-01", "4")}
    want |= {("pending_relations", "2025-01", i) for i in ("4", "7", "8", "10")} | {("pending_relations", "2025-02", "6")}
    assert run(spark, NODE_ROWS, rel, pend) == want


def test_hot_key_is_spread_without_loss(spark):
    rel = [(i, "gone" if i % 3 else "a", JAN) for i in range(3000)]
    with mock.patch.object(o, "HOT_KEY_ROWS", 100):
        assert len(run(spark, NODE_ROWS, rel, [])) == 2000 + 1


def test_empty_tables_and_counts(spark):
    assert run(spark, [], [], []) == set()
    got = run(spark, [], [(1, "a", JAN)], [(1, "x", None, None, FEB)])
    assert got == {("relations", "2025-01", "1"), ("pending_relations", "2025-02", "1")}
    counts = o.orphan_counts(spark.createDataFrame(list(got), "table_name string, created_month string, record_id string"))
    assert {tuple(r) for r in counts.collect()} == {("relations", "2025-01", 1), ("pending_relations", "2025-02", 1)}
