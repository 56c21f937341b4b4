import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from grovelake.functions import text
from grovelake.operators import graph, retrieval, stats, store, versions
from grovelake.sources import scan
from grovelake.streaming import reads


def test_depths_and_targets():
    assert [retrieval.clamp_depth(*a) for a in ((0, 1, 5), (-2, 3), (4, 1, 5), (9, 1, 5), (9, 1))] == [1, 3, 4, 5, 9]
    assert versions.rollback_target(3, 9) == 3
    for target in (0, -1, 10):
        with pytest.raises(ValueError):
            versions.rollback_target(target, 9)


def test_ignore_classes(spark):
    paths = ["a1.md", "a2.md", "ab.md", "x/a1.md", "b^.md", "a].md", "x/[k].md", "a-1.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    hit = lambda *rules: {r.p for r in df.where(scan.ignored(F.col("p"), list(rules))).collect()}
    assert hit("a[0-9].md") == {"a1.md", "a2.md", "x/a1.md"} and hit("/a[!0-9].md") == {"ab.md", "a].md"}
    assert hit("[^a]*[!1].md") == {"b^.md", "x/[k].md"} and hit("a[]b].md") == {"ab.md", "a].md"} and hit("*", "!x/") == set(paths) - {"x/a1.md", "x/[k].md"}


def test_common_folder(spark):
    folder = lambda *paths: text.common_folder(spark.createDataFrame([(p,) for p in paths], "p string"), "p")
    assert folder("/a/b/x.md", "/a/b/c/y.md", None) == "/a/b" and folder("/a/b/x.md", "/a/bc/y.md") == "/a"
    assert folder("a/x.md", "b/x.md") == "" == folder("x.md", "a/x.md") and folder("a/b/x.md") == "a/b" and folder(None) == "" == folder()


def test_padding(spark):
    rows = spark.createDataFrame([("äb",), ("abcdef",), (None,)], "t string").select(text.pad(F.col("t"), 4).alias("p"), text.short_hash(F.col("t"), 3).alias("h")).collect()
    assert [tuple(r) for r in rows] == [("äb  ", "äb"), ("abcdef", "abc"), ("    ", None)]


def test_upper_medians(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, rng.random()])) for _ in range(500)] + [("c", None), ("d", 0.5)]
    got = {r.g: r.median for r in stats.upper_medians(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    values = lambda g: sorted(x for k, x in rows if k == g and x is not None)
    assert got == {g: values(g)[len(values(g)) // 2] for g in ("a", "b", None, "d")}


def test_latest_root(spark):
    df = spark.createDataFrame([(1, "a"), (7, ""), (5, "b"), (None, "z"), (9, None)], "id long, compile_root string")
    assert store.latest_root(df).first()[0] == "b" and store.latest_root(df.limit(0)).first()[0] is None


def test_settled_references(spark):
    pending = spark.createDataFrame([(1, "s", "Plan", None, None, 0.0, "manual"), (2, "s", "none", None, None, 2.0, "manual"), (3, "s", None, None, "n2", 0.5, "parsed")], "id long, source_node_id string, target_label string, target_source string, target_id_hint string, weight double, origin string")
    nodes = spark.createDataFrame([("n1", "heading", " plan", "f", 1), ("n2", "text", None, "f", 2)], "id string, node_type string, label string, source_file string, depth int")
    edges, left = graph.settle(pending, nodes)
    assert {(r.id, r.target_node_id, r.weight) for r in edges.collect()} == {(1, "n1", 1.0), (3, "n2", 0.5)} and [r.id for r in left.collect()] == [2]


def test_nearest(spark):
    reached = spark.createDataFrame([("a", str(i), 1 + i % 2, float(i % 5)) for i in range(300)] + [("b", "gone", 1, 1.0)], "anchor_id string, node_id string, hop int, weight double")
    nodes = spark.createDataFrame([(str(i), i) for i in range(300)], "id string, token_count int")
    got = {r.node_id: r["rank"] for r in graph.nearest(reached, nodes, 100).collect()}
    want = sorted(range(300), key=lambda i: (1 + i % 2, -(i % 5), str(i)))[:100]
    assert got == {str(i): n + 1 for n, i in enumerate(want)}


def test_bursts_of_shuffled_files(spark, tmp_path):
    rng = random.Random(6)
    at, rows = datetime(2026, 1, 1), []
    for _ in range(600):
        at += timedelta(hours=rng.choice([0, 0, 1, 5, 11, 12, 13, 40]), minutes=rng.choice([0, 0, 30]))
        rows.append((rng.choice([1, 1, 1, 2]), at))
    rows += [(None, at), (1, None)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").repartition(20).write.parquet(str(tmp_path / "events"))
    want = []
    for u in (1, 2):
        last = None
        for t in sorted(t for k, t in rows if k == u and t):
            if last is None or t - last >= timedelta(hours=12):
                want.append([u, t, t, 0])
            want[-1][2:] = [t, want[-1][3] + 1]
            last = t
    got = reads.bursts_drained(reads.event_stream(spark, str(tmp_path / "events"), 3)).select("node_id", F.col("start").cast("timestamp_ntz"), F.col("last").cast("timestamp_ntz"), "n").collect()
    assert sorted(map(list, got)) == sorted(want)


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from types import SimpleNamespace

    from grovelake import durable

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://h:7077", getConf=lambda: SimpleNamespace(get=lambda _: None)))
    with pytest.raises(RuntimeError, match=re.escape("spark.checkpoint.dir")):
        durable.shared_root(fake)
