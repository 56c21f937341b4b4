import random

import pytest
from pyspark.sql import functions as F

from grovelake.durable import Scratch
from grovelake.functions.ids import xxh64
from grovelake.operators import graph, heat, positions, retrieval, search, stats, store, versions
from grovelake.operators.positions import with_position

CHANGES = "id long, snapshot_id long, node_id string, op string, old_hash string, new_hash string, old_content string, new_content string, old_parent_id string, old_source_file string, old_node_type string, old_depth int, old_label string, old_format string, old_token_count int"


def changes(spark, rows):
    """Rows (id, snapshot, node, op, old, new); hashes equal contents; metadata of the old side where there is one."""
    full = [(i, s, n, op, a, b, a, b, None, "f" if a is not None else None, "text", 1, "l", "plain", 1) for i, s, n, op, a, b in rows]
    return spark.createDataFrame(full, CHANGES)


def random_log(rng, nodes, snaps):
    """A consistent log and the states after each snapshot."""
    state, log, states, i = {}, [], [{}], 0
    for s in range(1, snaps + 1):
        for n in rng.sample(nodes, 3):
            i += 1
            if n not in state:
                log.append((i, s, n, "add", None, f"{n}-{s}"))
                state[n] = f"{n}-{s}"
            elif rng.random() < 0.4:
                log.append((i, s, n, "rem", state.pop(n), None))
            else:
                log.append((i, s, n, "mod", state[n], f"{n}-{s}"))
                state[n] = f"{n}-{s}"
        states.append(dict(state))
    return log, states


def test_states_restore_and_net_diff_agree(spark):
    log, states = random_log(random.Random(8), list("abcdefgh"), 14)
    diffs = changes(spark, log).cache()
    meta = [F.lit(None).cast("int" if c in ("depth", "token_count") else "string").alias(c) for c in versions.META]
    head = versions.state_at(diffs, 14).select("node_id", "hash", "content", *meta)
    for at in (0, 5, 11, 14):
        assert {r.node_id: r.content for r in versions.state_at(diffs, at).collect()} == states[at]
        assert {r.node_id: r.content for r in versions.restore_at(head, diffs, at).collect()} == states[at]
    for a, b in ((0, 14), (3, 9), (5, 5)):
        want = {n: ("add" if n not in states[a] else "rem" if n not in states[b] else "mod") for n in {*states[a], *states[b]} if states[a].get(n) != states[b].get(n)}
        assert {r.node_id: r.op for r in versions.net_diff(diffs, a, b).collect()} == want
        before, after = versions.state_at(diffs, a), versions.state_at(diffs, b)
        assert {r.node_id: r.op for r in versions.diff_states(before, after).collect()} == want
    with pytest.raises(ValueError):
        versions.net_diff(diffs, 5, 4)


def test_history_and_hashes(spark):
    diffs = changes(spark, [(i, i, "n", "mod", str(i), str(i + 1)) for i in range(1, 15)])
    assert [r.id for r in versions.history(diffs, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert [r.id for r in versions.history(diffs, 2, newest_first=True).orderBy("rank").collect()] == [14, 13]
    a = versions.delta_hashes(diffs).orderBy("snapshot_id").collect()
    b = versions.delta_hashes(diffs.orderBy(F.rand(3))).orderBy("snapshot_id").collect()
    assert a == b and len(a) == 14 and len(a[0].cursor_hash) == 16
    d = spark.createDataFrame([("a\nb", "a\nc"), (None, "x")], "o string, n string").select(versions.unified_diff(F.col("o"), F.col("n")).alias("h")).collect()
    assert d[0].h == "@@ -1,2 +1,2 @@\n a\n-b\n+c" and "+x" in d[1].h


def test_hashes_stream_through_batches(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([None, f"{rng.random()}é"])) for g in (1, 2, None, 3) for _ in range(200 if g == 2 else 5)] + [(4, None)]
    df = spark.createDataFrame(rows, "g long, p string").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        hashes = versions.cursor_hash(df, ["g"], F.col("p"))
        got = {r.g: r.cursor_hash for r in hashes.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == hashes.count() == 5
    for g, h in got.items():
        assert h == f"{xxh64(''.join(sorted(p for x, p in rows if x == g and p is not None)).encode()):016x}"
    # no group is gathered in one row
    assert "collect_list" not in hashes._jdf.queryExecution().toString()


def test_greedy_budget_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(f"k{i}", rng.choice([0.1, 0.5, 0.9, None, rng.random()]), rng.choice([0, 1, 3, 7, 20, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "node_id string, score double, token_count int")
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    for budget in (1, 40, 300, 10**6):
        left, want = budget, set()
        for k, _, n in order:
            if (n or 0) <= left:
                want.add(k)
                left -= n or 0
        assert {r.node_id for r in retrieval.greedy_budget(df, budget).collect()} == want
    assert retrieval.greedy_budget(df, 0).count() == 200


def test_scores_prefix_and_batch(spark):
    one = spark.range(1)
    s = lambda t, at, now=86400: one.select(retrieval.score(F.lit(1.0), F.lit(t), F.lit(at).cast("long"), now).alias("s")).first().s
    assert s(1.0, None) == pytest.approx(1.0) and s(0.0, None) == pytest.approx(0.3) and s(0.5, None) == pytest.approx(0.65) and s(1.0, 0) == pytest.approx(0.5)
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 50), (4, 1)], "i int, token_count int")
    assert [r.i for r in retrieval.prefix_budget(df, 11, ["i"]).orderBy("i").collect()] == [1, 2]
    nodes = spark.createDataFrame([("a", 5), ("b", 9), ("c", 4)], "id string, token_count int")
    got = retrieval.fetch_batch(nodes, ["b", "x", "a", "b", "c"], 10).orderBy("position").collect()
    assert [(r.node_id, r.status) for r in got] == [("b", "kept"), ("x", "missing"), ("a", "over_budget"), ("c", "over_budget")]
    with pytest.raises(ValueError):
        retrieval.fetch_batch(nodes, [], 10)


TREE = "id string, parent_id string, token_count int, temperature double, last_accessed_at long"


def test_fetch(spark):
    nodes = spark.createDataFrame([("r", None, 5, 0.5, None), ("a", "r", 50, 0.9, None), ("b", "r", 5, 0.1, None), ("c", "a", 5, 0.4, None), ("z", None, 1, 1.0, None)], TREE)
    assert {r.node_id: r.relation for r in retrieval.context(nodes, "a").collect()} == {"r": "ancestor", "c": "descendant", "b": "sibling"}
    got = retrieval.fetch(nodes, "a", 61, 0).orderBy("position").collect()
    assert [r.node_id for r in got] == ["c", "r", "a"]
    assert [r.node_id for r in retrieval.fetch(nodes, "a", 10, 0).collect()] == ["a"]
    assert retrieval.context(nodes, "r").count() == 3
    with pytest.raises(KeyError):
        retrieval.fetch(nodes, "nobody", 10, 0)


def test_context_of_deep_broken_and_looping_chains(spark):
    deep = [(f"d{i:03d}", f"d{i - 1:03d}" if i else None) for i in range(150)]
    loops = [("x", "y"), ("y", "x"), ("below", "x"), ("z", "z")] + [(f"l{i:03d}", f"l{(i + 1) % 100:03d}") for i in range(100)]
    nodes = spark.createDataFrame([*deep, *loops, ("b", "gone"), ("b2", "gone"), ("c", "b")], "id string, parent_id string")
    of = lambda a, depth=32: {r.node_id: r.relation for r in retrieval.context(nodes, a, depth).collect()}
    got = of("d120", 5)
    assert {k for k, v in got.items() if v == "ancestor"} == {f"d{i:03d}" for i in range(120)} and {k for k, v in got.items() if v == "descendant"} == {f"d{i:03d}" for i in range(121, 126)}
    assert of("b") == {"b2": "sibling", "c": "descendant"} and of("c") == {"b": "ancestor"} and of("z") == {}
    assert of("y") == {"below": "sibling"}
    assert of("below") == {"y": "sibling"} and of("l007") == {} and of("x") == {}


def test_search_index(spark):
    rows = [("1", "Plan", "retry the budget soon", "text"), ("2", "Retry budget", "x", "heading"), ("3", "Other", "snapshots of it", "text"), ("4", None, None, None)]
    nodes = spark.createDataFrame([(*r, 10, 0.5, None) for r in rows], "id string, label string, content string, node_type string, token_count int, temperature double, last_accessed_at long")
    ids = lambda df: {r.node_id for r in df.collect()}
    i = search.write_index(nodes, Scratch(spark, "index").base)
    assert i.counts.first().n == 4 and i.counts.first().words == 6 + 4 + 5
    assert ids(i.relevance(["retry", "snapshots"])) == {"1", "2", "3"} and ids(i.relevance(["retry", "plan"], True)) == {"1"}
    assert ids(i.phrase("retry", "budget")) == {"2"} and ids(i.near("retry", "budget", 1)) == {"1", "2"} and ids(i.phrase("budget", "soon", "text")) == {"1"}
    assert ids(i.near("budget", "retry", 0)) == {"2"} and ids(i.prefix("snap")) == {"3"}
    assert ids(i.word("retry", "label")) == {"2"} and ids(i.word("retry", "content")) == {"1"} and ids(i.word("heading", "node_type")) == {"2"} == ids(i.word("x", "content"))
    assert ids(search.without(i.word("budget"), i.word("plan"))) == {"2"}
    assert ids(search.both(search.either(i.word("plan"), i.word("other")), i.word("text"))) == {"1", "3"}
    assert ids(i.relevance(["retry"], among=i.word("heading"))) == {"2"}
    rows_of = lambda wanted: nodes.join(wanted, "id", "left_semi")
    stems = search.write_index(nodes, Scratch(spark, "index").base, stemmed=True)
    assert ids(search.search(stems, rows_of, "snapshot", 100, 0)) == {"3"} and search.search(i, rows_of, "", 100, 0).count() == 0
    p = search.postings(nodes)
    assert stats.index_differences(i.postings, p).count() == 0 and stats.index_differences(p.where("term <> 'plan'"), p).count() == 2
    empty = search.write_index(nodes.limit(0), Scratch(spark, "index").base)
    assert empty.relevance(["x"]).count() == 0 and empty.word("x").count() == 0


def test_search_reads_only_the_index(spark, tmp_path):
    nodes = spark.createDataFrame([(str(i), f"word{i}", "some text", "text", 10, 0.5, None) for i in range(50)], "id string, label string, content string, node_type string, token_count int, temperature double, last_accessed_at long")
    nodes.write.parquet(str(tmp_path / "nodes"))
    stored = spark.read.parquet(str(tmp_path / "nodes"))
    i = search.write_index(stored, Scratch(spark, "index").base)
    plan = search.search(i, lambda wanted: stored.select("id", "temperature", "last_accessed_at", "token_count").join(wanted, "id", "left_semi"), "word7", 100, 0)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "label" not in plan


def test_positions_and_sums_of_hot_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), i, rng.choice([None, 1, 5, 9])) for i in range(2_000)]
    df = spark.createDataFrame(rows, "g string, i int, n int")
    place, total = {}, {}
    want = {}
    for g, i, n in sorted(rows, key=lambda r: r[1]):
        place[g], total[g] = place.get(g, -1) + 1, total.get(g, 0) + (n or 0)
        want[i] = (place[g], total[g])
    at = {r.i: r.position for r in positions.with_position(df, ["g"], ["i"]).collect()}
    upto = {r.i: r.upto for r in positions.with_running_sum(df, ["g"], ["i"], "n").collect()}
    assert {i: (at[i], upto[i]) for i in at} == want and len(upto) == 2_000


def test_walks_against_enumeration(spark):
    rng = random.Random(9)
    for direction in ("out", "in", "both"):
        edges = [(f"n{rng.randrange(6)}", f"n{rng.randrange(6)}", round(rng.uniform(-1, 3), 2)) for _ in range(12)]
        best = {}
        for way in ("out", "in") if direction == "both" else (direction,):
            e = [(a, b, w) if way == "out" else (b, a, w) for a, b, w in edges if w >= 0]
            walks = [("n0", 0.0)]
            for hop in (1, 2, 3):
                walks = [(b, t + w) for at, t in walks for a, b, w in e if a == at]
                for n, t in walks:
                    if n != "n0":
                        h, x = best.get(n, (9, -9.0))
                        best[n] = (min(h, hop), max(x, t))
        rel = spark.createDataFrame(edges, "source_node_id string, target_node_id string, weight double")
        got = graph.related(rel, spark.createDataFrame([("n0",)], "id string"), 3, 0.0, direction)
        assert {r.node_id: (r.hop, round(r.weight, 6)) for r in got.collect()} == {n: (h, round(w, 6)) for n, (h, w) in best.items()}


def test_resolution_has_no_fallback_from_a_hint(spark):
    nodes = spark.createDataFrame([("a", "heading", "Plan", "x/p.md", 1), ("b", "heading", " plan", "q.md", 2), ("c", "text", "Plan", "a.md", 0)], "id string, node_type string, label string, source_file string, depth int")
    pend = [(1, "PLAN ", None, None), (2, "plan", "p.md", None), (3, "plan", None, "gone"), (4, "plan", "", "c"), (5, None, None, None), (6, "plan", "none.md", None)]
    df = spark.createDataFrame(pend, "id long, target_label string, target_source string, target_id_hint string")
    assert {r.id: r.target_id for r in graph.resolve_refs(df, nodes).collect()} == {1: "b", 2: "a", 3: None, 4: "c", 5: None, 6: None}


def test_heat_fold_across_segments_and_median(spark):
    rng = random.Random(1)
    base = 1_700_000_000
    rows = [(u, base + rng.randrange(40 * 86400)) for u in ("a", "b") for _ in range(60)] + [("a", base), ("a", base), (None, base), ("c", None)]
    df = spark.createDataFrame(rows, "u string, s long").select("u", F.timestamp_seconds("s").alias("ts"))
    got = {r.node_id: (r.reads, r.temperature) for r in heat.heat_fold(df, "u", "ts").collect()}
    for u in ("a", "b"):
        times = sorted(s for x, s in rows if x == u and s is not None)
        assert got[u][0] == len(times) and got[u][1] == pytest.approx(heat.heat_state(heat.START, None, times)[0])
    assert set(got) == {"a", "b"}
    values = [rng.choice([0.1, 0.5, rng.random()]) for _ in range(501)]
    for n in (1, 2, 500, 501):
        assert stats.upper_median(spark.createDataFrame([(v,) for v in values[:n]] + [(None,)], "t double"), "t") == sorted(values[:n])[n // 2]
    assert stats.upper_median(spark.createDataFrame([], "t double"), "t") is None


def test_heat_and_reports(spark):
    nodes = spark.createDataFrame([("a", 0.04, False, 0, None), ("b", 0.04, True, 0, None), ("c", 0.95, False, 1, 5)], "id string, temperature double, pinned boolean, access_count int, last_accessed_at long")
    assert heat.decay_factor(0.05, 24) == pytest.approx(0.301194) and heat.decay_factor(0, 5) == 1
    t = {r.id: r.temperature for r in heat.decay_tick(nodes, 0.05, 24).collect()}
    assert t["b"] == 0.04 and t["a"] == pytest.approx(0.04 * 0.301194, rel=1e-5)
    read = spark.createDataFrame([("c",), ("c",)], "id string")
    c = heat.boost(nodes, read, 9).where("id = 'c'").first()
    assert (c.temperature, c.access_count, c.last_accessed_at) == (1.0, 2, 9)
    assert [r.id for r in heat.cold_nodes(nodes).collect()] == ["a"]
    told = spark.createDataFrame([("a", 100)], "id string, notified_at long")
    assert heat.to_notify(nodes, told, 200).count() == 0 and heat.to_notify(nodes, told, 100 + 3600).count() == 1
    assert spark.range(1).select(stats.saving_percent(F.lit(25), F.lit(100)).alias("p"), stats.saving_percent(F.lit(1), F.lit(0)).alias("q")).first() == (75.0, None)


def test_upserts_and_positions(spark):
    cols = "id string, parent_id string, temperature double, access_count int, last_accessed_at long, created_at long, updated_at long, pinned boolean, label string"
    old = spark.createDataFrame([("a", None, 0.9, 3, 7, 1, 1, True, "x")], cols)
    new = spark.createDataFrame([("a", "p", None, 0, None, 5, 5, False, "y"), ("b", None, None, 0, None, 5, 5, False, "z")], cols)
    got = {r.id: r for r in store.upsert_nodes(old, new, 9).collect()}
    assert (got["a"].temperature, got["a"].access_count, got["a"].created_at, got["a"].pinned, got["a"].label, got["a"].updated_at) == (0.9, 3, 1, True, "y", 9)
    assert got["b"].temperature == 0.5
    rel = spark.createDataFrame([(1, "a", "b", 1.0, "parsed", 1), (2, "a", "b", 2.0, "parsed", 2), (3, "a", "b", 9.0, "manual", 3)], "id long, source_node_id string, target_node_id string, weight double, origin string, created_at long")
    assert {(r.id, r.weight) for r in store.upsert_relations(rel).collect()} == {(1, 2.0), (3, 9.0)}
    df = spark.createDataFrame([(None if i % 5 == 0 else "g" if i % 5 < 4 else "h", i) for i in range(100)], "g string, i int")
    got = with_position(df, ["g"], [F.col("i").desc()])
    for g in (None, "g", "h"):
        rows = sorted((r.position, -r.i) for r in got.collect() if r.g == g)
        assert [p for p, _ in rows] == list(range(len(rows))) and rows == sorted(rows, key=lambda x: x[1])
