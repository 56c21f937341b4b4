import random
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grovelake.durable import shared_root
from grovelake.operators.heat import START, heat_state
from grovelake.plans import corpus_queries
from grovelake.sources import parsing as p
from grovelake.sources.scan import changed_paths, deleted_paths, last_per_session, scan_files
from grovelake.sources.versioned import VersionedStore, compile_into
from grovelake.streaming import reads


def test_markdown_blocks():
    md = "---\ntitle: X\n---\n# A **b**\n\npara one\nline two\n\n- x\n- y\n\n## B\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx=1\n```\n\n---\ntext [[L;w=2]] `c`\n"
    want = [(1, "preamble", "title: X"), (1, "heading", "A b"), (2, "text", "para one line two"), (2, "list", "- x\n- y"), (2, "heading", "B"), (3, "table", "a\tb\n1\t2"), (3, "code", "py\nx=1"), (3, "text", "text [[L;w=2]] c")]
    assert [(d, t, c) for d, t, _, c in p.file_blocks("a.md", md)] == want
    assert p.file_blocks("a.md", "---\nnever closed\n")[0][1] != "preamble"


def test_html_blocks():
    html = "<head><title>t</title></head>loose<h1>H</h1><p>a <em>b</em><br>c</p><ul><li>x<ul><li>y</li></ul></li></ul><img src='i.png' alt='Al'><math><msqrt><mi>x</mi></msqrt></math><h1>G</h1><p>z"
    want = [(1, "heading", "H"), (2, "text", "a b\nc"), (2, "list", "- x\n\t- y"), (2, "embed", "![Al](i.png)"), (2, "code", "\\sqrt{x}"), (1, "heading", "G"), (2, "text", "z")]
    assert [(d, t, c) for d, t, _, c in p.file_blocks("a.html", html)] == want


def test_values_and_toon():
    five = {"k": {f"f{i}": i for i in range(5)}, "small": {"a": None}}
    assert [(d, c) for d, _, _, c in p.value_blocks(five)] == [(1, "small:\n  a: null"), (2, "k:\n  f0: 0\n  f1: 1\n  f2: 2\n  f3: 3\n  f4: 4")]
    rows = [{"id": str(i), "text": f"line {i}, with: signs"} for i in range(8)]
    assert p.parse_toon(p.toon_list("rows", rows)) == {"rows": rows}
    assert p.value_blocks(rows, "rows")[0][2] == "toon" and p.toon_list("x", [{"a": []}]) is None
    assert p.file_blocks("a.json", "null") == [] and p.file_blocks("a.jsonl", '{"a": 1}\n{"a": 2}')[0][1] == "list"
    with pytest.raises(ValueError):
        p.file_blocks("a.json", "{broken")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab #*-`|\n<>/p[]1.", max_size=80))
def test_no_text_breaks_markdown_or_html(t):
    for name in ("a.md", "a.html"):
        depths = [b[0] for b in p.file_blocks(name, t)]
        assert all(d >= 1 for d in depths) and all(b <= a + 1 for a, b in zip([0, *depths], depths))


def test_parsed_rows(spark):
    files = [("a.md", "# T\n\nbody. more\n\n## S\n\nx"), ("b.json", "{no"), ("c.md", None), ("d.md", ""), ("e.yaml", "a: 1\n")]
    rows = p.parse_files(spark.createDataFrame(files, "source_file string, text string")).collect()
    assert [r.source_file for r in rows if r.error] == ["b.json"]
    a = {r.content: r for r in rows if r.source_file == "a.md"}
    assert a["body. more"].parent_id == a["T"].node_id and a["x"].parent_id == a["S"].node_id and a["x"].depth == 3
    assert a["body. more"].label == "body." and a["T"].token_count == 1
    edited = p.parse_files(spark.createDataFrame([("a.md", "# T2\n\nother\n\n## S\n\nx")], "source_file string, text string")).collect()
    assert {r.node_id for r in edited} == {r.node_id for r in rows if r.source_file == "a.md"}


def test_scan_and_compile(spark, tmp_path: Path):
    (tmp_path / "sub/.hidden").mkdir(parents=True)
    for name, body in (("a.md", "# A\n\none\n"), ("sub/b.md", "text"), ("sub/.hidden/c.md", "no"), ("d.txt", "no"), ("sub/skip.md", "no")):
        (tmp_path / name).write_text(body)
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    scan = lambda: scan_files(spark, str(tmp_path), ["skip.md"], 10_000)
    assert {(r.relative, r.error) for r in scan().collect()} == {("a.md", None), ("sub/b.md", None), ("bad.md", "no UTF-8")}
    target = VersionedStore(spark, f"{shared_root(spark)}/test-store-{random.random()}")
    run = lambda now: compile_into(target, p.parse_files(scan().where("error is null")), "m", str(tmp_path), now)
    assert run(1) == {"added": 3, "modified": 0, "removed": 0, "total": 3}
    before = target.version()
    assert run(2)["total"] == 0 and target.version() == before
    (tmp_path / "a.md").write_text("# A\n\ntwo\n\nthree\n")
    assert run(3) == {"added": 1, "modified": 1, "removed": 0, "total": 2}
    (tmp_path / "a.md").write_text("# A\n")
    assert run(4) == {"added": 0, "modified": 0, "removed": 2, "total": 2}
    assert target.read("nodes").count() == 2 and target.read("snapshots").count() == 3
    ids = [r.id for r in target.read("diffs").orderBy("id").collect()]
    assert ids == list(range(1, 8))
    with pytest.raises(RuntimeError):
        target.commit({}, before)
    target.backup(f"{target.root}-copy")
    assert spark.read.parquet(f"{target.root}-copy/nodes").count() == 2


def test_listings_and_ledger(spark):
    known = spark.createDataFrame([("a", "2025-01-01 00:00:00"), ("b", "2025-01-01 00:00:00")], "source_file string, m string").selectExpr("source_file", "cast(m as timestamp) modified_at")
    seen = spark.createDataFrame([("a", "2025-01-02 00:00:00"), ("c", "2025-01-02 00:00:09")], "source_file string, m string").selectExpr("source_file", "cast(m as timestamp) modified_at")
    assert [r.source_file for r in deleted_paths(known, seen).collect()] == ["b"]
    assert [r.source_file for r in changed_paths(known, seen, 5, "2025-01-02 00:00:10").collect()] == ["a"]
    ledger = spark.createDataFrame([("s", 1, "x"), ("s", 5, "y"), ("t", 2, "z")], "session_id string, last_seen long, client string")
    assert {(r.session_id, r.client) for r in last_per_session(ledger).collect()} == {("s", "y"), ("t", "z")}


def test_stream_equals_batch(spark, tmp_path: Path):
    rng = random.Random(3)
    rows = sorted((1_700_000_000 + rng.randrange(10**6), rng.randrange(3)) for _ in range(90))
    for i in range(3):
        part = spark.createDataFrame([(u, "view", 1.0, s) for s, u in rows[i * 30 : i * 30 + 30]], "user_id long, event_type string, value double, s long")
        part.selectExpr("user_id", "event_type", "value", "timestamp_seconds(s) as ts").coalesce(1).write.parquet(f"{tmp_path}/events/p{i}")
    path = f"{tmp_path}/events/*"
    updates = reads.drain(reads.heat_stream(spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)), "update", "t")
    got = {r.node_id: (r.reads, r.temperature) for r in reads.latest(updates, "node_id").collect()}
    order = [f for f in sorted((tmp_path / "events").glob("p*"))]
    assert len(order) == 3
    for u in range(3):
        times = [s for s, x in rows if x == u]
        assert got[u][0] == len(times)
        if got[u][0]:
            assert got[u][1] == pytest.approx(heat_state(START, None, times)[0], abs=0.2)


def test_drained_streams_count_shuffled_files_whole(spark, tmp_path: Path):
    rng = random.Random(11)
    rows = sorted((1_700_000_000 + rng.randrange(60 * 86_400), rng.randrange(3), rng.choice(["view", "edit"])) for _ in range(400))
    order = rng.sample(range(20), 20)
    for name, i in enumerate(order):
        part = spark.createDataFrame([(u, k, 1.0, s) for s, u, k in rows[i * 20 : i * 20 + 20]], "user_id long, event_type string, value double, s long")
        part.selectExpr("user_id", "event_type", "value", "timestamp_seconds(s) as ts").coalesce(1).write.parquet(f"{tmp_path}/parts/{name}")
        (file,) = (tmp_path / f"parts/{name}").glob("*.parquet")
        (tmp_path / "events.parquet").mkdir(exist_ok=True)
        file.rename(tmp_path / f"events.parquet/part-{name:02d}.parquet")
    days = Counter((s // 86_400, k) for s, _, k in rows)
    got = corpus_queries.stream_activity(spark, str(tmp_path)).selectExpr("unix_date(cast(day as date)) as day", "event_type", "n", "total").collect()
    assert {(r.day, r.event_type): (r.n, r.total) for r in got} == {k: (n, float(n)) for k, n in days.items()}
    heat = {r.node_id: (r.reads, r.temperature) for r in corpus_queries.stream_heat(spark, str(tmp_path)).collect()}
    for u in range(3):
        times = [s for s, x, _ in rows if x == u]
        assert heat[u] == (len(times), pytest.approx(heat_state(START, None, times)[0], abs=1e-5))
