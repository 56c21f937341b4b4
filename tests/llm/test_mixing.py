import random

import pytest

from grovelake.llm import mixing as m

DOCS = "doc_id long, text string, lang string, source string, doc_format string"
TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def test_shortages_go_to_siblings_first():
    a = m.Branch("a", 0.5, children=[m.Branch("en", 1, 100, 1), m.Branch("de", 1, 1000, 1)])
    root = m.Branch("mix", children=[a, m.Branch("b", 0.5, children=[m.Branch("en", 1, 5000, 1)])])
    got = m.allocate(root, 1000)
    assert got[("mix", "a", "en")] == 100 and got[("mix", "a", "de")] == pytest.approx(400) and got[("mix", "b", "en")] == pytest.approx(500)
    # a cannot place its half: the rest goes up and to b
    got = m.allocate(root, 3000)
    assert got[("mix", "a", "en")] + got[("mix", "a", "de")] == pytest.approx(1100) and got[("mix", "b", "en")] == pytest.approx(1900)
    assert sum(m.allocate(root, 10**9).values()) == pytest.approx(6100)
    assert m.largest_budget(root) == pytest.approx(2200)


def test_shares_and_repeats(spark):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randint(5, 60), rng.choice(["en", "EN-us", "de", None]), rng.choice(["Big Source", "big-source", "big_source"] * 6 + ["small"]), rng.choice(["md", " JSON", None])) for i in range(1500)]
    rows += [(9001, None, "en", "small", "md"), (9002, "", "en", "small", "md"), (9003, "x", "en", None, "md"), (9004, "x y", "en", "other", "md"), (None, "x", "en", "small", "md"), rows[0]]
    targets = [("m", "big_source", 0.6, 1), ("m", "SMALL", 0.4, 4), ("m", "missing", 0.0, 2), ("n", "small", 1.0, 2)]
    docs, t = spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS)
    mixed = m.mix(docs, t).collect()
    keys = [(r.mix_name, r.doc_id) for r in mixed]
    assert len(keys) == len(set(keys))
    most = {("m", "big_source"): 1, ("m", "small"): 4, ("n", "small"): 2}
    assert all(1 <= r.repeats <= most[r.mix_name, r.source] for r in mixed)
    assert not {9001, 9002, 9003, 9004} & {r.doc_id for r in mixed}
    shares = {(r.mix_name, r.source): r for r in m.mix_shares(m.mix(docs, t), t).collect()}
    assert abs(shares["m", "big_source"].actual_share - 0.6) < 0.01 and abs(shares["m", "small"].actual_share - 0.4) < 0.01
    assert shares["m", "missing"].actual_share == 0 and shares["n", "small"].actual_share == 1
    # the same seed gives the same mix
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, m.mix(docs, t).collect()))


def test_explicit_total_redistributes(spark):
    docs = spark.createDataFrame([(i, "a b c d", "en", "s" if i < 10 else "b", "md") for i in range(200)], DOCS)
    t = spark.createDataFrame([("m", "s", 0.5, 2), ("m", "b", 0.5, 1)], TARGETS)
    shares = {r.source: r for r in m.mix_shares(m.mix(docs, t, {"m": 400}), t).collect()}
    assert shares["s"].n_tokens == 80 and shares["s"].max_used == 2 and shares["b"].n_tokens == 320
    # sources of 40 and 760 tokens, of all 800: the small one gives 80, the other all it has, and the report says what moved
    sizes = m.sized(docs, t)
    leaves = m.plan(sizes, t, "all")
    report = {r.source: r for r in m.shortages(m.select(sizes, leaves), leaves, t).collect()}
    assert (report["s"].budget, report["b"].budget) == (80, 720) and (report["s"].moved, report["b"].moved) == (-320, 320)
    assert report["b"].n_tokens == 720 and report["s"].capacity == 80


def test_rare_languages_give_their_excess_to_siblings(spark):
    docs = spark.createDataFrame([(i, "a b c d", "fr" if i < 4 else "en", "s", "md") for i in range(104)], DOCS)
    t = spark.createDataFrame([("m", "s", 1.0, 2)], TARGETS)
    got = {r.lang: r.budget for r in m.plan(m.sized(docs, t), t, {"m": 300}).collect()}
    # fr weighs 4 of 24 (50 tokens) but has 16 tokens, twice: the rest goes to en
    assert got == {"fr": 32, "en": 268}


def test_exact_prefix_against_brute_force(spark):
    rng = random.Random(8)
    sizes = spark.createDataFrame([(i, "s", "en", "md", rng.randint(1, 90)) for i in range(3000)], "doc_id long, source string, lang string, format string, n_tokens long")
    t = spark.createDataFrame([("m", "s", 1.0, 3)], TARGETS)
    for total in (1, 5_000, 77_777, 200_001, 10**9):
        leaf = m.plan(sizes, t, {"m": total}).collect()[0]
        order = sizes.selectExpr("doc_id", "n_tokens", f"xxhash64('{m.SEED}', 'm', {leaf.full_epochs}, doc_id) as o").collect()
        room, want = leaf.rest, {}
        for r in sorted(order, key=lambda r: (r.o % 2**64, r.doc_id)):
            extra = room > 0 and r.n_tokens / 2 < room
            room = room - r.n_tokens if extra else 0
            if leaf.full_epochs + extra:
                want[r.doc_id] = leaf.full_epochs + extra
        got = {r.doc_id: r.repeats for r in m.select(sizes, m.plan(sizes, t, {"m": total})).collect()}
        assert got == want


def test_empty(spark):
    t = spark.createDataFrame([("m", "s", 1.0, 2)], TARGETS)
    assert m.mix(spark.createDataFrame([], DOCS), t).count() == 0
    assert [r.actual_share for r in m.mix_shares(m.mix(spark.createDataFrame([], DOCS), t), t).collect()] == [0.0]
    docs = spark.createDataFrame([(1, "x", "en", "s", "md")], DOCS)
    assert m.mix(docs, spark.createDataFrame([], TARGETS)).count() == 0
