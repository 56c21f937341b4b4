from pyspark.sql import functions as F

from grovelake.functions import ids, redaction, text
from grovelake.operators.search import porter_stem, query_terms
from grovelake.sources.scan import ignored, seed_temperatures, wanted_path


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_hash_vectors():
    assert f"{ids.xxh64(b'abc'):016x}" == "44bc2cf5ad770999"
    assert len(ids.positional_id("f", "p", 3)) == 11 and ids.positional_id("f", "p", 3) != ids.positional_id("f", "p", 4)
    assert ids.base62(61) == "0000000000z"


def test_token_estimate_and_normal_form(spark):
    assert [one(spark, v, text.token_estimate) for v in (None, "", "a", "abcde", "äöü")] == [0, 0, 1, 2, 2]
    assert one(spark, "\n\na  \r\nb\t\n\n\n\nc \n", text.normalize_text) == "a\nb\n\nc"
    assert one(spark, None, text.normalize_text) is None


def test_labels(spark):
    label = lambda kind, content, fmt="plain": one(spark, content, lambda x: text.node_label(F.lit(kind), x, F.lit(fmt)))
    assert label("list", "- a\n- b") == "2-item list: a"
    assert label("table", "a\tb\n1\t2") == "Table: a, b (1 rows)"
    assert label("code", "py\nx = 1") == "Code (py): x = 1" and label("code", "x = 1") == "Code: x = 1"
    assert label("kv", "a: 1\n  b: 2\nc: 3\nd: 4\ne: 5") == "a, c, d"
    assert label("preamble", "a: 1\nb: 2") == "Preamble: a, b"
    assert label("embed", "![Alt](x.png)", "image") == "Image: Alt" and label("embed", "[](v.mp4)", "video") == "Video: v.mp4"
    assert label("text", "One. Two.") == "One." and label("text", "v1.2 is out") == "v1.2 is out"
    long = label("heading", "ä" * 100)
    assert len(long.encode()) <= 80 and long.endswith("...") and long.startswith("ä" * 38)


def test_links(spark):
    parts = one(spark, "see [[A b;w=2.5;source=x.md]] and [[0123456789a]] [[p; q]]", lambda x: F.transform(text.wiki_links(x), text.link_parts))
    assert [tuple(p) for p in parts] == [("A b", 2.5, "x.md", None), ("0123456789a", 1.0, None, "0123456789a"), ("p; q", 1.0, None, None)]


def test_display_forms(spark):
    assert one(spark, 1536, text.human_bytes, "long") == "1.5 KB" and one(spark, 90061, text.human_age, "long") == "1d"
    assert one(spark, "  My Client (v2)!", text.slug) == "my-client-v2"
    assert [one(spark, t, text.heat_color, "double") for t in (0.0, 0.5, 1.0)] == ["#0000ff", "#ffffff", "#ff0000"]


def test_redaction_prefers_the_earliest_and_longest(spark):
    secret = "ghp_" + "A1" * 18
    got = one(spark, f"GH_TOKEN={secret} end", redaction.redact)
    assert got.kinds == ["env_secret_assignment"] and got.text == "«redacted:env_secret_assignment» end"
    again = one(spark, got.text, redaction.redact)
    assert again.text == got.text and again.kinds == []
    assert one(spark, None, redaction.redact).text is None
    assert one(spark, "id-77 x", lambda x: redaction.redact(x, {"ticket": r"id-\d+"})).kinds == ["ticket"]


def test_porter_stems():
    words = {"caresses": "caress", "ponies": "poni", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "relational": "relat", "happy": "happi", "formaliti": "formal", "triplicate": "triplic", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "controll": "control", "rate": "rate"}
    assert {w: porter_stem(w) for w in words} == words
    assert query_terms("Retry, the RETRY_budget!") == ["retry", "the", "budget"]


def test_scan_paths(spark):
    paths = {"a.md": True, "b/C.HTML": True, "node_modules/x.md": False, "a/.git/x.md": False, "a/b.txt": False, "x.toon": True}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.y for r in df.select("p", wanted_path(F.col("p")).alias("y")).collect()} == paths
    rules = ["# comment", "*.html", "drafts/", "!drafts/keep.md", "/top.md", "a/**/z.md", "\\!odd.md"]
    want = {"x/p.html": True, "drafts/a.md": True, "drafts/keep.md": False, "top.md": True, "b/top.md": False, "a/z.md": True, "a/b/c/z.md": True, "!odd.md": True, "q.md": False}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.y for r in df.select("p", ignored(F.col("p"), rules).alias("y")).collect()} == want


def test_seed_temperatures(spark):
    files = spark.createDataFrame([("a/b/c.md",), ("a/d.md",), ("x.md",)], "source_file string")
    got = {r.source_file: r.temperature for r in seed_temperatures(files, {"a/*": 0.2, "a/b/*": 0.7, "a/d.md": 1.0}).collect()}
    assert got == {"a/b/c.md": 0.7, "a/d.md": 1.0, "x.md": None}
