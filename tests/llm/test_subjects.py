import math
import random
from collections import Counter

from grovelake.llm import subjects as s
from grovelake.llm.units import text_units

DOCS = "doc_id long, text string, doc_format string, source_file string"


def test_units_by_format():
    md = "---\ntitle: T\n---\n\n# Head\n\nOne thing. Two things!\nStill two.\n\n- item a\n- [ ] item b\n\nSee [[X]] and [[Y]]\n\n```py\ncode = 1\n```\n" + "Qm9" * 40
    assert text_units(md, "md") == (["One thing.", "Two things!", "Still two.", "item a", "item b"], ["Head"])
    assert text_units('{"version": 1, "notes": ["A b c.", "D e f?"], "pinned": false}\n' + "Qm9" * 40, "json")[0] == ["A b c.", "D e f?"]
    assert text_units('{"type": "user", "content": "Hello there."}\nnot json', "jsonl")[0] == ["Hello there.", "not json"]
    assert text_units("<h1>H</h1><p>A b.</p><li>c&nbsp;</li><pre>x</pre>", "html") == (["A b.", "c"], ["H"])
    assert text_units('kind: note\nentries:\n  - id: 0\n    text: "A b."\n', "yaml")[0] == ["A b."]
    assert text_units('notes[1]{id,text}:\n  0,"A b."\n', "toon")[0] == ["A b."]
    assert [text_units(t, f) for t, f in ((None, "md"), ("", "md"), (" \n ", None))] == [([], [])] * 3


WORDS = {"music": ["oboe", "fugue", "choir", "tempo", "sonata"], "law": ["verdict", "statute", "appeal", "tribunal", "clause"]}
NEUTRAL = ["Please keep it short.", "Call back after lunch.", "Thanks for today.", "Bring the blue folder."]


def corpus(n, seed):
    rng = random.Random(seed)
    rows, truth, labels = [], set(), []
    for i in range(n):
        main = rng.choice([["music"], ["law"], ["music", "law"], []])
        lines = [f"We compared the {rng.choice(WORDS[x])} with the {rng.choice(WORDS[x])} again." for x in main for _ in range(6)] + rng.sample(NEUTRAL, 3)
        rng.shuffle(lines)
        truth |= {(i, x) for x in main}
        folder = rng.choice(main) if main and rng.random() < 0.6 else "notes"
        if rng.random() < 0.3:
            labels += [(i, x) for x in main or [None]]
        rows.append((i, "\n".join(lines), "txt", f"/v/{folder}/{i}.txt"))
    return rows, truth, labels


def test_held_out_accuracy(spark):
    rows, truth, labels = corpus(400, 3)
    areas = spark.createDataFrame([("music", "d"), ("law", "d")], "subject string, description string")
    docs = s.unit_features(spark.createDataFrame(rows, DOCS))
    model = s.train(docs, areas, spark.createDataFrame(labels, "doc_id long, subject string"))
    fresh, want, _ = corpus(200, 77)
    fresh = spark.createDataFrame([(i, t, f, "/v/none.txt") for i, t, f, _ in fresh], DOCS)
    got = {(r.doc_id, r.subject) for r in s.subject_shares(s.unit_features(fresh), model).where(f"share >= {s.LEAST_SHARE}").collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_nulls_empty_and_clashing_columns(spark):
    areas = spark.createDataFrame([("music", "d"), ("law", None), (None, "x")], "subject string, description string")
    labels = spark.createDataFrame([(1, "music"), (1, None), (None, "law"), (2, "unknown")], "doc_id long, subject string")
    rows = [(1, "The oboe is here.", None, "/v/music/1.md", "p"), (2, None, "md", None, "p"), (3, "", "md", "x", "p"), (None, "x y", "md", "/law/", "p"), (4, " ", "txt", "/law/4", "p"), (5, "law " * 50_000, "txt", "/law/5", "p")]
    docs = spark.createDataFrame(rows, DOCS + ", _path string, TEXT string".replace(", TEXT string", ""))
    assert set(s.document_subjects(docs, areas, labels).columns) == {"doc_id", "subject"}
    assert s.document_subjects(docs, areas, labels).where("doc_id in (2, 3, 4)").count() == 0
    assert s.document_subjects(spark.createDataFrame([], DOCS), areas, labels).count() == 0


def test_document_frequencies_are_those_of_the_corpus(spark):
    rows, _, labels = corpus(300, 5)
    rows.append((300, "\n".join([*["Nothing of note here."] * 250, "The oboe ended late."]), "txt", "/v/music/300.txt"))
    areas = spark.createDataFrame([("music", "d"), ("law", "d")], "subject string, description string")
    model = s.train(s.unit_features(spark.createDataFrame(rows, DOCS)), areas, spark.createDataFrame(labels, "doc_id long, subject string"), docs=10)
    units = [set(s.features(u).tolist()) for _, text, kind, _ in rows for part in text_units(text, kind) for u in part]
    df = Counter(b for u in units for b in u)
    known = [b for b in df if model.idf[b] != 0]
    # of all documents, whole texts, though at most 20 of them were sampled; what the sample lacks has no value
    assert 0 < len(known) < len(df) and not any(model.idf[b] for b in range(s.BUCKETS) if b not in df)
    for b in known:
        assert math.isclose(model.idf[b], math.log((len(units) + 1) / (df[b] + 1)), rel_tol=1e-5)


def test_sampled_texts_are_whole(spark):
    text = "\n".join([*["Nothing of note here."] * 250, "The oboe ended late."])
    units = s.unit_features(spark.createDataFrame([(1, text, "txt", "/v/music/1.txt")], DOCS))
    sample = s.training_sample(units, s.weak_labels(units, ["music"], None))
    assert len(sample["sizes"][0]) == len(text_units(text, "txt")[0]) > 250
    assert sample["buckets"][0].as_py() == [b for u in text_units(text, "txt")[0] for b in s.features(u).tolist()]


def test_thresholds_use_all_held_out_documents_whole(spark):
    filler, music = ["Nothing of note here."] * 250, ["The oboe ended late."] * 300
    rows = [(i, "\n".join([*filler, *music]), "txt", f"/v/notes/{i}.txt") for i in range(80)]
    areas = spark.createDataFrame([("music", "d"), ("law", "d")], "subject string, description string")
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, "music") for i in range(80)], "doc_id long, subject string")
    docs = s.unit_features(docs)
    weights = s.np.zeros((s.BUCKETS, 2), s.np.float32)
    weights[s.features("oboe"), 1] = 9.0
    model = s.Model(["law", "music"], s.np.ones(s.BUCKETS, s.np.float32), weights, s.np.full(2, -4.0))
    weak = s.weak_labels(docs, ["law", "music"], labels)
    counts = s.held_out_counts(docs, weak, model).query("j == 1")
    n = docs.selectExpr("pmod(xxhash64(doc_id, 'held'), 4) = 0 as h").where("h").count()
    assert n > 5 and set(counts["want"]) == {n} and counts.query("i == 0")["hits"].item() == n
    # held-out documents are no rows of the fits, and few of them choose a threshold as many do
    assert s.training_sample(docs, weak)["doc_id"].to_pandas().nunique() == 80 - n
    assert s.train(docs, areas, labels, docs=3).thresholds.tolist() != [s.THRESHOLD] * 2


def test_one_rule_for_thresholds_at_every_size():
    def choose(n, other):
        """``n`` held-out documents of subject 0, for which 0.5 is better than ``other``, and 1,000 of subject 1, for which 0.2 is best."""
        at = ((0, n, 0.5, other), (1, 1000, 0.2, 0.8))
        rows = [(j, i, 0.9 * m if t == best else rest * m, m, m) for j, m, best, rest in at for i, t in enumerate(s.GRID)]
        return s.choose_thresholds(s.pd.DataFrame(rows, columns=["j", "i", "hits", "got", "want"]), 2).tolist()

    assert choose(1, 0.1) == choose(10, 0.8) == [0.2, 0.2]
    assert choose(10, 0.1) == choose(300, 0.8) == [0.5, 0.2]  # ten that differ much say as much as many that differ little
    assert s.choose_thresholds(s.pd.DataFrame({c: [] for c in ("j", "i", "hits", "got", "want")}).astype(int), 2).tolist() == [s.THRESHOLD] * 2


def test_buckets_of_many_units_are_those_of_each():
    units = ["The oboe, the oboe ended.", "", "Ça va? ça va", "x1 22", "one two three one two"]
    buckets, sizes = s.bucket_rows(units)
    edges = s.np.concatenate([[0], s.np.cumsum(sizes)])
    assert [buckets[a:b].tolist() for a, b in zip(edges, edges[1:])] == [s.features(u).tolist() for u in units]
    assert sizes.tolist() == [3 + 3, 0, 2 + 2, 1, 3 + 3]  # the, oboe, ended; the oboe, oboe the, oboe ended
    assert s.features("a b").tolist() != s.features("b a").tolist() and len(s.bucket_rows([])[0]) == 0


def test_scores_are_those_of_each_row_alone():
    rng = s.np.random.default_rng(3)
    units = [" ".join(rng.choice(["oboe", "fugue", "verdict", "clause", "the", "a"], rng.integers(0, 6))) for _ in range(50)]
    model = s.Model(["law", "music"], rng.random(s.BUCKETS).astype("float32"), rng.normal(size=(s.BUCKETS, 2)).astype("float32"), s.np.array([0.1, -0.2]))
    got = model.probabilities(*s.bucket_rows(units))
    for i, u in enumerate(units):
        f = s.features(u)
        v = model.idf[f] / max(1e-9, float(s.np.sqrt((model.idf[f] ** 2).sum())))
        assert s.np.allclose(got[i], 1 / (1 + s.np.exp(-(v @ model.weights[f] + model.bias))), atol=1e-5)


def test_headings_label_what_has_no_label(spark):
    rows = [(i, "# Aria night\n\nSome text.", "md", "/v/music/a.md") for i in range(6)] + [(20 + i, "# Contacts\n\nSome text.", "md", f"/v/{x}/a.md") for i, x in enumerate(["music", "law"] * 4)]
    rows += [(100, "# ARIA night\n\nOther.", "md", "/v/notes/b.md"), (101, "# Contacts\n\nOther.", "md", "/v/notes/b.md"), (102, "# Aria night\n\nOther.", "md", "/v/law/b.md")]
    weak = {r.doc_id: r._weak for r in s.weak_labels(s.unit_features(spark.createDataFrame(rows, DOCS)), ["law", "music"], None).collect()}
    assert (weak[100], weak[101], weak[102]) == (["music"], [], ["law"]) and len(weak) == len(rows)
