import random

from grovelake.llm import encoding as e

VOCABULARY = e.default_vocabulary()
LETTERS = "abcDE019  \n\n\t'’srtvemd.,;:!?$#@-_«»äöß日本語🙂  \x1d\ŕ{}[]\"\\"


def test_fragments_equal_the_whole_text():
    enc = e.Encoder(VOCABULARY)
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 60)))
        assert enc.encode(t).tolist() == enc.encoding.encode_ordinary(t)
        assert enc.encoding.decode(enc.encode(t).tolist()) == t
        assert "".join(enc.pieces(t, 5)) == "".join(enc.fragments(t)) == t


def test_ordinary_notes_have_many_fragments():
    enc = e.Encoder(VOCABULARY)
    for t in ("The budget was (nearly) spent; see notes_v2.md.", "# Titel\n\nÜber: 12% mehr.\n", '{"a": [1, 2], "b": "c"}'):
        assert len(enc.fragments(t)) > 4
        assert enc.encode(t).tolist() == enc.encoding.encode_ordinary(t)


def test_cuts_by_definition():
    enc, rng = e.Encoder(VOCABULARY), random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 40)))
        want = [i for i in range(1, len(t)) if not enc.inside[t[i - 1].encode()[-1], t[i].encode()[0]] and not t[i - 1].isspace() and t[i] != "'"]
        assert enc.cuts(t).tolist() == want


def test_corpus_with_pieces(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice(["tree", "naïve", "x=1;", "don't", "<|endoftext|>", "\n\n"]) for _ in range(4000))
    rows = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (4, long, "x"), (5, "a" * 5000, "x"), (6, " ", "x"), (4, long, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _KEY string")
    enc = e.Encoder(VOCABULARY).encoding
    got = e.encode_corpus(df, piece_chars=700).collect()
    assert len(got) == 7
    for r in got:
        text = dict((a, b) for a, b, _ in rows)[r.doc_id]
        assert r.ids == enc.encode_ordinary(text or "")
    sizes = {r.doc_id: r.n_tokens for r in e.token_counts(df, piece_chars=700).collect()}
    assert sizes == {r.doc_id: len(r.ids) for r in got}


def test_empty_table(spark):
    assert e.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
