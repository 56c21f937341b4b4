"""Full-text search: a written index over label, content and node type, sets of nodes by words, BM25, rescoring under a budget."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import Scratch
from .retrieval import greedy_budget, score

#: BM25 parameters, the least inverse document frequency, and the candidates that are rescored.
K1, B, LEAST_IDF, CANDIDATES = 1.2, 0.75, 1e-6, 50


def terms(text) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(query: str) -> list[str]:
    """The words of a plain query, each once."""
    return list(dict.fromkeys(t for t in re.split(r"[^\w]|_", query.lower()) if t))


#: Columns of a node that are searched, in the order of their words.
SEARCHED = ("label", "content", "node_type")


def postings(nodes: DataFrame, stemmed: bool = False) -> DataFrame:
    """(term, node_id, at, n_label, n_content, doc_len): the inverted index over label, content and node type.

    ``at`` holds the word's places from 0 in the words of the three columns one after the other; the first ``n_label``
    of them are the label's, the next ``n_content`` the content's. A node without words has one row without a term.
    """
    words = [stem_all(terms(F.col(c))) if stemmed else terms(F.col(c)) for c in SEARCHED]
    rows = nodes.select(F.col("id").alias("node_id"), *[w.alias(f"_{i}") for i, w in enumerate(words)])
    sizes = [F.size("_0").alias("n_label"), F.size("_1").alias("n_content"), (F.size("_0") + F.size("_1") + F.size("_2")).alias("doc_len")]
    rows = rows.select("node_id", *sizes, F.posexplode_outer(F.concat("_0", "_1", "_2")).alias("place", "term"))
    return rows.groupBy("term", "node_id", "n_label", "n_content", "doc_len").agg(F.array_sort(F.collect_list("place")).alias("at"))


def write_index(nodes: DataFrame, path: str, stemmed: bool = False) -> Index:
    """Write the postings of current nodes, clustered by term, and the corpus counts that relevance needs."""
    spark = nodes.sparkSession
    rows = postings(nodes, stemmed)
    rows.repartitionByRange("term", "node_id").sortWithinPartitions("term", "node_id").write.parquet(f"{path}/postings")
    sizes = spark.read.parquet(f"{path}/postings").groupBy("node_id").agg(F.first("doc_len").alias("doc_len"))
    sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("words")).write.parquet(f"{path}/counts")
    return Index(spark, path, stemmed)


class Index:
    """A written index. Look-ups read the postings of their words only: the scan is pruned to the files and row groups of these terms.

    Each look-up is a set of nodes (node_id, each once); ``either``, ``both`` and ``without`` combine them. ``column``
    limits a word to one of ``SEARCHED``.
    """

    def __init__(self, spark: SparkSession, path: str, stemmed: bool = False):
        self.stemmed = stemmed
        self.postings, self.counts = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/counts")

    def words(self, query: str) -> list[str]:
        """The words of a plain query in the index's form."""
        return [porter_stem(w) for w in query_terms(query)] if self.stemmed else query_terms(query)

    def rows(self, condition: Column, column: str | None = None) -> DataFrame:
        found = self.postings.where(condition)
        if column is None:
            return found
        low, high = {"label": (F.lit(0), F.col("n_label")), "content": (F.col("n_label"), F.col("n_label") + F.col("n_content")), "node_type": (F.col("n_label") + F.col("n_content"), F.col("doc_len"))}[column]
        return found.withColumn("at", F.filter("at", lambda x: (x >= low) & (x < high))).where(F.size("at") > 0)

    def word(self, word: str, column: str | None = None) -> DataFrame:
        return self.rows(F.col("term") == word, column).select("node_id")

    def prefix(self, start: str, column: str | None = None) -> DataFrame:
        """Nodes with a word that begins so."""
        return self.rows(F.startswith(F.col("term"), F.lit(start)), column).select("node_id").distinct()

    def phrase(self, *words: str, column: str | None = None) -> DataFrame:
        """Nodes with these words next to each other."""
        shifted = lambda i: F.transform("at", lambda x: x - i)
        if not words:
            raise ValueError("no words")
        found = None
        for i, w in enumerate(words):
            here = self.rows(F.col("term") == w, column).select("node_id", shifted(i).alias("_here"))
            if found is None:
                found = here.withColumnRenamed("_here", "_starts")
            else:
                found = found.join(here, "node_id").select("node_id", F.array_intersect("_starts", "_here").alias("_starts")).where(F.size("_starts") > 0)
        return found.select("node_id")

    def near(self, a: str, b: str, within: int = 10, column: str | None = None) -> DataFrame:
        """Nodes with two words with at most ``within`` words between them."""
        one = self.rows(F.col("term") == a, column).select("node_id", F.col("at").alias("_a"))
        two = self.rows(F.col("term") == b, column).select("node_id", F.col("at").alias("_b"))
        close = F.exists("_a", lambda i: F.exists("_b", lambda j: F.abs(i - j) <= within + 1))
        return one.join(two, "node_id").where(close).select("node_id")

    def relevance(self, words: Iterable[str], require_all: bool = False, among: DataFrame | None = None) -> DataFrame:
        """(node_id, relevance): BM25 of the nodes with any (or all) of the words, or of those of them that are ``among`` a set.

        idf = ln((N - n + 0.5) / (n + 0.5)), at least ``LEAST_IDF``; n and N are those of the whole index.
        """
        words = list(dict.fromkeys(words))
        found = self.postings.where(F.col("term").isin(words))
        # one row per word
        have = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}
        counts = self.counts.first()
        n, mean = counts["n"], counts["words"] / counts["n"] if counts["n"] and counts["words"] else 1.0
        weights = {w: max(math.log((n - k + 0.5) / (k + 0.5)), LEAST_IDF) for w, k in have.items()}
        idf = F.lit(0.0)
        for w, x in weights.items():
            idf = F.when(F.col("term") == w, F.lit(x)).otherwise(idf)
        tf = F.size("at").cast("double")
        part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.lit(mean)))
        if among is not None:
            found = found.join(among.select("node_id").distinct(), "node_id", "left_semi")
        scored = found.groupBy("node_id").agg(F.sum(part).alias("relevance"), F.count("*").alias("_n"))
        return (scored.where(F.col("_n") == len(words)) if require_all else scored).select("node_id", "relevance")


def either(*sets: DataFrame) -> DataFrame:
    """Nodes of any of the sets."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def both(*sets: DataFrame) -> DataFrame:
    """Nodes of all of the sets."""
    out = sets[0]
    for s in sets[1:]:
        out = out.join(s, "node_id", "left_semi")
    return out.distinct()


def without(some: DataFrame, others: DataFrame) -> DataFrame:
    """Nodes of the first set that are not in the other."""
    return some.join(others, "node_id", "left_anti").distinct()


def search(index: Index, nodes: Callable[[DataFrame], DataFrame], query: str, budget: int, now: int, require_all: bool = False, among: DataFrame | None = None, limit: int = CANDIDATES) -> DataFrame:
    """(node_id, relevance, score, token_count): the ``limit`` most relevant nodes, rescored by heat and recency, as many as fit the budget.

    The cut to ``limit`` comes before the rescoring; ``nodes`` gives the current rows of a set of ids (id), at most so
    many. Ties go by node id.
    """
    top = index.relevance(index.words(query), require_all, among).orderBy(F.col("relevance").desc(), "node_id").limit(limit)
    _, top = Scratch(top.sparkSession, "search").write(top)
    rows = nodes(top.select(F.col("node_id").alias("id"))).withColumnRenamed("id", "node_id").join(F.broadcast(top), "node_id")
    scored = rows.select("node_id", "relevance", score(F.col("relevance"), F.col("temperature"), F.col("last_accessed_at"), now).alias("score"), "token_count")
    return greedy_budget(scored, budget)


def _measure(stem: str) -> int:
    """Porter's m: how many vowel-consonant sequences a stem has."""
    kinds = "".join("v" if _is_vowel(stem, i) else "c" for i in range(len(stem)))
    return len(re.findall("v+c+", kinds))


def _is_vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _is_vowel(w, i - 1))


def _has_vowel(stem: str) -> bool:
    return any(_is_vowel(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _is_vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _is_vowel(w, n - 1) and _is_vowel(w, n - 2) and not _is_vowel(w, n - 3) and w[-1] not in "wxy"


# Suffix rules of Porter's paper (1980), steps 2 to 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _suffix(w: str, rules: dict[str, str]) -> str:
    for s in sorted(rules, key=len, reverse=True):
        if w.endswith(s):
            stem = w[: -len(s)]
            return stem + rules[s] if _measure(stem) > 0 else w
    return w


def porter_stem(w: str) -> str:
    """Porter's stemmer of 1980."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and _has_vowel(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _suffix(_suffix(w, _STEP2), _STEP3)
    for s in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(s):
            stem = w[: -len(s)]
            if _measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def _stem_lists(tokens: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def stem(w: str) -> str:
        if w not in known:
            known[w] = porter_stem(w)
        return known[w]

    return tokens.map(lambda ws: [stem(w) for w in ws])


def stem_all(tokens) -> Column:
    """Porter stems of an array of words."""
    return F.pandas_udf(_stem_lists, "array<string>")(tokens)
