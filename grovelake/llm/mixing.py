"""Mixing sources to target shares of tokens: budgets down a tree, shortages among siblings first, prefixes of seeded epochs."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import Scratch
from ..tables import exact
from .encoding import token_counts

#: Seed of the epochs' orders.
SEED = "mix-1"
#: Documents in a hash bucket, about; prefix sums are taken over a leaf's buckets, of which there are 2 to 2 ** MOST_BITS.
BUCKET_DOCS, MOST_BITS = 64, 20
#: A language weighs its tokens to this power within its source, so that rare languages are not drowned (1: in proportion).
LANGUAGE_POWER = 0.5
#: Formats that are leaves of their own; all others are one.
FORMATS = ("md", "yaml", "json", "jsonl", "html", "toon", "txt")
LEAF = ["mix_name", "source", "lang", "format"]


def source_key(column) -> F.Column:
    """Sources compare without case, outer spaces and kind of separator."""
    return F.regexp_replace(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), r"(?U)[\s_-]+", "_")


def language_key(column) -> F.Column:
    """The language without region, ``und`` where it is missing or no code of two or three letters."""
    base = F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(base != "", base).otherwise("und")


@dataclass
class Branch:
    """A node of the weight tree. A leaf has the tokens of one epoch and how often it may be repeated."""

    name: str
    weight: float = 1.0
    tokens: int = 0
    max_repeats: int = 0
    children: list[Branch] = field(default_factory=list)

    @property
    def capacity(self) -> float:
        return sum(c.capacity for c in self.children) if self.children else float(self.tokens * self.max_repeats)


def allocate(branch: Branch, budget: float, path: tuple[str, ...] = ()) -> dict[tuple[str, ...], float]:
    """Tokens of each leaf. What a child cannot use goes to its siblings by weight, and only what no sibling can use back to the parent's siblings."""
    path = (*path, branch.name)
    if not branch.children:
        return {path: min(budget, branch.capacity)}
    out, given = {}, _fill([(c.weight, c.capacity) for c in branch.children], min(budget, branch.capacity))
    for child, share in zip(branch.children, given):
        out |= allocate(child, share, path)
    return out


def _fill(children: list[tuple[float, float]], budget: float) -> list[float]:
    """Shares by weight, none above its capacity; the excess of full ones is spread over the others until all is placed."""
    given, open_ = [0.0] * len(children), [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    left = budget
    while open_ and left > 1e-9:
        total = sum(children[i][0] for i in open_)
        full = [i for i in open_ if left * children[i][0] / total >= children[i][1]]
        if not full:
            for i in open_:
                given[i] = left * children[i][0] / total
            return given
        for i in full:
            given[i] = children[i][1]
        left -= sum(children[i][1] for i in full)
        open_ = [i for i in open_ if i not in full]
    return given


def largest_budget(root: Branch) -> float:
    """The most tokens at which every child that has any capacity still gets its share in full."""
    usable = [c for c in root.children if c.weight > 0 and c.capacity > 0]
    total = sum(c.weight for c in usable)
    return min((c.capacity * total / c.weight for c in usable), default=0.0)


def format_key(column) -> F.Column:
    """One of ``FORMATS``, or ``other``."""
    name = F.lower(F.trim(column))
    return F.when(name.isin(*FORMATS), name).otherwise("other")


def keyed(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(key: struct of doc_id, source, lang and format; text) of the documents whose source some target names."""
    wanted = {r["source"] for r in _targets(targets)}  # as many as a hand-written table has
    documents = exact(documents, "doc_id", "text", "source", "lang", "doc_format")
    key = F.struct("doc_id", source_key(F.col("source")).alias("source"), language_key(F.col("lang")).alias("lang"), format_key(F.col("doc_format")).alias("format"))
    return documents.select(key.alias("key"), "text").where(F.col("doc_id").isNotNull() & F.col("key.source").isin(*wanted))


def sized(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, lang, format, n_tokens) of the documents that have tokens and a wanted source; repeated rows are one. Written once, read by budgets and selection."""
    sizes = token_counts(keyed(documents, targets), "key", "text", vocabulary).where(F.col("n_tokens") > 0)
    one = sizes.groupBy(F.col("key.doc_id").alias("doc_id")).agg(F.max(F.struct("n_tokens", "key")).alias("r"))
    rows = one.select("doc_id", *[f"r.key.{c}" for c in LEAF[1:]], "r.n_tokens")
    return Scratch(documents.sparkSession, "mixing").write(rows)[1]


def _targets(targets: DataFrame) -> list:
    targets = exact(targets, "mix_name", "source", "target_share", "max_repeats")
    return targets.select("mix_name", source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where(F.col("source").isNotNull()).distinct().collect()


_PLAN = "mix_name string, source string, lang string, format string, target_share double, capacity double, budget double, epoch_tokens long, full_epochs int, rest double, bits int"


def plan(sizes: DataFrame, targets: DataFrame, totals: dict[str, float] | str | None = None) -> DataFrame:
    """(mix_name, source, lang, format, target_share, capacity, budget, epoch_tokens, full_epochs, rest, bits) of each leaf; bits: of the hash, for its buckets.

    The tree of a mix is mix, source (the domain that the targets name; weight: its target share), language (weight: its
    tokens to the power ``LANGUAGE_POWER``), format (weight: its tokens). A leaf holds at most its tokens times the
    source's repeats. What a leaf cannot use goes to the formats beside it, then to other languages of the source, and
    only what the whole source cannot use to other sources.

    ``totals`` gives the tokens of each mix; ``"all"`` means as many as all its sources have together. Without one, the
    largest is taken at which each source that has documents gets its share in full. The tree is built from sums over
    all documents: at most one row per wanted source, language code and format comes to the driver.
    """
    counted = sizes.groupBy(*LEAF[1:]).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()
    rows, out = _targets(targets), []
    for mix in sorted({r["mix_name"] for r in rows}):
        wanted = {r["source"]: r for r in rows if r["mix_name"] == mix}
        leaves: dict[str, dict[str, list]] = {s: {} for s in sorted(wanted)}
        for c in sorted(counted, key=lambda c: (c["lang"], c["format"])):
            if c["source"] in leaves:
                leaves[c["source"]].setdefault(c["lang"], []).append(c)
        root = Branch(mix)
        for source, langs in leaves.items():
            most = max(0, wanted[source]["max_repeats"] or 0)
            branches = [
                Branch(lang, sum(c["n"] for c in cs) ** LANGUAGE_POWER, children=[Branch(c["format"], float(c["n"]), c["n"], most) for c in cs])
                for lang, cs in langs.items()
            ]
            # a source without documents is a leaf of no capacity
            root.children.append(Branch(source, weight=max(0.0, wanted[source]["target_share"] or 0.0), children=branches))
        total = sum(c["n"] for langs in leaves.values() for cs in langs.values() for c in cs) if totals == "all" else (totals or {}).get(mix)
        given = allocate(root, largest_budget(root) if total is None else float(total))
        for source, langs in leaves.items():
            most = max(0, wanted[source]["max_repeats"] or 0)
            for c in [c for cs in langs.values() for c in cs]:
                budget, size = given[mix, source, c["lang"], c["format"]], c["n"]
                full = min(int((budget + 1e-6) // size), most)
                rest = max(0.0, budget - full * size) if full < most else 0.0
                bits = min(MOST_BITS, max(1, int(math.log2(max(1, c["docs"] / BUCKET_DOCS)))))
                out.append((mix, source, c["lang"], c["format"], float(wanted[source]["target_share"] or 0), float(size * most), float(budget), size, full, rest, bits))
    return sizes.sparkSession.createDataFrame(out, _PLAN)


def select(sizes: DataFrame, leaves: DataFrame, seed: str = SEED) -> DataFrame:
    """(mix_name, doc_id, source, lang, format, n_tokens, repeats): which documents the leaves' budgets take, and how often.

    Every document of a leaf comes ``full_epochs`` times; the last epoch's order is a seeded hash, and its prefix of the
    leaf's remaining tokens comes once more. The prefix ends before or after the document that crosses its end, so that
    the leaves of a source together are as near to its budget as can be. Prefix sums are taken over hash buckets of a
    leaf, so a source may hold any part of all rows; only the bucket in which the prefix ends is sorted. Ties in the
    hash go by doc_id.
    """
    # one row per mix, source, language code and format
    rows = sizes.join(F.broadcast(leaves.drop("target_share", "capacity", "budget")), LEAF[1:])
    rows = rows.withColumn("_order", F.xxhash64(F.lit(seed), "mix_name", "full_epochs", "doc_id"))
    rows = rows.withColumn("_bucket", F.expr("shiftrightunsigned(_order, 64 - bits)"))
    sums = rows.groupBy(*LEAF, "rest", "_bucket").agg(F.sum("n_tokens").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*LEAF).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    last = sums.withColumn("_before", before).where((F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_n") >= F.col("rest")))
    # at most one row per leaf: the bucket in which its prefix ends
    edge = last.select(*LEAF, F.col("_bucket").alias("_edge"), (F.col("rest") - F.col("_before")).alias("_room"))
    marked = rows.join(F.broadcast(edge), LEAF, "left")
    at_edge = F.coalesce(F.col("_bucket") == F.col("_edge"), F.lit(False))
    inside = marked.where(~at_edge).withColumn("_extra", F.coalesce(F.col("_bucket") < F.col("_edge"), F.lit(False)))
    order = Window.partitionBy(*LEAF).orderBy(F.expr("shiftrightunsigned(_order, 1)"), F.expr("_order & 1"), "doc_id")
    border = marked.where(at_edge).withColumn("_lacks", F.col("_room") - F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("n_tokens"))
    crossing = border.where((F.col("_lacks") > 0) & (F.col("_lacks") < F.col("n_tokens"))).select(*LEAF, "doc_id", "n_tokens", "_lacks")
    taken = _nearest(crossing.collect())  # at most one row per leaf
    chosen = sizes.sparkSession.createDataFrame(taken, crossing.select(*LEAF, "doc_id").schema).withColumn("_taken", F.lit(True))
    border = border.join(F.broadcast(chosen), [*LEAF, "doc_id"], "left")
    border = border.withColumn("_extra", (F.col("_lacks") >= F.col("n_tokens")) | F.coalesce("_taken", F.lit(False)))
    repeats = F.col("full_epochs") + F.col("_extra").cast("int")
    return inside.unionByName(border.drop("_taken", "_lacks")).where(repeats > 0).select("mix_name", "doc_id", *LEAF[1:], "n_tokens", repeats.alias("repeats"))


def _nearest(crossing: list) -> list[tuple]:
    """Of the documents at the leaves' ends those to take: the large ones first, each so that its source misses its budget by least."""
    missing: dict[tuple, float] = {}
    taken = []
    for r in sorted(crossing, key=lambda r: (-r["n_tokens"], *[r[c] for c in LEAF])):
        source = (r["mix_name"], r["source"])
        without = missing.get(source, 0.0) + r["_lacks"]
        take = abs(without - r["n_tokens"]) < abs(without)
        missing[source] = without - r["n_tokens"] * take
        if take:
            taken.append((*[r[c] for c in LEAF], r["doc_id"]))
    return taken


def mix(documents: DataFrame, targets: DataFrame, totals: dict[str, float] | str | None = None, vocabulary: str | None = None, seed: str = SEED) -> DataFrame:
    """(mix_name, doc_id, source, lang, format, n_tokens, repeats): the documents of each mix by the budgets of ``plan``.

    Documents without tokens or id, and sources that no mix names, are in no mix.
    """
    sizes = sized(documents, targets, vocabulary)
    return select(sizes, plan(sizes, targets, totals), seed)


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, n_docs, n_tokens, max_used, actual_share): what each source really contributes; 0 for one that gives nothing."""
    wanted = exact(targets, "mix_name", "source", "target_share").select("mix_name", source_key(F.col("source")).alias("source"), "target_share").distinct()
    used = mixed.groupBy("mix_name", "source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("max_used")
    )
    rows = wanted.join(used, ["mix_name", "source"], "left").na.fill(0, ["n_docs", "n_tokens", "max_used"])
    # one row per mix and source
    total = F.sum("n_tokens").over(Window.partitionBy("mix_name"))
    return rows.withColumn("actual_share", F.when(total > 0, F.col("n_tokens") / total).otherwise(0.0))


def shortages(mixed: DataFrame, leaves: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_shares`` with (capacity, budget, moved): the most each source can give, what it was asked for, and how much of that came from sources that ran short (below 0: what it could not give)."""
    asked = leaves.groupBy("mix_name", "source").agg(F.sum("capacity").alias("capacity"), F.sum("budget").alias("budget"))
    rows = mix_shares(mixed, targets).join(asked, ["mix_name", "source"], "left").na.fill(0.0, ["capacity", "budget"])
    # one row per mix and source
    return rows.withColumn("moved", F.col("budget") - F.col("target_share") * F.sum("budget").over(Window.partitionBy("mix_name")))
