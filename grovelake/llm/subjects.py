"""Subject areas of documents: one-versus-rest linear classifiers on hashed word n-grams, trained on weak labels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import Scratch
from ..session import ship
from ..tables import exact
from .units import text_units

#: Size of the hashed feature space.
BUCKETS = 1 << 17
#: Bound of the training sample, whose texts are taken whole: documents with weak labels, and as many others.
TRAIN_DOCS = 4_000
#: A sampled document with more sentences and headings than this counts in the fits as much as one with so many: all its rows, each with a smaller weight.
FULL_WEIGHT_UNITS = 200
#: One labelled document in so many is kept from training for the calibration of thresholds.
HELD_OUT = 4
#: A subject is reported from this share of the document's sentences and items.
LEAST_SHARE = 0.25
#: Self-training rounds after the first fit on the weak labels, and strength of the weights' penalty.
ROUNDS, L2 = 3, 0.5
#: The best subject of a sentence must be so many times as probable as the second: to train on it, to count it.
SURE, CLEAR = 2.0, 1.3
#: A heading stands for a subject from so many documents with weak labels on, and this share of them.
SECTION_DOCS, SECTION_SHARE = 5, 0.7
#: Threshold without any held-out label, the grid that calibration chooses from, and the held-out documents that all subjects together count as in the choice for one.
THRESHOLD, GRID, POOLED_POSITIVES = 0.25, (0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5), 30
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


_hashes: dict[str, int] = {}
#: Odd factor that tells the first word of a pair from the second.
_ORDER = np.uint64(0x9E3779B97F4A7C15)
_BITS = BUCKETS.bit_length() - 1


def _hash(word: str) -> int:
    """Hash of a word; the worker remembers those it has seen."""
    if len(_hashes) > 500_000:
        _hashes.clear()
    found = _hashes[word] = xxhash.xxh64_intdigest(word)
    return found


def bucket_rows(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, sizes): the buckets of the words and word pairs of each sentence or item, each once, one unit after the other."""
    words, counts, known = [], [], _hashes
    for unit in units:
        found = _WORD.findall(unit.lower().replace("’", "'"))
        words += found
        counts.append(len(found))
    hashes = np.array([known.get(w) or _hash(w) for w in words], dtype=np.uint64)
    row = np.repeat(np.arange(len(units), dtype=np.int64), counts)
    beside = row[1:] == row[:-1]
    pairs = (hashes[:-1] * _ORDER + hashes[1:])[beside]
    buckets = (np.concatenate([hashes, pairs]) >> np.uint64(64 - _BITS)).astype(np.int64)
    once = np.unique(np.concatenate([row, row[1:][beside]]) << _BITS | buckets)
    return (once & (BUCKETS - 1)).astype(np.int32), np.bincount(once >> _BITS, minlength=len(units)).astype(np.int32)


def features(unit: str) -> np.ndarray:
    """Buckets of one sentence or item."""
    return bucket_rows([unit])[0]


class Rows:
    """Feature rows that are not empty, one after the other, each of length one under the weights ``idf``."""

    def __init__(self, index: np.ndarray, sizes: np.ndarray, idf: np.ndarray):
        self.index, self.n, self.width = index, len(sizes), len(idf)
        self.starts = np.cumsum(sizes, dtype=np.int64) - sizes
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        value = idf[index].astype(np.float32)
        norm = np.sqrt(np.add.reduceat(value * value, self.starts)) if self.n else value
        self.value = value / np.maximum(norm, 1e-9)[self.row]

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """One number per row, or one row per row where the weights have several columns."""
        picked = weights[self.index]
        value = self.value if weights.ndim == 1 else self.value[:, None]
        return np.add.reduceat(picked * value, self.starts, axis=0) if self.n else np.zeros((0, *weights.shape[1:]), np.float32)

    @cached_property
    def _by_bucket(self):
        order = np.argsort(self.index, kind="stable")
        buckets, starts = np.unique(self.index[order], return_index=True)
        return buckets, starts, self.row[order], self.value[order]

    def back(self, err: np.ndarray) -> np.ndarray:
        """The rows' errors brought back to the buckets."""
        buckets, starts, row, value = self._by_bucket
        out = np.zeros(self.width)
        if len(starts):
            out[buckets] = np.add.reduceat(err.astype(np.float32)[row] * value, starts)
        return out


#: Rows that are scored at a time.
SCORED_ROWS = 20_000


def fit_binary(x: Rows, y: np.ndarray, steps: int, l2: float = L2, rate: float = 0.5, weight: np.ndarray | float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression, one class against the rest, by full-batch steps with per-feature rates; rows count by ``weight``."""
    w, b, g2, gb2 = np.zeros(x.width), 0.0, np.full(x.width, 1e-6), 1e-6
    for _ in range(steps):
        err = weight * (1 / (1 + np.exp(-(x.dot(w.astype(np.float32)).astype(float) + b))) - y)
        g, gb = x.back(err) + l2 * w, err.sum()
        g2 += g * g
        gb2 += gb * gb
        w -= rate * g / np.sqrt(g2)
        b -= rate * gb / np.sqrt(gb2)
    return w, b


class Model:
    """Weights of all classifiers, the inverse document frequencies and one threshold per subject."""

    def __init__(self, subjects: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, thresholds: np.ndarray | None = None):
        self.subjects, self.idf, self.weights, self.bias = subjects, idf, weights, bias.astype(np.float32)
        self.thresholds = np.full(len(subjects), THRESHOLD) if thresholds is None else thresholds

    def probabilities(self, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """One row per unit, one column per subject: one sparse product with the matrix of all weights."""
        edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        z = np.zeros((len(sizes), len(self.subjects)), np.float32)
        for at in range(0, len(sizes), SCORED_ROWS):
            end = min(at + SCORED_ROWS, len(sizes))
            filled = sizes[at:end] > 0
            z[at:end][filled] = Rows(index[edges[at] : edges[end]], sizes[at:end][filled], self.idf).dot(self.weights)
        return 1 / (1 + np.exp(-(z + self.bias)))

    def best(self, p: np.ndarray, least, ratio: float) -> np.ndarray:
        """The subject of each row, -1 where none is probable enough or two are alike."""
        if p.shape[1] == 1:
            return np.where(p[:, 0] >= np.broadcast_to(least, 1), 0, -1)
        top = p.argmax(1)
        two = np.partition(p, -2, axis=1)[:, -2:]
        ok = (two[:, 1] >= np.broadcast_to(least, p.shape[1])[top]) & (two[:, 1] >= ratio * two[:, 0])
        return np.where(ok, top, -1)


#: Characters of text whose features are made at a time.
TEXT_BLOCK = 400_000
_FEATURES = pa.schema([("n_units", pa.int32()), ("sizes", pa.list_(pa.int32())), ("buckets", pa.list_(pa.int32())), ("heads", pa.list_(pa.string()))])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, kinds = b.column(2).to_pylist(), b.column(3).to_pylist()
        at = 0
        while at < len(texts):
            units, heads, rows, low, size = [], [], [], at, 0
            while at < len(texts) and size < TEXT_BLOCK:
                found, titles = text_units(texts[at], kinds[at])
                units += [*found, *titles]
                rows.append((len(found), len(found) + len(titles)))
                heads.append(list(dict.fromkeys(t.strip().lower() for t in titles if t.strip())))
                size += len(texts[at])
                at += 1
            buckets, sizes = bucket_rows(units)
            upto = np.concatenate([[0], np.cumsum([n for _, n in rows])]).astype(np.int32)
            edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[upto].astype(np.int32)
            columns = [
                pa.array([n for n, _ in rows], pa.int32()),
                pa.ListArray.from_arrays(pa.array(upto), pa.array(sizes)),
                pa.ListArray.from_arrays(pa.array(edges), pa.array(buckets)),
                pa.array(heads, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0)[low:at], b.column(1)[low:at], *columns], names=["doc_id", "source_file", *_FEATURES.names])


def unit_features(documents: DataFrame) -> DataFrame:
    """(doc_id, source_file, n_units, sizes, buckets, heads): the hashed features of each document's whole text.

    ``buckets`` holds those of the ``n_units`` sentences and items and then those of the headings, one after the other,
    ``sizes`` how many each has, ``heads`` the headings themselves. Null and blank texts and null ids have no row. Write
    it once: all else reads this table in place of the texts.
    """
    ship(documents.sparkSession)
    key = documents.schema["doc_id"].dataType.simpleString()
    rows = exact(documents, "doc_id", "source_file", "text", "doc_format").where(F.col("doc_id").isNotNull() & (F.length(F.trim("text")) > 0))
    return rows.mapInArrow(_featured, f"doc_id {key}, source_file string, n_units int, sizes array<int>, buckets array<int>, heads array<string>")


def weak_labels(units: DataFrame, areas: list[str], labels: DataFrame | None) -> DataFrame:
    """(doc_id, _weak, _held) of each document: subjects of the address path, of hand labels or of section headings; hand labels kept for calibration.

    Path and hand labels come first. A heading that stands for a subject (``section_subjects``) labels the documents
    that have neither. Held-out documents have no weak label.
    """
    folders = F.filter(F.transform(F.split(F.coalesce("source_file", F.lit("")), "[/\\\\]"), lambda x: F.lower(F.trim(x))), lambda x: x.isin(areas))
    none = F.array().cast("array<string>")
    rows = units.select("doc_id", "heads", F.array_distinct(folders).alias("_path"))
    if labels is None:
        rows = rows.select("doc_id", "heads", F.col("_path").alias("_weak"), F.lit(None).cast("array<string>").alias("_held"))
    else:
        known = exact(labels, "doc_id", "subject").where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_set(F.lower(F.trim("subject"))).alias("_hand"))
        rows = rows.join(known, "doc_id", "left")
        held = (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD_OUT)) == 0) & F.col("_hand").isNotNull()
        hand = F.filter(F.coalesce("_hand", none), lambda x: x.isin(areas))
        rows = rows.select("doc_id", "heads", F.when(held, none).otherwise(F.array_union("_path", hand)).alias("_weak"), F.when(held, hand).alias("_held"))
    # read twice below; only ids, labels and headings
    _, rows = Scratch(units.sparkSession, "weak-labels").write(rows)
    bare = (F.size("_weak") == 0) & F.col("_held").isNull()
    named = rows.where(bare).select("doc_id", F.explode("heads").alias("head")).join(section_subjects(rows), "head").groupBy("doc_id").agg(F.collect_set("subject").alias("_section"))
    return rows.join(named, "doc_id", "left").select("doc_id", F.when(bare, F.coalesce("_section", none)).otherwise(F.col("_weak")).alias("_weak"), "_held")


def section_subjects(rows: DataFrame) -> DataFrame:
    """(head, subject): headings of which at least ``SECTION_DOCS`` documents with weak labels, and ``SECTION_SHARE`` of them, have one subject."""
    seen = rows.select(F.explode("heads").alias("head"), "_weak").select("head", F.explode("_weak").alias("subject")).groupBy("head", "subject").count()
    heads = seen.groupBy("head").agg(F.sum("count").alias("n"), F.max(F.struct("count", "subject")).alias("top"))
    clear = (F.col("top.count") >= SECTION_DOCS) & (F.col("top.count") >= SECTION_SHARE * F.col("n"))
    return heads.where(clear).select("head", "top.subject")


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, np.int64), 0
    for b in batches:
        df += np.bincount(b.column(1).flatten().to_numpy(), minlength=BUCKETS)  # each bucket is in a unit once
        n += int(np.count_nonzero(b.column(0).flatten().to_numpy()))
    at = np.nonzero(df)[0]
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n))], names=["bucket", "n"])


def corpus_counts(units: DataFrame) -> tuple[np.ndarray, int]:
    """(units and headings that have each bucket, number of units and headings), over the whole texts of all documents."""
    # one row per bucket, and -1 for the number of rows
    found = units.select("sizes", "buckets").mapInArrow(_count_buckets, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    df = np.zeros(BUCKETS, np.int64)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return df, int(n[bucket < 0].sum())


def training_sample(units: DataFrame, weak: DataFrame, docs: int = TRAIN_DOCS) -> pa.Table:
    """(doc_id, _weak, sizes, buckets) of at most ``2 * docs`` documents: in hash order those with weak labels, and others; none that is held out."""
    keys = weak.where(F.col("_held").isNull()).select("doc_id", "_weak", F.xxhash64("doc_id", F.lit("sample")).alias("_order"))
    labelled = F.size("_weak") > 0
    pick = lambda k: k.orderBy("_order", "doc_id").limit(docs).select("doc_id", "_weak")
    # the picked ids are at most 2 * docs
    chosen = pick(keys.where(labelled)).unionByName(pick(keys.where(~labelled)))
    return units.select("doc_id", "sizes", "buckets").join(F.broadcast(chosen), "doc_id").select("doc_id", "_weak", "sizes", "buckets").toArrow()


def train(units: DataFrame, areas: DataFrame, labels: DataFrame | None = None, docs: int = TRAIN_DOCS) -> Model:
    """One linear classifier per subject, each fitted by a Spark task of its own on the bounded sample, and calibrated thresholds; ``units`` is ``unit_features``, written.

    Only the rows of the fits are bounded: the inverse document frequencies and the frequent words are those of all
    documents. A bucket that is nowhere in the sample has no weight, so it has no value either.
    The first round learns from weak labels: every unit and heading of a document has the subjects of its address path,
    hand labels or section headings. In the next rounds a unit has the one subject of which the classifiers together are
    sure; units that look alike to all of them and consist of frequent words are taken as "none"; the rest is left out.
    """
    spark = units.sparkSession
    ship(spark)
    subjects = sorted(r[0].strip().lower() for r in exact(areas, "subject").where(F.col("subject").isNotNull()).distinct().collect())
    _, weak_rows = Scratch(spark, "weak-labels").write(weak_labels(units, subjects, labels))
    sample = training_sample(units, weak_rows, docs)
    lists, sizes = sample["sizes"].combine_chunks(), sample["sizes"].combine_chunks().flatten().to_numpy()
    index = sample["buckets"].combine_chunks().flatten().to_numpy()
    per_doc = np.diff(lists.offsets.to_numpy())
    doc = np.repeat(np.arange(len(per_doc)), per_doc)[sizes > 0]
    sizes = sizes[sizes > 0]
    n = len(sizes)
    df, n_corpus = corpus_counts(units)
    known = np.bincount(index, minlength=BUCKETS) > 0
    idf = np.where(known, np.log((n_corpus + 1) / (df + 1)), 0).astype(np.float32)
    of_doc = np.zeros((len(per_doc), len(subjects)), dtype=bool)
    given = sample["_weak"].combine_chunks()
    number = {s: j for j, s in enumerate(subjects)}
    named = np.array([number[x] for x in given.flatten().to_pylist()], dtype=np.int64)
    of_doc[np.repeat(np.arange(len(per_doc)), np.diff(given.offsets.to_numpy())), named] = True
    weak = of_doc[doc]
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    frequent = (np.minimum.reduceat(df[index], starts) if n else df[:0]) >= max(8, 0.0005 * n_corpus)
    model = Model(subjects, idf, np.zeros((BUCKETS, len(subjects)), np.float32), np.full(len(subjects), -9.0))
    if not n or not weak.any():
        return model
    # the fits know only the buckets of the sample, by their place among them
    columns = np.nonzero(known)[0]
    place = np.zeros(BUCKETS, np.int32)
    place[columns] = np.arange(len(columns))
    weight = np.minimum(1.0, FULL_WEIGHT_UNITS / np.maximum(1, per_doc))[doc]
    shared = spark.sparkContext.broadcast((place[index], sizes, idf[columns], weight))
    for r in range(ROUNDS + 1):
        if r == 0:
            use, target = weak.any(1), weak
        else:
            p = model.probabilities(index, sizes)
            sure = model.best(p, 0.1, SURE)
            two = np.sort(p, axis=1)
            alike = (two[:, -1] < 1.5 * two[:, -2]) if r == 1 and p.shape[1] > 1 else two[:, -1] < 0.15
            use = (sure >= 0) | (alike & frequent & (sure < 0))
            target = sure[:, None] == np.arange(len(subjects))
        model = _fit_all(spark, shared, subjects, idf, columns, use, target, 80 if r == 0 else 50)
    model.thresholds = choose_thresholds(held_out_counts(units, weak_rows, model), len(subjects))
    shared.destroy()
    return model


def _fit_all(spark, shared, subjects, idf, columns, use, target, steps) -> Model:
    """One Spark task per subject; each returns its weights."""
    plan = spark.sparkContext.broadcast((use, target[use]))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for j in b["j"]:
                (index, sizes, idf, weight), (use, target) = shared.value, plan.value
                w, bias = fit_binary(Rows(index[np.repeat(use, sizes)], sizes[use], idf), target[:, j].astype(float), steps, weight=weight[use])
                yield pd.DataFrame([(j, float(bias), w.astype(np.float32).tobytes())], columns=["j", "bias", "weights"])

    tasks = spark.range(len(subjects), numPartitions=len(subjects)).withColumnRenamed("id", "j")
    weights, bias = np.zeros((BUCKETS, len(subjects)), np.float32), np.zeros(len(subjects))
    for row in tasks.mapInPandas(fit, "j long, bias double, weights binary").collect():
        weights[columns, row["j"]], bias[row["j"]] = np.frombuffer(row["weights"], dtype=np.float32), row["bias"]
    plan.destroy()
    return Model(subjects, idf, weights, bias)


#: Documents that are scored at a time.
SCORED_DOCS = 512


def _best_by_block(b: pa.RecordBatch, model: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, units per document, and per clear sentence or item: its document, subject, probability) of a batch of (n_units, sizes, buckets), some documents at a time."""
    n_units = b.column(0).to_numpy()
    upto, sizes = b.column(1).offsets.to_numpy(), b.column(1).flatten().to_numpy()
    upto = upto - upto[0]
    edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    buckets = b.column(2).flatten().to_numpy()
    for at in range(0, b.num_rows, SCORED_DOCS):
        end = min(at + SCORED_DOCS, b.num_rows)
        rows = upto[at : end + 1]
        doc = np.repeat(np.arange(end - at), np.diff(rows))
        place = np.arange(rows[0], rows[-1]) - rows[doc]
        p = model.probabilities(buckets[edges[rows[0]] : edges[rows[-1]]], sizes[rows[0] : rows[-1]])
        top = model.best(p, 0.0, CLEAR)
        ok = (top >= 0) & (place < n_units[at:end][doc])  # headings come after the units
        yield at, n_units[at:end], doc[ok], top[ok], p[ok, top[ok]]


def _held_out(model_ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_ref.value
        k = len(model.subjects)
        counts = np.zeros((k, len(GRID), 3), np.int64)
        for b in batches:
            held = b.column(3).to_pylist()
            for at, n, doc, top, p in _best_by_block(b, model):
                want = np.array([np.isin(model.subjects, held[at + i]) for i in range(len(n))]).reshape(len(n), k)
                for i, t in enumerate(GRID):
                    sure = p >= t
                    found = np.bincount(doc[sure] * k + top[sure], minlength=len(n) * k).reshape(len(n), k)
                    got = (n[:, None] > 0) & (found >= LEAST_SHARE * n[:, None])
                    counts[:, i] += np.stack([(got & want).sum(0), got.sum(0), want.sum(0)], axis=1)
        j, i = (x.ravel().astype(np.int32) for x in np.indices(counts.shape[:2]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (j, i, *(counts[:, :, at].ravel() for at in range(3)))], names=["j", "i", "hits", "got", "want"])

    return run


def held_out_counts(units: DataFrame, weak: DataFrame, model: Model) -> pd.DataFrame:
    """(j, i, hits, got, want) per subject and threshold of ``GRID``, over the whole texts of all held-out documents."""
    held = weak.where(F.col("_held").isNotNull()).select("doc_id", "_held")
    rows = units.select("doc_id", "n_units", "sizes", "buckets").join(held, "doc_id").select("n_units", "sizes", "buckets", "_held")
    counted = rows.mapInArrow(_held_out(units.sparkSession.sparkContext.broadcast(model)), "j int, i int, hits long, got long, want long")
    # one row per subject and threshold
    return counted.groupBy("j", "i").agg(*[F.sum(c).alias(c) for c in ("hits", "got", "want")]).toPandas()


def choose_thresholds(counts: pd.DataFrame, subjects: int) -> np.ndarray:
    """The threshold of each subject with the best F1, in which all subjects together count as ``POOLED_POSITIVES`` documents more.

    One rule for any number of held-out documents: a subject with few has nearly the pooled threshold, one with many its own.
    """
    own = np.zeros((subjects, len(GRID), 3))
    own[counts["j"], counts["i"]] = counts[["hits", "got", "want"]]
    pooled = own.sum(0)
    if not pooled[:, 2].any():
        return np.full(subjects, THRESHOLD)
    hits, got, want = np.moveaxis(own + POOLED_POSITIVES * pooled / pooled[:, 2:], 2, 0)
    f1 = 2 * hits / (got + want)
    out = np.full(subjects, THRESHOLD)
    for j in range(subjects):
        # the middle of the thresholds that are equally good
        good = np.nonzero(f1[j] >= f1[j].max() - 1e-9)[0]
        out[j] = GRID[good[len(good) // 2]]
    return out


def _shares(model_ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_ref.value
        k = len(model.subjects)
        names = pa.array(model.subjects, pa.string())
        for b in batches:
            for at, n, doc, top, p in _best_by_block(b, model):
                sure = p >= model.thresholds[top]
                found = np.bincount(doc[sure] * k + top[sure], minlength=len(n) * k)
                one = np.nonzero(found)[0]
                share = found[one] / n[one // k]
                columns = [b.column(3).take(pa.array(at + one // k)), names.take(pa.array(one % k)), pa.array(found[one]), pa.array(share)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "subject", "n_units", "share"])

    return run


def subject_shares(units: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject, n_units, share): how much of each document's sentences and items each subject takes up.

    ``units`` is ``unit_features``: whole texts of all documents; null, empty and blank texts and subjects that take up
    nothing have no row.
    """
    spark = units.sparkSession
    ship(spark)
    key = units.schema["doc_id"].dataType.simpleString()
    rows = units.select("n_units", "sizes", "buckets", "doc_id")
    return rows.mapInArrow(_shares(spark.sparkContext.broadcast(model)), f"doc_id {key}, subject string, n_units long, share double")


def corpus_shares(documents: DataFrame, areas: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``subject_shares`` of a corpus by classifiers trained on it. Texts are read once; their features are a written table."""
    _, units = Scratch(documents.sparkSession, "subjects").write(unit_features(documents))
    return subject_shares(units, train(units, areas, labels))


def document_subjects(documents: DataFrame, areas: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject): the subject areas that take up at least ``LEAST_SHARE`` of a document."""
    shares = corpus_shares(documents, areas, labels)
    return shares.where(F.col("share") >= LEAST_SHARE).select("doc_id", "subject").distinct()
