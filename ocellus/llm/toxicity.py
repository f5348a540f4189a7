"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017) with linear classifiers in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, bytes_of, frugal, longs_of, parts, per_batch, public_id, slim, small_table, stage
from .rolling import Words

#: Feature space; most labelled rows that a fit reads as confirmed and as unlabelled texts; and most word features of all of them.
DIMENSIONS = 1 << 17
MOST_POSITIVE, MOST_UNLABELLED, MOST_ENTRIES = 4_000, 12_000, 8_000_000
FOLDS = 5
CLASSIFIERS, STEPS, RATE, RIDGE = 3, 100, 0.1, 1e-4
#: Words in a smaller share of all texts are left out, unless so many of the confirmed toxic ones hold them.
LEAST_SHARE, LEAST_TOXIC_SHARE, LEAST_TOXIC = 0.002, 0.01, 3
#: Steps of the scores' histogram that the threshold is read from, a unit of the logit, and its ends.
STEP, MOST_LOGIT = 1000, 50
#: Bytes of text whose features a task holds at a time.
SLICE = 2_000_000
#: Letters, digits and all bytes of longer code points make words; the rest parts them.
_APART = np.ones(256, bool)
_APART[0x80:] = False
for _a, _b in (("0", "9"), ("a", "z"), ("A", "Z")):
    _APART[ord(_a) : ord(_b) + 1] = False


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that labels are never learnt from; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Sparse:
    """Rows of weighted word features, each of unit length."""

    start: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        each = np.append(self.value * w.astype(np.float32)[self.index], np.float32(0))
        return np.where(np.diff(self.start) > 0, np.add.reduceat(each, self.start[:-1]), 0).astype(np.float64) if len(self.start) > 1 else np.zeros(0)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * np.repeat(g.astype(np.float32), np.diff(self.start)), DIMENSIONS)

    def take(self, rows: np.ndarray) -> Sparse:
        n = np.diff(self.start)[rows]
        at = np.repeat(self.start[rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return Sparse(np.r_[0, np.cumsum(n)], self.index[at], self.value[at])


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, word numbers (each once a row) and 1 + log of their counts."""
    words = Words([t.lower() for t in texts], _APART)
    feature = (words.hashes() % np.uint64(DIMENSIONS)).astype(np.int64)
    key, n = np.unique(words.doc.astype(np.int64) * DIMENSIONS + feature, return_counts=True)
    start = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.int64) * DIMENSIONS)
    return start, (key % DIMENSIONS).astype(np.int32), 1 + np.log(n)


def weighted(start: np.ndarray, index: np.ndarray, value: np.ndarray, idf: np.ndarray) -> Sparse:
    v = value.astype(np.float32) * idf.astype(np.float32)[index]
    norm = np.sqrt(np.maximum(Sparse(start, index, v * v).dot(np.ones(DIMENSIONS)), 1e-12)).astype(np.float32)
    return Sparse(start, index, v / np.repeat(norm, np.diff(start)))


def risk(positive: Sparse, unlabelled: Sparse, prior: float, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
    """The non-negative risk prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with logistic loss, and the gradient to follow: the risk's,
    or, where the part for clean texts is below zero, that of raising it again."""
    n_p, n_u = len(positive.start) - 1, len(unlabelled.start) - 1
    zp, zu = positive.dot(w) + b, unlabelled.dot(w) + b
    up, uu = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))  # slopes of the loss of calling a text clean
    clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    gp, gu = prior * up / n_p, uu / n_u
    gp, gu = (prior * (up - 1) / n_p - gp, gu) if clean >= 0 else (gp, -gu)
    return prior * np.logaddexp(0, -zp).mean() + max(0.0, clean), positive.back(gp) + unlabelled.back(gu), gp.sum() + gu.sum()


def fit(positive: Sparse, unlabelled: Sparse, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and offset that make the risk, with a ridge, small: steps of Adam."""
    x = np.zeros(DIMENSIONS + 1)
    x[-1] = np.log(prior / (1 - prior))
    m, s = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for t in range(1, steps + 1):
        _, gw, gb = risk(positive, unlabelled, prior, x[:-1], float(x[-1]))
        g = np.append(gw + RIDGE * x[:-1], gb)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        x -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return x[:-1], float(x[-1])


@dataclass
class Model:
    """Classifier k didn't read the texts of part k."""

    weights: np.ndarray
    offsets: np.ndarray
    idf: np.ndarray

    def logits(self, texts: list[bytes], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By all classifiers, and by the one that didn't read the text."""
        rows = weighted(*features(texts), self.idf)
        each = np.stack([rows.dot(w) + b for w, b in zip(self.weights, self.offsets, strict=True)])
        return each.mean(axis=0), each[parts, np.arange(len(texts))]


def part_of(ids: np.ndarray) -> np.ndarray:
    """The part of each doc_id, which one classifier doesn't read."""
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(40)) % np.uint64(CLASSIFIERS)).astype(np.int64)


def _counter(toxic):
    """In how many texts each feature is, and in how many of the confirmed toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, DIMENSIONS), np.int64)
        for whole in batches:
            for batch in parts(whole, most=SLICE):
                start, index, _ = features(bytes_of(batch, "text"))
                n[0] += np.bincount(index, minlength=DIMENSIONS)
                known = np.isin(longs_of(batch, "doc_id"), toxic.value)
                if known.any():
                    n[1] += np.bincount(index[np.repeat(known, np.diff(start))], minlength=DIMENSIONS)
        at = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[0][at]), pa.array(n[1][at])], names=["feature", "n", "n_toxic"])

    return run


FEATURES = "doc_id long, size int, index binary, value binary"


def _featuriser(idf):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        start, index, value = features(bytes_of(batch, "text"))
        keep = idf.value[index] > 0
        start = np.r_[0, np.cumsum(keep)][start]
        index, value = index[keep], value[keep].astype(np.float32)
        cut = [slice(a, b) for a, b in zip(start[:-1], start[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(start).astype(np.int32)), pa.array([index[c].tobytes() for c in cut], pa.binary()), pa.array([value[c].tobytes() for c in cut], pa.binary())], names=["doc_id", "size", "index", "value"]
        )

    return per_batch(run, SLICE)


def _sample(known: DataFrame, most_positive: int, most_unlabelled: int) -> tuple[list[int], list[int]]:
    """Ids of confirmed toxic texts, and of labelled texts taken without their label, in the order of a hash of doc_id."""
    by_hash = [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")]
    first = lambda df, most: [r["doc_id"] for r in df.select("doc_id").distinct().orderBy(*by_hash).limit(most).collect()]
    return first(known.where("toxic = 1"), most_positive), first(known, most_unlabelled)


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, most_entries: int = MOST_ENTRIES) -> tuple[Model, float] | None:
    """Fit on a bounded sample of the labelled rows that aren't held out, by a hash of doc_id: at most ``most_positive`` texts labelled
    toxic, and at most ``most_unlabelled`` texts that count as unlabelled, whose labels aren't read. Both stop early where their words
    would pass ``most_entries`` features, so the driver never holds more, however long the texts. (Of rows that share an id the one with
    the smallest text counts.)

    All else covers all rows. Document frequencies are counted over the whole corpus. The class prior is the share of toxic among
    the labels that may be learnt from. CLASSIFIERS linear classifiers are each fitted without the texts of one part; a text's own part's
    logits, over the whole corpus, give the threshold: the share above it is the prior. Returns the model and the prior; None without a toxic label or any other text.
    """
    spark = docs.sparkSession
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id")))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == n:
        return None
    prior = toxic / n
    rows = slim(docs)
    positive, unlabelled = _sample(known, most_positive, most_unlabelled)
    sent = spark.sparkContext.broadcast(np.array(sorted(positive), np.int64))
    counted = rows.mapInArrow(frugal(_counter(sent)), "feature int, n long, n_toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    found = np.zeros((2, DIMENSIONS))
    for r in counted.toLocalIterator():  # at most DIMENSIONS rows
        found[:, r["feature"]] = r["n"], r["n_toxic"]
    texts = rows.count()
    wanted = (found[0] >= LEAST_SHARE * texts) | (found[1] >= max(LEAST_TOXIC, LEAST_TOXIC_SHARE * len(positive)))
    idf = np.where(wanted & (found[0] > 0), np.log((1 + texts) / (1 + found[0])) + 1, 0.0)
    chosen = small_table(spark, doc_id=pa.array(sorted({*positive, *unlabelled}), pa.int64()))  # at most both bounds
    some = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    table = stage(some.mapInArrow(_featuriser(spark.sparkContext.broadcast(idf)), FEATURES), "features")
    size = {r["doc_id"]: r["size"] for r in table.select("doc_id", "size").collect()}
    ids, left = {}, most_entries
    for kind, share in ((positive, 4), (unlabelled, 1)):  # a quarter is for the confirmed ones at most
        there = [i for i in kind if i in size]
        fits = np.cumsum([size[i] for i in there]) <= left // share
        ids[share] = [i for i, ok in zip(there, fits, strict=True) if ok]
        left -= sum(size[i] for i in ids[share])
    if not ids[4] or not ids[1]:
        return None
    use = small_table(spark, doc_id=pa.array(sorted({*ids[4], *ids[1]}), pa.int64()))
    got = {r["doc_id"]: r for r in table.join(F.broadcast(use), "doc_id").collect()}
    pos, unl = (weighted(*_joined([got[i] for i in kind]), idf) for kind in (ids[4], ids[1]))
    del got
    weights, offsets = np.zeros((CLASSIFIERS, DIMENSIONS), np.float32), np.zeros(CLASSIFIERS)
    for k in range(CLASSIFIERS):
        weights[k], offsets[k] = fit(pos.take(_others(ids[4], k)), unl.take(_others(ids[1], k)), prior)
    return Model(weights, offsets, idf), prior


def _others(ids: list[int], k: int) -> np.ndarray:
    """Places of the ids that aren't in part k; of all of them, if there are no others."""
    apart = part_of(np.array(ids, np.int64)) != k
    return np.flatnonzero(apart if apart.any() else ~apart)


def _joined(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.r_[0, np.cumsum([r["size"] for r in rows])], np.concatenate([np.frombuffer(r["index"], np.int32) for r in rows]), np.concatenate([np.frombuffer(r["value"], np.float32) for r in rows])


def _scorer(model):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole, apart = model.value.logits(bytes_of(batch, "text"), part_of(longs_of(batch, "doc_id")))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole), pa.array(apart)], names=["doc_id", "held_out", "logit", "apart"])

    return per_batch(run, SLICE)


def threshold(apart: DataFrame, prior: float) -> float:
    """The logit (column ``apart``) above which lies a share of ``prior`` of all rows, to 1 / STEP: from a histogram of at most
    2 * MOST_LOGIT * STEP + 1 rows."""
    step = F.round(F.least(F.greatest("apart", F.lit(-MOST_LOGIT)), F.lit(MOST_LOGIT)) * STEP).cast("int").alias("step")
    got = sorted((r["step"], r["count"]) for r in apart.groupBy(step).count().collect())
    if not got:
        return 0.0
    above = np.cumsum([n for _, n in got][::-1])[::-1]  # rows at a step or beyond
    at = np.flatnonzero(above <= prior * above[0])
    return (got[at[0]][0] if len(at) else got[-1][0] + 1) / STEP


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted (1 at 0.5 or more).

    Only the text is scored; a null text is empty, and an empty one gets the offset's score. Without a toxic label to learn from
    every score is 0. A null doc_id isn't held out, isn't learnt from, and comes back null. Rows that repeat a doc_id are scored apart,
    equal rows alike. Very long texts are read whole, one slice at a time; all other columns are left out, whatever their names. An
    empty table gives no rows.
    """
    learnt = train(docs, labels)
    rows = slim(docs).select("doc_id", (held_out(F.col("doc_id")) & (F.col("doc_id") != NULL_ID)).alias("held_out"), "text")
    if learnt is None:
        scored = rows.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        model, prior = learnt
        sent = docs.sparkSession.sparkContext.broadcast(model)  # CLASSIFIERS * DIMENSIONS weights
        judged = stage(rows.mapInArrow(_scorer(sent), "doc_id long, held_out boolean, logit double, apart double"), "logits")
        cut = threshold(judged, prior)
        scored = judged.select("doc_id", "held_out", (1 / (1 + F.exp(F.lit(cut) - F.col("logit")))).alias("score"))
    return scored.select(public_id(), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
