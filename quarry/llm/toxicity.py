"""Toxicity: non-negative positive-unlabelled learning of a numpy logistic classifier.

Confirmed toxic texts are the positives; all other training texts are unlabelled. The loss is the class-prior-corrected
risk pi*R+ + max(0, Ru- - pi*R-) with the logistic loss; where the corrected negative part falls below zero, the step
ascends it instead (Kiryo et al., 2017). Features are the distinct words and word beginnings of the whole text, hashed.

Defined results: null and empty texts have no feature and get the score of the bias; without positives (an empty table of
labels, too) every score is 0; texts of any length are read whole, in pieces; repeated rows are scored alike, and of rows
that share an id one is drawn to fit on; an empty table gives an empty result. Only the id and text columns are read, so
extra columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common, scan

BITS = 18
PREFIX = 4
#: A feature takes part if its document frequencies among positives and unlabelled texts differ by so many standard errors.
SCREEN = 6.0
#: Texts to fit on, at most.
POSITIVES, UNLABELLED = 3000, 6000


@dataclass
class Model:
    weight: np.ndarray
    bias: float


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, feature) of each distinct feature of each text."""
    found = []
    for group in scan.pieces(texts):
        words = scan.Words(group)
        begin, which = words.prefix_hash(PREFIX)
        key = np.concatenate([words.hash, begin]) >> np.uint64(64 - BITS)
        doc = np.concatenate([words.doc, words.doc[which]]).astype(np.uint64)
        found.append(np.unique(doc << np.uint64(BITS) | key))
    both = np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.empty(0, np.uint64)
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def screened(positive: np.ndarray, n1: int, unlabelled: np.ndarray, n0: int, least: float = SCREEN) -> np.ndarray:
    """Which features differ enough between two samples to learn from; the others would only fit noise.

    ``positive`` and ``unlabelled``: in how many of the ``n1`` and ``n0`` texts each feature is.
    """
    n1, n0 = max(1, n1), max(1, n0)
    p1, p0 = positive / n1, unlabelled / n0
    p = (positive + unlabelled + 1) / (n1 + n0 + 2)
    return np.abs(p1 - p0) >= least * np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))


def risk(z: np.ndarray, n1: int, prior: float) -> tuple[float, float]:
    """(positive part, corrected negative part) of the risk with the logistic loss: the first ``n1`` of the scores are of
    positives, the others of unlabelled texts."""
    as_positive, as_negative = np.logaddexp(0, -z), np.logaddexp(0, z)
    return prior * as_positive[:n1].mean(), as_negative[n1:].mean() - prior * as_negative[:n1].mean()


def direction(z: np.ndarray, n1: int, prior: float, beta: float = 0.0) -> np.ndarray:
    """Gradient by score that a step descends: that of the whole risk, or, where the corrected negative part is below -beta,
    that of its negative alone (so that part rises)."""
    s = _sigmoid(z)
    g = np.empty(len(z))
    if risk(z, n1, prior)[1] >= -beta:
        g[:n1] = -prior / n1
        g[n1:] = s[n1:] / (len(z) - n1)
    else:
        g[:n1] = prior * s[:n1] / n1
        g[n1:] = -s[n1:] / (len(z) - n1)
    return g


def fit_features(rows: list[np.ndarray], positive: np.ndarray, prior: float, epochs: int = 16, batch: int = 256, rate: float = 0.005, decay: float = 1e-4, beta: float = 0.0, seed: int = 7) -> Model:
    """Minimise the non-negative risk by Adam. ``rows``: features of each text; ``positive``: confirmed toxic or not."""
    rng = np.random.default_rng(seed)
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    weight, bias = np.zeros(1 << BITS), -2.0
    m, v = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    if not len(pos) or not len(unl):
        return Model(weight.astype(np.float32), -np.inf if not len(pos) else 40.0)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    step = 0
    parts = max(1, -(-len(unl) // batch))
    for _ in range(epochs):
        for p, u in zip(np.array_split(rng.permutation(pos), parts), np.array_split(rng.permutation(unl), parts), strict=True):
            if not len(p):
                p = rng.choice(pos, min(len(pos), 16))
            own = np.concatenate([p, u])
            feats = np.concatenate([rows[i] for i in own])
            index = np.repeat(np.arange(len(own)), size[own])
            g = direction(bias + np.bincount(index, weight[feats], len(own)), len(p), prior, beta)
            grad = np.bincount(feats, g[index], 1 << BITS) + decay * weight
            grad = np.append(grad, g.sum())
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
            weight -= move[:-1]
            bias -= move[-1]
    z = np.array([weight[r].sum() for r in rows])
    return Model(weight.astype(np.float32), -_cut(z[pos], z[unl], prior))


def _cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """Where the non-negative risk with the zero-one loss is least: the middle of the widest such gap between sums."""
    edges = np.unique(np.concatenate([positive, unlabelled]))
    if len(edges) < 2:
        return float(edges[0]) if len(edges) else 0.0
    cuts = (edges[1:] + edges[:-1]) / 2
    hit = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    flagged = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    risk = prior * (1 - hit) + np.maximum(0, flagged - prior * hit)
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    return float(cuts[best[np.argmax((edges[1:] - edges[:-1])[best])]])


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    doc, feature = features(texts)
    return _sigmoid(model.bias + np.bincount(doc, model.weight[feature], len(texts))) if np.isfinite(model.bias) else np.zeros(len(texts))


def fit(documents: DataFrame, labels: DataFrame, train: F.Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """Fit on bounded samples of the rows that ``train`` (an expression on doc_id) admits.

    ``prior``: share of toxic texts; by default that among the admitted labels. Labels of 0 count as unlabelled.
    """
    spark = documents.sparkSession
    common.prepare(spark)
    known = labels.where(train & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    n, toxic = known.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    if not n or not toxic:
        return Model(np.zeros(1 << BITS, np.float32), -np.inf)
    if prior is None:
        prior = toxic / n
    own = common.bounded_sample(known.where("toxic = 1"), "doc_id", positives).withColumn("q_positive", F.lit(True))
    rest = common.bounded_sample(documents.where(train & F.col("doc_id").isNotNull()), "doc_id", unlabelled).withColumn("q_positive", F.lit(False))

    def counted(batches):
        count, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            positive = np.asarray(batch.column(1).to_pylist(), bool)
            doc, feature = features(batch.column(0).to_pylist())
            for c in (0, 1):
                count[c] += np.bincount(feature[positive[doc] == bool(c)], minlength=1 << BITS)
                n[c] += int((positive == bool(c)).sum())
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array([count.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["count", "n"])

    # ids of a bounded sample: broadcasting them is safe; of rows that share an id one is drawn
    ids = F.broadcast(own.unionByName(rest))
    drawn = documents.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "q_positive").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    drawn = common.saved(drawn.select("text", "q_positive").coalesce(16), "toxicity")
    count, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for row in drawn.mapInArrow(counted, "count binary, n binary").toLocalIterator():  # one row a task
        count += np.frombuffer(row["count"], np.int64).reshape(2, -1)
        n += np.frombuffer(row["n"], np.int64)
    keep = screened(count[1], int(n[1]), count[0], int(n[0]))

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            doc, feature = features(texts)
            doc, feature = doc[keep[feature]], feature[keep[feature]]
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            packed = [feature[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1)], ["packed", "q_positive"])

    got = drawn.mapInArrow(run, "packed binary, q_positive boolean").collect()  # screened features of the bounded sample
    rows = [np.frombuffer(r["packed"], "<i4") for r in got]
    return fit_features(rows, np.array([r["q_positive"] for r in got], bool), float(min(max(prior, 1e-4), 0.9)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every document."""
    common.prepare(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(shared.value, batch.column(1).to_pylist()))], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
