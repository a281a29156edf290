"""Quality: regularised quadratic discriminant over transformed document statistics.

``statistics`` turns every whole text into 14 transformed figures (log lengths, logit shares, repetition). ``fit`` adds
up count, sum and outer products of all admitted labelled rows on the executors, shrinks each class covariance towards
its scaled identity and factors it once. The score is the posterior of class 1 from the difference of the two log
densities, whose Mahalanobis distances use the cached Cholesky factors.

Defined results: null and empty texts have the statistics of an empty text; a class without rows gets the pooled
moments; without any label every score is the prior 0.5; texts of any length are read whole, in pieces; a label counts for
every row of its id, repeated rows are scored alike; an empty table gives an empty result. Only the id and text columns
are read, so other columns of any name do not matter.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common, scan

N_STATS = 14
SHRINKAGE = 0.1
_CLASS = np.zeros(256, np.int8)  # 1 letter, 2 capital, 3 digit, 4 white space, 5 line end, 6 full stop or comma, 7 other mark
_CLASS[list(range(97, 123)) + list(range(128, 256))] = 1
_CLASS[list(range(65, 91))] = 2
_CLASS[list(range(48, 58))] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[10] = 5
_CLASS[[44, 46]] = 6
_CLASS[[x for x in range(33, 128) if chr(x) in "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"]] = 7



def text_statistics(text: str | None) -> np.ndarray:
    """Figures of a whole text, which is gone through in pieces; only a hash and a length of each word are kept."""
    data = (text or "").encode("utf-8", "surrogatepass")
    kind, hashes, lengths = np.zeros(8, np.int64), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for _, piece in scan.space_pieces(data):
        kind += np.bincount(_CLASS[np.frombuffer(piece, np.uint8)], minlength=8)
        found, start, end = scan.space_words(piece)
        hashes.append(found)
        lengths.append(end - start)
    hash_, length = np.concatenate(hashes), np.concatenate(lengths)
    n = len(hash_)
    distinct = np.unique(hash_, return_counts=True)[1]
    pairs = len(np.unique(hash_[:-1] * np.uint64(3) ^ hash_[1:]))
    seen, n_lines = set(), 0
    for line in io.BytesIO(data):
        if line := line.rstrip(b"\n"):
            if line.strip():
                n_lines += 1
                seen.add(line if len(line) < 16 else xxhash.xxh3_128_digest(line))
    share = lambda a, b: np.log((a + 0.5) / (b + 1.0))
    return np.array([
        np.log1p(len(data)),
        np.log1p(n),
        np.log1p(length.mean()) if n else 0.0,
        np.log1p(length.std()) if n else 0.0,
        share(kind[2], kind[1] + kind[2]),
        share(kind[3], len(data)),
        share(kind[6], n),
        share(kind[7], len(data)),
        share(kind[5], n),
        share(len(distinct), n),
        share(int(distinct.max()) if n else 0, n),
        share(pairs, n),
        share(len(seen), n_lines),
        share(int((length > 18).sum()), n),
    ])


@dataclass
class Model:
    prior: tuple[float, float]
    centre: np.ndarray
    scale: np.ndarray
    mean: list[np.ndarray]
    cholesky: list[np.ndarray]
    log_det: list[float]


def statistics(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``stats`` (array of 14 doubles) of every document."""
    common.prepare(documents.sparkSession)

    def run(batches):
        for batch in batches:
            stats = np.stack([text_statistics(t.as_py()) for t in batch.column(1)]) if batch.num_rows else np.zeros((0, N_STATS))
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, N_STATS * (len(stats) + 1), N_STATS), pa.int32()), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "stats"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<double>")


def fit_moments(count: np.ndarray, total: np.ndarray, outer: np.ndarray, shrinkage: float = SHRINKAGE) -> Model:
    """From count, sum and sum of outer products of each of the two classes."""
    n = count.sum()
    if not n:
        eye = np.eye(N_STATS)
        return Model((0.5, 0.5), np.zeros(N_STATS), np.ones(N_STATS), [np.zeros(N_STATS)] * 2, [eye] * 2, [0.0] * 2)
    centre = total.sum(0) / n
    scale = np.sqrt(np.maximum(np.diag(outer.sum(0)) / n - centre**2, 1e-6))
    pooled = (outer.sum(0) / n - np.outer(centre, centre)) / np.outer(scale, scale)
    mean, root, log_det = [], [], []
    for c in (0, 1):
        mu, cov = np.zeros(N_STATS), pooled
        if count[c] > 1:
            mu = (total[c] / count[c] - centre) / scale
            raw = outer[c] / count[c] - np.outer(centre, total[c] / count[c]) - np.outer(total[c] / count[c], centre) + np.outer(centre, centre)
            cov = raw / np.outer(scale, scale) - np.outer(mu, mu)
        cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / N_STATS, 1e-3) * np.eye(N_STATS)
        low = np.linalg.cholesky(cov)
        mean.append(mu)
        root.append(low)
        log_det.append(2 * float(np.log(np.diag(low)).sum()))
    share = (count[1] + 1) / (n + 2)
    return Model((1 - share, share), centre, scale, mean, root, log_det)


def forward(low: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Solves low @ y = x for a lower triangular matrix, column by column of x."""
    y = np.empty_like(x)
    for i in range(len(low)):
        y[i] = (x[i] - low[i, :i] @ y[:i]) / low[i, i]
    return y


def score_statistics(model: Model, stats: np.ndarray) -> np.ndarray:
    x = (stats - model.centre) / model.scale
    log_p = []
    for c in (0, 1):
        y = forward(model.cholesky[c], (x - model.mean[c]).T)
        log_p.append(np.log(model.prior[c]) - 0.5 * (model.log_det[c] + (y * y).sum(0)))
    return 1 / (1 + np.exp(np.clip(log_p[0] - log_p[1], -700, 700)))


def fit(stats: DataFrame, labels: DataFrame, train: F.Column, shrinkage: float = SHRINKAGE) -> Model:
    """Moments over all labelled rows that ``train`` (an expression on doc_id) admits; one small row a task comes to the driver."""
    known = labels.where(train & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("q_label"))

    def run(batches):
        count, total, outer = np.zeros(2), np.zeros((2, N_STATS)), np.zeros((2, N_STATS, N_STATS))
        for batch in batches:
            y = np.asarray(batch.column(1).to_pylist(), np.int64)
            x = np.asarray(batch.column(0).flatten()).reshape(-1, N_STATS)
            for c in (0, 1):
                own = x[(y != 0) == bool(c)]
                count[c] += len(own)
                total[c] += own.sum(0)
                outer[c] += own.T @ own
        if count.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([count, total.ravel(), outer.ravel()]).tolist()], pa.list_(pa.float64()))], ["sums"])

    got = [np.array(r["sums"]) for r in stats.join(known, "doc_id").select("stats", "q_label").mapInArrow(run, "sums array<double>").toLocalIterator()]
    sums = np.sum(got, axis=0) if got else np.zeros(2 + 2 * N_STATS + 2 * N_STATS**2)
    return fit_moments(sums[:2], sums[2 : 2 + 2 * N_STATS].reshape(2, N_STATS), sums[2 + 2 * N_STATS :].reshape(2, N_STATS, N_STATS), shrinkage)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row of ``statistics``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_statistics(shared.value, x))], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")
