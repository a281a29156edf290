"""Language identification: known words first, then progressively shorter character n-grams for unseen words.

``fit`` learns, per language, the log frequency of every word of a bounded training sample and of the character
n-grams (5 down to 1 letters) of its distinct words of that language. ``predict`` scores every whole text: a known word adds its per-language log
frequency; an unseen word adds the mean log frequency of its longest n-grams that are known for any language, with a
constant penalty per step back. The score is the posterior of the best language (uniform prior, evidence tempered by
the number of words), 0 to 1.

Defined results: null, empty or letter-free texts give ``und`` with score 0; texts of any length are read whole, in
pieces; equal scores go to the language first in alphabetical order; repeated rows are scored alike and count once in
the training sample; an empty table gives an empty result; without any training row every text is ``und``. Only the id,
text and language columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import common, scan

U = np.uint64
#: Training texts per language, at most; and characters of them, the bound of the driver's memory. Longer texts than a
#: hundredth of that are not drawn.
TEXTS_PER_LANGUAGE = 1500
CHARS_PER_LANGUAGE = 20_000_000
MAX_N = 5
BACK_OFF = 1.2


@dataclass
class Model:
    """Sorted keys (hashes of words, and of n-grams by n) and, beside them, log frequencies by language."""

    languages: list[str]
    word_key: np.ndarray
    word_value: np.ndarray
    gram_key: list[np.ndarray]
    gram_value: list[np.ndarray]


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


def _grams(words: scan.Words, n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-letter grams of the chosen words, and the position of each one's word in ``which``."""
    count = np.maximum(words.length[which] - n + 1, 0)
    total = int(count.sum())
    owner = np.repeat(np.arange(len(which)), count)
    offset = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    at = words.start[which][owner] + offset
    h = np.full(total, n, U)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = h * U(0x9E3779B97F4A7C15) + scan.code_values()[words.codes[at + j]]
        return scan.mix(h), owner


def _values(counts: np.ndarray) -> np.ndarray:
    """Smoothed log frequencies by language."""
    total = counts.sum(0, keepdims=True)
    return (np.log(counts + 0.5) - np.log(total + 0.5 * max(1, len(counts)))).astype(np.float32)


def fit_texts(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    code = {x: i for i, x in enumerate(names)}
    lang = np.array([code[x] for x in langs], np.int64)
    parts: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(MAX_N + 1)]

    def add(level: int, keys: np.ndarray, j: int) -> None:
        distinct, n = np.unique(keys, return_counts=True)
        parts[level].append((distinct, np.full(len(distinct), j), n))

    seen = [np.empty(0, U) for _ in names]
    for group in scan.pieces(texts):
        words = scan.Words(group)
        of = lang[words.doc]
        for j in range(len(names)):
            own = np.flatnonzero(of == j)
            add(0, words.hash[own], j)
            # n-grams count once for each distinct word of a language
            distinct, one = np.unique(words.hash[own], return_index=True)
            fresh = ~_find(seen[j], distinct)[1]
            seen[j] = np.union1d(seen[j], distinct)
            for n in range(1, MAX_N + 1):
                add(n, _grams(words, n, own[one[fresh]])[0], j)
    tables = []
    for level, got in enumerate(parts):
        if not got:
            keys, counts = np.empty(0, U), np.zeros((0, len(names)))
        else:
            key, which, n = (np.concatenate(x) for x in zip(*got, strict=True))
            keys, at = np.unique(key, return_inverse=True)
            counts = np.zeros((len(keys), len(names)))
            np.add.at(counts, (at, which), n)
        tables.append((keys, _values(counts)))
    return Model(names, *tables[0], [k for k, _ in tables[1:]], [v for _, v in tables[1:]])


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and score of each text."""
    sums, seen = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    for group in scan.pieces(texts):
        words = scan.Words(group)
        if not len(words.hash):
            continue
        distinct, one, back = np.unique(words.hash, return_index=True, return_inverse=True)
        at, known = _find(model.word_key, distinct)
        value = np.zeros((len(distinct), len(model.languages)), np.float32)
        value[known] = model.word_value[at[known]]
        if not known.all():
            value[~known] = _unseen(model, words, one[~known])
        for j in range(len(model.languages)):
            sums[:, j] += np.bincount(words.doc, value[back, j], len(texts))
        seen += np.bincount(words.doc, minlength=len(texts))
    best = sums.argmax(1) if model.languages else np.zeros(len(texts), int)
    temper = np.maximum(1.0, np.sqrt(seen))[:, None]
    z = (sums - sums.max(1, keepdims=True)) / temper if model.languages else sums
    score = np.where(seen > 0, 1 / np.maximum(np.exp(z).sum(1), 1e-300), 0.0) if model.languages else np.zeros(len(texts))
    return [model.languages[b] if n and model.languages else "und" for b, n in zip(best, seen, strict=True)], score


def _unseen(model: Model, words: scan.Words, which: np.ndarray) -> np.ndarray:
    out = np.zeros((len(which), len(model.languages)), np.float32)
    open_ = np.arange(len(which))
    for n in range(MAX_N, 0, -1):
        if not len(open_):
            break
        keys, owner = _grams(words, n, which[open_])
        at, hit = _find(model.gram_key[n - 1], keys)
        if not hit.any():
            continue
        owner, value = owner[hit], model.gram_value[n - 1][at[hit]]
        count = np.bincount(owner, minlength=len(open_))
        got = count > 0
        for j in range(out.shape[1]):
            total = np.bincount(owner, value[:, j], len(open_))
            out[open_[got], j] = total[got] / count[got] - BACK_OFF * (MAX_N - n)
        open_ = open_[~got]
    return out


def fit(documents: DataFrame, train: F.Column | None = None, texts_per_language: int = TEXTS_PER_LANGUAGE, chars_per_language: int = CHARS_PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of each language: of the distinct rows that ``train`` admits, those with the smallest hash of
    doc_id and text, at most ``texts_per_language`` texts and ``chars_per_language`` characters."""
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = (rows.where(train) if train is not None else rows).select("lang", "text", F.col("doc_id").alias("q_id"))
    rows = rows.withColumn("q_n", F.length("text")).where(F.col("q_n") <= chars_per_language // 100)
    # one narrow pass for the sizes; then about twice as many texts as are wanted, distinct ones, of which exactly the first stay
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit_texts([], [])
    top = 1 << 62
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(top, int(top / n * (2 * texts_per_language + 50))))])
    rows = rows.withColumn("q_hash", F.xxhash64("q_id", "text").bitwiseAND(top - 1)).where(F.col("q_hash") < F.element_at(limit, F.col("lang")))
    first = Window.partitionBy("lang").orderBy("q_hash", "text")
    drawn = rows.dropDuplicates(["lang", "q_hash"]).withColumn("q_rank", F.row_number().over(first)).where(F.col("q_rank") <= texts_per_language)
    drawn = drawn.withColumn("q_sum", F.sum("q_n").over(first.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("q_sum") <= chars_per_language)
    got = drawn.select("text", "lang").collect()
    got.sort(key=lambda r: (r["lang"], r["text"]))
    return fit_texts([r["text"] for r in got], [r["lang"] for r in got])


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` of every document."""
    common.prepare(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, score = score_texts(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(documents: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of ``documents``, all columns as they are, whose language is known with at least ``least_score``.

    Texts without any letter (``und``) go; without any language learned, every text with a letter stays.
    """
    common.prepare(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, score = score_texts(shared.value, batch.column("text").to_pylist())
            keep = [n != "und" and s >= least_score for n, s in zip(names, score, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema) if model.languages else documents.where(F.col("text").rlike(r"\p{L}"))
