"""Greedy token matching of answers and references: each token meets its nearest one on the other side, both ways.

The form of a contextual-embedding F1 with the token vectors as a parameter. A pair of texts is one row; rows go through in
Arrow batches, and a batch's distinct tokens get their vectors once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.sources import shared

DIMENSION = 32
#: Cells of a similarity matrix computed at once; longer texts go in strips.
STRIP_CELLS = 1 << 22


def gram_vector(token: str, dimension: int = DIMENSION) -> np.ndarray:
    """Stand-in for a token embedding: the token's letters and three-letter grams, hashed."""
    out = np.zeros(dimension)
    marked = f"^{token}$"
    for g in [*token, *(marked[i : i + 3] for i in range(len(marked) - 2))]:
        h = zlib.crc32(g.encode("utf-8", "surrogatepass"))
        out[h % dimension] += 1.0 if h >> 31 else -1.0
    return out


def letter_counts(token: str) -> np.ndarray:
    """A vector anyone can check: how often each of the 26 letters occurs."""
    return np.array([token.count(x) for x in "abcdefghijklmnopqrstuvwxyz"], float)


def greedy(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> tuple[float, float, float]:
    """Precision, recall, F1 of ``b`` (answer) against ``a`` (reference): unit token vectors and their weights."""
    best_a, best_b = np.full(len(a), -1.0), np.full(len(b), -1.0)
    step = max(1, STRIP_CELLS // max(1, len(b)))
    for lo in range(0, len(a), step):
        sim = a[lo : lo + step] @ b.T
        best_a[lo : lo + step] = sim.max(1, initial=-1.0)
        best_b = np.maximum(best_b, sim.max(0, initial=-1.0))
    recall = float(best_a @ wa / wa.sum()) if wa.sum() > 0 else 0.0
    precision = float(best_b @ wb / wb.sum()) if wb.sum() > 0 else 0.0
    return precision, recall, 2 * precision * recall / (precision + recall) if precision + recall > 0 else 0.0


def document_weights(references: DataFrame, c: str = "reference") -> DataFrame:
    """``token``, ``weight``: -ln((df + 1) / (n + 1)) over the distinct references; tokens that all have weigh 0."""
    own = references.select(text.text(c).alias("t")).distinct()
    n = own.agg(F.count("*").alias("n"))
    df = own.select(F.explode(F.array_distinct(text.alpha_words(F.col("t")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("token", (-F.log((F.col("df") + 1) / (F.col("n") + 1))).alias("weight"))


def scores(pairs: DataFrame, weights: DataFrame | None = None, vector: Callable[[str], np.ndarray] = gram_vector, baseline: float = 0.0) -> DataFrame:
    """``id``, ``precision``, ``recall``, ``f1`` of ``pairs`` (id, reference, answer).

    Tokens are lower-cased runs of letters. ``weights`` (token, weight) weigh them, an unknown one like a token that no
    reference has (the largest weight); without it all weigh 1. A baseline b rescales x to (x - b) / (1 - b). An empty side
    scores 0, as does a side whose weights are all 0; repeated tokens count each.
    """
    sides = pairs.select("id", *[text.alpha_words(text.text(c)).alias(c) for c in ("reference", "answer")])
    if weights is not None:
        most = weights.agg(F.coalesce(F.max("weight"), F.lit(1.0)).alias("most"))

        def placed(c):
            return F.transform(c, lambda t, i: F.struct(F.lit(c).alias("side"), i.alias("at"), t.alias("token")))

        each = sides.select("id", F.explode(F.concat(placed("reference"), placed("answer"))).alias("x")).select("id", "x.*")
        known = each.join(weights, "token", "left").join(F.broadcast(most)).withColumn("weight", F.coalesce("weight", "most"))
        listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == c, F.struct("at", "weight")))), lambda x: x["weight"]).alias(f"w_{c}")
        sides = sides.join(known.groupBy("id").agg(listed("reference"), listed("answer")), "id", "left")
    else:
        sides = sides.withColumns({f"w_{c}": F.transform(c, lambda t: F.lit(1.0)) for c in ("reference", "answer")})

    def run(batches):
        for batch in batches:
            table: dict[str, np.ndarray] = {}

            def unit(tokens):
                for t in tokens:
                    if t not in table:
                        v = vector(t)
                        size = np.sqrt(v @ v)
                        table[t] = v / size if size > 0 else v
                return np.stack([table[t] for t in tokens])

            out = []
            for a, b, wa, wb in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                found = greedy(unit(a), unit(b), np.array(wa, float), np.array(wb, float)) if a and b else None
                out.append(tuple((x - baseline) / (1 - baseline) for x in found) if found else (0.0, 0.0, 0.0))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.float64()) for x in columns]], ["id", "precision", "recall", "f1"])

    shared.workers(pairs.sparkSession)
    kind = pairs.schema["id"].dataType.simpleString()
    return sides.select("id", "reference", "answer", "w_reference", "w_answer").mapInArrow(run, f"id {kind}, precision double, recall double, f1 double")
