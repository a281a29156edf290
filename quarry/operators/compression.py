"""Compression of passages: key figures with their surroundings, relevant sentences, size limits by tier."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import rules, text
from quarry.operators import tfidf
from quarry.sources import shared

AROUND = 50


def surroundings(passage: str, patterns: list[str] = rules.KEY_PATTERNS, around: int = AROUND) -> str:
    """All matches, pattern by pattern, each with the characters around it; overlapping surroundings repeat text."""
    found: dict[str, None] = {}
    for pattern in patterns:
        for m in re.finditer(pattern, passage, re.IGNORECASE):
            found.setdefault(passage[max(0, m.start() - around) : m.end() + around].strip())
    return " ... ".join(found) if found else passage


def key_information(passages: DataFrame) -> DataFrame:
    """``id``, ``key_info``: surroundings may overlap, which regular expressions of columns cannot return; Arrow batches do."""

    def run(batches):
        for batch in shared.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([surroundings(t or "") for t in batch.column(1).to_pylist()], pa.string())], ["id", "key_info"])

    shared.workers(passages.sparkSession)
    return passages.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, key_info string")


def compress(chunks: DataFrame, least: int = 200, aggressive: bool = False, max_chunks: int | None = None) -> DataFrame:
    """``id``, ``compressed``: key information or relevant sentences of passages without boilerplate, if short enough.

    ``chunks`` (id, query, text, tier; with ``max_chunks`` also query_id and rank, of which the first stay). Passages under
    ``least`` characters stay; so do those that compress badly: beyond 0.8 of the length for tier 1 and 0.6 for others, 0.2
    less if aggressive. A passage is settled by itself, in Arrow batches: its sentences are weighed only where its key
    information does not decide.
    """
    if max_chunks is not None:
        first = Window.partitionBy("query_id").orderBy("rank")
        chunks = chunks.withColumn("q_place", F.row_number().over(first)).where(F.col("q_place") <= max_chunks).drop("q_place")

    def run(batches):
        for batch in shared.slices(batches):
            out = [_compressed(*row, least, aggressive) for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "compressed"])

    shared.workers(chunks.sparkSession)
    rows = chunks.select(F.col("id").cast("long").alias("id"), "query", "text", F.col("tier").cast("int").alias("tier"), text.remove_boilerplate(F.col("text")).alias("cleaned"))
    return rows.mapInArrow(run, "id long, compressed string")


def _compressed(query: str | None, passage: str | None, tier: int | None, cleaned: str | None, least: int, aggressive: bool) -> str | None:
    if passage is None or len(passage) < least:
        return passage
    cleaned = cleaned or ""
    best = surroundings(cleaned)
    if len(best) <= len(cleaned) * 0.3:
        best = tfidf.best_sentences(query, cleaned)
    ratio = (0.8 if tier == 1 else 0.6) - (0.2 if aggressive else 0.0)
    return best if len(best) < len(passage) * ratio else passage
