"""Answers remembered across the batches of a stream: a bounded memo with eviction by last use.

The memo after a batch is a small table of at most ``size`` rows below ``path``, one folder a batch. A batch reads the memo of
the batch before it and overwrites its own, as it overwrites its own answers, so a repeated batch finds what it found before.
Folders older than the one before the last batch are not read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions import text
from quarry.sources import shared

SIZE = 128
_MEMO = "key string, answer string, used long"


def remembered(batch: DataFrame, memo: DataFrame, answer: Callable[[DataFrame], DataFrame], order: str, turn: int, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """The rows of a batch with ``answer`` and ``hit``, and the memo after it.

    ``batch`` (question, and a column that orders its rows), ``memo`` (key, answer, used). Only questions the memo lacks are
    answered, each once: ``answer`` gets them as (key, question) and returns (key, answer). A row is a hit unless it is the first of a
    question that the memo lacked. The memo after it holds the ``size`` questions used last, as a least-recently-used cache
    over the rows in order would; within a batch nothing is dropped.
    """
    first = Window.partitionBy("q_key").orderBy(order)
    rows = batch.withColumn("q_key", F.sha2(text.text("question"), 256))
    rows = shared.saved(rows.withColumn("q_place", F.row_number().over(first)), "asked")
    last = rows.groupBy(F.col("q_key").alias("key")).agg(F.min("question").alias("question"), F.max(order).alias("q_last"))
    # places of the last uses follow those of all batches before: only the newest ``size`` matter
    newest = last.orderBy(F.desc("q_last"), "key").limit(size).select("key", (F.lit(turn << 32) + F.row_number().over(Window.orderBy("q_last", F.desc("key")))).alias("q_used"))
    new = answer(last.join(F.broadcast(memo), "key", "left_anti").select("key", "question"))
    known = shared.saved(memo.select("key", "answer", F.lit(True).alias("old")).join(last.select("key"), "key").unionByName(new.select("key", "answer", F.lit(False).alias("old"))), "known")
    told = known.withColumnRenamed("key", "q_key")
    out = rows.join(told, "q_key").withColumn("hit", F.col("old") | (F.col("q_place") > 1)).drop("q_key", "q_place", "old")
    used = newest.join(known.select("key", "answer"), "key").select("key", "answer", F.col("q_used").alias("used"))
    kept = memo.join(last.select("key"), "key", "left_anti").select("key", "answer", "used").unionByName(used)
    return out, kept.orderBy(F.desc("used")).limit(size)


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], order: str, path: str, checkpoint: str, size: int = SIZE) -> StreamingQuery:
    """Start a query that answers a stream of questions, with the memo of its batches; ``answers`` reads what it wrote."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        memo = spark.read.schema(_MEMO).parquet(f"{path}/memo/{number - 1}") if number else spark.createDataFrame([], _MEMO)
        out, kept = remembered(batch, memo, answer, order, number, size)
        out.write.mode("overwrite").parquet(f"{path}/answers/batch={number}")
        kept.write.mode("overwrite").parquet(f"{path}/memo/{number}")

    return questions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers(spark: SparkSession, path: str) -> DataFrame:
    """All answered rows with ``hit`` and the number of their batch."""
    return spark.read.parquet(f"{path}/answers")
