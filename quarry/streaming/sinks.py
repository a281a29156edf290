"""Logs that hold each row of a stream once, whatever is killed and started again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Spark's CSV writer would cut blanks off.
_AS_IT_IS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_once(rows: DataFrame, sink: str, stream: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet", mode: str = "append", **options: str) -> StreamingQuery:
    """Start a query that writes what ``prepare`` makes of each micro-batch to the folder of that batch below ``sink``.

    A batch that Spark repeats (it was not committed when the driver died, whole or in part written) overwrites its own
    folder and no other. ``stream`` names the stream: several may write to one sink, each with its own checkpoint, and a
    stream restarted from its checkpoint goes on under its name.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = prepare(batch) if prepare else batch
        out.write.mode("overwrite").format(fmt).options(**(_AS_IT_IS | options if fmt == "csv" else options)).save(f"{sink}/stream={stream}/batch={number}")

    return rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(spark: SparkSession, sink: str, schema: str | None = None, fmt: str = "parquet", **options: str) -> DataFrame:
    """The rows of all streams of a sink, with ``stream`` and ``batch``."""
    reader = spark.read.format(fmt).options(**options)
    reader = reader.schema(f"{schema}, stream string, batch long") if schema else reader
    return reader.load(sink)


def chat_log(answers: DataFrame) -> DataFrame:
    """Lines of the chat log: time, question, answer, sources as JSON."""
    return answers.select(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "question", "answer", F.to_json(F.coalesce("sources", F.array().cast("array<string>"))).alias("sources"))
