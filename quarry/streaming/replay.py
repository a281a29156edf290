"""Tables as streams that arrive out of order, and what a stream needs to end: a row that moves its watermark past all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources import shared

#: Rows of a file of a part, about.
FILE_ROWS = 250_000


def arrivals(rows: DataFrame, at: str, jitter: int, parts: int, seed: int = 0, end_after: int | None = None) -> str:
    """Write rows to folders 0, 1, ... in order of arrival, up to ``jitter`` seconds after the time in ``at``; the path above them.

    A part has as many files as its rows need, not as many as tasks happen to write it. It spans ``span / parts`` seconds, so a watermark delay of a part and the jitter makes no row late. With ``end_after``
    a last folder holds one row of a time so many seconds after all others, with -1 for numbers and empty strings: nulls
    would be filtered out before the watermark sees them.
    """
    spark = rows.sparkSession
    path = shared.path(spark, "arrivals")
    arrival: Column = F.unix_seconds(F.col(at)) + F.pmod(F.xxhash64(F.struct(*[f"`{c}`" for c in rows.columns]), F.lit(seed)), F.lit(max(jitter, 1)))
    rows = shared.saved(rows.withColumn("arrival", arrival), "arrivals")
    low, high, last, n = rows.agg(F.min("arrival"), F.max("arrival"), F.max(F.unix_seconds(F.col(at))), F.count("*")).first()
    files = max(1, -(-n // parts // FILE_ROWS))
    if low is not None:
        part = F.least(F.floor((F.col("arrival") - low) * parts / (high - low + 1)), F.lit(parts - 1))
        for i in range(parts):  # one after the other: a file source takes files by age
            rows.where(part == i).drop("arrival").repartition(files).write.parquet(f"{path}/{i:04d}")
    if end_after is not None:
        time, other = F.timestamp_seconds(F.lit((last or 0) + end_after)), {"string": F.lit(""), "bigint": F.lit(-1), "int": F.lit(-1)}
        end = spark.range(1).select(*[(time if f.name == at else other.get(f.dataType.simpleString(), F.lit(None))).cast(f.dataType).alias(f.name) for f in rows.drop("arrival").schema])
        end.write.parquet(f"{path}/{parts:04d}")
    return path


def stream(rows: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """A stream over ``arrivals``, ``files`` files a micro-batch: those of a part, so that batches are as many as parts whatever their size."""
    spark = rows.sparkSession
    if files is None:
        first = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/0000/part-*")
        files = max(1, len(first.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(first) or []))
    return spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(path)
