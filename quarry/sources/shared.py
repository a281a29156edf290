"""What driver and executors share: a folder for intermediate tables, and this package in Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_scopes: list[list[str]] = []
_ROOT = str(Path(__file__).resolve().parents[2])


def workers(spark: SparkSession | None = None) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder the driver was started in."""
    session = spark or SparkSession.getActiveSession()
    if session is None:
        return
    environment = session.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: what Python makes of one is gone before the next."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a session on one machine gets a temporary folder; a cluster has none that all would see, so that
    is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quarry-"))
    return _own[0]


def path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared folder; an open ``scope`` will delete it."""
    own = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(own)
    return own


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables made within, at its end: write the result first, elsewhere.

    Without a scope they stay until the shared folder is cleared, as a result that has not been read yet needs them.
    """
    _scopes.append([])
    try:
        yield
    finally:
        conf = spark._jsc.hadoopConfiguration()
        for own in _scopes.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(own)
            place.getFileSystem(conf).delete(place, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    own = path(df.sparkSession, name)
    df.write.parquet(own)
    return df.sparkSession.read.schema(df.schema).parquet(own)
