"""Shared folder handling, hold-out columns and distributed connected components."""

from __future__ import annotations

import gc
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import shared
from quarry.sources.shared import path as shared_path  # noqa: F401
from quarry.sources.shared import saved

#: Bytes of a batch between Spark and a Python worker, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Links a task contracts at a time (16 bytes each), and the most that one task finishes.
CHUNK_LINKS = 1 << 17
#: Up to this many labels (16 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_LABELS = 1_000_000


def prepare(spark: SparkSession) -> None:
    """Make this package importable by Python workers and give ``checkpoint()`` a folder.

    On a cluster ``spark.checkpoint.dir`` names a folder all executors share and is used as it is; only a session on one
    machine without it (as in tests) gets a temporary one.
    """
    sc = spark.sparkContext
    shared.workers(spark)
    sc.environment.setdefault("OMP_NUM_THREADS", "1")
    sc.environment.setdefault("OPENBLAS_NUM_THREADS", "1")
    sc.environment.setdefault("TOKENIZERS_PARALLELISM", "false")
    # workers live on from stage to stage: what they free goes back to the system, fragments are not kept
    sc.environment.setdefault("MALLOC_ARENA_MAX", "2")
    sc.environment.setdefault("MALLOC_MMAP_THRESHOLD_", str(4 << 20))
    sc.environment.setdefault("MALLOC_TRIM_THRESHOLD_", str(16 << 20))
    sc.environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    # texts reach the workers in batches bounded by bytes: rows are no bound, and both sides hold several batches
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared.root(spark))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not when the driver next happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; the fold a row belongs to. A null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(None)).cast("string")
    return F.pmod(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` distinct keys, the smallest by a hash: the same on every run.

    Only rows whose key's hash is among about the first four times ``limit`` keys are made distinct, so few are shuffled.
    """
    top, n = 1 << 62, max(1, df.agg(F.approx_count_distinct(key)).first()[0])
    own = F.xxhash64(F.col(key)).bitwiseAND(top - 1)
    few = df.select(key).where(own < min(top, int(top / n * 4 * limit)) + 1).distinct()
    return few.orderBy(own, F.col(key)).limit(limit)


def unite(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` indices over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the links (a, b), ascending, and the smallest vertex each one reaches over them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return ids, ids[unite(len(ids), at[: len(a)], at[len(a) :])]


def _chunks(batches, chunk: int):
    """Column pairs of at least ``chunk`` rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
        if n >= chunk:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def contract(batches, chunk: int = CHUNK_LINKS):
    """Links (a, b) as stars: rows (x, r) from every vertex to the smallest it reaches; a forest of half a chunk at most is carried on."""
    x = r = np.empty(0, np.int64)
    for a, b in _chunks(batches, chunk):
        x, r = _forest(np.concatenate([x, a]), np.concatenate([r, b]))
        if len(x) > chunk // 2:
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(r)], ["x", "r"])
            x = r = x[:0]
    if len(x):
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(r)], ["x", "r"])


def _meet(batches, chunk: int):
    """Of rows sorted by (x, r): x's smallest r as a pointer, and the stars of what joins its other r to that one."""
    x0 = m0 = None
    for x, r in _chunks(batches, chunk):
        start = np.concatenate(([x0 is None or x[0] != x0], x[1:] != x[:-1]))
        first = np.flatnonzero(start)
        m = r[np.maximum.accumulate(np.where(start, np.arange(len(x)), 0))]
        if not start[0]:  # the first run began in the chunk before
            m[: first[0] if len(first) else len(x)] = m0
        x0, m0 = x[-1], m[-1]
        other = r != m
        ids, low = _forest(r[other], m[other]) if other.any() else (x[:0], x[:0])
        columns = np.concatenate([x[first], ids]), np.concatenate([m[first], low]), np.repeat([False, True], [len(first), len(ids)])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["x", "r", "further"])


def connected_components(edges: DataFrame, chunk: int = CHUNK_LINKS) -> DataFrame:
    """Smallest vertex reachable from each vertex that has an edge: ``id``, ``label`` (a vertex without edges is not listed).

    ``edges`` has long columns ``a`` and ``b``; null ends and loops are ignored.
    """
    prepare(edges.sparkSession)
    links = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    return connected_stars(links.mapInArrow(partial(contract, chunk=chunk), "x long, r long"), chunk)


def connected_stars(stars: DataFrame, chunk: int = CHUNK_LINKS) -> DataFrame:
    """``connected_components`` of links that each task has put through ``contract`` already.

    As every task contracts its own links to stars, a vertex with very many neighbours leaves a task as one row. Stars
    of all tasks meet by vertex in one shuffle: a vertex points to its smallest root, and only links between roots,
    contracted again, go on to the next round. Each round is one table in the shared folder and loses at least the
    largest vertex of every component, in practice nearly all. What at last fits a chunk (a fixed number of rows) one
    task finishes. Then the pointers are followed backwards; a round's labels are broadcast if few, else joined by a
    shuffle that can be split.
    """
    spark = stars.sparkSession
    pointers, labels = [], None
    while labels is None:
        met = stars.repartition("x").sortWithinPartitions("x", "r").mapInArrow(partial(_meet, chunk=chunk), "x long, r long, further boolean")
        met = saved(met, "components")
        release(spark)
        pointers.append(met.where("not further").select("x", "r"))
        stars = met.where("further").select("x", "r")
        left = stars.count()
        if left <= chunk:
            labels = saved(stars.coalesce(1).mapInArrow(partial(contract, chunk=chunk), "x long, r long"), "components") if left else pointers.pop()
    for layer in reversed(pointers):
        known = labels.select(F.col("x").alias("k"), F.col("r").alias("l"))
        known = F.broadcast(known) if labels.count() <= BROADCAST_LABELS else known
        labels = saved(layer.join(known, F.col("r") == F.col("k"), "left").select("x", F.coalesce("l", "r").alias("r")), "components")
    return labels.select(F.col("x").alias("id"), F.col("r").alias("label"))
