"""Near-duplicate embeddings by Int8 quantised tile products with rigorous error bounds.

Every vector is normalised and quantised to int8 with its own scale; the exact norm of what quantisation lost is kept
per vector. For x = s*q + e the true cosine differs from s*s'*(q.q') by at most |s*q||e'| + |e||x'|, so a pair whose
quantised product plus bound stays below the threshold cannot link; all others are recomputed in double precision. The
integer products of a tile run as float32 matrix products over at most ``SLICE`` components at a time, which are exact
(1,024 * 127**2 < 2**24); slices add up in double precision.

Identical vectors are one class and enter once. Classes are dealt into blocks by hash; the tasks are the pairs of blocks, each
of bounded size, so a large group of near copies spreads over many tasks; a task emits, per vector, how many rows it
links with, and a spanning forest of the links it found, never the pairs themselves. n classes make n / BLOCK copies of
each and n**2 / 2 products: the contract compares all pairs, and at this threshold no bound on angles to a centre excludes
blocks of vectors of many dimensions without losing links.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths do not link; equal vectors link; repeated vec_ids count as rows of their own (n_links counts rows);
a null vec_id is never the smallest of a component unless alone (component null); an empty table gives an empty
result; only vec_id and embedding are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

THRESHOLD = 0.95
#: Classes of a block, at most; a task holds two blocks. Few classes make smaller blocks, for some tasks each.
BLOCK, LEAST_BLOCK, LEAST_BLOCKS = 8192, 512, 8
TILE = 1024
#: Components of an exact float32 product of int8 codes, at most.
SLICE = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, norm of the coded vector and norm of its error (rounded up) of unit vectors."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127.0
    code = np.rint(x / scale[:, None]).astype(np.int8)
    coded = code * scale[:, None]
    slack = 1 + 1e-9
    return code, scale, np.sqrt((coded**2).sum(1)) * slack, np.sqrt(((x - coded) ** 2).sum(1)) * slack + 1e-12


def _product(qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """Exact integer products of codes, as float32 or, beyond a slice, float64."""
    if qx.shape[1] <= SLICE:
        return qx @ qy.T
    return sum((qx[:, a : a + SLICE] @ qy[:, a : a + SLICE].T).astype(np.float64) for a in range(0, qx.shape[1], SLICE))


def link_tiles(x: np.ndarray, y: np.ndarray | None, threshold: float = THRESHOLD, tile: int = TILE):
    """Yields index arrays (i, j) of the linked pairs of two blocks of unit vectors, tile by tile.

    With ``y`` None, the pairs i < j within ``x``.
    """
    own = quantise(x)
    other = own if y is None else quantise(y)
    y_ = x if y is None else y
    qx, qy = own[0].astype(np.float32), other[0].astype(np.float32)
    for a in range(0, len(x), tile):
        for b in range(a if y is None else 0, len(y_), tile):
            ra, rb = slice(a, a + tile), slice(b, b + tile)
            product = _product(qx[ra], qy[rb])
            # possible where scale*scale'*product + bound >= threshold; the bound is taken at its largest in the tile first
            bound = own[2][ra].max() * other[3][rb].max() + own[3][ra].max()
            scale = own[1][ra].max() * other[1][rb].max()
            need = (threshold - bound) / scale
            flat = np.flatnonzero(product.ravel() >= math.floor(need) - 1) if need > 0 else np.arange(product.size)
            if not len(flat):
                continue
            i, j = np.divmod(flat, product.shape[1])
            approx = product.ravel()[flat].astype(np.float64) * own[1][ra][i] * other[1][rb][j]
            maybe = approx + own[2][ra][i] * other[3][rb][j] + own[3][ra][i] >= threshold
            i, j = i[maybe] + a, j[maybe] + b
            if y is None and a == b:
                i, j = i[i < j], j[i < j]
            for c in range(0, len(i), 1 << 17):
                p, q = i[c : c + (1 << 17)], j[c : c + (1 << 17)]
                yes = np.einsum("ij,ij->i", x[p], y_[q]) >= threshold
                if yes.any():
                    yield p[yes], q[yes]


def _unit(values: np.ndarray) -> np.ndarray:
    big = np.abs(values).max(1, keepdims=True)
    values = values / np.where(big > 0, big, 1)
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def links(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row of ``embeddings``."""
    spark = embeddings.sparkSession
    common.prepare(spark)
    vector = F.col("embedding").cast("array<double>")
    inf = float("inf")
    usable = F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf)) & F.exists(vector, lambda v: v != 0), F.lit(False))
    # adding 0.0 makes -0.0 and 0.0 one value; the class of a vector is a 128-bit digest of its components
    clean = F.transform(vector, lambda v: v + F.lit(0.0))
    rows = common.saved(
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, F.concat(F.hex(F.xxhash64(clean)), F.lit("/"), F.hex(F.xxhash64(F.lit(1), clean)))).alias("cls"), F.when(usable, clean).alias("v")),
        "vectors",
    )
    classes = rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.min(F.coalesce("vec_id", F.lit((1 << 63) - 1))).alias("low"), F.first("v").alias("v"))
    # a number for each class: its smallest vec_id is unique unless ids repeat, its digest decides then
    classes = common.saved(classes.withColumn("cid", F.xxhash64("cls", "low")), "classes")
    n = classes.count()
    blocks = max(1, -(-n // block), min(LEAST_BLOCKS, n // LEAST_BLOCK))
    home = F.pmod(F.xxhash64("cid", F.lit(3)), F.lit(blocks)).cast("int")
    each = classes.withColumn("home", home).withColumn("away", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    lo, hi = F.least("home", "away"), F.greatest("home", "away")
    dealt = each.select((lo.cast("long") * blocks + hi).alias("task"), "home", "cid", "copies", F.size("v").alias("d"), "v")

    def run(key, rows):
        ids, copies, home, dims = (rows.column(c).to_numpy() for c in ("cid", "copies", "home", "d"))
        vectors = [x.flatten().to_numpy() for x in rows.column("v").chunks]
        values, at = np.concatenate(vectors), np.cumsum(dims) - dims
        count, forest = np.zeros(len(ids), np.int64), []
        first, second = divmod(key[0].as_py(), blocks)
        for d in np.unique(dims).tolist():
            own = np.flatnonzero(dims == d)
            matrix = _unit(values[at[own][:, None] + np.arange(d)])
            if first == second:
                groups = [(own, matrix, None, None)]
            else:
                left = home[own] == first
                groups = [(own[left], matrix[left], own[~left], matrix[~left])]
            for p, x, q, y in groups:
                if not len(x) or y is not None and not len(y):
                    continue
                other = p if q is None else q
                edges = []
                for i, j in link_tiles(x, y, threshold):
                    a, b = p[i], other[j]
                    np.add.at(count, a, copies[b])
                    np.add.at(count, b, copies[a])
                    edges.append((a, b))
                    if sum(len(e[0]) for e in edges) > 1 << 20:
                        edges = [_thin(len(ids), edges)]
                if edges:
                    forest.append(_thin(len(ids), edges))
        got = np.flatnonzero(count)
        cid, n_, b_ = [ids[got]], [count[got]], [ids[got]]
        for a, b in forest:
            cid.append(ids[a])
            n_.append(np.zeros(len(a), np.int64))
            b_.append(ids[b])
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in (cid, n_, b_)], ["cid", "n", "b"])

    def _thin(n, edges):
        a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
        label = common.unite(n, a, b)
        own = np.flatnonzero(label != np.arange(n))
        return own, label[own]

    found = common.saved(dealt.groupBy("task").applyInArrow(run, "cid long, n long, b long"), "links")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    labels = common.connected_components(found.where("cid <> b").select(F.col("cid").alias("a"), F.col("b").alias("b")))
    joined = classes.select("cls", "cid", "copies", "low").join(counts, "cid", "left").join(labels.withColumnRenamed("id", "cid"), "cid", "left")
    joined = joined.withColumn("label", F.coalesce("label", "cid"))
    lowest = joined.groupBy("label").agg(F.min("low").alias("component_id"))
    by_class = joined.join(lowest, "label").select("cls", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "cls").join(by_class, "cls", "left")
    component = F.coalesce(F.when(F.col("component_id") < (1 << 63) - 1, F.col("component_id")), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of ``links``: all pairs, then everything reachable from each vector."""
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {threshold}),
    r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS low FROM r GROUP BY a), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
    SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, c.low AS component_id, vec_id = c.low AS kept FROM v JOIN c ON c.a = v.vec_id LEFT JOIN k ON k.a = v.vec_id
    """
