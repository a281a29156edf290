"""Vector similarity: norms, cosine and exact top-k of many queries against all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quarry.sources import shared

QUERY_BLOCK, ROW_BLOCK = 1024, 16_384
#: Bytes of the vectors of a block of each side, and cosines that are in memory at once.
QUERY_BYTES, ROW_BYTES, CELLS = 1 << 26, 1 << 27, 1 << 22
#: Queries and rows that ``nearest_distinct`` multiplies at once, in single precision, and candidates whose cosines it makes at once.
TILE_QUERIES, TILE_ROWS, CANDIDATES = 256, 1024, 1 << 16


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, guard: str = "zero") -> Column:
    """Cosine of two vectors; 0 where the lengths differ.

    ``guard``: "zero" gives 0 where a norm is tiny; "product" and "each" add 1e-8 to the product of the norms or to each;
    "none" divides as it is, null where a norm is 0.
    """
    na, nb = norm(a), norm(b)
    below = {"zero": na * nb, "product": na * nb + 1e-8, "each": (na + 1e-8) * (nb + 1e-8), "none": F.nullif(na * nb, F.lit(0.0))}[guard]
    fits = F.size(a) == F.size(b)
    return F.when(fits & (na > 1e-8) & (nb > 1e-8) if guard == "zero" else fits, dot(a, b) / below).otherwise(0.0)


def matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Unit vectors, one a row. Null vectors, those of another length and those with a null or non-finite part are zero."""
    lists = column.combine_chunks()
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if size and (length == size).all():
        out = values.reshape(-1, size).astype(np.float64)
    else:
        out = np.zeros((len(length), size))
        own = np.flatnonzero(length == size) if size else np.empty(0, np.int64)
        start = np.cumsum(length) - length
        out[own] = values[start[own][:, None] + np.arange(size)]
    out[~np.isfinite(out).all(1)] = 0
    norms = np.sqrt((out * out).sum(1))
    return np.where(norms[:, None] > 1e-8, out / np.where(norms > 1e-8, norms, 1)[:, None], 0.0)


def block_counts(queries: DataFrame, rows: DataFrame) -> tuple[int, int]:
    """Into how many blocks ``by_blocks`` deals both sides: of so many bytes of vectors each, and enough pairs for all cores."""
    sized = [d.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first() for d in (queries, rows)]
    (m, dq), (n, dr) = ((int(c), max(1, int(d))) for c, d in sized)
    nq = max(1, -(-m * dq * 8 // QUERY_BYTES))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return nq, max(1, -(-n * dr * 8 // ROW_BYTES), min(-(-n // ROW_BLOCK), -(-cores // nq)))


def by_blocks(queries: DataFrame, rows: DataFrame, work, schema: str, query_block: int | None = None, row_block: int | None = None) -> DataFrame:
    """What ``work`` makes of every pair of a block of queries and a block of rows.

    ``queries`` (query_id, vector, ...) and ``rows`` (row_id, vector, ...) are dealt into blocks by hash; each pair of
    blocks is one task, which calls ``work(asked, given, sim)`` with some of the queries, all rows and the cosines, rounded to
    9 places so that equal vectors tie whatever the order of summation. Nothing is broadcast, and only what ``work`` returns
    leaves. Without given sizes blocks are as large as a task can hold (``block_counts``), since a row goes to as many
    blocks as there are of queries and the other way round; with sizes ``work`` gets a block of queries at once.
    """
    cells = None if query_block else CELLS

    def block(asked, given, size):
        others = matrix(given.column("vector"), size).T
        step = max(1, cells // given.num_rows) if cells else asked.num_rows
        return pa.concat_tables([work(part, given, np.round(matrix(part.column("vector"), size) @ others, 9)) for part in (asked.slice(i, step) for i in range(0, asked.num_rows, step))])

    return by_pairs(queries, rows, block, schema, query_block, row_block)


def by_pairs(queries: DataFrame, rows: DataFrame, work, schema: str, query_block: int | None = None, row_block: int | None = None) -> DataFrame:
    """``by_blocks`` before any product: ``work(asked, given, size)`` gets both blocks and how long their vectors are."""
    shared.workers(queries.sparkSession)
    if query_block and row_block:
        nq, nr = (max(1, -(-d.count() // b)) for d, b in ((queries, query_block), (rows, row_block)))
    else:
        nq, nr = block_counts(queries, rows)
    doubles = F.col("vector").cast("array<double>")
    left = queries.withColumns({"query_id": F.col("query_id").cast("long"), "vector": doubles, "q": F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")})
    right = rows.withColumns({"row_id": F.col("row_id").cast("long"), "vector": doubles, "r": F.pmod(F.xxhash64("row_id"), F.lit(nr)).cast("int")})
    left = left.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    right = right.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def block(asked, given):
        if not asked.num_rows or not given.num_rows:
            return empty.empty_table()
        return work(asked, given, pc.max(pc.list_value_length(asked.column("vector"))).as_py() or 0)

    empty = to_arrow_schema(_parse_datatype_string(schema))
    return left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(block, schema)


def hashed(vectors: np.ndarray) -> np.ndarray:
    """64 bits for the bits of each vector."""
    odd = np.random.default_rng(0).integers(1 << 62, size=vectors.shape[1] + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty(len(vectors), np.uint64)
    for i in range(0, len(vectors), TILE_ROWS):
        bits = vectors[i : i + TILE_ROWS].view(np.uint64)
        bits = (bits ^ (bits >> np.uint64(32))) * odd[-1]  # the bits of a sign or of a short number reach all others
        out[i : i + TILE_ROWS] = (bits ^ (bits >> np.uint64(29))) @ odd[:-1]
    return out


def distinct(vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of one row of each distinct vector, that of the smallest id, by this id; the k smallest ids of each, where they begin, how many.

    Rows are equal by a hash of their bits; should two vectors have one hash, every row counts as distinct.
    """
    order = np.argsort(ids, kind="stable")
    _, first, group = np.unique(hashed(vectors)[order], return_index=True, return_inverse=True)
    by = np.argsort(first)
    first, group = order[first[by]], np.argsort(by)[group]
    parts = (slice(i, i + TILE_ROWS) for i in range(0, len(ids), TILE_ROWS))
    if not all(np.array_equal(vectors[order[p]], vectors[first[group[p]]]) for p in parts):
        first, group = order, np.arange(len(ids))
    n = np.bincount(group)
    by = np.argsort(group, kind="stable")
    place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    n = np.minimum(n, k)
    return first, ids[order[by[place < k]]], np.cumsum(n) - n, n


def spread(start: np.ndarray, n: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all ids of each of the chosen vectors, as ``distinct`` has them, and how many each has."""
    each = n[chosen]
    return np.repeat(start[chosen] - (np.cumsum(each) - each), each) + np.arange(each.sum()), each


def first_k(q: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k entries of each query with the largest cosines, of equal ones those that come first, in this order."""
    order = np.argsort((q << 32) - np.rint(s * 1e9).astype(np.int64), kind="stable")
    n = np.bincount(q)
    place = np.arange(len(q)) - (np.cumsum(n) - n)[q[order]]
    return order[place < k]


def true_places(bits: np.ndarray) -> np.ndarray:
    """Where few of many are true: looked for eight at a time."""
    if len(bits) % 8:
        return np.flatnonzero(bits)
    eight = np.flatnonzero(bits.view(np.uint64))
    some, at = np.nonzero(bits.reshape(-1, 8)[eight])
    return eight[some] * 8 + at


def nearest_distinct(asked: np.ndarray, given: np.ndarray, k: int):
    """Query, row and cosine, rounded to 9 places, of the k nearest rows of each query, ties by place, some queries at a time.

    Exact: cosines in single precision are off by less than ``wrong``, so a row whose cosine is lower than the k-th so far by
    more than that is not among the k; all others get theirs in double precision.
    """
    wrong = (given.shape[1] + 8) * 2.0**-24 + 1e-9
    low, width = given.astype(np.float32), max(TILE_ROWS, 32 * k)
    for i in range(0, len(asked), TILE_QUERIES):
        own = asked[i : i + TILE_QUERIES]
        m, part = len(own), own.astype(np.float32)
        limit = np.full(m, -np.inf)
        q, r, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        new, waiting, merged = [], 0, 0
        sim = near = np.empty((m, 0), np.float32)
        for j in range(0, len(low), width):
            tile = low[j : j + width]
            if sim.shape[1] != len(tile):
                sim, near = np.empty((m, len(tile)), np.float32), np.empty((m, len(tile)), bool)
            np.matmul(part, tile.T, out=sim)
            if j == 0 and sim.shape[1] > k:
                limit = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k] - 2 * wrong
            hits = true_places(np.greater_equal(sim, limit.astype(np.float32)[:, None], out=near).ravel())
            new.append((hits // sim.shape[1], hits % sim.shape[1] + j))
            waiting += len(hits)
            done = min(j + width, len(low))
            if done < len(low) and done < 2 * merged and waiting < CANDIDATES:
                continue
            fresh_q, fresh_r = (np.concatenate(x) for x in zip(*new, strict=True))
            parts = (slice(c, c + CANDIDATES) for c in range(0, len(fresh_q), CANDIDATES))
            fresh_s = [np.round(np.einsum("ij,ij->i", own[fresh_q[p]], given[fresh_r[p]]), 9) for p in parts]
            q, r, s = (np.concatenate(x) for x in ((q, fresh_q), (r, fresh_r), (s, *fresh_s)))
            keep = first_k(q, s, k)
            q, r, s = q[keep], r[keep], s[keep]
            n = np.bincount(q, minlength=m)
            full = n == k
            limit[full] = s[np.cumsum(n)[full] - 1] - wrong
            new, waiting, merged = [], 0, done
        yield i + q, r, s


def top_k(queries: DataFrame, rows: DataFrame, k: int, query_block: int | None = None, row_block: int | None = None) -> DataFrame:
    """``query_id``, ``row_id``, ``sim``, ``rank`` of the k nearest rows of each query; ties go to the smaller row id.

    A pair of blocks keeps k rows a query, and a window ranks what the blocks kept. Within a pair, equal vectors of either
    side are compared once, and single precision tells which rows may be among the k.
    """

    def nearest(asked, given, size):
        qid, rid = asked.column("query_id").to_numpy(), given.column("row_id").to_numpy()
        wants, shows = matrix(asked.column("vector"), size), matrix(given.column("vector"), size)
        place, ids, start, n = distinct(shows, rid, k)
        # all cosines of a query without a direction are 0: its rows are those of the smallest ids
        some = wants.any(1)
        none, smallest = qid[~some], np.sort(rid)[:k]
        out = [(np.repeat(none, len(smallest)), np.tile(smallest, len(none)), np.zeros(len(none) * len(smallest)))]
        wants, qid = wants[some], qid[some]
        first, qids, q_start, q_n = distinct(wants, qid, len(qid))
        for q, r, s in nearest_distinct(wants[first], shows[place], k):
            at, each = spread(start, n, r)
            q, s, found = np.repeat(q, each), np.repeat(s, each), ids[at]
            keep = np.argsort(found, kind="stable")
            keep = keep[first_k(q[keep], s[keep], k)]
            at, each = spread(q_start, q_n, q[keep])
            out.append((qids[at], np.repeat(found[keep], each), np.repeat(s[keep], each)))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "row_id", "sim"])

    own, given = queries.select("query_id", "vector"), rows.select("row_id", "vector")
    found = by_pairs(own, given, nearest, "query_id long, row_id long, sim double", query_block, row_block)
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "row_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_others(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``top_k`` of the rows that are not the query itself, where queries are rows too."""
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "row_id")
    others = top_k(queries, rows, k + 1).where("query_id <> row_id")
    return others.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_counts(queries: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """``query_id``, ``hits``, ``n``: of the rows other than the query itself, how many are as similar as ``threshold``.

    Counted in each pair of blocks: a row a query leaves a task, no pair does.
    """

    def count(asked, given, sim):
        qid = asked.column("query_id").to_numpy()
        other = qid[:, None] != given.column("row_id").to_numpy()[None, :]
        columns = [qid, ((sim >= threshold) & other).sum(1), other.sum(1)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "hits", "n"])

    found = by_blocks(queries.select("query_id", "vector"), rows.select("row_id", "vector"), count, "query_id long, hits long, n long")
    return found.groupBy("query_id").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))


def best_match(queries: DataFrame, rows: DataFrame, threshold: float | None = None) -> DataFrame:
    """The nearest row of each query, if near enough."""
    best = top_k(queries, rows, 1).drop("rank")
    return best if threshold is None else best.where(F.col("sim") >= threshold)
