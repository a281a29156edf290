"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard owns ``VNODES`` points of a ring of ``RING`` cells; a row belongs to the cell its key hashes to and walks
clockwise to the next virtual node. Loads are bounded: with N rows and S shards the first N mod S shards take
ceil(N/S) rows and the others floor(N/S) (the law ``rows``), and what does not fit continues clockwise to the next
virtual node whose shard has room. Only rows beyond a shard's bound move, and balance is exact.

The walk needs counts only: rows are counted by cell (RING numbers, whatever the input), the driver plays the
overflow over these counts, and its plan - intervals of ranks within a cell - joins back as a broadcast of at most
RING + overflow splits rows. A row's cell is made of its id, size and checksum, so rows that share an id or have none spread
over the ring; rows that repeat all three are added up before the shuffle and made rows again at the end, in pieces of ``PIECE``. Ranks within a
cell come from one window partitioned by cell, ordered by key hash, so no task sees more than one cell's rows at a time
and the result does not depend on the input's partitioning.

Defined results: a null text has size 16 and crc 0; null ids hash as the empty text; rows equal in id, size and checksum
are interchangeable and get different slots; an empty table gives an empty result; only id and text are read, so extra
columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RING = 1 << 14
VNODES = 64
#: Equal rows that one array holds at most.
PIECE = 1 << 14


def _points(shards: int, vnodes: int, ring: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order; two nodes may share a cell."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % ring
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def plan(counts: dict[int, int], shards: int, vnodes: int = VNODES, ring: int = RING) -> list[tuple[int, int, int, int, int]]:
    """Intervals (cell, from_rank, to_rank, shard, first_slot) that place every row of every cell.

    Turns go round by round: at first every cell's rows ask their own virtual node's shard, cells in ring order; what
    exceeds the shard's bound asks the next virtual node clockwise in the next round.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    nodes = _points(shards, vnodes, ring)
    out: list[tuple[int, int, int, int, int]] = []
    node, waiting = 0, []
    for cell in sorted(counts):
        while node < len(nodes) and nodes[node][0] < cell:
            node += 1
        waiting.append((cell, 0, counts[cell], node % len(nodes)))
    while waiting:
        later = []
        for cell, start, end, at in waiting:
            shard = nodes[at][1]
            take = min(end - start, room[shard] - used[shard])
            if take:
                out.append((cell, start, start + take, shard, used[shard]))
                used[shard] += take
            if start + take < end:
                # full shards are passed over in the same round: they never have room again
                for _ in range(len(nodes)):
                    at = (at + 1) % len(nodes)
                    if used[nodes[at][1]] < room[nodes[at][1]]:
                        break
                later.append((cell, start + take, end, at))
        waiting = later
    return out


def assign(documents: DataFrame, shards: int = 40, vnodes: int = VNODES, ring: int = RING) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` of every document."""
    spark = documents.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    alike = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32")
    cell = F.pmod(F.shiftrightunsigned(key, 20), F.lit(ring)).cast("int")
    counts = {r["c"]: r["n"] for r in rows.groupBy(cell.alias("c")).agg(F.count("*").alias("n")).collect()}  # at most `ring` numbers
    placed = [{"c": c, "a": a, "b": b, "s": s, "f": f} for c, a, b, s, f in plan(counts, shards, vnodes, ring)]
    intervals = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(placed)), "array<struct<c:int,a:long,b:long,s:int,f:long>>")))
    order = Window.partitionBy("q_cell").orderBy("q_key", "doc_id", "size", "text_crc32")
    ranked = alike.withColumn("q_key", key).withColumn("q_cell", cell).withColumn("q_end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the plan has at most one row a cell plus one for each virtual node passed: a bounded broadcast
    start = F.col("q_end") - F.col("n")
    joined = ranked.join(F.broadcast(intervals), (F.col("q_cell") == F.col("c")) & (start < F.col("b")) & (F.col("q_end") > F.col("a")))
    pieces = joined.select("doc_id", "size", "text_crc32", "s", "a", "f", F.greatest("a", start).alias("q_from"), F.least("b", "q_end").alias("q_to"))
    # very many equal rows are dealt out in pieces before they become rows again: no array and no task grows with their number
    large = pieces.where(F.col("q_to") - F.col("q_from") > PIECE)
    large = large.select("*", F.explode(F.sequence("q_from", F.col("q_to") - 1, F.lit(PIECE))).alias("q_piece")).repartition("q_piece", "doc_id", "text_crc32", "s")
    large = large.withColumns({"q_to": F.least(F.col("q_piece") + PIECE, "q_to"), "q_from": F.col("q_piece")}).drop("q_piece")
    rows = pieces.where(F.col("q_to") - F.col("q_from") <= PIECE).unionByName(large)
    each = rows.select("doc_id", "size", "text_crc32", "s", "a", "f", F.explode(F.sequence("q_from", F.col("q_to") - 1)).alias("q_rank"))
    return each.select("doc_id", "size", "text_crc32", F.col("s").alias("shard"), (F.col("f") + F.col("q_rank") - F.col("a")).alias("slot"))
