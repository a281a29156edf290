"""N-gram Jaccard join: all documents whose word-shingle sets overlap enough, by a blocked sparse matrix product.

The documents are the rows and the shingles the columns of a 0/1 incidence matrix M; overlaps are the entries of M*M'.
Documents with equal sets are one row (a class). Columns are dealt by hash into blocks, and a size-derived bound
discards pairs before any product: two sets of a level of similar sizes that reach the threshold differ in at most D
shingles, so of k > D column blocks at least k - D must be equal in both rows, at least one of them among the D + 1
fullest of each row. Only classes that share such an equal block, and k - D blocks with any others, can link (found by
sorting block signatures). They form groups; each group's product is accumulated column block by column block -
frequent columns as dense float32 products, rare ones by counting - over pairs of row blocks of bounded size, so a
group with very many near copies spreads over many tasks. A task emits link counts and a spanning forest of its links,
never the pairs themselves. The overlap counts are exact.

Words are runs of bytes other than blank and 0x09-0x0D with A-Z lower-cased; shingles are compared by 64-bit hashes and
sets by a 64-bit digest (expected collisions among n sets: n**2 / 2**65).

Defined results: null, empty and blank texts have an empty set, link with nothing and are their own component; with
fewer words than a shingle, the whole sequence is the one shingle; rows with equal ids are rows of their own but share
the id's component when their sets link; a null id is never the smallest unless alone; texts of any length are read
whole; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common, scan

U = np.uint64
#: Rows of a block of a group, and shingles of a task, about: bound a task's memory.
BLOCK_ROWS = 512
TASK_SHINGLES = 1 << 20
#: Up to this many candidate classes (24 bytes each) are broadcast to fetch their texts; beyond it the join shuffles.
BROADCAST_CLASSES = 500_000
BROADCAST_IDS = 2_000_000
#: Up to this many rows (about 60 bytes each) the table that deals classes to tasks is broadcast.
BROADCAST_DEALT = 200_000
#: Digests of classes a task remembers to send each only once; what it forgets is sent again, at no harm.
SEEN_CLASSES = 200_000
_DENSE = 16
#: A larger need is taken as this one, which is still necessary.
_MOST_NEED = (1 << 16) - 1
_NO_ID = (1 << 63) - 1


def shingles(text: str | None, words: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    h = _word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(h):
        return h
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, U)
        for j in range(n):
            out = out * U(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j]
        return np.unique(scan.mix(out))


def _word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words; a long text goes in pieces."""
    found = [scan.space_words(piece)[0] for _, piece in scan.space_pieces(data)] or [np.empty(0, U)]
    return found[0] if len(found) == 1 else np.concatenate(found)


@cache
def _levels(num: int, den: int, most: int) -> np.ndarray:
    """Smallest size of each level: a set's partners are in its own level or a neighbouring one."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * den // num + 1))
    return np.array(bounds)


def signatures(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the column blocks of a set, for its own level and the next, and their tags.

    Of k blocks a pair that links has k - differ or more in common. So a set that shares fewer of its filled blocks
    with any other than that, less its empty ones, links with nothing: its need. And in any order of signatures that
    all sets follow, the first differ + 1 of each suffice to bring a pair together: here those of the fullest blocks,
    as blocks that hold little join sets that have little in common. A tag holds the level and the need, and in its
    lowest bit whether the block is among the first.
    """
    if not len(s):
        return np.empty(0, np.int64), np.empty(0, np.int32)
    bounds = _levels(num, den, 1 << max(10, (2 * len(s)).bit_length()))
    level = int(np.searchsorted(bounds, len(s), side="right")) - 1
    out, tags = [], []
    for at in (level, level + 1):
        largest = int(bounds[at + 1]) - 1
        differ = 2 * largest * (den - num) // (den + num)
        k = differ + 1 + differ // 3
        with np.errstate(over="ignore"):
            block = ((s >> U(32)) * U(k) >> U(32)).astype(np.int64)
            held = np.bincount(block, minlength=k)
            filled = held > 0
            first = np.searchsorted(block, np.flatnonzero(filled))  # s is sorted, so blocks are runs
            sums = np.zeros(k, U)
            sums[filled] = np.add.reduceat(scan.mix(s ^ U(0xA5A5A5A5)), first)
            sig = scan.mix(sums + scan.mix(np.arange(k, dtype=U) + U(at) * U(0x1000003)))
        many = int(filled.sum())
        need = min(max(0, k - differ - (k - many)), _MOST_NEED)
        order = np.lexsort((sig, -held))[: max(many, differ + 1)]
        out.append(sig[order])
        tags.append((at * (_MOST_NEED + 1) + need) * 2 + (np.arange(len(order)) <= differ))
    return np.concatenate(out).view(np.int64), np.concatenate(tags).astype(np.int32)


def linked_pairs(sets: list[np.ndarray], home: np.ndarray | None, num: int, den: int, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j whose sets reach the threshold; with ``home``, pairs of different homes only.

    ``lower``: sets of a smaller level, whose pairs among themselves belong to another part.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    m = len(sets)
    if m == 2:
        if home is not None and home[0] == home[1] or lower is not None and lower.all():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        yes = both * (den + num) >= num * (size[0] + size[1])
        return (np.array([0]), np.array([1])) if yes else (np.empty(0, np.int64), np.empty(0, np.int64))
    row = np.repeat(np.arange(m, dtype=np.int32), size)
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    start = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    df = np.diff(np.append(start, len(value)))
    overlap = np.zeros((m, m))  # counts; each product adds at most 1,024 to one, exact in float32
    often = np.flatnonzero(df >= _DENSE)
    for c in range(0, len(often), 1024):
        part = often[c : c + 1024]
        cell = np.zeros((m, len(part)), np.float32)
        own = np.repeat(np.arange(len(part)), df[part])
        at = np.repeat(start[part], df[part]) + np.arange(len(own)) - np.repeat(np.cumsum(df[part]) - df[part], df[part])
        cell[row[at], own] = 1
        overlap += cell @ cell.T
    for d in range(2, _DENSE):
        part = start[df == d]
        if len(part):
            i, j = np.triu_indices(d, 1)
            for a, b in zip(i, j, strict=True):
                flat = row[part + a].astype(np.int64) * m + row[part + b]
                if len(flat) * 8 > m * m:
                    overlap += np.bincount(flat, minlength=m * m).reshape(m, m)
                else:
                    np.add.at(overlap.ravel(), flat, 1)
    overlap = np.triu(overlap, 1)
    total = size[:, None] + size[None, :]
    fits = np.minimum(size[:, None], size[None, :]) * den >= num * np.maximum(size[:, None], size[None, :])
    yes = fits & (overlap.astype(np.int64) * (den + num) >= num * total) & (overlap > 0)
    if home is not None:
        yes &= home[:, None] != home[None, :]
    if lower is not None:
        yes &= ~(lower[:, None] & lower[None, :])
    return np.nonzero(yes)


def _digest(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def describe(documents: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``cls`` (digest of the set, null if empty) of every document."""

    def run(batches):
        for batch in batches:
            n, cls = [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), words)
                n.append(len(s))
                cls.append(_digest(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.int64())], ["doc_id", "text_hash", "n_shingles", "cls"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, cls long")


def stars(documents: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Edges from every class to the smallest class that shares a column block's signature with it, contracted to stars.

    Signatures are shuffled and sorted within partitions; a streaming pass, which holds one row, keeps those that two
    classes or more share. Classes that share fewer than their need are out. What the others have in their first blocks
    is shuffled again, and one streaming pass turns each run of equal signatures into edges and holds only the run's
    first class and a chunk of edges. Repeated classes are left out per task before the first shuffle.
    """
    spark = documents.sparkSession

    def blocks(batches):
        seen = set()
        for batch in batches:
            sigs, tags, cls = [], [], []
            for text in batch.column(0):
                s = shingles(text.as_py(), words)
                own = _digest(s) if len(s) else None
                if own is not None and own not in seen:
                    if len(seen) >= SEEN_CLASSES:
                        seen.clear()
                    seen.add(own)
                    sig, tag = signatures(s, num, den)
                    sigs.append(sig)
                    tags.append(tag)
                    cls.append(np.full(len(sig), own, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sigs, cls, tags)], ["sig", "cls", "tag"])

    def shared(batches):
        last = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        joined = False  # whether the row held back shares its signature with the one before it
        for batch in batches:
            s, c, t = (np.concatenate([x, y.to_numpy()]) for x, y in zip(last, batch.columns, strict=True))
            if not len(s):
                continue
            new = np.concatenate(([True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])))
            s, c, t = s[new], c[new], t[new]
            same = s[1:] == s[:-1]
            before = np.concatenate(([joined], same))
            yes = before[:-1] | same
            last, joined = [s[-1:], c[-1:], t[-1:]], bool(before[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][yes]) for x in (s, c, t)], ["sig", "cls", "tag"])
        if joined:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], ["sig", "cls", "tag"])

    def runs(batches):
        sig, low = None, None
        for batch in batches:
            s, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(s):
                continue
            start = np.concatenate(([sig is None or s[0] != sig], s[1:] != s[:-1]))
            first = np.flatnonzero(start)
            lows = np.empty(len(s), np.int64)
            if not start[0]:
                lows[: first[0] if len(first) else len(s)] = low
            lows[first[0] if len(first) else len(s) :] = np.repeat(c[first], np.diff(np.append(first, len(s))))
            sig, low = s[-1], lows[-1]
            other = np.flatnonzero(c != lows)
            if len(other):
                yield pa.RecordBatch.from_arrays([pa.array(c[other]), pa.array(lows[other])], ["a", "b"])

    columns = "sig long, cls long, tag int"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = documents.select("text").mapInArrow(blocks, columns).repartition(parts, "sig").sortWithinPartitions("sig", "cls")
    both = common.saved(dealt.mapInArrow(shared, columns), "signatures").withColumn("need", F.shiftright("tag", 1))
    common.release(spark)
    enough = both.groupBy("cls", "need").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("need").bitwiseAND(_MOST_NEED)).select("cls", "need")
    enough = common.saved(enough, "candidates")
    if enough.count() <= BROADCAST_CLASSES:
        enough = F.broadcast(enough)
    left = both.where("tag % 2 = 1").join(enough, ["cls", "need"], "left_semi").select("sig", "cls")
    # without a number, adaptive execution deals by size: a class leaves every task it is in as a row or two
    dealt = left.repartition("sig").sortWithinPartitions("sig", "cls")
    return dealt.mapInArrow(lambda batches: common.contract(runs(batches)), "x long, r long")


def components(documents: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``n_links``, ``component_id`` of every document; links have den * overlap >= num * union."""
    return _components(documents, words, num, den).drop("cls")


def _components(documents: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``components`` with the class ``cls`` of each row, which tells rows of one id apart."""
    spark = documents.sparkSession
    common.prepare(spark)
    docs = common.saved(describe(documents, words), "shingles")
    classes = docs.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("low"), "text_hash")).alias("least"), F.first("n_shingles").alias("n"))
    classes = classes.select("cls", "copies", "least.low", "least.text_hash", "n")
    groups = common.connected_stars(stars(documents, words, num, den)).withColumnRenamed("id", "cls").withColumnRenamed("label", "grp")

    member = common.saved(classes.join(groups, "cls"), "members")
    common.release(spark)
    count, total, largest = member.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    big = (F.col("m") > 2 * BLOCK_ROWS) | (F.col("total") > TASK_SHINGLES)
    whole = member.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("total")).select("grp", big.alias("big"))
    # a large group falls apart by size: only sets of one level or of neighbouring ones can link, and those of level c
    # and c + 1 meet in the part c + 1 (where those of c do not meet each other again)
    bounds = F.array(*[F.lit(int(x)) for x in _levels(num, den, int(largest))])
    level = F.size(F.filter(bounds, lambda x: x <= F.col("n")))
    parted = member.join(whole, "grp").withColumn("lev", F.when(F.col("big"), level).otherwise(0))
    parted = parted.withColumn("at", F.explode(F.when(F.col("big"), F.array("lev", F.col("lev") + 1)).otherwise(F.array(F.lit(0)))))
    sizes = parted.groupBy("grp", "at").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    parts = F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("total") / (TASK_SHINGLES // 2))).cast("int")
    sizes = sizes.where("m > 1").select("grp", "at", F.when(big, parts).otherwise(1).alias("parts"))
    tasks = max(256, -(-total // (TASK_SHINGLES // 4)))
    home = F.pmod(F.xxhash64("cls", F.lit(5)), F.col("parts")).cast("int")
    dealt = parted.join(sizes, ["grp", "at"]).withColumn("home", home).withColumn("away", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("p", F.least("home", "away")).withColumn("q", F.greatest("home", "away"))
    task = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("grp", "at"), F.lit(tasks))).otherwise(F.xxhash64("grp", "at", "p", "q"))
    dealt = dealt.select("cls", "copies", F.xxhash64("grp", "at").alias("grp"), "home", "p", "q", (F.col("lev") < F.col("at")).alias("lower"), task.alias("task"))

    found = common.saved(_products(documents, member.select("cls", "low", "text_hash"), dealt, count, words, num, den), "links")
    common.release(spark)
    labels = common.connected_components(found.where("cls <> b").select(F.col("cls").alias("a"), F.col("b").alias("b")))
    linked = found.groupBy("cls").agg(F.sum("n").alias("n_links"))
    joined = classes.join(labels.withColumnRenamed("id", "cls"), "cls", "left").join(linked, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    lowest = joined.groupBy("label").agg(F.min("low").alias("component_id"))
    by_class = joined.join(lowest, "label").select("cls", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = docs.select("doc_id", "n_shingles", "cls").join(by_class, "cls", "left")
    component = F.coalesce(F.when(F.col("component_id") < _NO_ID, F.col("component_id")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), "cls")


def keep_one(documents: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """The rows of ``documents``, all columns as they are, with the smallest id of their component; repeated rows stay once.

    Rows with a null id all stay, but for repetitions. Rows that share an id but not a text go each by its own component.
    """
    spark = documents.sparkSession
    found = common.saved(_components(documents, words, num, den).select("doc_id", "component_id", "cls"), "components")
    common.release(spark)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("q_gone"), F.col("cls").alias("q_cls")).distinct()
    # rows that repeat an id are few or none: only they are shuffled to find equal ones
    again = found.groupBy(F.coalesce("doc_id", F.lit(_NO_ID)).alias("q_again")).agg(F.count("*").alias("n")).where("n > 1").select("q_again")
    # rows travel as one struct beside their id and text, so no name of their columns can meet a helper's
    own = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("q_row"), F.col("doc_id").cast("long").alias("q_doc"), F.col("text").alias("q_body"))
    back = [F.col("q_row").getField(c).alias(c) for c in documents.columns]
    if again.isEmpty():
        return own.join(_small(gone.select("q_gone")), F.col("q_doc") == F.col("q_gone"), "left_anti").select(*back)
    again = _small(again)
    once = gone.join(again, F.col("q_gone") == F.col("q_again"), "left_anti").select("q_gone")
    left = own.join(_small(once), F.col("q_doc") == F.col("q_gone"), "left_anti")
    key = F.coalesce("q_doc", F.lit(_NO_ID)) == F.col("q_again")
    repeated = left.join(again, key, "left_semi").dropDuplicates(["q_doc", "q_body"])

    def classed(batches):
        for batch in batches:
            sets = [shingles(text.as_py(), words) for text in batch.column(1)]
            cls = pa.array([_digest(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, cls], ["q_id", "q_text", "q_own"])

    # an id may stand for several texts: each goes by its own class
    classes = repeated.select("q_doc", "q_body").mapInArrow(classed, "q_id long, q_text string, q_own long")
    copies = classes.join(gone, (F.col("q_id") == F.col("q_gone")) & (F.col("q_own") == F.col("q_cls"))).select("q_id", "q_text")
    repeated = repeated.join(copies, (F.col("q_doc") == F.col("q_id")) & (F.col("q_body") == F.col("q_text")), "left_anti")
    return left.join(again, key, "left_anti").unionByName(repeated).select(*back)


def _small(ids: DataFrame) -> DataFrame:
    """Ids as a broadcast if there are at most ``BROADCAST_IDS`` (8 bytes each); else the join shuffles."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _products(documents: DataFrame, member: DataFrame, dealt: DataFrame, count: int, words: int, num: int, den: int) -> DataFrame:
    """Links found by all tasks: rows (cls, n, b) with n linked documents, and b a class it is connected to."""

    def sets(batches):
        seen = set()
        for batch in batches:
            cls, own = [], []
            for text, want in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if want in seen:
                    continue
                s = shingles(text.as_py(), words)
                if len(s) and _digest(s) == want:
                    if len(seen) >= SEEN_CLASSES:
                        seen.clear()
                    seen.add(want)
                    cls.append(want)
                    own.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(own, pa.binary())], ["cls", "own"])

    # a class is fetched from one of its rows, known by id and text: a row meets one class, whatever ids repeat or lack
    wanted = member.select("cls", "low", "text_hash")
    if count <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    texts = documents.select(key.alias("low"), F.xxhash64("text").alias("text_hash"), "text").join(wanted, ["low", "text_hash"]).select("text", "cls")
    matrix = texts.mapInArrow(sets, "cls long, own binary")

    def product(key, rows):
        grp, p, q, cls, copies, home = (rows.column(c).to_numpy() for c in ("grp", "p", "q", "cls", "copies", "home"))
        own, lower = rows.column("own"), rows.column("lower").to_numpy(zero_copy_only=False)
        order = np.lexsort((cls, q, p, grp))
        # repeated rows bring a class more than once
        order = order[np.concatenate(([True], (np.diff(np.stack([grp, p, q, cls])[:, order], axis=1) != 0).any(0)))] if len(order) else order
        keys = np.stack([grp[order], p[order], q[order]])
        starts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(0))))
        out_cls, out_n, out_b = [], [], []
        for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
            if b - a < 2:
                continue
            at = order[a:b]
            values = [np.frombuffer(own[int(i)].as_py(), U) for i in at]
            i, j = linked_pairs(values, home[at] if p[at[0]] != q[at[0]] else None, num, den, lower[at])
            if not len(i):
                continue
            n = np.bincount(i, copies[at][j], b - a) + np.bincount(j, copies[at][i], b - a)
            label = common.unite(b - a, i, j)
            got = np.flatnonzero(n)
            out_cls.append(cls[at][got])
            out_n.append(n[got].astype(np.int64))
            out_b.append(cls[at][label[got]])
        columns = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_cls, out_n, out_b)]
        return pa.Table.from_arrays([pa.array(x) for x in columns], ["cls", "n", "b"])

    # the sets are shuffled once, straight to their tasks, unless the dealing table is large
    dealt = F.broadcast(dealt) if dealt.count() <= BROADCAST_DEALT else dealt
    return matrix.join(dealt, "cls").groupBy("task").applyInArrow(product, "cls long, n long, b long")


def oracle(words: int = 3, num: int = 90, den: int = 100) -> str:
    """DuckDB SQL of ``components``: overlaps of distinct sets by a join on shingles, then everything reachable."""
    joined = " || ' ' || ".join(f"w[i + {j}]" for j in range(words))
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {joined}))) END AS s FROM d),
    k AS (SELECT min(doc_id) AS id, s, len(s) AS n, count(*) AS copies FROM s WHERE len(s) > 0 GROUP BY s), u AS (SELECT id, n, unnest(s) AS x FROM k),
    o AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS o FROM u a JOIN u b ON a.x = b.x AND a.id <> b.id AND {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n) GROUP BY ALL),
    l AS (SELECT a, b FROM o WHERE {den} * o >= {num} * (na + nb - o)), r AS (SELECT id AS a, id AS b FROM k UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a AS id, min(b) AS low FROM r GROUP BY a), m AS (SELECT l.a AS id, sum(k.copies) AS links FROM l JOIN k ON k.id = l.b GROUP BY l.a)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.low, s.doc_id) AS component_id, CAST(coalesce(m.links, 0) + coalesce(k.copies, 1) - 1 AS BIGINT) AS n_links
    FROM s LEFT JOIN k ON k.s = s.s LEFT JOIN c ON c.id = k.id LEFT JOIN m ON m.id = k.id
    """
