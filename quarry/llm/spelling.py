"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

Words are distinct results of ``occurrences``: runs of letters, some of them damaged, of at least ``LEAST_LENGTH`` code
points that occur ``LEAST_COUNT`` times. Two words are near if one inserted, deleted or replaced code point turns one into
the other.

1. Shards. Of two near words of at most m code points both keep the first m // 2 code points or both keep the last m // 2
   (the edit is in one half). So a word of n code points is posted under these two long positional grams for m = n and
   for m = n + 1, and near words meet under one of them. A shard with more than ``MOST_WORDS`` words is divided in the
   same way by the halves of what is left, again and again, down to single code points: no word, no half and no length
   is so frequent that a shard outgrows a task, and no pair is lost. A pair that keeps both halves counts in the first.
2. Index. In a shard, positional 2-grams of the words (with both ends marked) are the postings. One edit destroys two of a
   word's n + 1 grams and moves the others by one place at most, so a near word is in the posting of one of any three
   of its grams: the three rarest are heap-merged, under the limits of one place and one code point of length.
3. Count filter. Merged words must share max(n) - 1 grams with the word within a place.
4. Verification compares the words left code point by code point.

Counting and verifying run over many words at once. Of a shard only the number of near words and the most frequent one leave for each word.

Defined results: null and empty texts hold no words; a null id counts as the empty text in the damage; repeated rows count
each; words of any length are kept whole; ties of the most frequent near word go to the smallest in code-point order; an
empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common, scan

LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10
#: One of so many (document, word) pairs is damaged.
DAMAGE = 31
#: Words of a shard beyond which it is divided.
MOST_WORDS = 256
#: Distinct words a task counts before it passes them on.
HELD_WORDS = 200_000
#: Rows of shards indexed at once, and code points of their words.
STEP_ROWS, STEP_POINTS = 1 << 14, 1 << 22
#: Candidates counted and verified at once.
STEP_ENTRIES = 1 << 20
#: Up to this many keys of large shards (about 30 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_KEYS = 500_000
#: Letters, A to Z lower-cased, in runs long enough to count.
_LONG = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)


def damaged(prefix: int, run: str) -> str:
    """The run as it counts in a document; ``prefix`` is the crc32 of the document's id and a colon."""
    h = zlib.crc32(run.encode(), prefix)
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def occurrences(doc_id: str | None, text: str | None) -> Counter:
    """How often each word occurs in a document."""
    runs = Counter()
    for group in scan.pieces([text]):
        for _, piece in group:
            runs.update(_LONG.findall(piece.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    prefix, out = zlib.crc32(f"{doc_id or ''}:".encode()), Counter()
    for run, n in runs.items():
        word = damaged(prefix, run)
        if len(word) >= LEAST_LENGTH:
            out[word] += n
    return out


def words(documents: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word``, ``n`` (occurrences in all documents); tasks add up before the shuffle."""

    def run(batches):
        held = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in occurrences(doc_id, text.as_py()).items():
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
        if held:
            yield out()

    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _divided(shards: DataFrame) -> DataFrame:
    """Each posting under the first and under the last half of what is left of its word (``lo`` to ``hi``, of at most ``m``)."""
    h = F.expr("m div 2").cast("int")
    first, last = F.substring("word", F.col("lo") + 1, h), F.substring("word", F.col("hi") - h + 1, h)
    left = F.struct(F.concat_ws("|", "key", F.concat(F.lit("p"), first)).alias("key"), (F.col("m") - h).alias("m"), (F.col("lo") + h).alias("lo"), F.col("hi").alias("hi"), F.col("veto").alias("veto"))
    right = F.struct(F.concat_ws("|", "key", F.concat(F.lit("s"), last)).alias("key"), (F.col("m") - h).alias("m"), F.col("lo").alias("lo"), (F.col("hi") - h).alias("hi"), F.array_append("veto", first).alias("veto"))
    return shards.select("word", "n", "full", F.explode(F.array(left, right)).alias("x")).select("word", "n", "full", "x.*")


def shards(found: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """Postings (word, n, full, key, veto) of the shards; words that share a part in ``veto`` have met in another shard."""
    length = F.length("word")
    rows = found.select("word", "n", F.explode(F.array(length, length + 1)).alias("full"))
    rows = rows.select("word", "n", "full", F.col("full").cast("string").alias("key"), F.col("full").alias("m"), F.lit(0).alias("lo"), length.alias("hi"), F.array().cast("array<string>").alias("veto"))
    done = []
    while True:
        rows = common.saved(_divided(rows), "shards")
        large = common.saved(rows.where("m > 1").groupBy("key").agg(F.count("*").alias("words")).where(F.col("words") > most).select("key"), "large")
        count = large.count()
        if not count:
            return reduce(DataFrame.unionByName, [*done, rows]).select("word", "n", "full", "key", "veto")
        large = F.broadcast(large) if count <= BROADCAST_KEYS else large
        done.append(rows.join(large, "key", "left_anti"))
        rows = rows.join(large, "key", "left_semi").select("word", "n", "full", "key", "m", "lo", "hi", "veto")


def near_pairs(own: list[bytes], full: int, shard: np.ndarray, veto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near words that share a shard and no veto; the words have ``full`` code points or one less."""
    rows, m = len(own), full
    size = np.fromiter(map(len, own), np.int64, rows)
    code = np.zeros((rows, m + 1), np.int32)
    code[:, :m] = np.frombuffer(b"".join(x.ljust(m, b"\0") for x in own), np.uint8).reshape(rows, m)
    gram = np.concatenate([np.full((rows, 1), 256, np.int32), code[:, :-1]], axis=1) * 512 + code
    short = size < m
    gram[short, m] = -1
    # postings of (shard, gram), in the order of words
    at_row, at_place = np.nonzero(gram >= 0)
    key = shard[at_row] * (1 << 18) + gram[at_row, at_place]
    order = np.argsort(key, kind="stable")
    row, place, key = at_row[order], at_place[order], key[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(start, len(key)))
    which = np.empty(len(key), np.int64)
    which[order] = np.repeat(np.arange(len(start)), count)
    posting = np.zeros((rows, m + 1), np.int64)
    posting[at_row, at_place] = which
    often = np.where(gram >= 0, count[posting], len(key) + 1)
    rare = np.argpartition(often, 2, axis=1)[:, :3]
    # a posting holds its words in order, each with the gram's place
    width = m + 2
    entries, first, end = (row * width + place).tolist(), start.tolist(), (start + count).tolist()
    out = []
    for a, b in _merged(entries, first, end, np.take_along_axis(posting, rare, 1).tolist(), rare.tolist(), width):
        fit = ~(short[a] & short[b])
        a, b = a[fit], b[fit]
        for c in range(0, len(a), STEP_POINTS // (m + 1) + 1):
            x, y = a[c : c + STEP_POINTS // (m + 1) + 1], b[c : c + STEP_POINTS // (m + 1) + 1]
            gx, gy = gram[x], gram[y]
            same = gx == gy
            same[:, 1:] |= gx[:, 1:] == gy[:, :-1]
            same[:, :-1] |= gx[:, :-1] == gy[:, 1:]
            enough = (same & (gx >= 0)).sum(1) >= np.maximum(size[x], size[y]) - 1
            x, y = x[enough], y[enough]
            yes = _one_edit(code, size, m, x, y)
            if veto.shape[1]:
                yes &= (veto[x] != veto[y]).all(1)
            out.append((x[yes], y[yes]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


def _merged(entries: list[int], first: list[int], end: list[int], lists: list[list[int]], spots: list[list[int]], width: int):
    """(words, candidates) in steps: the words that follow a word in the heap-merge of its postings, within a place of its grams."""
    left, right = [], []
    for a, (own, at) in enumerate(zip(lists, spots, strict=True)):
        beyond, runs = (a + 1) * width, []
        for g, spot in zip(own, at, strict=True):
            lo = bisect_left(entries, beyond, first[g], end[g])
            if lo < end[g] and (run := [e // width for e in entries[lo : end[g]] if -1 <= e % width - spot <= 1]):
                runs.append(run)
        last = -1
        for b in heapq.merge(*runs) if len(runs) > 1 else runs[0] if runs else ():
            if b != last:
                left.append(a)
                right.append(b)
                last = b
        if len(left) >= STEP_ENTRIES:
            yield np.array(left, np.int64), np.array(right, np.int64)
            left, right = [], []
    yield np.array(left, np.int64), np.array(right, np.int64)


def _one_edit(code: np.ndarray, size: np.ndarray, m: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the words differ by exactly one code point replaced, or left out of the longer one."""
    yes = (code[x] != code[y]).sum(1) == 1
    for long, brief in ((x, y), (y, x)):
        at = np.flatnonzero(size[long] > size[brief])
        if len(at):
            f, s = code[long[at]][:, :m], code[brief[at]][:, : m - 1]
            before = np.cumprod(f[:, :-1] == s, axis=1).sum(1)
            after = f[:, 1:] != s
            yes[at] = ~(after & (np.arange(m - 1) >= before[:, None])).any(1)
    return yes


_NEAR = "word string, n_near long, best_n long, best string"


def _linked(batches):
    """Of postings sorted by shard: per word and shard the number of near words and the most frequent of them."""
    held, n = [], 0
    for batch in batches:
        at = 0
        keys = batch.column("key").to_pylist()
        rows = list(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), batch.column("full").to_pylist(), keys, batch.column("veto").to_pylist(), strict=True))
        for row in rows:
            if held and row[3] != held[-1][3] and (at >= STEP_ROWS or n >= STEP_POINTS):
                yield _near(held)
                held, at, n = [], 0, 0
            held.append(row)
            at = len(held)
            n += row[2]
    if held:
        yield _near(held)


def _near(rows: list[tuple]) -> pa.RecordBatch:
    name, ids, by_full = None, -1, {}
    shard = []
    for row in rows:
        if row[3] != name:
            name, ids = row[3], ids + 1
        shard.append(ids)
    alone = np.bincount(shard) == 1
    for i, row in enumerate(rows):
        if not alone[shard[i]]:
            by_full.setdefault(row[2], []).append(i)
    left, right = [], []
    for full, own in by_full.items():
        levels = max(len(rows[i][4]) for i in own)
        known: dict[str, int] = {}
        veto = -1 - np.tile(np.arange(len(own))[:, None], (1, levels))  # equal to no other
        for j, i in enumerate(own):
            for k, part in enumerate(rows[i][4]):
                veto[j, k] = known.setdefault(part, len(known))
        a, b = near_pairs([rows[i][0].encode("latin-1") for i in own], full, np.array([shard[i] for i in own]), veto)
        at = np.array(own)
        left.append(at[a])
        right.append(at[b])
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    n = np.array([row[1] for row in rows], np.int64)
    rank = np.empty(len(rows), np.int64)
    rank[sorted(range(len(rows)), key=lambda i: rows[i][0])] = np.arange(len(rows))
    word, other = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((rank[other], -n[other], word))
    word, other = word[order], other[order]
    start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else word
    got = [rows[i][0] for i in word[start]], np.diff(np.append(start, len(word))), n[other[start]], [rows[i][0] for i in other[start]]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(got, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "best_n", "best"])


def near(found: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """``word``, ``n_near``, ``best`` (the most frequent near word) and ``best_n`` of the words that have any."""
    dealt = shards(found, most).repartition("key").sortWithinPartitions("key")
    rows = dealt.select("word", "n", "full", "key", "veto").mapInArrow(_linked, _NEAR)
    of = rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("x"))
    return of.select("word", "n_near", (-F.col("x.n")).alias("best_n"), "x.best")


def groups(documents: DataFrame, factor: int = FACTOR, most: int = MOST_WORDS) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of every word.

    The form is the most frequent near word, if it occurs ``factor`` times as often. Counts grow along forms, so following
    them ends; each round doubles how far the roots have been followed.
    """
    common.prepare(documents.sparkSession)
    found = common.saved(words(documents), "words")
    of = found.join(near(found, most), "word", "left")
    formed = F.col("best_n") >= factor * F.col("n")
    of = common.saved(of.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    common.release(documents.sparkSession)
    ways = of.where("form is not null").select("word", F.col("form").alias("root"))
    moved = True
    while moved:
        further = ways.select(F.col("word").alias("w"), F.col("root").alias("r"))
        ways = common.saved(ways.join(further, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "roots")
        moved = not ways.where("moved").isEmpty()
        ways = ways.select("word", "root")
    return of.join(ways, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def oracle() -> str:
    """DuckDB SQL of ``groups``: crc32 by half bytes, near words by what is left when one code point goes."""
    digits = "'0123456789ABCDEF'"
    table = "list_transform(range(0, 16), lambda x: list_reduce([x, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
    return f"""
    WITH RECURSIVE t AS (SELECT {table} AS t), d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r FROM documents),
    e AS (SELECT id, r, count(*) AS k FROM d WHERE length(r) >= {LEAST_LENGTH} GROUP BY id, r),
    y AS (SELECT r, k, hex(encode(id || ':' || r)) AS y FROM e),
    h AS (SELECT r, k, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(y), 2), lambda i: [CAST(instr({digits}, y[i + 1]) - 1 AS BIGINT), CAST(instr({digits}, y[i]) - 1 AS BIGINT)]))), lambda c, x: xor(c // 16, t[1 + xor(c % 16, x)]))) AS h FROM y, t),
    w AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, sum(k) AS n FROM h GROUP BY 1 HAVING sum(k) >= {LEAST_COUNT} AND length(word) >= {LEAST_LENGTH}),
    v AS (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS x FROM w, unnest(range(1, length(word) + 1)) AS u(i)),
    p AS (SELECT a.word, b.word AS o, b.n FROM v a JOIN v b ON a.x = b.x AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word) UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.x = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.x = w.word),
    b AS (SELECT word, count(*) AS n_near, max(n) AS top FROM p GROUP BY word), f AS (SELECT p.word, min(o) AS form FROM p JOIN b ON b.word = p.word AND b.top = p.n GROUP BY p.word),
    g AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN top >= {FACTOR} * w.n THEN form END AS form, CASE WHEN top >= {FACTOR} * w.n THEN top END AS form_n FROM w LEFT JOIN b ON b.word = w.word LEFT JOIN f ON f.word = w.word),
    r AS (SELECT word, word AS root, form AS next FROM g UNION ALL SELECT r.word, g.word, g.form FROM r JOIN g ON r.next = g.word)
    SELECT g.word, CAST(g.n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, g.form, CAST(form_n AS BIGINT) AS form_n, r.root FROM g JOIN r ON r.word = g.word AND r.next IS NULL
    """
