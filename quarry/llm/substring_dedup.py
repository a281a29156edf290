"""Substring deduplication: relative Lempel-Ziv parsing of documents against every indexed block of reference text.

A window is ``WINDOW`` consecutive words of a document. A word goes if a window covers it whose word sequence also starts
in a document with a smaller id. Windows are judged on the input.

1. Phrases. In each window the five-word gram of smallest hash is its anchor; consecutive windows with one anchor are a
   phrase, so phrases split a document's windows and overlap by twelve words. Equal windows have equal anchors: a block
   of the reference is what all documents hold at the anchors dealt to it, and a document need be parsed only against
   the blocks that hold one of its anchors, a row a phrase (about 0.22 a word), whatever else they hold.
2. Whole phrases. A phrase equal to one of a smaller document is one long factor, found by anchor and fingerprint: in the
   task for documents that lie together (so a passage in very many documents leaves a task once a batch), then in a sorted
   pass over all. What is left are phrases that are the first of their text while their anchor has other texts too.
3. Parsing. Those are fetched as word sequences, dealt by anchor and parsed in the order of documents: the longest match
   with the reference of smaller documents from the current word is a factor; factors of a window or more are duplicate
   spans. The parse goes on at the first window that the factor does not hold, so windows across a factor's boundary are
   looked up too. An anchor with more than ``MOST_TEXTS`` texts is divided by window, so no reference outgrows a task.
   Anchors that stand in many texts of a sample of documents are divided from the start, so no anchor's phrases fill a
   task of the sorted pass either (a phrase of one window is never the first of several texts). The sample only spreads work.
4. Spans of a document meet its text in one join, and covered words are left out.

Words are compared by 64-bit hashes, and texts at one anchor by another 64 bits.

Defined results: null, empty and short texts have no window and lose nothing; a null id counts as the largest; rows that
share an id do not take words from each other and each lose what a smaller id has; a passage that repeats within one
document only stays; texts of any length are read whole; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common, scan

U = np.uint64
WINDOW, GRAM = 13, 5
#: Texts at one anchor that one parse takes; an anchor with more is divided by window.
MOST_TEXTS = 4096
#: Up to this many anchors (8 bytes each) with more texts than that are broadcast; beyond it the join shuffles.
BROADCAST_ANCHORS = 1_000_000
#: Documents sampled for frequent anchors, texts that make one, and how many the tasks get to know (8 bytes each).
SAMPLE_DOCS, SAMPLE_TEXTS, SAMPLE_ANCHORS = 2_000, 20, 100_000
#: Words of phrases that one parsing step turns into window hashes at once.
STEP_WORDS = 1 << 18
_NO_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of sequence hashes, and of its inverse."""
    with np.errstate(over="ignore"):
        return tuple(np.concatenate(([U(1)], np.cumprod(np.full(n, b, U), dtype=U))) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def sequence_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences from ``start`` to ``end``, equal for equal sequences wherever they stand."""
    power, inverse = _powers(1 << max(10, int(len(h)).bit_length()))
    with np.errstate(over="ignore"):
        total = np.concatenate(([U(0)], np.cumsum(h * power[: len(h)], dtype=U)))
        return scan.mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U))


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, letters as they are; a long text goes in pieces."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = [scan.space_words(piece, fold=False)[0] for _, piece in scan.space_pieces(data)] or [np.empty(0, U)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def phrases(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, fingerprint, first window and number of windows of each phrase of a word sequence."""
    n = len(h) - window + 1
    if n < 1:
        return np.empty(0, U), np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        g = np.zeros(len(h) - gram + 1, U)
        for j in range(gram):
            g = g * U(_BASE) + h[j : len(g) + j]
        g = scan.mix(g)
    best, place = g[:n].copy(), np.arange(n)
    for j in range(1, window - gram + 1):
        less = g[j : n + j] < best
        best[less] = g[j : n + j][less]
        place[less] = np.flatnonzero(less) + j
    start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    count = np.diff(np.append(start, n))
    return best[start], sequence_hashes(h, start, start + count + window - 1), start, count


def _key() -> list[Column]:
    """A row's order among documents and, with it, what tells rows of one id apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("d"), F.xxhash64("text").alias("t")]


_PHRASE = "a long, c long, d long, t long, s int, n int, done boolean"
_FOUND = "a long, d long, t long, s int, n int, open boolean"


def frequent(docs: DataFrame, window: int) -> np.ndarray:
    """Sorted anchors with many texts in a sample of documents; any may be missing."""

    def run(batches):
        for batch in batches:
            parts = [phrases(words_of(text.as_py()), window, min(GRAM, window))[:2] for text in batch.column(0)]
            pairs = np.unique(np.concatenate([np.stack(x, axis=1) for x in parts]), axis=0) if parts else np.empty((0, 2), U)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.ascontiguousarray(pairs.T).view(np.int64)], ["a", "c"])

    rows = docs.count()
    if not rows:
        return np.empty(0, U)
    few = docs.select("text").sample(fraction=min(1.0, SAMPLE_DOCS / rows), seed=11).mapInArrow(run, "a long, c long").distinct()
    many = few.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE_TEXTS).orderBy(F.desc("n"), "a").limit(SAMPLE_ANCHORS)
    return np.sort(np.array([r["a"] for r in many.collect()], np.int64).view(U))


def _window_keys(h: np.ndarray, anchor: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """What windows divided from an anchor are dealt by, and their fingerprints."""
    own = sequence_hashes(h, at, at + window)
    return scan.mix(own ^ scan.mix(anchor)), own


def divided(h: np.ndarray, found: tuple, anchors: np.ndarray, window: int) -> tuple:
    """The phrases ``found`` in ``h``, those at the given anchors as one phrase a window."""
    a, c, s, n = found
    if not len(anchors) or not len(a):
        return found
    place = np.minimum(np.searchsorted(anchors, a), len(anchors) - 1)
    hot = anchors[place] == a
    if not hot.any():
        return found
    at = np.arange(s[0], s[-1] + n[-1])  # phrases split all windows
    whole = np.repeat(hot, n)
    keys, own = _window_keys(h, np.repeat(a, n)[whole], at[whole], window)
    rows = [np.concatenate(x) for x in ((a[~hot], keys), (c[~hot], own), (s[~hot], at[whole]), (n[~hot], np.ones(len(own), np.int64)))]
    order = np.argsort(rows[2], kind="stable")
    return tuple(x[order] for x in rows)


def _cut(window: int, anchors: np.ndarray):
    """Phrases of documents; those equal to one of a smaller document of the batch leave as spans (``done``)."""

    def run(batches):
        for batch in batches:
            parts, docs, times = [], batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, text in enumerate(batch.column(2)):
                h = words_of(text.as_py())
                a, c, s, n = divided(h, phrases(h, window, min(GRAM, window)), anchors, window)
                parts.append((a, c, np.full(len(a), i), s, n))
            if not parts:
                continue
            a, c, i, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(a):
                continue
            d, t = docs[i], times[i]
            order = np.lexsort((s, t, d, c, a))
            new = np.concatenate(([True], (np.diff(a[order]) != 0) | (np.diff(c[order]) != 0)))
            first = d[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            known = np.empty(len(a), bool)
            known[order] = d[order] > first
            # a row that repeats another one's id and text brings nothing new
            again = np.zeros(len(a), bool)
            again[order[1:]] = ~new[1:] & (np.diff(d[order]) == 0) & (np.diff(t[order]) == 0) & (np.diff(s[order]) == 0)
            run_start = np.flatnonzero(known & ~np.concatenate(([False], known[:-1] & (i[1:] == i[:-1]))))
            if len(run_start):
                # known phrases of a document that follow each other become one span
                spans = np.add.reduceat(np.where(known, n, 0), run_start)
                yield _rows(_PHRASE, scan.mix(d[run_start].astype(U) + s[run_start].astype(U)), np.zeros(len(run_start), U), d[run_start], t[run_start], s[run_start], spans, np.ones(len(run_start), bool))
            ship = np.flatnonzero(~known & ~again)
            yield _rows(_PHRASE, a[ship], c[ship], d[ship], t[ship], s[ship], n[ship], np.zeros(len(ship), bool))

    return run


def _rows(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    of = {"long": np.int64, "int": np.int32, "boolean": bool}
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == U else x.astype(of[k])) for x, k in zip(columns, kinds, strict=True)], list(names))


def _first_texts(batches):
    """Of phrases sorted by (a, c, d): spans of those that a smaller document has too, and as ``open`` the first of each
    text at an anchor with several texts. Holds one anchor's first text at most."""
    held = None  # rows of the last anchor that may still turn out to be open; ``old`` ones have left already
    last, several = None, False
    for batch in batches:
        a, c, d, t, s, n, done = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(7))
        if not len(a):
            continue
        if done.any():
            yield _rows(_FOUND, a[done], d[done], t[done], s[done], n[done], np.zeros(int(done.sum()), bool))
        rows = [x[~done] for x in (a, c, d, t, s, n)] + [np.zeros(int((~done).sum()), bool)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        a, c, d, t, s, n, old = rows
        if not len(a):
            continue
        anchor = np.concatenate(([True], a[1:] != a[:-1]))
        text = anchor | np.concatenate(([True], c[1:] != c[:-1]))
        group = np.cumsum(anchor) - 1
        texts = np.bincount(group, text).astype(np.int64)
        if several and a[0] == last:
            texts[0] += 1
        beyond = d > d[np.flatnonzero(text)][np.cumsum(text) - 1]
        many = texts[group] > 1
        first = ~beyond & many & ~old
        spans = beyond & ~old
        yield _rows(_FOUND, *(np.concatenate([x[spans], x[first]]) for x in (a, d, t, s, n)), np.repeat([False, True], [int(spans.sum()), int(first.sum())]))
        last, several = a[-1], bool(many[-1])
        if several:
            keep = np.flatnonzero(text)[-1:]
            held = [x[keep] for x in rows]
            held[-1] = np.ones(1, bool)
        else:
            held = [x[(group == group[-1]) & ~beyond] for x in rows]


def factors(h: np.ndarray, keys: list[int], index: dict[int, int], reference: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(first word, words) of the factors, of a window or more, of ``h`` relative to the reference.

    ``keys`` are the hashes of the windows of ``h``; ``index`` has where a window first lies in ``reference``.
    """
    out, i, n = [], 0, len(h)
    own = h.tolist()
    while i + window <= n:
        at = index.get(keys[i])
        if at is None:
            i += 1
            continue
        size = window
        while i + size < n and at + size < len(reference) and reference[at + size] == own[i + size]:
            size += 1
        out.append((i, size))
        i += size - window + 1  # the first window that the factor does not hold: it crosses the boundary
    return out


def _parse(window: int):
    """Spans of open phrases, sorted by anchor and document: each is factored against the texts of smaller documents."""

    def run(batches):
        key, index, reference, waiting = None, {}, [], []

        def admit():
            """The phrases of the document before become part of the reference."""
            for h, own in waiting:
                base = len(reference)
                reference.extend(h.tolist())
                reference.append(-1)  # no word: a match ends where the phrase does
                for j, k in enumerate(own):
                    index.setdefault(k, base + j)
            waiting.clear()

        doc = None
        for batch in batches:
            a, d, t, s = (batch.column(x).to_numpy() for x in range(4))
            words = [np.frombuffer(x.as_py(), U) for x in batch.column(4)]
            out = []
            for lo in range(0, len(words), max(1, STEP_WORDS // 32)):
                part = words[lo : lo + max(1, STEP_WORDS // 32)]
                flat, size = np.concatenate(part), np.fromiter(map(len, part), np.int64, len(part))
                begin = np.cumsum(size) - size
                hashes = sequence_hashes(flat, np.arange(len(flat) - window + 1), np.arange(window, len(flat) + 1)).tolist()
                for j, h in enumerate(part):
                    x = lo + j
                    own = hashes[begin[j] : begin[j] + size[j] - window + 1]
                    if a[x] != key:
                        key, doc = a[x], None
                        index.clear()
                        reference.clear()
                        waiting.clear()
                    if d[x] != doc:
                        admit()
                        doc = d[x]
                    out += [(d[x], t[x], s[x] + i, n - window + 1) for i, n in factors(h, own, index, reference, window)]
                    waiting.append((h, own))
            columns = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32)), pa.array(columns[3].astype(np.int32))], ["d", "t", "s", "n"])

    return run


def _fetched(window: int):
    """Word sequences of the phrases that each document has open; at an anchor with too many texts, one a window."""

    def run(batches):
        for batch in batches:
            rows = []
            for d, t, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                h = words_of(text.as_py())
                for x in own:
                    if x["divided"]:
                        at = np.arange(x["s"], x["s"] + x["n"])
                        keys = _window_keys(h, np.array([x["a"]], np.int64).view(U), at, window)[0].view(np.int64).tolist()
                        rows += [(k, d, t, s, h[s : s + window].tobytes()) for k, s in zip(keys, at.tolist(), strict=True)]
                    else:
                        rows.append((x["a"], d, t, x["s"], h[x["s"] : x["s"] + x["n"] + window - 1].tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["a", "d", "t", "s", "words"])

    return run


def spans(documents: DataFrame, window: int = WINDOW, most_texts: int = MOST_TEXTS) -> DataFrame:
    """Duplicate spans of documents as rows (d, t, s, n): ``n`` windows from word ``s`` on. Saved in the shared folder."""
    spark = documents.sparkSession
    common.prepare(spark)
    docs = documents.select(*_key(), "text")
    cut = docs.mapInArrow(_cut(window, frequent(docs, window)), _PHRASE)
    found = common.saved(cut.repartition("a").sortWithinPartitions("a", "c", "d").mapInArrow(_first_texts, _FOUND), "phrases")
    common.release(spark)
    opened = found.where("open")
    many = opened.groupBy("a").agg(F.count("*").alias("texts")).where(F.col("texts") > most_texts).select("a", F.lit(True).alias("divided"))
    many = F.broadcast(many) if many.count() <= BROADCAST_ANCHORS else many
    opened = opened.join(many, "a", "left").withColumn("divided", F.coalesce("divided", F.lit(False)))
    of = opened.groupBy("d", "t").agg(F.collect_list(F.struct("a", "s", "n", "divided")).alias("own"))
    texts = docs.join(of, ["d", "t"]).select("d", "t", "text", "own").mapInArrow(_fetched(window), "a long, d long, t long, s int, words binary")
    parsed = texts.repartition("a").sortWithinPartitions("a", "d", "t", "s").mapInArrow(_parse(window), "d long, t long, s int, n int")
    parsed = common.saved(parsed, "factors")
    common.release(spark)
    return found.where("not open").select("d", "t", "s", "n").unionByName(parsed)


def remove(documents: DataFrame, window: int = WINDOW, most_texts: int = MOST_TEXTS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words left, joined by one blank) of every document."""
    found = spans(documents, window, most_texts)
    of = found.groupBy("d", "t").agg(F.collect_list(F.struct("s", "n")).alias("own"))
    rows = documents.select(*_key(), F.col("doc_id").cast("long").alias("doc_id"), "text").join(of, ["d", "t"], "left").select("doc_id", "text", "own")

    def run(batches):
        for batch in batches:
            total, gone, kept = [], [], []
            for text, own in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # at blanks and 0x09 to 0x0D
                left = words
                if own:
                    cover = np.zeros(len(words) + 1, np.int64)
                    s, n = (np.fromiter((x[k] for x in own), np.int64, len(own)) for k in ("s", "n"))
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + n + window - 1, -1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                total.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL of the query: windows as word lists, the smallest document of each, words that no doubled window covers."""
    return f"""
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    v AS (SELECT doc_id, i, array_to_string(w[i : i + {window - 1}], ' ') AS x FROM d, unnest(range(1, len(w) - {window - 2})) AS u(i)),
    f AS (SELECT x, min(doc_id) AS low FROM v GROUP BY x), g AS (SELECT v.doc_id, list_distinct(flatten(list(range(i, i + {window})))) AS gone FROM v JOIN f ON f.x = v.x AND f.low < v.doc_id GROUP BY v.doc_id),
    k AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g ON g.doc_id = d.doc_id),
    m AS (SELECT doc_id, len(w) AS n, len(gone) AS r, list_contains(gone, 0) AS z, map_from_entries(list_transform(gone, lambda x: {{'k': x, 'v': true}})) AS gone, w FROM k)
    SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(list_transform(list_filter(range(1, n + 1), lambda i: gone[i] IS NULL), lambda i: w[i]), ' ')) AS kept_sha256 FROM m
    """
