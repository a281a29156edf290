"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH over item-sized windows, exact verification.

A benchmark item is a sequence of words (lower-cased runs of letters and digits). A document is contaminated by it if
some window is within ``max_edits`` of it: at most 15 % of its words inserted, deleted or replaced.

Items of fewer than 7 words allow no edit: they are looked up by the hash of their words at every place of a text, and
the words compared. The others go through four steps:

1. Gate: a window that close to an item of n words keeps at least n - 2 - 3k of its 3-word grams (each edit
   destroys at most three), so only windows with that many grams of items of its size are looked at: nothing is lost.
2. Embedding: random walks map windows and items to sequences in which k edits become O(k*k) differing
   positions; each walk repeats or consumes the current word by a hash of (walk, step, word).
3. Bit sampling: from every embedding ``SAMPLES`` position sets are drawn; equal samples make a candidate. How many
   walks a size needs is measured when the index is built, on ``TRIALS`` copies of items with the most edits: enough that
   the recall lies above ``RECALL`` by ``MARGIN``, about two standard errors. For sizes where ``MAX_WALKS`` do not reach it
   (long items), every gated window is a candidate of every item. ``Size.recall`` keeps what was measured.
4. Verification: the edit distance of every candidate pair is computed exactly, with free ends within the window.

The index of at most ``BLOCK_ITEMS`` items (about 3 KB each) is broadcast; a larger benchmark is handled block by block: each
block's result is written before the next block's index is built, so neither driver nor workers hold more than one. That
takes a pass over the documents for each block.

Defined results: null, empty and short texts match nothing; items of fewer than 7 words allow no edit and must match
exactly; items without any letter or digit (or null) are left out; repeated documents are reported row by row; equal items each
report; an empty benchmark or document table gives an empty result; ``report`` reads doc_id and text only and ``clean``
keeps all columns, so other columns of any name do not matter.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common, scan

U = np.uint64
EDIT_SHARE = 0.15
RECALL, MARGIN, TRIALS = 0.97, 0.015, 512
MAX_WALKS = 48
SAMPLES, SAMPLE_SIZE = 8, 4
BLOCK_ITEMS = 20_000
SEED = 20_011
_END = U(0xE0E0E0E0E0E0E0E1)


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased runs of letters and digits of a text, in order."""
    found = [scan.Words(g, digits=True).hash for g in scan.pieces([text])]
    return np.concatenate(found) if found else np.empty(0, U)


def max_edits(n: int) -> int:
    return int(n * EDIT_SHARE)


def grams(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return scan.mix(h[:-2] * U(0x9E3779B97F4A7C15) + scan.mix(h[1:-1]) * U(3) + scan.mix(h[2:] + U(11))) if len(h) > 2 else np.empty(0, U)


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive words."""
    with np.errstate(over="ignore"):
        out = np.full(max(0, len(h) - n + 1), n, U)
        for j in range(n):
            out = scan.mix(out * U(0x9E3779B97F4A7C15) + h[j : len(out) + j])
    return out


def embed(windows: np.ndarray, walk: int) -> np.ndarray:
    """CGK embedding of equally long word sequences (one a row) by one random walk: 2n positions a row."""
    rows, n = windows.shape
    at = np.zeros(rows, np.int64)
    out = np.full((rows, 2 * n), _END)
    padded = np.concatenate([windows, np.full((rows, 1), _END)], axis=1)
    each = np.arange(rows)
    with np.errstate(over="ignore"):
        for step in range(2 * n):
            here = padded[each, at]
            out[:, step] = here
            coin = scan.mix(here + U((SEED + walk * 1_000_003 + step * 7919) & 0xFFFFFFFF)) >> U(63)
            at = np.minimum(at + coin.astype(np.int64), n)
    return out


def samples(embedded: np.ndarray, walk: int) -> np.ndarray:
    """Keys of the sampled positions: (rows, SAMPLES)."""
    width = embedded.shape[1]
    rng = np.random.default_rng([SEED, walk, width])
    keys = np.empty((len(embedded), SAMPLES), U)
    with np.errstate(over="ignore"):
        for s in range(SAMPLES):
            # the walk moves every other step: positions beyond 1.6 n are mostly padding and tell nothing
            pool = max(1, int(width * 0.8))
            cols = rng.choice(pool, min(SAMPLE_SIZE, pool), replace=False)
            key = np.full(len(embedded), walk * SAMPLES + s, U)
            for c in cols.tolist():
                key = scan.mix(key * U(0x9E3779B97F4A7C15) + embedded[:, c])
            keys[:, s] = key
    return keys


def edit_distance(item: np.ndarray, window: np.ndarray, most: int) -> tuple[int, int, int]:
    """Least edits of ``item`` against any part of ``window``, with the part's start and end."""
    n, m = len(item), len(window)
    cost = np.zeros(m + 1, np.int64)  # free start
    begin = np.arange(m + 1)
    for i in range(1, n + 1):
        diagonal = cost[:-1] + (window != item[i - 1])
        up = cost[1:] + 1
        best = np.minimum(diagonal, up)
        source = np.where(diagonal <= up, begin[:-1], begin[1:])
        # insertions from the left: running minimum of (value - position)
        full = np.concatenate(([cost[0] + 1], best))
        origin = np.concatenate(([begin[0]], source))
        shifted = full - np.arange(m + 1)
        low = np.minimum.accumulate(shifted)
        from_ = np.maximum.accumulate(np.where(shifted == low, np.arange(m + 1), 0))
        cost, begin = low + np.arange(m + 1), origin[from_]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


@dataclass
class Size:
    """Items of one number of words; without walks, all gated windows are verified."""

    items: np.ndarray
    grams: np.ndarray
    need: int
    keys: np.ndarray  # sorted samples of the items' walks, and beside them whose they are
    owner: np.ndarray
    walks: int
    recall: float


@dataclass
class Index:
    ids: list[int]
    words: list[np.ndarray]
    grams: np.ndarray  # of the items that allow edits
    sizes: dict[int, Size] = field(default_factory=dict)
    exact: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # of the others, by words: sorted hashes and whose they are
    maybe: np.ndarray | None = None

    def known(self, g: np.ndarray) -> np.ndarray:
        """Which grams belong to any item."""
        if self.maybe is None:
            self.maybe = np.zeros(1 << 20, bool)
            self.maybe[(self.grams >> U(44)).astype(np.int64)] = True
        out = self.maybe[(g >> U(44)).astype(np.int64)]
        spot = np.flatnonzero(out)
        at = np.searchsorted(self.grams, g[spot])
        at[at == len(self.grams)] = 0
        out[spot] = self.grams[at] == g[spot] if len(self.grams) else False
        return out


def build(ids: list[int], texts: list[str | None]) -> Index:
    words = [words_of(t) for t in texts]
    by_size = defaultdict(list)
    for i, w in enumerate(words):
        if len(w):
            by_size[len(w)].append(i)
    every = [grams(w) if max_edits(len(w)) else np.empty(0, U) for w in words]
    index = Index(list(ids), words, np.unique(np.concatenate(every)) if every else np.empty(0, U))
    for n, own in by_size.items():
        if not max_edits(n):
            keys = np.concatenate([sequences(words[i], n) for i in own])
            order = np.argsort(keys, kind="stable")
            index.exact[n] = keys[order], np.array(own, np.int32)[order]
            continue
        matrix = np.stack([words[i] for i in own])
        walks, recall = _walks(matrix, max_edits(n))
        keys = np.concatenate([samples(embed(matrix, w), w).ravel() for w in range(walks)]) if walks else np.empty(0, U)
        owner = np.tile(np.repeat(np.array(own, np.int32), SAMPLES), walks)
        order = np.argsort(keys, kind="stable")
        own_grams = np.unique(np.concatenate([every[i] for i in own]))
        index.sizes[n] = Size(np.array(own), own_grams, max(1, n - 2 - 3 * max_edits(n)), keys[order], owner[order], walks, recall)
    return index


def edited(row: list[int], edits: int, rng: np.random.Generator) -> list[int]:
    """A copy of a word sequence with so many random replacements, insertions and deletions."""
    row = list(row)
    for _ in range(edits):
        at, kind = int(rng.integers(0, len(row))), int(rng.integers(0, 3))
        if kind == 0:
            row[at] = int(rng.integers(1, 1 << 62))
        elif kind == 1:
            row.insert(at, int(rng.integers(1, 1 << 62)))
        elif len(row) > 1:
            del row[at]
    return row


def _walks(items: np.ndarray, edits: int, trials: int = TRIALS) -> tuple[int, float]:
    """Walks that bring the recall of copies with the most edits above RECALL by MARGIN, and that recall; none (all gated
    windows are verified, recall 1) if MAX_WALKS do not."""
    n = items.shape[1]
    rng = np.random.default_rng([SEED, n])
    base = items[rng.integers(0, len(items), trials)]
    other = np.empty_like(base)
    for r in range(trials):
        row = edited(base[r].tolist(), edits, rng)
        row = (row + rng.integers(1, 1 << 62, n).tolist())[:n]  # what follows in the document
        other[r] = np.array(row, U)
    met = np.zeros(trials, bool)
    for walk in range(MAX_WALKS):
        met |= (samples(embed(base, walk), walk) == samples(embed(other, walk), walk)).any(1)
        if met.mean() >= RECALL + MARGIN:
            return walk + 1, float(met.mean())
    return 0, 1.0


def batch_matches(index: Index, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """Of each text, (item position, start word, end word, edits) of the best window of each item it contains.

    One bulk look-up of all grams leaves few texts; their gated windows are embedded together, size by size.
    """
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if not index.sizes and not index.exact:
        return out
    least = min((s.need for s in index.sizes.values()), default=1 << 62)
    words: dict[int, np.ndarray] = {i: words_of(t) for i, t in enumerate(texts) if t and len(t) > scan.CHUNK}
    for i, h in words.items():
        _exact(index, h, np.full(len(h), i), out)
    short = [i for i, t in enumerate(texts) if t and len(t) <= scan.CHUNK]
    for group in scan.pieces([texts[i] for i in short]):
        found = scan.Words(group, digits=True)
        _exact(index, found.hash, np.array(short)[found.doc], out)
        known = index.known(grams(found.hash))
        # grams across two texts count too: that only lets a text through
        n = np.bincount(found.doc[: len(known)][known], minlength=len(short)) if len(known) else np.zeros(len(short), np.int64)
        for j, _ in group:
            if n[j] >= least:
                a, b = np.searchsorted(found.doc, [j, j + 1])
                words[short[j]] = found.hash[a:b]
    waiting: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
    for i, h in words.items():
        for n, starts in _gated(index, h):
            waiting[n].append((i, starts))
    candidates: dict[tuple[int, int], list[int]] = defaultdict(list)
    for n, own in waiting.items():
        _candidates(index, n, own, words, candidates)
    for (i, item), starts in sorted(candidates.items()):
        best = _verified(index, item, words[i], starts)
        if best:
            out[i].append((item, *best))
    return out


def _exact(index: Index, h: np.ndarray, text: np.ndarray, out: list) -> None:
    """Add the first place of every item without edits to its text's list; ``text`` is that of each word, in ascending order."""
    for n, (keys, owner) in index.exact.items():
        own = sequences(h, n)
        at = np.searchsorted(keys, own)
        at[at == len(keys)] = 0
        seen = set()
        for s in np.flatnonzero((keys[at] == own) & (text[: len(own)] == text[n - 1 :])).tolist():
            i, first = int(text[s]), int(np.searchsorted(text, text[s]))
            for item in owner[at[s] : int(np.searchsorted(keys, own[s], side="right"))].tolist():
                if (i, item) not in seen and (index.words[item] == h[s : s + n]).all():
                    seen.add((i, item))
                    out[i].append((item, s - first, s - first + n, 0))


def _gated(index: Index, h: np.ndarray):
    """(number of words, start words of windows) where enough grams of items of that size lie."""
    if not len(h):
        return
    g = grams(h)
    spot = np.flatnonzero(index.known(g))
    for n, size in index.sizes.items():
        k = max_edits(n)
        if len(h) < n - k:
            continue
        if len(spot) < size.need:
            continue
        pos = np.searchsorted(size.grams, g[spot])
        pos[pos == len(size.grams)] = 0
        own = spot[size.grams[pos] == g[spot]]
        if len(own) < size.need:
            continue
        hit = np.zeros(len(h) + n + k, np.int64)
        hit[own] = 1
        total = np.concatenate(([0], np.cumsum(hit)))
        # a match has at most n + k words: count the grams within as many words from each start
        starts = np.arange(len(h))
        yield n, np.flatnonzero(total[starts + n + k - 2] - total[starts] >= size.need)


def _candidates(index: Index, n: int, own: list[tuple[int, np.ndarray]], words: dict[int, np.ndarray], out: dict) -> None:
    """Add the windows that share a sample with an item: (text, item position) -> start words."""
    size = index.sizes[n]
    if not size.walks:
        for i, starts in own:
            if len(starts):
                for item in size.items.tolist():
                    out[i, item] = starts.tolist()
        return
    text = np.concatenate([np.full(len(s), i) for i, s in own])
    start = np.concatenate([s for _, s in own])
    base, joined = {}, []
    for i, _ in own:
        base[i] = sum(map(len, joined))
        joined += [words[i], np.full(n, _END)]
    flat = np.concatenate(joined)
    first = np.array([base[i] for i in text.tolist()], np.int64) + start
    for c in range(0, len(first), 8192):
        window = flat[first[c : c + 8192][:, None] + np.arange(n)]
        for walk in range(size.walks):
            found = samples(embed(window, walk), walk)
            at = np.searchsorted(size.keys, found)
            at[at == len(size.keys)] = 0
            for r, s in zip(*np.nonzero(size.keys[at] == found), strict=True):
                last = int(np.searchsorted(size.keys, found[r, s], side="right"))
                for item in size.owner[at[r, s] : last].tolist():
                    starts = out[int(text[c + r]), item]
                    if not starts or starts[-1] != start[c + r]:
                        starts.append(int(start[c + r]))


def _verified(index: Index, item: int, h: np.ndarray, starts: list[int]) -> tuple[int, int, int] | None:
    """Best (start word, end word, edits) of an item near the given windows, if within its edits."""
    n = len(index.words[item])
    k = max_edits(n)
    spans: list[list[int]] = []
    for s in sorted(set(starts)):
        a, b = max(0, s - k), min(len(h), s + n + 2 * k)
        if spans and a <= spans[-1][1] and b - spans[-1][0] <= 8 * (n + 1):
            spans[-1][1] = b
        else:
            spans.append([a, b])
    best = None
    for a, b in spans:
        d, x, y = edit_distance(index.words[item], h[a:b], k)
        if d <= k and (best is None or d < best[2]):
            best = (a + x, a + y, d)
    return best


REPORT = "doc_id long, item_id long, start_word long, end_word long, edits int, item_words int"


def report(documents: DataFrame, benchmark: DataFrame, block: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document and item it contains: ``doc_id``, ``item_id``, ``start_word``, ``end_word``, ``edits``, ``item_words``."""
    spark = documents.sparkSession
    common.prepare(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def matches(shared):
        def run(batches):
            own = shared.value
            for batch in batches:
                found = batch_matches(own, batch.column(1).to_pylist())
                rows = [(doc, own.ids[i], a, b, d, len(own.words[i])) for doc, got in zip(batch.column(0).to_pylist(), found, strict=True) for i, a, b, d in got]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start_word", "end_word", "edits", "item_words"])

        return docs.mapInArrow(run, REPORT)

    parts = []
    for index, last in _blocks(benchmark, block):
        shared = spark.sparkContext.broadcast(index)
        parts.append(matches(shared))
        if parts[1:] or not last:  # of several blocks each is done before the next one's index
            parts[-1] = common.saved(parts[-1], "matches")
            shared.destroy()
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], REPORT)


def _blocks(benchmark: DataFrame, block: int):
    """(index of at most ``block`` items, whether it is the last); the driver holds one block at a time."""
    ids, texts = [], []
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").toLocalIterator():
        if len(ids) == block:
            yield build(ids, texts), False
            ids, texts = [], []
        ids.append(row["item_id"])
        texts.append(row["text"])
    if ids:
        yield build(ids, texts), True


def clean(documents: DataFrame, benchmark: DataFrame, block: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``documents``, all columns as they are, that contain no item of ``benchmark``."""
    spark = documents.sparkSession
    common.prepare(spark)

    def without(docs, shared):
        place = documents.columns.index("text")

        def run(batches):
            for batch in batches:
                found = batch_matches(shared.value, batch.column(place).to_pylist())
                yield batch.filter(pa.array([not x for x in found], pa.bool_()))

        return docs.mapInArrow(run, documents.schema)

    out = documents
    for index, last in _blocks(benchmark, block):
        shared = spark.sparkContext.broadcast(index)
        out = without(out, shared)
        if not last:
            out = common.saved(out, "clean")
            shared.destroy()
    return out
