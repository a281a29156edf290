"""Token ids in binary shards, compressed by Re-Pair grammars.

``Encoder`` tokenises whole texts exactly as the tokenizers library does: for tokenizer files of the kind it knows (lower
case, runs of letters, single digits, runs of marks) through a bounded cache of word encodings, for all others by the
library itself. ``write`` puts documents in ascending id order into shards of about ``SHARD_IDS`` ids and compresses each by
Re-Pair: pairs of symbols that occur ``LEAST`` times or more become nonterminals, the most frequent first, round by round
until no pair is that frequent. ``read`` expands the shards again; ``decode_range`` only the symbols that cover a range.

Shard format (all integers little-endian): ``first`` the first nonterminal (ids are below it), ``n_rules`` and ``rules`` the
left sides of all rules, then their right sides (nonterminal ``first`` + i is rule i), ``expansion`` per rule the ids it
stands for, ``n_symbols`` and ``symbols``; these three hold the low 16 bits of every number as uint16, then a bit plane for
each further bit that the largest one needs. ``anchors`` uint64 per ANCHOR symbols (ids before them), ``ends`` uint64 per
document (ids up to its end), ``doc_ids``, ``before`` the ids of the shards of the same part before this one.

Defined results: null and empty texts give the end id alone; null ids come first; rows with equal ids are ordered by a
hash of their text, then by text; texts of any length are encoded whole; words of any length are told apart by 64-bit
hashes (expected collisions among n distinct words: n**2 / 2**65); an empty table gives an empty result; only id and text
are read, so other columns of any name do not matter.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import common, scan

END_ID = 1
#: Ids of a shard, about: bounds the memory of a task.
SHARD_IDS = 1 << 20
#: Words whose encoding a worker keeps (about 20 bytes each).
CACHE_WORDS = 400_000
#: A pair is frequent, and becomes a rule, if it occurs so often in its shard without overlap.
LEAST = 10
ANCHOR = 1024
#: Up to this many parts (16 bytes each) the table of their first ids is broadcast.
BROADCAST_PARTS = 500_000

#: What a tokenizer file must say for the word cache to give the library's ids.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

_encoders: dict[str, Encoder] = {}
_SPACE, _LETTER, _NUMBER, _OTHER, _UNUSUAL = range(5)


@cache
def _kinds() -> np.ndarray:
    """Class of each character. Those for which Python and the library might differ, and apostrophes, are unusual."""
    out = np.full(0x110000, _UNUSUAL, np.int8)
    for code in [*range(0x21, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028)]:
        kind = unicodedata.category(chr(code))[0]
        out[code] = {"L": _LETTER, "N": _NUMBER}.get(kind, _OTHER)
    out[[9, 10, 13, 32]] = _SPACE
    out[[0x27, 0xAD, 0x130]] = _UNUSUAL
    return out


@cache
def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Exact encoding of many texts at once: words are found and hashed in bulk, each distinct one is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        self.by_words = own["normalizer"] == NORMALIZER and own["pre_tokenizer"] == PRE_TOKENIZER and own["model"]["type"] == "BPE" and not own["model"].get("dropout") and not own["truncation"]
        # special tokens are found before anything else: texts with the first two characters of one go to the library
        self.marks = tuple({x["content"][:2] for x in own["added_tokens"]}) if self.by_words else ()
        self.n_ids = max(chain(self.whole.get_vocab(with_added_tokens=True).values(), [0])) + 1
        self.clear()

    def clear(self) -> None:
        """Forget all words: sorted hashes, and where in the pool each one's ids begin and how many they are."""
        self.keys, self.offset, self.length = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.pool, self.filled = np.empty(1 << 16, np.uint32), 0

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders.clear()  # a worker keeps one
            _encoders[path] = cls(path)
        return _encoders[path]

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Add words whose (sorted) hashes are not known yet."""
        tokenize, letters = self.model.tokenize, _byte_letters()
        got = [[t.id for t in tokenize(w if w.isascii() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))] for w in words]
        length = np.fromiter(map(len, got), np.int32, len(got))
        total = int(length.sum())
        if self.filled + total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.empty(self.filled + total, np.uint32)])
        self.pool[self.filled : self.filled + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.length = np.insert(self.keys, at, keys), np.insert(self.length, at, length)
        self.offset = np.insert(self.offset, at, self.filled + np.cumsum(length, dtype=np.int32) - length)
        self.filled += total

    def _rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        plain = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.by_words or "'" in t or any(m in t for m in self.marks) or len(t) > scan.CHUNK and max(map(len, t.split())) > scan.CHUNK // 4:
                parts[i].append(self._library(t))
            else:
                plain.append(i)
        for group in scan.pieces([texts[i] for i in plain]):
            for (i, piece), ids in zip(group, self._group([t for _, t in group]), strict=True):
                # a piece with an unusual character makes its whole text go to the library
                parts[plain[i]].append(ids)
        return [self._library(texts[i]) if any(x is None for x in p) else np.concatenate(p) if p else np.empty(0, np.uint32) for i, p in enumerate(parts)]

    def _group(self, texts: list[str]) -> list[np.ndarray | None]:
        low = [t.lower() for t in texts]
        text = "\n".join(low)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[codes]
        ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(kind == _UNUSUAL), side="right")).tolist()
        before = np.concatenate(([_SPACE], kind[:-1]))
        begins = (kind != _SPACE) & ((kind != before) | (kind == _NUMBER))
        start = np.flatnonzero(begins)
        if not len(start):
            return [None if i in odd else np.empty(0, np.uint32) for i in range(len(texts))]
        inside = np.flatnonzero(kind != _SPACE)
        first = np.flatnonzero(begins[inside])
        size = np.diff(np.append(first, len(inside)))
        own = codes[inside]
        hashes = scan.word_hashes(scan.code_values()[own], own, first, size)[0]
        distinct, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        at, known = self._rows(distinct)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > CACHE_WORDS:
                self.clear()
                known[:] = False
            new = np.flatnonzero(~known)
            a = start[one[new]]
            self._learn(distinct[new], [text[i:j] for i, j in zip(a.tolist(), (a + size[one[new]]).tolist(), strict=True)])
            at, _ = self._rows(distinct)
        row = at[back]
        length = self.length[row]
        stop = np.cumsum(length, dtype=np.int64)
        ids = self.pool[np.repeat(self.offset[row] - (stop - length), length) + np.arange(stop[-1])]
        word_cut = np.searchsorted(start, ends)
        cut = np.concatenate(([0], np.concatenate(([0], stop))[word_cut]))
        out: list[np.ndarray | None] = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for i in odd:
            out[i] = None
        return out


def repair(ids: np.ndarray, first: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Rules (n, 2) and symbols of a sequence of ids below ``first``: Re-Pair until no pair occurs ``least`` times.

    Each round counts the pairs exactly, without overlap, and makes a nonterminal of every frequent one. Where chosen pairs
    overlap, the more frequent one is replaced; a pair that is left with fewer than ``least`` places waits for a later
    round. The most frequent pair loses no place, so each round makes a rule. Only pairs with a symbol of the round before,
    or that waited, can have become frequent: from the second round on, only these are counted.
    """
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    made, active = first, np.arange(max(0, len(seq) - 1))
    while len(active) >= least:
        left, right = seq[active], seq[active + 1]
        run = np.flatnonzero(left == right)
        passed = active[:0]
        if len(run):  # of the places of a pair of equal symbols in a run of them, every other counts
            at = active[run]
            start = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
            odd = (np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % 2 == 1
            counted = np.ones(len(active), bool)
            counted[run[odd]] = False
            passed = at[odd]
            active, left, right = active[counted], left[counted], right[counted]
        bits, wide = max(1, int(len(seq)).bit_length()), int(made).bit_length()
        if bits + 2 * wide <= 64:
            key = (left.astype(np.uint64) << np.uint64(wide) | right) << np.uint64(bits) | active.astype(np.uint64)
            key.sort()
            pair, place = key >> np.uint64(bits), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
        else:
            pair = left.astype(np.uint64) << np.uint64(32) | right
            order = np.argsort(pair, kind="stable")
            pair, place, wide = pair[order], active[order], 32
        lead = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        count = np.diff(np.append(lead, len(pair)))
        often = count >= least
        if not often.any():
            break
        chosen, count = pair[lead[often]], count[often]
        place = place[np.repeat(often, np.diff(np.append(lead, len(pair))))]
        # ranks from the most frequent (1) on; 0: no chosen pair begins here
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(1, len(order) + 1)
        rank = np.repeat(rank, count)
        at = np.zeros(len(seq) + 1, np.int32)  # the last stands for both ends
        at[place] = rank
        ahead, behind = at[place - 1], at[place + 1]
        won = ((behind == 0) | (rank <= behind)) & ((ahead == 0) | (rank < ahead))
        uses = np.bincount(rank[won], minlength=len(order) + 1)
        good = uses >= least
        won &= good[rank]
        # rules in the order of ranks
        number = np.cumsum(good) - 1 + made
        of_rank = chosen[order][good[1:]]
        rules.append(np.stack([of_rank >> np.uint64(wide), of_rank & np.uint64((1 << wide) - 1)], axis=1).astype(np.uint32))
        here = place[won]
        at[:] = 0
        at[place[~won]] = at[passed] = 1  # these wait, unless one of their symbols goes
        seq[here] = number[rank[won]]
        alive = np.ones(len(seq), bool)
        alive[here + 1] = False
        waits = at[:-1][alive] > 0
        seq = seq[alive]
        fresh = seq >= made
        made += int(good.sum())
        near = waits[:-1] | fresh[:-1] | fresh[1:]
        active = np.flatnonzero(near)
    return (np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)), seq


def expansions(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule stands for."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1))
    return np.array(out, np.int64)


def expand(rules: np.ndarray, symbols: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for, level by level; takes no more memory than the ids do."""
    out = symbols.astype(np.uint32)
    while len(out) and len(open_ := np.flatnonzero(out >= first)):
        pair = rules[out[open_] - first]
        out[open_] = pair[:, 0]
        out = np.insert(out, open_ + 1, pair[:, 1])
    return out


def stored(symbols: np.ndarray) -> bytes:
    """Low 16 bits of all symbols, then a bit plane for each further bit in use."""
    planes = max(0, int(symbols.max(initial=0)).bit_length() - 16)
    return b"".join([symbols.astype("<u2").tobytes(), *(np.packbits((symbols >> np.uint32(16 + p)) & np.uint32(1)).tobytes() for p in range(planes))])


def loaded(data: bytes, n: int, start: int = 0, end: int | None = None) -> np.ndarray:
    """Symbols ``start`` (a multiple of 8) to ``end`` of ``n`` stored ones."""
    end = n if end is None else min(end, n)
    out = np.frombuffer(data, "<u2", max(0, end - start), 2 * start).astype(np.uint32)
    size = -(-n // 8)
    for p in range((len(data) - 2 * n) // size if n else 0):
        plane = np.frombuffer(data, np.uint8, -(-(end - start) // 8), 2 * n + p * size + start // 8)
        out |= np.unpackbits(plane, count=end - start).astype(np.uint32) << np.uint32(16 + p)
    return out


def loaded_rules(data: bytes, n: int) -> np.ndarray:
    """Rules (n, 2) of a shard."""
    return loaded(data, 2 * n).reshape(2, n).T


def decode_range(shard: dict, start: int, end: int) -> np.ndarray:
    """Ids start to end of a shard, expanding only the symbols that cover them."""
    first, rules = shard["first"], loaded_rules(shard["rules"], shard["n_rules"])
    anchors = np.frombuffer(shard["anchors"], "<u8")
    if not len(anchors) or end <= start:
        return np.empty(0, np.uint32)
    low = max(0, int(np.searchsorted(anchors, start, side="right")) - 1)
    high = int(np.searchsorted(anchors, end, side="left"))
    own = loaded(shard["symbols"], shard["n_symbols"], low * ANCHOR, high * ANCHOR)
    lengths = _lengths(own, loaded(shard["expansion"], shard["n_rules"]), first)
    before = int(anchors[low]) + np.cumsum(lengths) - lengths
    inside = (before + lengths > start) & (before < end)
    if not inside.any():
        return np.empty(0, np.uint32)
    offset = start - int(before[inside][0])
    return expand(rules, own[inside], first)[offset : offset + end - start]


def _lengths(symbols: np.ndarray, expansion: np.ndarray, first: int) -> np.ndarray:
    out = np.ones(len(symbols), np.int64)
    own = np.flatnonzero(symbols >= first)
    out[own] = expansion[symbols[own] - first]
    return out


def pack(doc_ids: list[int | None], encoded: list[np.ndarray], first: int) -> dict:
    """A shard of documents whose ids are all below ``first``."""
    ids = np.concatenate(encoded) if encoded else np.empty(0, np.uint32)
    rules, symbols = repair(ids, first)
    expansion = expansions(rules, first)
    lengths = _lengths(symbols, expansion, first)
    before = np.cumsum(lengths) - lengths
    return {
        "n_ids": len(ids),
        "first": first,
        "n_symbols": len(symbols),
        "n_rules": len(rules),
        "rules": stored(rules.T.ravel()),
        "expansion": stored(expansion.astype(np.uint32)),
        "symbols": stored(symbols),
        "anchors": before[::ANCHOR].astype("<u8").tobytes(),
        "ends": np.cumsum([len(x) for x in encoded]).astype("<u8").tobytes(),
        "doc_ids": doc_ids,
    }


SHARD_SCHEMA = "part int, shard int, before long, n_ids long, first int, n_symbols long, n_rules long, rules binary, expansion binary, symbols binary, anchors binary, ends binary, doc_ids array<bigint>"


def write(documents: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, partitions: int | None = None) -> None:
    """Write the shards of ``documents`` in ascending id order below ``path``: part is the range of ids, shard its piece.

    ``tokenizer``: a file of the tokenizers library that every executor can open. Rows that share an id spread over
    parts by a hash of their text.
    """
    spark = documents.sparkSession
    common.prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, shard, before = TaskContext.get().partitionId(), 0, 0
        encoder = Encoder.at(tokenizer)
        first = max(encoder.n_ids, end_id + 1)
        doc_ids, encoded, size = [], [], 0

        def shard_row():
            row = {"part": part, "shard": shard, "before": before} | pack(doc_ids, encoded, first)
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.batch(batch.column(1).to_pylist()), strict=True):
                encoded.append(np.append(ids, np.uint32(end_id)))
                doc_ids.append(doc_id)
                size += len(encoded[-1])
                if size >= shard_ids:
                    yield shard_row()
                    doc_ids, encoded, before, size = [], [], before + size, 0
                    shard += 1
        if doc_ids:
            yield shard_row()

    binary = pa.binary()
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": binary, "array<bigint>": pa.list_(pa.int64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in SHARD_SCHEMA.split(", "))])
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    ordered.mapInArrow(run, SHARD_SCHEMA).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, from the files."""
    common.prepare(spark)
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # one row a part, not a shard: its number of ids, and from that where it begins
    parts = common.saved(shards.groupBy("part").agg(F.sum("n_ids").alias("n")), "parts")
    begins = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begins"))
    begins = F.broadcast(begins) if parts.count() <= BROADCAST_PARTS else begins
    rows = shards.join(begins, "part").select((F.col("begins") + F.col("before")).alias("start"), "first", "n_symbols", "n_rules", "rules", "symbols", "ends", "doc_ids")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                start, first, n, n_rules = (row[c].as_py() for c in ("start", "first", "n_symbols", "n_rules"))
                symbols = loaded(row["symbols"].as_buffer(), n)
                ids = expand(loaded_rules(row["rules"].as_buffer(), n_rules), symbols, first).astype("<u4", copy=False)
                ends = np.frombuffer(row["ends"].as_buffer(), "<u8").astype(np.int64)
                begin = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                columns = [row["doc_ids"].values, pa.array(start + begin), pa.array(ends - begin), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
