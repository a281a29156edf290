"""Vectorised scanning of whole texts: words, their 64-bit hashes and character n-grams, many texts at once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import xxhash

U = np.uint64
#: Characters handled at once. Longer texts are cut at white space, so memory does not depend on text length.
CHUNK = 1 << 18
#: Longer words are hashed whole by xxhash: a sum over powers of one number is for short words only.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@cache
def powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(LONG_WORD, 0x9E3779B97F4A7C15, U), dtype=U)


def word_hashes(values: np.ndarray, raw: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the terms it is the sum of.

    ``values`` are those of all characters inside words and ``raw`` the characters; word i begins at ``first[i]`` there.
    """
    pos = (np.arange(len(values), dtype=np.int32) - np.repeat(first.astype(np.int32), length)) % LONG_WORD
    with np.errstate(over="ignore"):
        terms = values * powers()[pos]
        out = mix(np.add.reduceat(terms, first)) if len(first) else np.empty(0, U)
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[first[i] : first[i] + length[i]].tobytes(), seed=len(raw.dtype.str))
    return out, terms


@cache
def code_values() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(0x110000, dtype=U) + U(0x51ED27))


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@cache
def letters_and_digits() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


_BREAK = re.compile(r"\s")


def pieces(texts: list[str | None], limit: int = CHUNK) -> Iterator[list[tuple[int, str]]]:
    """Groups of (index, piece) of at most about ``limit`` characters; a longer text is cut at white space."""
    out, size = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        at = 0
        while at < len(t):
            end = len(t)
            if end - at > limit:
                end = at + limit
                cut = max(t.rfind(" ", at + limit // 2, end), t.rfind("\n", at + limit // 2, end))
                if cut < 0:  # a run of letters without a break is never cut: it is one word
                    found = _BREAK.search(t, end)
                    cut = found.start() if found else len(t) - 1
                end = cut + 1
            if size and size + end - at > limit:
                yield out
                out, size = [], 0
            out.append((i, t[at:end]))
            size += end - at
            at = end
    if out:
        yield out


class Words:
    """Runs of letters, or of letters and digits, of lower-cased texts.

    ``hash``: of each word; ``doc``: index of its text; ``start``/``length``: its place in ``codes``.
    """

    def __init__(self, group: list[tuple[int, str]], digits: bool = False):
        low = [t.lower() for _, t in group]
        self.codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, low), np.int64, len(low)) + 1
        inside = (letters_and_digits() if digits else letters())[self.codes]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.start = np.flatnonzero(edge == 1)
        self.length = np.flatnonzero(edge == -1) - self.start
        text = np.searchsorted(np.cumsum(sizes), self.start, side="right")
        self.doc = np.fromiter((i for i, _ in group), np.int64, len(group))[text]
        self.first = np.concatenate(([0], np.cumsum(self.length)[:-1])) if len(self.length) else self.length
        own = self.codes[inside]
        self.hash, self.terms = word_hashes(code_values()[own], own, self.first, self.length)

    def prefix_hash(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``n`` letters of the words longer than that, and which words these are."""
        if not len(self.first):
            return np.empty(0, U), np.empty(0, np.int64)
        which = np.flatnonzero(self.length > n)
        with np.errstate(over="ignore"):
            total = np.full(len(which), n, U)
            for j in range(n):
                total += self.terms[self.first[which] + j]
        return mix(total), which


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def space_words(data: bytes, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each run of bytes other than blank and 0x09 to 0x0D; ``fold`` lower-cases A to Z."""
    raw = np.frombuffer(data, np.uint8)
    raw = _LOWER[raw] if fold else raw
    inside = ~_SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, U), start, end
    length = end - start
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    own = raw[inside]
    return word_hashes(code_values()[own], own, first, length)[0], start, end


def space_pieces(data: bytes, limit: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(offset, piece) of a text of any length, cut at white space."""
    at = 0
    while at < len(data):
        end = min(len(data), at + limit)
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield at, data[at:end] if end - at < len(data) else data
        at = end
