"""Pluggable scorers. The defaults are deterministic lexical stand-ins for neural models and are labelled as such.

They keep the dataflow of embedding, cross-scoring, generating and rewriting; they do not reproduce a neural model's numbers.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.sources import shared

DIMENSION = 64
#: Texts that are taken apart at once.
TEXTS = 1024
#: All bytes but a to z become blanks.
_LETTERS = bytes(i if chr(i) in string.ascii_lowercase else 32 for i in range(256))


def vectors_of(texts: list[str | None], dimension: int = DIMENSION) -> np.ndarray:
    """A unit vector a text, zero where it has no words. Sums before the division are whole numbers, so their order does not matter."""
    words = [(t or "").lower().encode().translate(_LETTERS).split() for t in texts]
    hashes = np.fromiter(map(zlib.crc32, chain.from_iterable(words)), np.uint32)
    row = np.repeat(np.arange(len(words)), [len(own) for own in words])
    sums = np.bincount(row * dimension + hashes % dimension, np.where(hashes >> 31, 1.0, -1.0), len(words) * dimension).reshape(-1, dimension)
    size = np.sqrt((sums * sums).sum(1))
    return sums / np.where(size > 0, size, 1.0)[:, None]


def hashed_vector(c: Column, dimension: int = DIMENSION) -> Column:
    """Stand-in for a sentence embedding: unit vector of hashed words, each counted by sign of another bit.

    An Arrow-batched function, as an embedding model would be; marked so that plans neither repeat nor merge it.
    """

    def encode(texts: pa.Array) -> pa.Array:
        parts = [vectors_of(texts.slice(i, TEXTS).to_pylist(), dimension).ravel() for i in range(0, len(texts), TEXTS)]
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * dimension, np.concatenate([np.empty(0), *parts]))

    shared.workers()
    return F.arrow_udf(encode, "array<double>").asNondeterministic()(text.text(c))


def overlap_score(query: Column, passage: Column, most: int = 512) -> Column:
    """Stand-in for a cross-encoder: share of the query's content words in the passage's first 512 characters."""
    q = text.content_tokens(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, text.content_tokens(F.substring(passage, 1, most)))) / F.size(q)).otherwise(0.0)


def first_sentences(context: Column, n: int = 2) -> Column:
    """Stand-in for a generator: the first sentences of the best passage."""
    return F.array_join(F.slice(text.sentences(text.clean_space(text.text(context))), 1, n), " ")


def token_f1(reference: Column, answer: Column) -> Column:
    """Stand-in for a contextual-embedding F1: harmonic mean of shares of common words; 0 for an empty side."""
    a, b = F.array_distinct(text.alpha_words(reference)), F.array_distinct(text.alpha_words(answer))
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * both / (F.size(a) + F.size(b))).otherwise(0.0)


def letter_vector(c: Column) -> Column:
    """A vector anyone can check: how often each of the 26 letters occurs."""
    low = F.lower(text.text(c))
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("double") for x in "abcdefghijklmnopqrstuvwxyz"])


def asked_of_title(passage: Column, title: Column) -> Column:
    """Stand-in for a generator of questions: one on the last part of the title, one on the first words of the passage."""
    last = F.element_at(F.split(text.text(title), " - "), -1)
    words = F.array_join(F.slice(text.split_words(text.text(passage)), 1, 8), " ")
    return F.array(F.concat(F.lit("What does the catalog say about "), last, F.lit("?")), F.concat(F.lit("Where does it say "), words, F.lit("?")))


@dataclass(frozen=True)
class Models:
    """What a neural model would do, as column functions; every field can be replaced.

    ``candidates``: rewrites of a question, given it and its prompt; none by default, as no model is at hand. ``imagine``: a
    passage that would answer a question, to search by.
    """

    embed: Callable[[Column], Column] = hashed_vector
    cross: Callable[[Column, Column], Column] = overlap_score
    generate: Callable[[Column, Column], Column] = lambda question, passage: first_sentences(passage)
    rewrite: Callable[[Column], Column] = text.transform_query
    candidates: Callable[[Column, Column], Column] | None = None
    imagine: Callable[[Column], Column] = lambda question: F.concat(F.lit("The catalog describes "), text.text(question))
    similarity: Callable[[Column, Column], Column] = token_f1
    ask: Callable[[Column, Column], Column] = asked_of_title
