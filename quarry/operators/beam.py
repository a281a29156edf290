"""Beam decoding: candidates from a word-pair model of the passages, scored by ``ranking.answer_score``.

The decoder is what a generator with beams does, with a model small enough to be made from the passages of one question: the
probability of a word after another one, sentences weighed by the words they share with the question. No word pair occurs
twice in a candidate, and a word that occurred already is less likely. A neural generator takes the place of ``candidates``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import ranking
from quarry.sources import shared

WIDTH, RETURNED, MOST_WORDS, PENALTY = 5, 3, 128, 1.2
#: Bytes of passages that a task decodes, about.
TASK_BYTES = 1 << 22
_WORD = re.compile(r"\w+")
#: What the last word of a sentence ends with.
MARKS = (".", "!", "?")
#: Before the first and after the last word of a sentence.
START, END = "", "\n"


class PairModel:
    """Log probabilities of what follows a word, likeliest first, ties in order of words; ``get`` is that of a dictionary.

    A sentence counts once more for each word of the question in it. A decoder comes to few words: what follows one is
    looked up in the text when it is asked for.
    """

    def __init__(self, passages: list[str | None], question: str | None) -> None:
        asked = set(_WORD.findall((question or "").lower()))
        told = [s for p in passages for s in sentences(p)]
        self.text = f" {END} " + "".join(f"{s} {END} " for s in told)
        self.weights = [1 + len(asked.intersection(_WORD.findall(s.lower()))) for s in told] if asked else [1] * len(told)
        self.starts = list(accumulate((len(s) + 3 for s in told), initial=3))[:-1]
        self.found: dict[str, list[tuple[str, float]]] = {}

    def get(self, word: str, default: list[tuple[str, float]] | None = None) -> list[tuple[str, float]] | None:
        known = self.found.get(word)
        if known is None:
            known = self.found[word] = self._followers(word)
        return known or default

    def _followers(self, word: str) -> list[tuple[str, float]]:
        told, starts, weights, own = self.text, self.starts, self.weights, {}
        sought = f" {word or END} "
        size, found = len(sought), told.find(sought)
        while found >= 0:
            end = told.find(" ", found + size)
            if end < 0:
                break
            after = told[found + size : end]
            own[after] = own.get(after, 0) + weights[bisect_right(starts, found + size) - 1]
            found = told.find(sought, found + size - 1)
        if len(own) == 1:
            return [(after, 0.0) for after in own]
        total = sum(own.values())
        return [(after, math.log(n / total)) for after, n in sorted(own.items(), key=lambda x: (-x[1], x[0]))]


def sentences(passage: str | None) -> list[str]:
    """Sentences with single blanks: each ends with a word that ends with a mark, or with the passage."""
    told = " ".join((passage or "").split())
    for mark in MARKS:
        told = told.replace(mark + " ", mark + END)
    return told.split(END) if told else []


def pair_model(passages: list[str | None], question: str | None) -> dict[str, list[tuple[str, float]]]:
    """A ``PairModel`` of all words."""
    model = PairModel(passages, question)
    heads = [START, *dict.fromkeys(w for w in model.text.split(" ") if w not in ("", END))]
    return {w: found for w in heads if (found := model.get(w))}


def decode(model: dict[str, list[tuple[str, float]]] | PairModel, width: int = WIDTH, returned: int = RETURNED, most: int = MOST_WORDS, penalty: float = PENALTY) -> list[str]:
    """The best candidates, by mean log probability; ties in order of their words.

    ``width`` open sequences go on at each step. A sequence is done at a sentence's end or with ``most`` words; decoding
    stops when there are ``width`` done ones or nothing can go on. No sequence has more than ``width`` of the continuations that
    are kept: with a penalty, what follows as many likelier new words is not among them.
    """
    open_: list[tuple[float, tuple[str, ...]]] = [(0.0, ())]
    done: list[tuple[float, tuple[str, ...]]] = []
    enough = max(width, returned)
    while open_ and len(done) < width:
        grown = []
        for score, words in open_:
            last, used, fresh = words[-1] if words else START, set(words), 0
            after = {b for a, b in zip(words, words[1:]) if a == last} if words.count(last) > 1 else ()
            for word, p in model.get(last, []):
                if word == END:
                    done.append(((score + p) / (len(words) + 1), words))
                elif (fresh < enough or penalty < 1) and word not in after:
                    again = word in used
                    grown.append((score + (p * penalty if again else p), (*words, word)))
                    fresh += not again
        done += [(s / len(w), w) for s, w in grown if len(w) >= most]
        open_ = sorted((x for x in grown if len(x[1]) < most), key=lambda x: (-x[0], x[1]))[:width]
    return [" ".join(w) for _, w in sorted(done, key=lambda x: (-round(x[0], 12), x[1]))[:returned]]


def dealt(rows: DataFrame, id_: str, passage: str) -> DataFrame:
    """Rows in as many tasks as the bytes of their passages need, whatever the files and row groups that they come from."""
    total = rows.agg(F.sum(F.octet_length(passage))).first()[0] or 0
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES)), id_)


def candidates(question: Column, passages: Column, width: int = WIDTH, returned: int = RETURNED, most: int = MOST_WORDS) -> Column:
    """Answers to a question from its passages (an array of texts), best first; empty without passages."""

    def run(asked: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([decode(PairModel([] if p is None else list(p), q), width, min(returned, width), most) for q, p in zip(asked, given, strict=True)])

    shared.workers()
    return F.pandas_udf(run, "array<string>").asNondeterministic()(question, passages)


def best_scored(found: Column, context: Column) -> Column:
    """Of candidates the one with the highest score against the context, the first of equals: a struct of ``answer`` and ``score``.

    Without any the answer is null, with the score of none. The context's words are found once for all candidates.
    """
    scored = lambda known: F.transform(found, lambda x, i: F.struct((-ranking.answer_score(x, known=known)).alias("s"), i.alias("i"), x.alias("x")))
    first = F.transform(F.array(ranking.answer_terms(context)), lambda known: F.array_min(scored(known)))[0]
    none = ranking.answer_score(F.lit(""), F.lit(""))
    return F.transform(F.array(first), lambda x: F.struct(x["x"].alias("answer"), F.coalesce(-x["s"], none).alias("score")))[0]


def best(found: Column, context: Column) -> Column:
    """The answer of ``best_scored``; null without any."""
    return best_scored(found, context)["answer"]


def generate(question: Column, passage: Column) -> Column:
    """A generator for ``Models``: the best of the candidates from one passage, or nothing without any."""
    return F.coalesce(best(candidates(question, F.array(passage)), passage), F.lit(""))
