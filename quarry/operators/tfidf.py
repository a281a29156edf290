"""Term-weight similarity within groups: smoothed idf, unit-length vectors, cosine to the group's query."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import rules, text
from quarry.sources import shared


def terms(c, stop: Sequence[str] = rules.STOPWORDS):
    """Words of at least two letters or digits that are no stop words, then adjacent pairs of them."""
    w = F.filter(F.regexp_extract_all(F.lower(text.text(c)), F.lit(r"[a-z0-9]{2,}"), F.lit(0)), lambda x: ~x.isin(list(stop)))
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.concat(w, F.filter(pairs, lambda p: p.isNotNull()))


def scores(items: DataFrame, stop: Sequence[str] = rules.STOPWORDS, max_features: int | None = 1000) -> DataFrame:
    """``group_id``, ``item_id``, ``tfidf``: cosine of each item to its group's query.

    ``items`` (group_id, item_id, is_query, text), one query a group. idf = ln((1+n)/(1+df)) + 1 over the group's
    items and query; the ``max_features`` most frequent terms of a group (ties: alphabetical) take part. A group is a
    short list (the results of a query, the sentences of a passage): all is one shuffle by group, and every
    window and aggregate after it keeps that distribution. Tasks are as many as the items need, and are not merged again: an
    item becomes a row for each of its terms.
    """
    every = Window.partitionBy("group_id")
    by_term = Window.partitionBy("group_id", "term")
    dealt = items.select("group_id", "item_id", "is_query", terms("text", stop).alias("terms")).repartition(max(1, -(-items.count() // TASK_ITEMS)), "group_id")
    each = dealt.withColumn("n", F.count("*").over(every)).select("group_id", "item_id", "is_query", "n", F.explode_outer("terms").alias("term"))
    counted = each.groupBy("group_id", "item_id", "is_query", "n", "term").agg(F.count("term").alias("tf"))
    known = counted.withColumns({"df": F.count("*").over(by_term), "total": F.sum("tf").over(by_term)})
    if max_features is not None:
        known = known.withColumn("place", F.dense_rank().over(every.orderBy(F.desc("total"), "term")))
        known = known.withColumn("tf", F.when(F.col("place") <= max_features, F.col("tf")).otherwise(0))
    weighted = known.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    weighted = weighted.withColumn("qw", F.max(F.when(F.col("is_query"), F.col("w"))).over(by_term))
    summed = weighted.groupBy("group_id", "item_id", "is_query").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    summed = summed.withColumn("q_length", F.max(F.when(F.col("is_query"), F.col("length"))).over(every))
    both = F.nullif(F.col("length") * F.col("q_length"), F.lit(0.0))
    return summed.where("not is_query").select("group_id", "item_id", F.coalesce(F.col("dot") / both, F.lit(0.0)).alias("tfidf"))


#: Items that a task of ``scores`` gets, about.
TASK_ITEMS = 2_000

_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_WORD, _END = re.compile("[a-z0-9]{2,}"), re.compile("[.!?]+")


def best_sentences(query: str | None, passage: str | None, top_n: int = 3, stop: frozenset[str] = frozenset(rules.STOPWORDS), max_features: int = 500) -> str:
    """The sentences of a passage nearest to a query by the weights of ``scores``, in text order; the passage if it has none.

    Sentences have more than 20 characters.
    """
    parts = [s for s in (x.strip(_SPACES) for x in _END.split(passage or "")) if len(s) > 20]
    if not parts:
        return passage or ""
    counts, df, total = [], Counter(), Counter()
    for item in [*parts, query or ""]:
        words = [w for w in _WORD.findall(item.lower()) if w not in stop]
        own = Counter(words)
        own.update(map(" ".join, zip(words, words[1:])))
        counts.append(own)
        df.update(own.keys())
        total.update(own)
    if len(total) > max_features:
        known = {t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:max_features]}
        counts = [{t: n for t, n in own.items() if t in known} for own in counts]
    weight = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    asked = {t: n * weight[t] for t, n in counts[-1].items()}
    size = math.sqrt(sum(w * w for w in asked.values()))
    near = []
    for i, own in enumerate(counts[:-1]):
        dot = sum(n * weight[t] * asked[t] for t, n in own.items() if t in asked)
        length = math.sqrt(sum((n * weight[t]) ** 2 for t, n in own.items())) if dot else 0.0
        near.append((-round(dot / (length * size), 9) if length * size else 0.0, i))
    return ". ".join(parts[i] for i in sorted(i for _, i in sorted(near)[:top_n])) + "."


def relevant_sentences(passages: DataFrame, top_n: int = 3, stop: Sequence[str] = rules.STOPWORDS) -> DataFrame:
    """``group_id``, ``extract`` of ``passages`` (group_id, query, text): ``best_sentences`` of each.

    A passage is one row and needs no other, so rows go through in Arrow batches and nothing is shuffled.
    """
    words = frozenset(stop)

    def run(batches):
        for batch in shared.slices(batches):
            found = [best_sentences(q, t, top_n, words) for q, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["group_id", "extract"])

    shared.workers(passages.sparkSession)
    return passages.select(F.col("group_id").cast("long").alias("group_id"), "query", "text").mapInArrow(run, "group_id long, extract string")
