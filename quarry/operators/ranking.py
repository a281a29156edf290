"""Boosting, re-ranking and fusing of retrieval results."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import rules, text, web
from quarry.operators import vectors


def tier_boost(tier: Column, query: Column | None = None, boosts: dict[int, float] | None = None, tiers_on: bool = True, gold_on: bool = True, policy: Sequence[str] = rules.POLICY_TERMS) -> Column:
    """Gold rows count most, or as general information if gold is off; policy queries lift tier 1 by 30 %."""
    table = boosts or rules.TIER_BOOSTS
    asked = text.any_in(F.lower(text.text(query)), policy) if query is not None else F.lit(False)
    own = F.when((tier == 0) & F.lit(not gold_on), 2).otherwise(tier)
    factor = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() if k for x in (k, v)]), own), F.lit(1.0))
    factor = F.when((own == 1) & asked, factor * 1.3).otherwise(factor)
    return F.when((tier == 0) & F.lit(gold_on), F.lit(table.get(0, 3.0))).otherwise(factor if tiers_on else F.lit(1.0))


def gold_boost(is_gold: Column, known_url: Column, says_answer: Column, is_match: Column, factors: Sequence[float] = (2.5, 1.5, 1.8, 2.0)) -> Column:
    """Product of the factors for gold rows, gold addresses, rows that hold the gold answer, and the matched gold row.

    An empty address is no gold address. A null flag counts as false.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    base = F.when(yes(is_gold), factors[0]).otherwise(1.0) * F.when(yes(known_url), factors[1]).otherwise(1.0) * F.when(yes(says_answer), factors[2]).otherwise(1.0)
    return base * F.when((base > 1) & yes(is_match), factors[3]).otherwise(1.0)


def rank_boosted(found: DataFrame, k: int, score: str = "boosted") -> DataFrame:
    """Rank of each query's rows by boosted score, similarity and row id; the first k."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), F.desc("sim"), "row_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ensure_gold(found: DataFrame, k: int, least: float = 0.3, score: str = "boosted") -> DataFrame:
    """As ``rank_boosted``; a query without a gold row among its k gets its best one above ``least`` at position 2."""
    every = Window.partitionBy("query_id")
    order = every.orderBy(F.desc(score), F.desc("sim"), "row_id")
    gold = F.col("tier") == 0
    ranked = found.withColumn("place", F.row_number().over(order))
    ranked = ranked.withColumn("has_gold", F.max((gold & (F.col("place") <= k)).cast("int")).over(every) == 1)
    best = F.min(F.when(gold & (F.col(score) > least), F.col("place"))).over(every)
    ranked = ranked.withColumn("moved", ~F.col("has_gold") & (F.col("place") == best))
    key = F.when(F.col("moved"), 1.5).otherwise(F.col("place").cast("double"))
    out = ranked.withColumn("rank", F.row_number().over(every.orderBy(key)))
    return out.where(F.col("rank") <= k).withColumnRenamed("place", "original_rank").drop("has_gold")


def metadata_score(query: Column, title: Column, url: Column, tier: Column) -> Column:
    """0.5, 0.15 a tier below 4, 0.1 a shared title word (0.3 at most) and 0.15 for a word in the url; within 0 and 1."""
    words = F.array_distinct(text.split_words(F.lower(text.text(query))))
    shared = F.size(F.array_intersect(words, text.split_words(F.lower(text.text(title)))))
    in_url = F.exists(words, lambda w: F.contains(F.lower(text.text(url)), w))
    raw = F.lit(0.5) + (4 - F.coalesce(tier, F.lit(3))) * 0.15 + F.least(shared * 0.1, F.lit(0.3)) + F.when(in_url, 0.15).otherwise(0.0)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def position_bias(score: Column, position: Column) -> Column:
    return score * (F.lit(0.85) + F.lit(0.15) / (1 + F.log1p(position.cast("double"))))


def fuse(found: DataFrame, k: int, use_cross: bool = True, use_tfidf: bool = True) -> DataFrame:
    """Weighted sum of position-adjusted similarity, metadata, cross score and term score; ranked, first k.

    Needs ``query_id, row_id, sim, position, metadata, cross, tfidf``; only the first 20 positions have a cross
    score, the others count 0.3.
    """
    weights = {"semantic": 0.25, "metadata": 0.15, "cross": 0.45 * use_cross, "tfidf": 0.15 * use_tfidf}
    total = sum(weights.values())
    cross = F.when(F.col("position") < 20, F.col("cross")).otherwise(0.3)
    parts = {"semantic": position_bias(F.col("sim"), F.col("position")), "metadata": F.col("metadata"), "cross": cross, "tfidf": F.col("tfidf")}
    score = sum((parts[n] * (w / total) for n, w in weights.items()), F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("final_score", 9)), "position")
    return found.withColumn("final_score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieval_score(answer: Column, n_sources: Column, n_path: Column, query: Column) -> Column:
    """1 plus 0.1 a source, 0.05 a retrieved row, 0.5 if all content words of the query occur in the answer."""
    tokens = text.content_tokens(query, rules.ANSWER_STOPWORDS)
    whole = (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(F.lower(text.text(answer)), t))
    return F.when(n_sources > 0, 1.0 + 0.1 * n_sources).otherwise(0.0) + F.when(n_path > 0, 0.05 * n_path).otherwise(0.0) + F.when(whole, 0.5).otherwise(0.0)


def best_variant(variants: DataFrame) -> DataFrame:
    """Of each query's variants the one with the best score, the first of equals."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "variant")
    return variants.withColumn("q_place", F.row_number().over(w)).where("q_place = 1").drop("q_place")


def answer_terms(c: Column) -> Column:
    """The distinct words of three letters or more of an answer or a context."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text.text(c)), F.lit(r"(?U)\b\w{3,}\b"), F.lit(0)))


def answer_score(answer: Column, context: Column | None = None, unknown: str = text.UNKNOWN, known: Column | None = None) -> Column:
    """-100 for no answer, -5 below three words, 0.1 a word shared with the context, or with ``known``, its ``answer_terms``."""
    shared = F.size(F.array_intersect(answer_terms(answer), answer_terms(context) if known is None else known)) * 0.1
    short = F.when(F.size(text.split_words(text.text(answer))) < 3, -5.0).otherwise(0.0)
    return F.when(text.strip(text.text(answer)) == unknown, -100.0).otherwise(short + shared)


def program_match(messages: DataFrame, programs: DataFrame) -> DataFrame:
    """Best program of each message by 0.9 cosine + 0.1 shared words; degree-filtered pool first, then all.

    ``messages`` (query_id, vector, tokens, degree), ``programs`` (row_id, vector, tokens, flags). The cosine counts as
    0.5 + 0.5 cos. Each pair of blocks keeps the best program of both pools of a message.
    """
    degrees = list(rules.DEGREE_MARKS)
    wants = messages.select("query_id", "vector", "tokens", F.array(*[F.col("degree")[d].cast("int") for d in degrees]).alias("wants"))
    shows = programs.select("row_id", "vector", "tokens", F.array(*[F.col("flags")[d].cast("int") for d in degrees]).alias("shows"))

    def flags(column):
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(degrees)).astype(bool)

    def best(asked, given, sim):
        sim = np.round(0.5 + 0.5 * sim, 9)
        shared = shared_tokens(asked.column("tokens").combine_chunks(), given.column("tokens").combine_chunks())
        combined = np.round(0.9 * sim + 0.1 * np.minimum(shared, 3) / 3, 9)
        want, show = flags(asked.column("wants")), flags(given.column("shows"))
        allowed = (~want[:, None, :] | show[None, :, :]).all(2) & want.any(1)[:, None]
        rid = given.column("row_id").to_numpy()
        order = np.argsort(rid, kind="stable")  # the first of equals is the smallest id
        out = []
        for pool, score in ((1, np.where(allowed, combined, -np.inf)), (2, combined)):
            at = order[np.argmax(score[:, order], axis=1)]
            each = np.arange(len(at))
            some = np.isfinite(score[each, at])
            i, j = each[some], at[some]
            out.append([asked.column("query_id").to_numpy()[i], np.full(len(i), pool), rid[j], sim[i, j], shared[i, j], combined[i, j]])
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query_id", "pool", "row_id", "sim", "shared", "combined"])

    found = vectors.by_blocks(wants, shows, best, "query_id long, pool int, row_id long, sim double, shared long, combined double", vectors.QUERY_BLOCK, vectors.ROW_BLOCK)
    w = Window.partitionBy("query_id", "pool").orderBy(F.desc("combined"), "row_id")
    first = found.withColumn("q_place", F.row_number().over(w)).where("q_place = 1")
    good = first.where((F.col("sim") >= 0.68) | ((F.col("sim") >= 0.62) & (F.col("shared") >= 1)))
    pool = Window.partitionBy("query_id").orderBy("pool")
    return good.withColumn("q_place", F.row_number().over(pool)).where("q_place = 1").select("query_id", "row_id", "combined")


def shared_tokens(asked: pa.ListArray, given: pa.ListArray) -> np.ndarray:
    """How many distinct tokens each list of ``asked`` shares with each of ``given``."""
    out = np.zeros((len(asked), len(given)), np.int64)
    words = pc.unique(asked.flatten())
    sides = []
    for lists in (asked, given):
        row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        word = pc.fill_null(pc.index_in(lists.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False)
        pairs = np.unique(np.stack([word, row])[:, word >= 0], axis=1)
        sides.append(pairs)
    (wa, ra), (wb, rb) = sides
    start, stop = np.searchsorted(wb, np.arange(len(words))), np.searchsorted(wb, np.arange(len(words)), side="right")
    for w, r in zip(wa.tolist(), ra.tolist(), strict=True):
        out[r, rb[start[w] : stop[w]]] += 1
    return out


def build_program_index(chunks: DataFrame) -> DataFrame:
    """``row_id``, ``title``, ``url``, ``tokens``, ``flags`` of the program pages among chunks: tiers 3 and 4 with a title and an
    address of a program, one row an address (the first chunk's)."""
    w = Window.partitionBy("url").orderBy("chunk_idx")
    wanted = chunks.where(F.col("tier").isin(3, 4) & (text.text("title") != "") & web.is_program_url(F.col("url")))
    first = wanted.withColumn("q_place", F.row_number().over(w)).where("q_place = 1")
    tokens = F.array_distinct(F.concat(web.match_tokens(F.col("title")), web.url_tokens(F.col("url"))))
    return first.select(F.col("chunk_idx").alias("row_id"), "title", "url", tokens.alias("tokens"), web.degree_flags(F.col("title"), F.col("url")).alias("flags"))


def near_title(found: DataFrame, embed, least: float = 0.42) -> DataFrame:
    """Rows of tier 4 stay only if the question is near enough to their title and address; other tiers stay.

    ``found`` (question, title, url, tier); ``embed`` makes a vector column of a text column.
    """
    shown = web.tail_title(F.col("title"), F.col("url"))
    both = found.withColumns({"q_asked": embed(F.col("question")), "q_shown": embed(shown)})
    near = (shown != "") & (vectors.cosine(F.col("q_asked"), F.col("q_shown"), "product") >= least)
    return both.where((F.coalesce("tier", F.lit(2)) != 4) | near).drop("q_asked", "q_shown")
