"""Evaluation: recall, gain, nugget coverage, summaries, latencies and comparisons of runs."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text, web
from quarry.operators import vectors
from quarry.plans.models import Models
from quarry.sources import shared

METRICS = ["nugget_precision", "nugget_recall", "nugget_f1", "sbert_cosine", "sbert_cosine_chunk", "bertscore_f1", "recall@1", "recall@3", "recall@5", "ndcg@1", "ndcg@3", "ndcg@5"]


def recall_at(predicted: Column, wanted: Column, k: int) -> Column:
    """Share of the wanted ids among the first k distinct ones; 0 without wanted ids."""
    top = F.array_distinct(F.slice(predicted, 1, k))
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(top, wanted)) / F.size(F.array_distinct(wanted))).otherwise(0.0)


def gain(relevance: Column) -> Column:
    return F.aggregate(F.transform(relevance, lambda r, i: r.cast("double") / F.log2(i.cast("double") + 2)), F.lit(0.0), lambda a, x: a + x)


def _relevance(predicted: Column, wanted: Column, k: int) -> Column:
    return F.transform(F.slice(predicted, 1, k), lambda p: F.array_contains(wanted, p).cast("int"))


def ndcg_retrieved(predicted: Column, wanted: Column, k: int) -> Column:
    """Gain over that of the same retrieved relevances in the best order; repeated ids count each time."""
    rel = _relevance(predicted, wanted, k)
    best = gain(F.sort_array(rel, asc=False))
    return F.when(best > 0, gain(rel) / best).otherwise(0.0)


def ndcg_standard(predicted: Column, wanted: Column, k: int) -> Column:
    """Gain over that of as many wanted ids as there are, up to k."""
    best = gain(F.array_repeat(F.lit(1), F.least(F.size(F.array_distinct(wanted)), F.lit(k))))
    return F.when(F.size(wanted) > 0, gain(_relevance(predicted, wanted, k)) / best).otherwise(0.0)


def nugget_scores(similarities: DataFrame, questions: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Precision (always 1), recall and F1 of nuggets whose similarity to the answer reaches the threshold.

    ``questions`` (id, n_nuggets, has_answer), ``similarities`` (id, sim) one row a nugget.
    """
    covered = similarities.groupBy("id").agg(F.count_if(F.col("sim") >= threshold).alias("hits"))
    recall = F.when(F.col("n_nuggets") == 0, 1.0).when(~F.col("has_answer"), 0.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("n_nuggets"))
    out = questions.join(covered, "id", "left").select("id", F.lit(1.0).alias("nugget_precision"), recall.alias("nugget_recall"))
    return out.withColumn("nugget_f1", 2 * F.col("nugget_recall") / (1 + F.col("nugget_recall")))


def join_predictions(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every gold question with its prediction, or an empty one."""
    return gold.join(predictions, "id", "left").withColumn("model_answer", F.coalesce("model_answer", F.lit("")))


def summary(per_question: DataFrame, metrics: list[str]) -> DataFrame:
    return per_question.agg(F.count("*").alias("count"), *[F.coalesce(F.avg(f"`{m}`"), F.lit(0.0)).alias(m) for m in metrics])


def best_of_top(similarities: DataFrame, k: int = 3) -> DataFrame:
    return similarities.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("sim"))), F.lit(0.0)).alias("sbert_cosine_chunk"))


def latency_percentiles(measured: DataFrame, c: str, group: list[str]) -> DataFrame:
    """Median, and the values at 1-based positions floor(0.95 n) and floor(0.99 n) of the sorted latencies.

    Values are counted, the distinct ones dealt by ranges and written once with the number of their range. Running counts
    are then kept within a range; where a range begins comes from one small row a group and range. So a group with very many
    distinct values spreads over all ranges.
    """
    counts = measured.where(F.col(c).isNotNull()).groupBy(*group, F.col(c).alias("v")).agg(F.count("*").alias("m"))
    dealt = shared.saved(counts.repartitionByRange(*group, "v").withColumn("part", F.spark_partition_id()), "latencies")
    every = Window.partitionBy(*group)
    parts = dealt.groupBy(*group, "part").agg(F.sum("m").alias("pm"))
    parts = parts.withColumns({"before": F.sum("pm").over(every.orderBy("part")) - F.col("pm"), "n": F.sum("pm").over(every)}).drop("pm")
    inside = F.sum("m").over(Window.partitionBy(*group, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    same = reduce(lambda x, y: x & y, [F.col(f"x.{g}").eqNullSafe(F.col(f"y.{g}")) for g in [*group, "part"]])
    ranked = dealt.withColumn("inside", inside).alias("x").join(parts.alias("y"), same).select("x.*", "y.n", (F.col("before") + F.col("inside")).alias("upto"))
    at = lambda p: F.min(F.when(F.col("upto") >= F.greatest(F.floor(F.col("n") * p), F.lit(1)), F.col("v")))
    low, high = F.min(F.when(F.col("upto") >= F.floor((F.col("n") + 1) / 2), F.col("v"))), F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2) + 1, F.col("v")))
    return ranked.groupBy(*group).agg(F.max("n").alias("n"), ((low + high) / 2).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def evaluate(gold: DataFrame, predictions: DataFrame, models: Models | None = None, threshold: float = 0.7, undefined: float = 0.0) -> DataFrame:
    """``id`` and the twelve ``METRICS`` of every gold question.

    ``gold`` (id, reference_answer, nuggets, gold_passages), ``predictions`` (id, model_answer, retrieved: an array of
    struct(idx, url, text) in rank order). Questions without a prediction count as answered by nothing. Retrieved rows are
    known by the slug of their address, which is what gold passages name; of texts the first three count. ``undefined`` is
    the cosine of a vector of norm 0: 0, or NaN as a plain division gives, which in SQL is above every number.
    """
    own = models or Models()
    told = predictions.select("id", text.strip(text.text("model_answer")).alias("answer"), F.col("retrieved").alias("found"))
    q = gold.select("id", text.strip(text.text("reference_answer")).alias("reference"), F.col("nuggets").alias("points"), F.col("gold_passages").alias("passages")).join(told, "id", "left")
    strings = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    said = F.filter(F.transform(strings(F.col("points")), text.strip), lambda x: x.isNotNull() & (x != ""))
    ids = strings(F.transform("found", lambda x: web.slug(x["url"])))
    top = F.filter(F.transform(F.slice(F.coalesce("found", F.array().cast(predictions.schema["retrieved"].dataType)), 1, 3), lambda x: text.strip(text.text(x["text"]))), lambda x: x != "")
    q = shared.saved(q.select("id", text.text("answer").alias("answer"), "reference", said.alias("points"), strings(F.col("passages")).alias("wanted"), ids.alias("ids"), top.alias("top")), "questions")
    # every text gets its vector once: (id, kind, place) is a row of one table
    texts = F.concat(
        F.array(F.struct(F.lit("answer").alias("kind"), F.col("answer").alias("t")), F.struct(F.lit("reference").alias("kind"), F.col("reference").alias("t"))),
        F.transform("points", lambda x: F.struct(F.lit("point").alias("kind"), x.alias("t"))),
        F.transform("top", lambda x: F.struct(F.lit("chunk").alias("kind"), x.alias("t"))),
    )
    embedded = shared.saved(q.select("id", F.explode(texts).alias("x")).select("id", "x.kind", own.embed(F.col("x.t")).alias("v")).where("v is not null"), "vectors")
    sides = embedded.groupBy("id").agg(*[F.max(F.when(F.col("kind") == k, F.struct("v")))["v"].alias(k) for k in ("answer", "reference")])
    sims = embedded.where("kind in ('point', 'chunk')").join(sides, "id")
    cosine = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.coalesce(vectors.cosine(a, b, "none"), F.lit(undefined)))
    sims = sims.withColumn("sim", cosine(F.col("v"), F.when(F.col("kind") == "point", F.col("answer")).otherwise(F.col("reference"))))
    near = sims.groupBy("id").agg(F.count_if((F.col("kind") == "point") & (F.col("sim") >= threshold)).alias("hits"), F.max(F.when(F.col("kind") == "chunk", F.col("sim"))).alias("chunk"))
    found = q.join(sides, "id", "left").join(near, "id", "left")
    empty = F.col("answer_text") == ""
    out = found.select("id", F.col("hits"), F.col("chunk"), "points", "wanted", "ids", q["answer"].alias("answer_text"), q["reference"].alias("reference_text"), sides["answer"].alias("va"), sides["reference"].alias("vr"))
    recall = F.when(F.size("points") == 0, 1.0).when(empty, 0.0).otherwise(F.coalesce("hits", F.lit(0)) / F.size("points"))
    both = ~empty & (F.col("reference_text") != "")
    scored = out.withColumns({
        "nugget_precision": F.lit(1.0),
        "nugget_recall": recall,
        "nugget_f1": 2 * recall / (1 + recall),
        "sbert_cosine": F.when(both, F.coalesce(cosine(F.col("va"), F.col("vr")), F.lit(0.0))).otherwise(0.0),
        "sbert_cosine_chunk": F.when(F.col("reference_text") != "", F.coalesce("chunk", F.lit(0.0))).otherwise(0.0),
        "bertscore_f1": F.when(both, own.similarity(F.col("reference_text"), F.col("answer_text"))).otherwise(0.0),
    })
    scored = scored.withColumns({f"recall@{k}": recall_at(F.col("ids"), F.col("wanted"), k).cast("double") for k in (1, 3, 5)} | {f"ndcg@{k}": ndcg_retrieved(F.col("ids"), F.col("wanted"), k) for k in (1, 3, 5)})
    return scored.select("id", *[F.col(f"`{m}`") for m in METRICS])


def report(per_question: DataFrame) -> DataFrame:
    """One row as reports are stored: ``per_question`` rows in order of ids, and the ``summary`` of all metrics.

    A report is a document about one gold set, which is small; questions in the millions are better kept as a table.
    """
    rows = F.transform(F.array_sort(F.collect_list(F.struct("id", *[F.col(f"`{m}`") for m in METRICS]))), lambda x: x)
    means = F.create_map(F.lit("count"), F.count("*").cast("double"), *[x for m in METRICS for x in (F.lit(m), F.coalesce(F.avg(f"`{m}`"), F.lit(0.0)))])
    return per_question.agg(rows.alias("per_question"), means.alias("summary"))


def prediction_metrics(predictions: DataFrame, gold: DataFrame, per_question: DataFrame) -> DataFrame:
    """Predictions of known questions with their gold data, category and metrics; a missing metric is 0."""
    own = per_question.select("id", *[F.col(f"`{m}`") for m in METRICS])
    joined = predictions.join(gold.select("id", "query", "reference_answer", "nuggets", "gold_passages", "url"), "id").join(own, "id", "left")
    return joined.withColumns({m: F.coalesce(F.col(f"`{m}`"), F.lit(0.0)) for m in METRICS} | {"category": F.split_part("id", F.lit(":"), F.lit(1))})


def category_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def run_numbers(runs: DataFrame) -> DataFrame:
    """``run_id``, ``number`` from 1 for the oldest, ``date``. Runs are few: one row each."""
    return runs.select("run_id", F.row_number().over(Window.orderBy("run_id")).alias("number"), text.run_date(F.col("run_id")).alias("date"))


def timed(measure, queries: list[str], repeat: int = 1) -> list[tuple[str, float]]:
    """Seconds each query takes, each measured ``repeat`` times: ``measure`` is called with a query on the driver."""
    out = []
    for q in queries:
        for _ in range(repeat):
            began = time.perf_counter()
            measure(q)
            out.append((q, time.perf_counter() - began))
    return out


def compare(a: DataFrame, b: DataFrame, metrics: list[str]) -> DataFrame:
    """Second minus first run, in percent points, of questions both have."""
    left, right = (t.select("id", *[F.col(f"`{m}`").alias(f"{s}_{m}") for m in metrics]) for t, s in ((a, "a"), (b, "b")))
    return left.join(right, "id").select("id", *[((F.col(f"`b_{m}`") - F.col(f"`a_{m}`")) * 100).alias(f"delta_{m}") for m in metrics])


def categories(predictions: DataFrame) -> DataFrame:
    return predictions.select(F.coalesce(F.nullif("category", F.lit("")), F.lit("Uncategorized")).alias("category")).distinct()


def shared_categories(a: DataFrame, b: DataFrame) -> DataFrame:
    return categories(a).intersect(categories(b))


def same_questions(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both runs have the same ids, and how many only one has."""
    x, y = a.select("id").distinct().withColumn("in_a", F.lit(1)), b.select("id").distinct().withColumn("in_b", F.lit(1))
    joined = x.join(y, "id", "full_outer")
    return joined.agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b")).withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def filter_predictions(predictions: DataFrame, category: str | None = None, term: str = "") -> DataFrame:
    out = predictions if category is None else predictions.where(F.col("category") == category)
    low = F.lit(term.lower())
    return out.where(F.contains(F.lower("query"), low) | F.contains(F.lower("model_answer"), low) | F.contains(F.lower("reference_answer"), low)) if term else out
