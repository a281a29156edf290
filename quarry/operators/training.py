"""Training data: triplets, splits and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text


def triplets(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """First positive (same label, not the query itself) and first negative row of each query; from the two smallest ids of
    each label, not from pairs."""
    w = Window.partitionBy("label").orderBy("row_id")
    lows = rows.withColumn("place", F.row_number().over(w)).where("place <= 2").select("label", F.col("row_id").alias("low"))
    positive = queries.join(lows, "label").where("low <> query_id").groupBy("query_id").agg(F.min("low").alias("positive"))
    # the first row of another label is one of the two smallest minima
    two = lows.groupBy("label").agg(F.min("low").alias("negative")).orderBy("negative").limit(2).withColumnRenamed("label", "n_label")
    negative = queries.join(F.broadcast(two), F.col("label") != F.col("n_label")).groupBy("query_id").agg(F.min("negative").alias("negative"))
    return positive.join(negative, "query_id")


def selected_triplets(examples: DataFrame) -> DataFrame:
    """(query, positive, negative) from passages with selection flags; examples that lack either are dropped."""
    zipped = F.arrays_zip(F.col("passages").alias("p"), F.col("selected").alias("s"))
    first = lambda flag: F.try_element_at(F.filter(F.transform(zipped, lambda x: F.when(x["s"] == flag, x["p"])), lambda p: p.isNotNull() & (p != "")), F.lit(1))
    return examples.select("query", first(1).alias("positive"), first(0).alias("negative")).where((text.text("query") != "") & F.col("positive").isNotNull() & F.col("negative").isNotNull())


def answerable(examples: DataFrame) -> DataFrame:
    """Question-answering rows with an answer, as prompt and output."""
    kept = examples.where((F.size("answers") > 0) & (text.text("question") != "") & (text.text("context") != ""))
    return kept.select(text.prompt(F.col("question"), F.col("context")).alias("input"), F.element_at("answers", 1).alias("output"))


def drawn(key: Column, share: float, seed: int) -> Column:
    """Whether a row belongs to a random share of the rows, by the seeded digest of its key: the same rows on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / (1 << 32) < share


def split(rows: DataFrame, validation: Column) -> DataFrame:
    """Deterministic split by an expression on the id, the same on every run and partitioning."""
    return rows.withColumn("part", F.when(validation, "validation").otherwise("train"))


def prompts(rows: DataFrame) -> DataFrame:
    return rows.select(text.prompt(F.col("question"), F.col("context")).alias("input"), "output", "question")


def retrieval_set(gold: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, corpus and relevance pairs of an evaluation set; the reference answers are the corpus."""
    queries = gold.select("id", "query")
    corpus = gold.select(F.concat(F.lit("doc:"), "id").alias("doc_id"), F.col("reference_answer").alias("text")).where(text.text("text") != "")
    return queries, corpus, gold.select("id", F.concat(F.lit("doc:"), "id").alias("doc_id"))
