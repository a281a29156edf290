"""Curated questions with nuggets and passages: import, search, statistics, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text


def category(id_: Column) -> Column:
    return F.when(F.contains(id_, F.lit(":")), F.split_part(id_, F.lit(":"), F.lit(1))).otherwise("uncategorized")


def one_record(records: DataFrame, overwrite: bool = False, order: str = "position") -> DataFrame:
    """Of usable records with one id the first in the order of a column, or the last on overwrite; whole, so that a question,
    its nuggets and its passages come from the same record.

    Without that column, and among equal places, the smallest (or largest) record by its fields decides: not by chance.
    """
    own = records.where(F.col("id").isNotNull() & F.col("query").isNotNull())
    # a struct of the row's fields, arrays included, has an order of its own
    whole = F.struct(*[c for c in ([order] if order in records.columns else []) + [c for c in records.columns if c != order]])
    pick = F.max(whole) if overwrite else F.min(whole)
    return own.groupBy(F.col("id").alias("q_id")).agg(pick.alias("q_row")).select(*[F.col("q_row").getField(c).alias(c) for c in records.columns])


def import_records(existing: DataFrame, records: DataFrame, overwrite: bool = False, order: str = "position") -> DataFrame:
    """Questions after an import: known ids stay as they are, unless everything is overwritten; ``one_record`` of each id counts."""
    new = one_record(records, overwrite, order).select("id", "query", "reference_answer", "url", category(F.col("id")).alias("category"))
    return new if overwrite else existing.select(*new.columns).unionByName(new.join(existing, "id", "left_anti"))


def children(records: DataFrame, column: str, name: str) -> DataFrame:
    """1:N table of trimmed, non-empty strings with their position."""
    return records.select(F.col("id").alias("question_id"), F.posexplode(column).alias("pos", name)).withColumn(name, text.strip(F.col(name))).where(F.col(name) != "")


def with_children(questions: DataFrame, nuggets: DataFrame, passages: DataFrame) -> DataFrame:
    """Questions with arrays of nuggets and passages; children are aggregated first, so they don't multiply."""
    lists = [t.groupBy(F.col("question_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(n).alias("v")))), lambda x: x["v"]).alias(f"{n}s")) for t, n in ((nuggets, "nugget"), (passages, "passage"))]
    out = questions
    for t in lists:
        out = out.join(t, "id", "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("nuggets", "passages")})


def search(questions: DataFrame, term: str) -> DataFrame:
    low = term.lower()
    return questions.where(F.contains(F.lower("query"), F.lit(low)) | F.contains(F.lower("reference_answer"), F.lit(low))).orderBy("id")


def by_category(questions: DataFrame, name: str) -> DataFrame:
    return questions.where(F.col("category") == name).orderBy("id")


def in_order(questions: DataFrame) -> DataFrame:
    """All questions by category and id."""
    return questions.orderBy("category", "id")


def embeddings_in_order(embedded: DataFrame) -> DataFrame:
    """``question_id``, ``embedding`` (float32 values) by question."""
    return embedded.select("question_id", F.col("embedding").cast("array<float>").alias("embedding")).orderBy("question_id")


def store_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors after a store: those of the same question are replaced as a whole."""
    return new.unionByName(old.join(new.select("question_id").distinct(), "question_id", "left_anti"))


def import_children(existing: DataFrame, records: DataFrame, known: DataFrame, column: str, name: str, overwrite: bool = False, order: str = "position") -> DataFrame:
    """Nuggets or passages after an import, of the record that ``one_record`` chooses: those of new questions are appended; everything is replaced on overwrite.

    ``known``: the questions before the import (id).
    """
    new = children(one_record(records, overwrite, order), column, name)
    if overwrite:
        return new
    return existing.unionByName(new.join(known.select(F.col("id").alias("question_id")).distinct(), "question_id", "left_anti"))


def by_id(questions: DataFrame, id_) -> DataFrame:
    return questions.where(F.col("id") == id_)


def categories(questions: DataFrame) -> DataFrame:
    return questions.groupBy("category").agg(F.count("*").alias("n")).orderBy("category")


def statistics(questions: DataFrame, nuggets: DataFrame, passages: DataFrame, embedded: DataFrame) -> DataFrame:
    one = lambda t, n: t.agg(F.count("*").alias(n))  # noqa: E731  one row each
    out = one(questions, "questions").crossJoin(one(nuggets, "nuggets")).crossJoin(one(passages, "passages")).crossJoin(one(embedded, "embeddings"))
    return out.withColumn("has_embeddings", F.col("embeddings") > 0)


def documents(questions: DataFrame, default_title: str = "Catalog Information") -> DataFrame:
    """Gold rows as chunks of tier 0: question, answer and key points; the title from the category."""
    points = F.when(F.size("nuggets") > 0, F.concat(F.lit("\n\nKey Points: "), F.array_join("nuggets", "; "))).otherwise("")
    body = F.concat(F.lit("Question: "), text.text("query"), F.lit("\n\nAnswer: "), text.text("reference_answer"), points)
    named = F.concat(F.initcap(F.translate("category", "-_", "  ")), F.lit(" Information"))
    title = F.when(F.col("category").isNull() | (F.col("category") == "uncategorized"), default_title).otherwise(named)
    return questions.select(F.col("id").alias("gold_id"), body.alias("text"), title.alias("title"), "url", F.lit(0).alias("tier"), F.lit(True).alias("is_gold"), F.col("query").alias("original_query"), F.col("passages").alias("gold_passages"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of equal key, column by column where they have a value; with ``change`` new, kept or updated."""
    a, b = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns]), new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    joined = a.join(b, F.col(f"o_{key}") == F.col(f"n_{key}"), "full_outer")
    change = F.when(F.col(f"o_{key}").isNull(), "created").when(F.col(f"n_{key}").isNull(), "kept").otherwise("updated")
    return joined.select(*[F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in old.columns], change.alias("change"))


def changes(upserted: DataFrame) -> DataFrame:
    """One row: how many rows an upsert created, updated and kept."""
    return upserted.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("created", "updated", "kept")])


def merge_generated(chunks: DataFrame, generated: DataFrame, keep_originals: bool = False) -> DataFrame:
    """Question-and-answer chunks of matched originals, and the originals without any (or all).

    ``chunks`` (chunk_idx, text), ``generated`` (original_text, qa_text). Texts match but for white space; of equal
    originals the last one counts.
    """
    key = lambda c: F.sha2(text.clean_space(text.text(c)), 256)
    last = chunks.groupBy(key("text").alias("key")).agg(F.max("chunk_idx").alias("chunk_idx"))
    made = generated.select(key("original_text").alias("key"), "qa_text").join(last, "key")
    qa = made.select("chunk_idx", F.col("qa_text").alias("text"), F.lit(True).alias("is_synthetic_qa"))
    originals = chunks if keep_originals else chunks.withColumn("key", key("text")).join(made.select("key").distinct(), "key", "left_anti")
    return qa.unionByName(originals.select("chunk_idx", "text", F.lit(False).alias("is_synthetic_qa")))
