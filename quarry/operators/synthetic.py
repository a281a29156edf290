"""Questions made for chunks: which chunks are asked about, clean and distinct questions, and chunks made of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text

LEAST_CHARS = 50


def wanted(tier: Column, url: Column, tiers: Sequence[int] | None = None, programs: Sequence[str] = ()) -> Column:
    """Whether a chunk is of one of the tiers (None: of any), or its address names one of the programs."""
    by_tier = F.lit(True) if tiers is None else F.coalesce(tier, F.lit(2)).isin(list(tiers))
    return by_tier | text.any_in(text.text(url), list(programs))


def long_enough(c: Column, least: int = LEAST_CHARS) -> Column:
    return F.length(text.strip(text.text(c))) >= least


def questions(chunks: DataFrame, ask: Callable[[Column, Column], Column], n: int = 3, tiers: Sequence[int] | None = None, programs: Sequence[str] = ()) -> DataFrame:
    """``chunk_idx``, ``place``, ``question``: clean questions of the chunks that are wanted and long enough.

    ``chunks`` (chunk_idx, text, title, url, tier); ``ask`` (text, title) -> array of raw questions. A question counts
    once in the whole corpus, for the first chunk and place that has it; of a chunk the first ``n`` of its own stay.
    """
    asked = chunks.where(wanted(F.col("tier"), F.col("url"), tiers, programs) & long_enough(F.col("text")))
    raw = asked.select("chunk_idx", F.posexplode(ask(F.col("text"), F.col("title"))).alias("place", "raw")).select("chunk_idx", "place", text.clean_question(F.col("raw")).alias("question")).where("question is not null")
    key = F.lower(text.strip(F.col("question")))
    own = raw.withColumn("q_key", key).withColumn("q_first", F.row_number().over(Window.partitionBy("chunk_idx", "q_key").orderBy("place"))).where("q_first = 1")
    own = own.withColumn("q_n", F.row_number().over(Window.partitionBy("chunk_idx").orderBy("place"))).where(F.col("q_n") <= n)
    first = Window.partitionBy("q_key").orderBy("chunk_idx", "place")
    return own.withColumn("q_first", F.row_number().over(first)).where("q_first = 1").select("chunk_idx", "place", "question")


def qa_chunks(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Records of generated chunks: ``original_chunk_index``, ``tier``, ``questions``, ``num_questions``, ``original_text``, ``title``,
    ``full_qa_chunk``; of equal chunks (but for case) the first stays."""
    lists = asked.groupBy("chunk_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "question"))), lambda x: x["question"]).alias("questions"))
    made = chunks.join(lists, "chunk_idx").withColumn("full_qa_chunk", text.qa_chunk(F.col("text"), F.col("questions")))
    same = Window.partitionBy(F.sha2(text.strip(F.lower("full_qa_chunk")), 256)).orderBy("chunk_idx")
    first = made.withColumn("q_first", F.row_number().over(same)).where("q_first = 1")
    return first.select(F.col("chunk_idx").alias("original_chunk_index"), F.coalesce("tier", F.lit(2)).alias("tier"), "questions", F.size("questions").alias("num_questions"), F.col("text").alias("original_text"), "title", "full_qa_chunk")


def statistics(chunks: DataFrame, made: DataFrame, tiers: Sequence[int] | None = None, programs: Sequence[str] = ()) -> DataFrame:
    """One row: chunks, those left out by tier and program, those too short, chunks made, questions in all and on average."""
    in_ = wanted(F.col("tier"), F.col("url"), tiers, programs)
    counts = chunks.agg(F.count("*").alias("chunks"), F.count_if(~in_).alias("filtered"), F.count_if(in_ & ~long_enough(F.col("text"))).alias("too_short"))
    sums = made.agg(F.count("*").alias("made"), F.coalesce(F.sum("num_questions"), F.lit(0)).alias("questions"))
    return counts.crossJoin(F.broadcast(sums)).withColumn("average", F.when(F.col("made") > 0, F.col("questions") / F.col("made")).otherwise(0.0))  # one row each
