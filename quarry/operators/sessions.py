"""Sessions of conversations, logs of selections, and up and down times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import rules, text


def last_turns(turns: DataFrame, keep: int = 5) -> DataFrame:
    """The last ``keep`` turns of each conversation with ``recency`` 1 for the latest."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= keep)


def state(turns: DataFrame) -> DataFrame:
    """One row a conversation: turns, last question, last answer, intent of the last question."""
    last = lambda role: F.max(F.when(F.col("role") == role, F.struct("turn", "text")))["text"]
    out = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"), last("user").alias("last_question"), last("assistant").alias("last_answer"))
    return out.withColumn("intent", text.intent(F.col("last_question")))


def previous_question(turns: DataFrame) -> DataFrame:
    """Every assistant turn with the user's last text before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    return turns.withColumn("question", asked).where(F.col("role") == "assistant")


def selection_log(rows: DataFrame) -> DataFrame:
    """Log rows: line breaks become blanks, nulls empty, the similarity has four places."""
    texts = ["timestamp", "session_id", "selected_version", "answer_mode", "question", "primary_answer", "alternative_answer"]
    return rows.select(*[text.selection_log_text(F.col(c).cast("string")).alias(c) for c in texts], F.when(F.col("gold_similarity").isNotNull(), F.format_string("%.4f", F.col("gold_similarity").cast("double"))).otherwise("").alias("gold_similarity"))


def downtimes(events: DataFrame, group: list[str], down: Column) -> DataFrame:
    """Intervals from the first down event to the next up event of each group; open ones have no end.

    Gaps and islands: a change starts a new island, islands that are down become intervals. An unknown state is up.
    """
    w = Window.partitionBy(*group).orderBy("ts", "event_id")
    marked = events.withColumn("down", F.coalesce(down, F.lit(False))).withColumn("changed", (F.col("down") != F.lag("down", 1, False).over(w)).cast("int"))
    changes = marked.where("changed = 1").withColumn("until", F.lead("ts").over(w)).where("down")
    seconds = F.floor(F.unix_micros(F.col("until").cast("timestamp")) / 1_000_000) - F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return changes.select(*group, F.col("ts").alias("down_since"), F.col("until").alias("up_at"), seconds.alias("seconds"), text.clock(seconds).alias("duration"))


def downtime_totals(intervals: DataFrame, group: list[str]) -> DataFrame:
    return intervals.groupBy(*group).agg(F.count("*").alias("crashes"), F.coalesce(F.sum("seconds"), F.lit(0)).alias("total_seconds"))


def classify_log(lines: DataFrame, c: str = "line", code: str = "exit_code") -> DataFrame:
    """Flags of known causes in each log line and the meaning of the exit code."""
    meanings = F.create_map(*[F.lit(x) for k, v in rules.EXIT_CODES.items() for x in (k, v)])
    known = F.try_element_at(meanings, F.col(code).cast("int"))
    reason = F.when(F.col(code).isNull(), "exit code unavailable").otherwise(F.coalesce(known, F.lit("unexpected exit")))
    return lines.withColumns({name: text.text(c).rlike(f"(?i){pattern}") for name, pattern in rules.LOG_CAUSES} | {"exit_meaning": reason})


def last_errors(lines: DataFrame, group: list[str], order: str, keep: int = 5, pattern: str = "(?i)error|exception|fatal|panic") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc(order))
    return lines.where(text.text("line").rlike(pattern)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def title_labels(sources: DataFrame, group: list[str], order: str, visible: int = 3) -> DataFrame:
    """Labels "Title (n)" for titles that occur more than once in a group, and whether a source is shown."""
    key = F.lower(F.trim(text.text("title")))
    same = Window.partitionBy(*group, key)
    n = F.count("*").over(same)
    label = F.when(n > 1, F.concat(F.col("title"), F.lit(" ("), F.row_number().over(same.orderBy(order)).cast("string"), F.lit(")"))).otherwise(F.col("title"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return sources.withColumns({"label": label, "visible": place <= visible})
