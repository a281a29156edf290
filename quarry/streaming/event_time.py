"""Downtimes of events that come out of order, by event time: watermark, timers, and pending events in keyed state.

``stateful.downtimes`` orders events within a micro-batch only. Here an event waits in its key's state until the watermark
has passed it, so no earlier one can still come; then all that wait are gone through in order of time and id. State per key is
what lies between the watermark and the newest event, and one open interval.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quarry.sources import shared

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def keyed_state(spark: SparkSession) -> None:
    """State in RocksDB, which ``transformWithState`` needs: larger than memory, and read by key."""
    shared.workers(spark)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Downtimes(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "is_down boolean, since long")
        self.pending = handle.getListState("pending", "micros long, event_id long, down boolean")
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, rows: list[tuple]) -> None:
        """One timer, for the earliest pending event."""
        first = -(-min(micros for micros, *_ in rows) // 1000)
        set_ = self.timer.get()[0] if self.timer.exists() else None
        if set_ is None or first < set_:
            if set_ is not None:
                self.handle.deleteTimer(set_)
            self.handle.registerTimer(first)
            self.timer.update((first,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(m), int(e), bool(d)) for batch in rows for m, e, d in zip(batch["micros"], batch["event_id"], batch["down"], strict=True)]
        if new:
            self.pending.appendList(new)
            self._wake(new)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.pending.get()]
        due, left = sorted(r for r in rows if r[0] <= until), [r for r in rows if r[0] > until]
        self.timer.clear()
        if left:
            self.pending.put(left)
            self._wake(left)
        else:
            self.pending.clear()
        down, since = self.open.get() if self.open.exists() else (False, 0)
        found = []
        for micros, _, is_down in due:
            if down and not is_down:
                found.append((since, micros))
            if is_down and not down:
                since = micros
            down = is_down
        if down:
            self.open.update((True, since))
        else:
            self.open.clear()
        if found:
            yield pd.DataFrame({"key": key[0], "down_since": [a for a, _ in found], "up_at": [b for _, b in found]})


def downtimes(events: DataFrame, key: str, down: Column, delay: str) -> DataFrame:
    """Closed intervals of each key: ``key``, ``down_since``, ``up_at``, ``seconds`` (append mode).

    Events (``ts``, ``event_id``) may come up to ``delay`` behind the newest one, in any order; later ones are left out and
    counted (``late_rows``). An interval comes once the watermark has passed its end. Events of a null key or time count for none.
    """
    keyed_state(events.sparkSession)
    own = events.select(F.col(key).cast("long").alias("key"), F.coalesce("event_id", F.lit(0)).cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("at"), F.coalesce(down, F.lit(False)).alias("down"))
    own = own.withWatermark("at", delay).where("key is not null and at is not null").withColumn("micros", F.unix_micros("at"))
    found = own.groupBy("key").transformWithStateInPandas(_Downtimes(), "key long, down_since long, up_at long", "Append", "EventTime")
    seconds = F.floor(F.col("up_at") / 1_000_000) - F.floor(F.col("down_since") / 1_000_000)
    return found.select(F.col("key").alias(key), F.timestamp_micros("down_since").alias("down_since"), F.timestamp_micros("up_at").alias("up_at"), seconds.alias("seconds"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, over the micro-batches whose progress Spark still holds."""
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)


def previous_question(questions: DataFrame, answers: DataFrame, within: str, delay: str) -> DataFrame:
    """Two streams of turns (conv_id, turn, at, text): each answer with the last question before it, at most ``within`` old.

    An interval join: both sides wait in state only as long as a partner may still come, and an answer without a question
    comes with a null once it cannot have one any more (append mode). Of several questions the latest turn wins.
    """
    asked = questions.where("text is not null").select(F.col("conv_id").alias("q_conv"), F.col("turn").alias("q_turn"), F.col("at").alias("q_at"), F.col("text").alias("q_text"))
    asked = asked.withWatermark("q_at", delay)
    told = answers.select("conv_id", "turn", "at", "text").withWatermark("at", delay)
    near = f"q_conv = conv_id AND q_turn < turn AND q_at <= at AND q_at >= at - INTERVAL {within}"
    joined = told.join(asked, F.expr(near), "leftOuter")
    last = F.max_by("q_text", "q_turn").alias("question")
    return joined.groupBy("at", "conv_id", "turn", "text").agg(last).select("conv_id", "turn", "at", "question", F.col("text").alias("answer"))
