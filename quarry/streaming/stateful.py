"""Streaming twins of the stateful operators: last turns of a session, intervals of downtime, batch answering.

State is kept per key and bounded: five turns, or one open interval. With ``idle_ms`` it is dropped once its key has been
quiet for so long (processing time), so state does not grow with all keys ever seen. That is for streams that go on: under an
availableNow trigger Spark would run batches for as long as any state may still time out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.sources import shared


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def last_turns(turns: DataFrame, keep: int = 5, idle_ms: int | None = None) -> DataFrame:
    """After each batch, the last ``keep`` turns of every conversation it touched (update mode).

    ``turns`` (conv_id, turn, role, text); a turn with role "reset" clears its session: all turns up to it are gone,
    in whatever order they come.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        floor, kept = -(1 << 63), pd.DataFrame({"turn": [], "role": [], "text": []})
        if state.exists:
            floor, *columns = state.get
            kept = pd.DataFrame(dict(zip(kept.columns, columns, strict=True)))
        for batch in batches:
            resets = batch["turn"][batch["role"] == "reset"]
            floor = max(floor, int(resets.max())) if len(resets) else floor
            kept = pd.concat([kept, batch[["turn", "role", "text"]]]) if len(kept) else batch[["turn", "role", "text"]]
            kept = kept[kept["turn"] > floor].sort_values("turn", kind="stable").tail(keep)
        turn = [int(x) for x in kept["turn"]]
        role, said = ([None if pd.isna(x) else x for x in kept[c]] for c in ("role", "text"))
        state.update((int(floor), turn, role, said))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if turn:
            yield pd.DataFrame({"conv_id": key[0], "turn": turn, "role": role, "text": said, "recency": range(len(turn), 0, -1)})

    shared.workers(turns.sparkSession)
    grouped = turns.select("conv_id", "turn", "role", "text").groupBy("conv_id")
    return grouped.applyInPandasWithState(run, "conv_id long, turn long, role string, text string, recency int", "floor long, turn array<long>, role array<string>, text array<string>", "update", _timeout(idle_ms))


def downtimes(events: DataFrame, key: str, down: Column, idle_ms: int | None = None) -> DataFrame:
    """Closed intervals of each key as they end: ``key``, ``down_since``, ``up_at``, ``seconds`` (append mode).

    State: whether the key is down and since when. The events of a key in a micro-batch are ordered by time and id and gone
    through as arrays: where the state changes, an interval begins or ends. With ``idle_ms`` an interval still open after so
    long a silence is given up.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        was, since = state.get if state.exists else (False, 0)
        rows = pd.concat(list(batches)).sort_values(["micros", "event_id"])
        is_down, micros = rows["down"].to_numpy(bool), rows["micros"].to_numpy(np.int64)
        change = np.flatnonzero(is_down != np.concatenate(([was], is_down[:-1])))
        begun, ended = micros[change[is_down[change]]], micros[change[~is_down[change]]]
        begun = np.concatenate(([since], begun)) if was else begun
        state.update((bool(is_down[-1]), int(begun[-1]) if is_down[-1] else 0))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if len(ended):
            yield pd.DataFrame({"key": k[0], "down_since": begun[: len(ended)], "up_at": ended})

    shared.workers(events.sparkSession)
    own = events.select(F.col(key).cast("long").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.coalesce(down, F.lit(False)).alias("down"))
    found = own.groupBy("key").applyInPandasWithState(run, "key long, down_since long, up_at long", "is_down boolean, since long", "append", _timeout(idle_ms))
    return found.select(F.col("key").alias(key), F.timestamp_micros("down_since").alias("down_since"), F.timestamp_micros("up_at").alias("up_at"), (F.floor(F.col("up_at") / 1_000_000) - F.floor(F.col("down_since") / 1_000_000)).alias("seconds"))


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Start a query that answers each micro-batch of questions and appends the rows to ``sink``."""
    return questions.writeStream.foreachBatch(lambda batch, _: answer(batch).write.mode("append").parquet(sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
