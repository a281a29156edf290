"""Sessions in keyed state: the counterpart of a server's session table for a stream of turns, listed by the state reader.

Sessions lie in ``BUCKETS`` buckets by hash. A bucket is one key of the stream and holds a map from conversation to session
in RocksDB, so it may be larger than memory; a row that clears all sessions goes to every bucket and empties its map.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.functions import text
from quarry.streaming.event_time import keyed_state

BUCKETS = 64
#: Roles of control rows.
RESET, RESET_ALL = "reset", "reset_all"
_SESSION = "floor long, n_turns long, last_turn long, q_turn long, last_question string, a_turn long, last_answer string, turns array<long>, roles array<string>, texts array<string>, updated_at long"
_CHANGED = "conv_id long, n_turns long, last_turn long, last_question string, last_answer string, updated_at long"


def _updated(session: tuple | None, rows: list[tuple], keep: int, cleared: int) -> tuple:
    """A session after turns (at, turn, role, text) in order of ``at``; those up to a reset are gone, whenever they come."""
    floor, n, last, q_turn, question, a_turn, answer, turns, roles, texts, updated = session or (cleared, 0, None, None, None, None, None, [], [], [], None)
    recent = list(zip(turns, roles, texts, strict=True))
    for at, turn, role, said in rows:
        if role == RESET:
            if at > floor:
                floor, n, last, q_turn, question, a_turn, answer, recent, updated = at, 0, None, None, None, None, None, [], at
            continue
        if at <= max(floor, cleared):
            continue
        n += 1
        last = turn if last is None or turn > last else last
        if role == "user" and (q_turn is None or turn >= q_turn):
            q_turn, question = turn, said
        if role == "assistant" and (a_turn is None or turn >= a_turn):
            a_turn, answer = turn, said
        recent.append((turn, role, said))
        updated = at if updated is None else max(updated, at)
    recent = sorted(recent, key=lambda r: r[0])[-keep:]
    turns, roles, texts = (list(x) for x in zip(*recent, strict=True)) if recent else ([], [], [])
    return floor, n, last, q_turn, question, a_turn, answer, turns, roles, texts, updated


class _Store(StatefulProcessor):
    def __init__(self, keep: int, ttl_ms: int | None):
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getMapState("sessions", "conv_id long", _SESSION, self.ttl_ms)
        self.cleared = handle.getValueState("cleared", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own: dict[int, list[tuple]] = {}
        floor = self.cleared.get()[0] if self.cleared.exists() else -(1 << 63)
        before = floor
        for batch in rows:
            for at, conv, turn, role, said in zip(*(batch[c] for c in ("at", "conv_id", "turn", "role", "text")), strict=True):
                if role == RESET_ALL:
                    floor = max(floor, int(at))
                else:
                    own.setdefault(int(conv), []).append((int(at), None if pd.isna(turn) else int(turn), role, None if pd.isna(said) else said))
        if floor > before:
            self.cleared.update((floor,))
            # sessions that went on after the clearing keep what is newer
            newer = {k[0]: v for k, v in self.sessions.iterator() if v[-1] is not None and v[-1] > floor}
            self.sessions.clear()
            for conv, session in newer.items():
                self.sessions.updateValue((conv,), tuple(session))
        out = []
        for conv, turns in own.items():
            held = self.sessions.getValue((conv,)) if self.sessions.containsKey((conv,)) else None
            session = _updated(held, sorted((t for t in turns if t[1] is not None or t[2] == RESET), key=lambda t: t[0]), self.keep, floor)
            if session[-1] is not None:
                self.sessions.updateValue((conv,), session)
                out.append((conv, session[1], session[2], session[4], session[6], session[-1]))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _CHANGED.split(", ")])


def sessions(turns: DataFrame, keep: int = 10, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The sessions each micro-batch changed (update mode), from turns (conv_id, turn, role, text, at).

    ``at`` orders rows as they happened. Role "reset" clears its session and "reset_all" every session, in each case what
    happened up to it, in whatever order rows come. With ``ttl_ms`` a session is dropped so long after its last update
    (processing time; not for an availableNow trigger, which would wait for it). Rows without a conversation, unless they
    clear all, and turns without a number count for none.
    """
    keyed_state(turns.sparkSession)
    own = F.array(F.pmod(F.xxhash64(F.col("conv_id").cast("long")), F.lit(buckets)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    rows = turns.where("conv_id is not null or role = 'reset_all'").select(F.explode(F.when(F.col("role") == RESET_ALL, every).otherwise(own)).alias("bucket"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.col("at").cast("long").alias("at"))
    return rows.groupBy("bucket").transformWithStateInPandas(_Store(keep, ttl_ms), _CHANGED, "Update", "ProcessingTime" if ttl_ms else "None")


def all_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All sessions a stream holds, read from its checkpoint: a row each, with the last turns and the intent of the last question."""
    found = spark.read.format("statestore").option("stateVarName", "sessions").load(checkpoint)
    value = lambda c: F.col(f"user_map_value.{c}").alias(c)
    history = F.arrays_zip(*[F.col(f"user_map_value.{c}").alias(a) for c, a in (("turns", "turn"), ("roles", "role"), ("texts", "text"))])
    rows = found.where("user_map_value.n_turns > 0").select(F.col("user_map_key.conv_id").alias("conv_id"), *[value(c) for c in ("n_turns", "last_turn", "last_question", "last_answer", "updated_at")], history.alias("history"))
    return rows.withColumn("intent", text.intent(F.col("last_question")))
