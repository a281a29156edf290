"""Conversation structure repair: the cheapest edits that turn a conversation into ``(system? (user assistant)+)?``.

A conversation's rows stand by turn (nulls first, then by role and text). A row's first fault counts: blank (no character
but white space), duplicate (role and text seen earlier), truncated (does not end with . ! or ?). Edits: K keeps a row (0),
R makes it a user's or an assistant's (1), D deletes it (2; blank and duplicate rows must go), I inserts an empty row of
either anywhere (5); a truncated row that stays costs 5 more. Of equally cheap edits the ASCII-least string of initials wins.

1. Equal rows are counted before anything is shuffled by conversation: what follows the first of them is deleted.
2. Rows are dealt by ranges of (conversation, turn, role, beginning of the text) and cut into chunks of at most
   ``CHUNK_ROWS`` rows, so a conversation of any length spreads over tasks.
3. Tensor DP. Chunks are bucketed by length; arrays are time-major, and a step updates the costs of all chunks of a bucket
   from the states nothing, system, user, assistant at once, backwards, and keeps them. Edits are traced forwards the same way.
4. A conversation in one chunk is done with that. Of longer ones each chunk is a 4 x 4 matrix of costs; a pass over these
   (not over rows) from the last to the first gives each chunk the costs beyond it, the chunk then tells for each state it may
   begin in where it ends, and a pass from the first to the last tells which state it is. Digests run over the chunks in order.

Defined results: null roles and texts are one space; a null conversation is one of its own; rows of one turn order by role
and text; a role counts by its first character, any but s, u and a fits nowhere unless it is made to; a conversation without
rows has zeros, no edits and the digest of nothing; repeated rows are duplicates; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

CHUNK_ROWS = 512
#: Characters of a chunk beyond which it is closed (one row may be longer), and of the chunks traced at once.
CHUNK_CHARS, STEP_CHARS = 1 << 20, 1 << 22
STEP_CHUNKS = 4096
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
NONE, BLANK, DUPLICATE, CUT, PAD = 0, 1, 2, 3, 9
_FAR = 1 << 40
#: States: nothing, system, user, assistant. What an inserted or changed row leads to, and by which role.
_NEXT = np.array([2, 2, 3, 2])
_ROLE = {2: "user", 3: "assistant"}
_SPACES = " \t\n\x0b\x0c\r"
#: Edits still needed where a conversation ends in each state.
_TAIL = {0: [], 1: ["user", "assistant"], 2: ["assistant"], 3: []}


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage that crc32 of ``conv_id:turn`` decides; ``copies`` is 0 for a dropped and 2 for a repeated row."""
    string = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), string("role").alias("role"), string("text").alias("text"), F.pmod(F.crc32(F.concat_ws(":", string("conv_id"), string("turn")).cast("binary")), F.lit(20)).alias("h"))
    h = F.col("h")
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"))


def _faulty(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number, and each row's first fault; a conversation without rows keeps one of 0 copies."""
    live = F.col("copies") > 0
    rows = rows.select("conv_id", F.when(live, F.col("turn")).alias("turn"), *[F.when(live, F.coalesce(F.col(c), F.lit(" "))).otherwise("").alias(c) for c in ("role", "text")], "copies")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    # texts are known again by 128 bits; only those of several turns are looked up
    rows = common.saved(rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary")))), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    seen = rows.where(live).groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("g"), F.col("first.turn").alias("first"))
    joined = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("g")), "left")
    end = F.expr("trim(TRAILING ' \\t\\n\\u000B\\f\\r' FROM text)")
    again = F.col("g").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    fault = F.when(end == "", BLANK).when(again, DUPLICATE).when(~F.substring(end, -1, 1).isin(".", "!", "?"), CUT).otherwise(NONE)
    return joined.select("conv_id", "turn", "role", "text", "copies", fault.cast("int").alias("fault"))


def _initials(roles: list[str]) -> np.ndarray:
    """State that a kept row leads to: 1, 2 or 3, or 0 if there is none."""
    return np.fromiter(({"s": 1, "u": 2, "a": 3}.get(r[:1], 0) for r in roles), np.int8, len(roles))


def step(after: np.ndarray, role: np.ndarray, fault: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Costs from each state (last axis) before a row, of all chunks (first axis), given those after it."""
    wide = (slice(None),) + (None,) * (after.ndim - 2)
    role, fault, more = role[wide], fault[wide], more[wide]
    stays = (fault == NONE) | (fault == CUT)
    extra = np.where(stays, TRUNCATED * (fault == CUT), _FAR)
    cost = after + DELETE
    for state in range(4):
        changed = after[..., _NEXT[state]] + REROLE + extra
        fits = (role == 1) & (state == 0) | (role == 2) & (state != 2) | (role == 3) & (state == 2)
        kept = np.where(role == 1, after[..., 1], after[..., _NEXT[state]]) + np.where(fits, extra, _FAR)
        cost[..., state] = np.minimum(cost[..., state], np.minimum(changed, kept))
    cost = inserted(cost) + (DELETE * more)[..., None]
    return np.where((fault == PAD)[..., None], after, np.minimum(cost, _FAR))


def inserted(cost: np.ndarray) -> np.ndarray:
    """Costs from each state when rows may be inserted first."""
    user, assistant = np.minimum(cost[..., 2], cost[..., 3] + INSERT), np.minimum(cost[..., 3], cost[..., 2] + INSERT)
    return np.stack([np.minimum(cost[..., 0], user + INSERT), np.minimum(cost[..., 1], user + INSERT), user, assistant], axis=-1)


#: Costs from each state where a conversation ends.
END = inserted(np.array([0, _FAR, _FAR, 0], np.int64))


def backward(role: np.ndarray, fault: np.ndarray, more: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs before every row of chunks of one length (time-major), and at last the given ones after them."""
    costs = [end]
    for t in range(len(role) - 1, -1, -1):
        costs.append(step(costs[-1], role[t], fault[t], more[t]))
    return np.stack(costs[::-1])


def matrices(role: np.ndarray, fault: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Cost of each chunk from state to state: (chunks, from, to)."""
    one = np.where(np.eye(4, dtype=bool), 0, _FAR).astype(np.int64)
    cost = np.broadcast_to(one, (role.shape[1], 4, 4)).copy()
    for t in range(len(role) - 1, -1, -1):
        cost = step(cost, role[t], fault[t], more[t])
    return cost.transpose(0, 2, 1)


def trace(costs: np.ndarray, role: np.ndarray, fault: np.ndarray, more: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inserts before each row, each row's edit (a letter's code, 0 where padded), states after each row, and those at the end."""
    steps, n = role.shape
    each, state = np.arange(n), start.copy()
    inserts, edits, states = np.zeros((steps, n), np.int8), np.zeros((steps, n), np.uint8), np.zeros((steps, n), np.int8)
    for t in range(steps):
        now, after = costs[t], costs[t + 1]
        pad = fault[t] == PAD
        while True:
            cost = now[each, state]
            delete = after[each, state] + DELETE + DELETE * more[t] == cost
            insert = ~pad & ~delete & (now[each, _NEXT[state]] + INSERT == cost)
            if not insert.any():
                break
            inserts[t] += insert
            state = np.where(insert, _NEXT[state], state)
        fits = (role[t] == 1) & (state == 0) | (role[t] == 2) & (state != 2) | (role[t] == 3) & (state == 2)
        into = np.where(fits & (role[t] == 1), 1, _NEXT[state])
        extra = np.where(fault[t] == CUT, TRUNCATED, 0) + DELETE * more[t]
        keep = ~delete & fits & (after[each, into] + extra == cost)
        into = np.where(keep | ~fits, into, _NEXT[state])
        state = np.where(pad | delete, state, into)
        edits[t] = np.where(pad, 0, np.where(delete, ord("D"), np.where(keep, ord("K"), ord("R"))))
        states[t] = state
    return inserts, edits, states, state


def _buckets(chunks: list[dict]):
    """Indexes of chunks of similar length with their padded, time-major arrays."""
    by = defaultdict(list)
    for i, c in enumerate(chunks):
        by[max(1, 1 << (len(c["role"]) - 1).bit_length()) if c["role"] else 0].append(i)
    for size, own in by.items():
        role, fault, more = np.zeros((size, len(own)), np.int8), np.full((size, len(own)), PAD, np.int8), np.zeros((size, len(own)), np.int64)
        for j, i in enumerate(own):
            n = len(chunks[i]["role"])
            role[:n, j], fault[:n, j], more[:n, j] = _initials(chunks[i]["role"]), chunks[i]["fault"], np.array(chunks[i]["copies"], np.int64) - 1
        yield np.array(own), role, fault, more


_CHUNK = "seq long, turn array<long>, role array<string>, text array<string>, copies array<long>, fault array<int>, cost array<long>"


def _cut(most: int):
    """Sorted rows as chunks, numbered in order over all tasks."""

    def run(batches):
        part, held, chars = TaskContext.get().partitionId() << 32, [], 0
        seq = part

        def out():
            flat = {c["seq"]: m for own, *arrays in _buckets(held) for c, m in zip([held[i] for i in own], matrices(*arrays), strict=True)}
            for c in held:
                c["cost"] = flat[c["seq"]].ravel().tolist()
            return pa.RecordBatch.from_pylist(held, schema)

        schema = None
        for batch in batches:
            if schema is None:
                kinds = {"seq": pa.int64(), "turn": pa.list_(pa.int64()), "role": pa.list_(pa.string()), "text": pa.list_(pa.string()), "copies": pa.list_(pa.int64()), "fault": pa.list_(pa.int32()), "cost": pa.list_(pa.int64())}
                schema = pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), *kinds.items()])
            for conv, turn, role, text, copies, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = held[-1] if held else None
                if last is None or last["conv_id"] != conv or len(last["role"]) >= most or last["chars"] >= CHUNK_CHARS:
                    if len(held) >= STEP_CHUNKS or chars >= STEP_CHARS:
                        yield out()
                        held.clear()
                        chars = 0
                    last = {"conv_id": conv, "seq": seq, "turn": [], "role": [], "text": [], "copies": [], "fault": [], "chars": 0}
                    held.append(last)
                    seq += 1
                if copies:
                    for k, v in (("turn", turn), ("role", role), ("text", text), ("copies", copies), ("fault", fault)):
                        last[k].append(v)
                    last["chars"] += len(text)
                    chars += len(text)
        if held:
            yield out()

    return run


def _beyond(batches):
    """Of chunk matrices, each conversation's from the last to the first: costs beyond each chunk of those with several."""
    conv, end, before, yet = None, END, None, False
    for batch in batches:
        rows = []
        for own, seq, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if before is None or own != conv:
                conv, end, before, yet = own, END, (own, seq, END.tolist()), False
            else:
                if not yet:
                    rows.append(before)
                    yet = True
                rows.append((own, seq, end.tolist()))
            end = np.minimum((np.array(cost, np.int64).reshape(4, 4) + end).min(1), _FAR)
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (batch.column(0).type, pa.int64(), pa.list_(pa.int64())), strict=True)], ["conv_id", "seq", "beyond"])


def _ends(batches):
    """Of each chunk of a long conversation, the state it ends in for every state it may begin in."""
    for batch in batches:
        chunks = batch.to_pylist()
        out = np.zeros((len(chunks), 4), np.int64)
        for own, *arrays in _buckets(chunks):
            costs = backward(*arrays, np.array([chunks[i]["beyond"] for i in own], np.int64))
            for s in range(4):
                out[own, s] = trace(costs, *arrays, np.full(len(own), s))[3]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seq"), pa.array(out.tolist(), pa.list_(pa.int64()))], ["conv_id", "seq", "ends"])


def _starts(batches):
    """Of the states each chunk may end in, in order: the one it begins in."""
    conv, state, known = None, 0, False
    for batch in batches:
        out = []
        for own, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if not known or own != conv:
                conv, state, known = own, 0, True
            out.append(state)
            state = ends[state]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.int64())], ["seq", "start"])


_PIECE = "seq long, low long, high long, turns long, first_turn long, last_turn long, first string, last string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, end int, role array<string>, text array<string>"
_LEGAL = {"su", "ua", "au"}


def _repaired(batches):
    """Each chunk's counts, edits and repaired rows; ``beyond`` and ``start`` are null where a chunk is a whole conversation."""
    for batch in batches:
        chunks = batch.to_pylist()
        for own, role, fault, more in _buckets(chunks):
            end = np.array([chunks[i]["beyond"] or END.tolist() for i in own], np.int64)
            costs = backward(role, fault, more, end)
            start = np.array([chunks[i]["start"] or 0 for i in own])
            inserts, edits, states, last = trace(costs, role, fault, more, start)
            for j, i in enumerate(own):
                chunks[i]["state"] = int(last[j])
                chunks[i]["edits"] = list(zip(inserts[:, j].tolist(), edits[:, j].tolist(), states[:, j].tolist(), strict=True))
        rows = [_piece(c) for c in chunks]
        schema = pa.schema([batch.schema.field("conv_id"), *((k, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[v]) for k, v in (x.split() for x in _PIECE.split(", ")))])
        yield pa.RecordBatch.from_pylist(rows, schema)


def _piece(c: dict) -> dict:
    roles, texts, audit, cost, state = [], [], [], 0, c["start"] or 0
    counts, illegal, before = {BLANK: 0, DUPLICATE: 0, CUT: 0}, 0, None
    for role, text, copies, fault, (inserts, edit, after) in zip(c["role"], c["text"], c["copies"], c["fault"], c["edits"]):
        for _ in range(inserts):
            state = int(_NEXT[state])
            roles.append(_ROLE[state])
            texts.append("")
        audit.append("I" * inserts + chr(edit) + "D" * (copies - 1))
        cost += INSERT * inserts + DELETE * (copies - 1) + {"D": DELETE, "K": 0, "R": REROLE}[chr(edit)]
        if edit != ord("D"):
            cost += TRUNCATED * (fault == CUT)
            roles.append(role if edit == ord("K") else _ROLE[after])
            texts.append(text)
        state = after
        if fault:
            counts[fault] += 1
        counts[BLANK if fault == BLANK else DUPLICATE] += copies - 1
        initial = role[:1]
        illegal += copies - 1 + (before is not None and before + initial not in _LEGAL)
        before = initial
    turns = [t for t in c["turn"] if t is not None]
    distinct = len(set(turns))
    return {
        "conv_id": c["conv_id"], "seq": c["seq"], "low": min(turns, default=None), "high": max(turns, default=None), "turns": distinct,
        "first_turn": c["turn"][0] if c["turn"] else None, "last_turn": c["turn"][-1] if c["turn"] else None, "first": c["role"][0][:1] if c["role"] else None, "last": before,
        "blank": counts[BLANK], "duplicate": counts[DUPLICATE], "truncated": counts[CUT], "illegal": illegal, "cost": cost, "audit": "".join(audit), "end": c["state"], "role": roles, "text": texts,
    }


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _folded(batches):
    """Pieces in order as one row a conversation; holds one conversation's counts and edits, never its texts."""
    now = None

    def done():
        tail = _TAIL[now["end"]]
        for r in tail:
            _digest(now, r, "")
        gaps = now["high"] - now["low"] + 1 - now["turns"] if now["low"] is not None else 0
        return (now["conv_id"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"] + INSERT * len(tail), "".join(now["audit"]) + "I" * len(tail), now["sha"].hexdigest())

    kind = None
    for batch in batches:
        kind, rows = batch.schema.field("conv_id").type, []
        for p in batch.to_pylist():
            if now is not None and now["conv_id"] == p["conv_id"]:
                now["illegal"] += now["last"] is not None and p["first"] is not None and now["last"] + p["first"] not in _LEGAL
                now["turns"] -= now["last_turn"] is not None and now["last_turn"] == p["first_turn"]
            else:
                if now is not None:
                    rows.append(done())
                now = {"conv_id": p["conv_id"], "sha": hashlib.sha256(), "any": False, "audit": [], "low": None, "high": None, "last": None, "last_turn": None} | dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal", "cost", "end"), 0)
            for k in ("turns", "blank", "duplicate", "truncated", "illegal", "cost"):
                now[k] += p[k]
            now["audit"].append(p["audit"])
            now["end"] = p["end"]
            for k, least in (("low", min), ("high", max)):
                now[k] = p[k] if now[k] is None else now[k] if p[k] is None else least(now[k], p[k])
            if p["last"] is not None:
                now["last"], now["last_turn"] = p["last"], p["last_turn"]
            for r, t in zip(p["role"], p["text"], strict=True):
                _digest(now, r, t)
        yield _summaries(rows, kind)
    if now is not None:
        yield _summaries([done()], kind)


def _digest(now: dict, role: str, text: str) -> None:
    now["sha"].update(("\n" * now["any"] + f"{role}:{text}").encode("utf-8", "surrogatepass"))
    now["any"] = True


def _summaries(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (kind, *[pa.int64()] * 6, pa.string(), pa.string()), strict=True)], ["conv_id", *(x.split()[0] for x in _SUMMARY.split(", "))])


def pieces(rows: DataFrame, most: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Chunks with counts, edits and repaired rows: those that are whole conversations, and those of longer ones.

    ``rows`` has conv_id, turn, role, text, copies. A longer conversation's pieces follow each other by ``seq``.
    """
    spark = rows.sparkSession
    common.prepare(spark)
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, "
    faulty = common.saved(_faulty(rows), "faults")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges: list[Column] = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 32)]
    dealt = faulty.repartitionByRange(tasks, *ranges).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    chunks = common.saved(dealt.mapInArrow(_cut(most), conv + _CHUNK), "chunks")
    costs = chunks.select("conv_id", "seq", "cost").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seq"))
    beyond = common.saved(costs.mapInArrow(_beyond, conv + "seq long, beyond array<long>"), "beyond")
    chunks = chunks.drop("cost")
    of = beyond.select("seq", "beyond")
    whole = chunks.join(of, "seq", "left_anti").select(*chunks.columns, F.lit(None).cast("array<long>").alias("beyond"), F.lit(None).cast("long").alias("start"))
    long = chunks.join(of, "seq").select(*chunks.columns, "beyond")
    ends = long.mapInArrow(_ends, conv + "seq long, ends array<long>").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    starts = common.saved(ends.mapInArrow(_starts, "seq long, start long"), "starts")
    long = long.join(starts, "seq").select(*chunks.columns, "beyond", "start")
    return tuple(x.mapInArrow(_repaired, conv + _PIECE) for x in (whole, long))


def audit(rows: DataFrame, most: int = CHUNK_ROWS) -> DataFrame:
    """A row a conversation: faults, the cheapest edits, their cost, and the digest of what they make of it."""
    whole, long = pieces(rows, most)
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, "
    ordered = long.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return whole.mapInArrow(_folded, conv + _SUMMARY).unionByName(ordered.mapInArrow(_folded, conv + _SUMMARY))


def oracle() -> str:
    """DuckDB SQL of the query: costs and edits from each state, row by row, forwards."""
    table = "list_transform(range(0, 16), lambda x: list_reduce([x, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
    digits = "'0123456789ABCDEF'"
    add = lambda x, cost, edit, row=None: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}', 'p': " + (f"list_append({x}.p, {row})" if row else f"{x}.p") + "}"
    ins = {2: "'user:'", 3: "'assistant:'"}
    far, stay, text = "{'c': 1000000000, 'a': '', 'p': []::VARCHAR[]}", "(CASE WHEN f IN ('b', 'd') THEN 1000000000 WHEN f = 't' THEN 5 ELSE 0 END)", "role || ':' || text"
    kept = {1: ("s", [0]), 2: ("u", [0, 1, 3]), 3: ("a", [2])}

    def reached(s: int) -> str:
        found = [add(f"r.s{s}", 2, "D")]
        if s:
            found += [f"CASE WHEN role[1] = '{kept[s][0]}' THEN {add(f'r.s{x}', stay, 'K', text)} ELSE {far} END" for x in kept[s][1]]
        if s > 1:
            found += [add(f"r.s{x}", f"1 + {stay}", "R", f"{ins[s]} || text") for x in kept[s][1]]
        return f"list_min([{', '.join(found)}])"

    closed = f"SELECT conv_id, i, s0, s1, s2, list_min([s3, {add('s2', 5, 'I', ins[3])}]) AS s3 FROM (SELECT conv_id, i, s0, s1, list_min([s2, {', '.join(add(f's{x}', 5, 'I', ins[2]) for x in (0, 1, 3))}]) AS s2, s3 FROM (%s))"
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    WITH RECURSIVE t AS (SELECT {table} AS t), o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS y FROM conversations),
    h AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(y), 2), lambda i: [CAST(instr({digits}, y[i + 1]) - 1 AS BIGINT), CAST(instr({digits}, y[i]) - 1 AS BIGINT)]))), lambda c, x: xor(c // 16, t[1 + xor(c % 16, x)]))) % 20 AS h FROM o, t),
    c AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(copy)),
    i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM c),
    f AS (SELECT *, CASE WHEN rtrim(text, {spaces}) = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(rtrim(text, {spaces}), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM i),
    k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
    r AS ({closed % f"SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 'p': []::VARCHAR[]}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM conversations"}
      UNION ALL {closed % f"SELECT r.conv_id, f.i, {', '.join(f'{reached(s)} AS s{s}' for s in range(4))} FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1"}),
    l AS (SELECT conv_id, list_min([s0, s3]) AS x FROM r QUALIFY i = max(i) OVER (PARTITION BY conv_id))
    SELECT l.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(x.c AS BIGINT) AS cost, x.a AS audit, sha256(coalesce(array_to_string(x.p, chr(10)), '')) AS repaired_sha256
    FROM l LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM l.conv_id
    """
