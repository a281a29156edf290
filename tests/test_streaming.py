"""Streams out of order against their batch twins, sessions in state, and logs after a failure."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import sessions
from quarry.streaming import event_time, memo, replay, session_store, sinks

EVENTS = "event_id long, ts timestamp, user_id long, event_type string"
TURNS = "conv_id long, turn long, role string, text string, at long"


def parts(spark, folder, schema, batches):
    """A stream of the given micro-batches."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)


def event(spark, i, second, user, kind):
    return (i, spark.sql(f"select timestamp_seconds({second}) t").first()["t"] if second is not None else None, user, kind)


def test_downtimes_in_any_order_equal_the_batch_twin(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.randrange(100_000, 200_000), rng.randrange(4), rng.choice(["error", "click", None])) for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type")
    path = replay.arrivals(events, "ts", 20_000, 5, end_after=10**6)
    query = sinks.write_once(event_time.downtimes(replay.stream(events, path), "user_id", F.col("event_type") == "error", "45000 seconds"), str(tmp_path / "s"), "e", str(tmp_path / "c"))
    query.awaitTermination(300)
    assert query.exception() is None and event_time.late_rows(query) == 0
    found = {tuple(r) for r in sinks.written(spark, str(tmp_path / "s")).select("user_id", "down_since", "up_at", "seconds").collect()}
    twin = sessions.downtimes(events, ["user_id"], F.col("event_type") == "error").where("up_at is not null")
    assert found == {tuple(r) for r in twin.select("user_id", "down_since", "up_at", "seconds").collect()} and found


def test_rows_beyond_the_watermark_are_counted(spark, tmp_path):
    e = lambda *x: event(spark, *x)
    batches = [
        [e(1, 1000, 1, "error"), e(2, 1100, 1, "up"), e(3, 5000, 2, "up")],
        [e(5, 4990, 1, "error"), e(6, None, 1, "error"), e(7, 5100, None, "error")],
        [e(8, 9000, 1, "up"), e(4, 1050, 1, "up")],  # the second one is late: all up to 4,900 has been gone through
        [e(9, 99000, 3, "up")],
    ]
    read = parts(spark, str(tmp_path / "in"), EVENTS, batches)
    query = sinks.write_once(event_time.downtimes(read, "user_id", F.col("event_type") == "error", "100 seconds"), str(tmp_path / "s"), "e", str(tmp_path / "c"))
    query.awaitTermination(300)
    assert event_time.late_rows(query) == 1
    found = sinks.written(spark, str(tmp_path / "s")).select("user_id", F.unix_seconds("down_since"), F.unix_seconds("up_at"), "seconds").collect()
    assert sorted(tuple(r) for r in found) == [(1, 1000, 1100, 100), (1, 4990, 9000, 4010)]


def store(spark, tmp_path, batches, **options):
    read = parts(spark, str(tmp_path / "in"), TURNS, batches)
    stream = session_store.sessions(read, **options)
    query = stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return {r["conv_id"]: r for r in session_store.all_sessions(spark, str(tmp_path / "c")).collect()}


def test_sessions_listed_from_state_equal_the_batch_state(spark, tmp_path):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), f"{c}/{t}", 100 * c + t) for c in range(30) for t in range(rng.randrange(1, 9))]
    shuffled = rng.sample(rows, len(rows))
    found = store(spark, tmp_path, [shuffled[i::3] for i in range(3)], keep=4, buckets=5)
    twin = sessions.state(spark.createDataFrame(rows, TURNS).drop("at")).collect()
    assert {c: (r["n_turns"], r["last_turn"], r["last_question"], r["last_answer"], r["intent"]) for c, r in found.items()} == {r["conv_id"]: (r["n_turns"], r["last_turn"], r["last_question"], r["last_answer"], r["intent"]) for r in twin}
    last = {c: sorted((t, role, text) for k, t, role, text, _ in rows if k == c)[-4:] for c in found}
    assert {c: [tuple(h) for h in r["history"]] for c, r in found.items()} == last


def test_clearing_one_session_and_all(spark, tmp_path):
    turn = lambda c, t, at, role="user": (c, t, role, f"{c}/{t}", at)
    batches = [
        [turn(1, 0, 10), turn(2, 0, 11), turn(3, 0, 12)],
        [turn(1, None, 20, "reset"), turn(2, 1, 21), turn(1, 1, 22)],
        [turn(None, None, 30, "reset_all"), turn(4, 0, 31), turn(3, 1, 29)],
        [turn(2, 9, 25), turn(2, 2, 40), turn(1, 7, 15), turn(None, 3, 50)],  # what happened before the clearing comes too late
    ]
    for i, want in ((3, {4: (1, 0)}), (4, {2: (1, 2), 4: (1, 0)})):
        found = store(spark, tmp_path / str(i), batches[:i], buckets=3)
        assert {c: (r["n_turns"], r["last_turn"]) for c, r in found.items()} == want


def test_sessions_have_a_time_to_live():
    asked = []

    class Handle:
        def getMapState(self, *args):
            asked.append(args)

        getValueState = getMapState

    session_store._Store(10, 86_400_000).init(Handle())
    assert asked[0][0] == "sessions" and asked[0][-1] == 86_400_000


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    schema = "id long, line string"
    read = parts(spark, str(tmp_path / "in"), schema, [[(1, "a"), (2, "b,\"c\"\n")], [(3, "c")], [(4, "d")]])
    seen = []

    def fails_after_writing(batch):
        """The second batch is written and then fails before Spark commits it; a third of its rows is in another file already."""
        rows = batch.collect()
        seen.append([r.id for r in rows])
        if [r.id for r in rows] == [3] and len(seen) == 2:
            batch.write.mode("overwrite").csv(str(tmp_path / "s/stream=log/batch=1"), header=True)
            raise RuntimeError("killed")
        return batch

    options = {"header": "true", "escape": '"', "quoteAll": "true"}
    query = sinks.write_once(read, str(tmp_path / "s"), "log", str(tmp_path / "c"), fails_after_writing, "csv", **options)
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination(300)
    assert seen == [[1, 2], [3]]
    sinks.write_once(read, str(tmp_path / "s"), "log", str(tmp_path / "c"), fails_after_writing, "csv", **options).awaitTermination(300)
    other = parts(spark, str(tmp_path / "in2"), schema, [[(9, "z")]])
    sinks.write_once(other, str(tmp_path / "s"), "other", str(tmp_path / "c2"), None, "csv", **options).awaitTermination(300)
    found = sinks.written(spark, str(tmp_path / "s"), schema, "csv", header="true", escape='"', multiLine="true").collect()
    assert sorted((r.id, r.line, r.stream, r.batch) for r in found) == [(1, "a", "log", 0), (2, "b,\"c\"\n", "log", 0), (3, "c", "log", 1), (4, "d", "log", 2), (9, "z", "other", 0)]


def test_chat_log_lines(spark):
    rows = spark.createDataFrame([(0, "q", "a", ["u", "v"]), (60, None, "b", None)], "s long, question string, answer string, sources array<string>")
    found = sinks.chat_log(rows.withColumn("at", F.timestamp_seconds("s"))).collect()
    assert [tuple(r) for r in found] == [("1970-01-01T00:00:00Z", "q", "a", '["u","v"]'), ("1970-01-01T00:01:00Z", None, "b", "[]")]


def test_answers_meet_the_last_question_or_none(spark, tmp_path):
    at = lambda s: spark.sql(f"select timestamp_seconds({s}) t").first()["t"]
    schema = "conv_id long, turn long, at timestamp, text string"
    asked = [[(1, 2, at(1020), "late one"), (2, 0, at(1000), "q2")], [(1, 0, at(1000), "q1"), (4, 0, at(1001), None)], [(9, 0, at(10**6), "")]]
    told = [[(1, 1, at(1010), "a1"), (2, 1, at(5000), "too far")], [(1, 3, at(1030), "a2"), (3, 0, at(1002), "alone"), (4, 1, at(1003), "b")], [(9, 1, at(10**6), "")]]
    out = event_time.previous_question(parts(spark, str(tmp_path / "q"), schema, asked), parts(spark, str(tmp_path / "a"), schema, told), "10 MINUTES", "2 HOURS")
    sinks.write_once(out, str(tmp_path / "s"), "x", str(tmp_path / "c")).awaitTermination(300)
    found = sinks.written(spark, str(tmp_path / "s")).collect()
    assert sorted((r.conv_id, r.turn, r.question, r.answer) for r in found) == [(1, 1, "q1", "a1"), (1, 3, "late one", "a2"), (2, 1, None, "too far"), (3, 0, None, "alone"), (4, 1, None, "b")]


def test_arrivals_keep_all_rows_within_their_delay(spark):
    rows = spark.createDataFrame([(i, i * 100) for i in range(500)], "id long, s long").select("id", F.timestamp_seconds("s").alias("at"))
    path = replay.arrivals(rows, "at", 3000, 4, end_after=5000)
    read = spark.read.option("recursiveFileLookup", True).parquet(path).select("id", F.unix_seconds("at").alias("s"), F.regexp_extract(F.input_file_name(), r"/(\d{4})/", 1).cast("int").alias("part")).collect()
    assert sorted(r.id for r in read) == [-1, *range(500)]
    newest = 0
    for p in range(5):
        own = [r.s for r in read if r.part == p]
        assert min(own) >= newest - 3000 - 54_000 / 4
        newest = max([newest, *own])
    assert newest == 49_900 + 5000


class PlainMemo:
    def __init__(self, size):
        self.size, self.keys = size, {}

    def ask(self, question):
        hit = question in self.keys
        self.keys.pop(question, None)
        self.keys[question] = True
        while len(self.keys) > self.size:
            del self.keys[next(iter(self.keys))]
        return hit


def test_memo_over_batches_equals_a_cache_over_rows(spark, tmp_path):
    rng = random.Random(1)
    asked, calls = [rng.choice("abcdefg") for _ in range(14)], []

    def answer(rows):
        calls.append(sorted(r.question for r in rows.collect()))
        return rows.select("key", F.upper("question").alias("answer"))

    read = parts(spark, str(tmp_path / "in"), "at long, question string", [[(i, q)] for i, q in enumerate(asked)])
    memo.answer_stream(read, answer, "at", str(tmp_path / "m"), str(tmp_path / "c"), 3).awaitTermination(300)
    plain = PlainMemo(3)
    found = sorted(memo.answers(spark, str(tmp_path / "m")).collect(), key=lambda r: r.at)
    assert [r.hit for r in found] == [plain.ask(q) for q in asked] and [r.answer for r in found] == [q.upper() for q in asked]
    assert [c for c in calls if c] == [[r.question] for r in found if not r.hit]


def test_memo_after_larger_batches(spark):
    rng = random.Random(2)
    plain, held = PlainMemo(4), spark.createDataFrame([], memo._MEMO)
    for turn in range(4):
        asked = [rng.choice([*"abcdefgh", None]) for _ in range(9)]
        before = set(plain.keys)
        batch = spark.createDataFrame([(i, q, "x") for i, q in enumerate(asked)], "at long, question string, answer_mode string")
        out, held = memo.remembered(batch, held, lambda rows: rows.select("key", F.lit("y").alias("answer")), "at", turn, 4)
        found = sorted(out.collect(), key=lambda r: r.at)
        assert [r.hit for r in found] == [(q or "") in before or (q or "") in [x or "" for x in asked[:i]] for i, q in enumerate(asked)]
        for q in asked:
            plain.ask(q or "")
        names = {r.k: q for q in [*"abcdefgh", ""] for r in [spark.sql(f"select sha2('{q}', 256) as k").first()]}
        rows = held.orderBy("used").collect()
        assert [names[r.key] for r in rows] == list(plain.keys)
        held = spark.createDataFrame(rows, memo._MEMO)


def test_parts_have_as_many_files_as_rows_need(spark):
    import glob

    from quarry.streaming import replay

    rows = spark.range(4000).repartition(9).selectExpr("id", "timestamp_seconds(id * 10) AS at")
    path = replay.arrivals(rows, "at", 60, 4)
    assert [len(glob.glob(f"{path}/{i:04d}/part-*")) for i in range(4)] == [1] * 4
