"""Substring deduplication, spelling variants and conversation repair against plain versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import conversation_repair, queries, spelling, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- substring deduplication ---------------------------------------------------------------------------------------


def plain_removal(rows, window):
    """(n_words, n_removed, kept) of each (doc_id, text)."""
    words = [WORD.findall(t or "") for _, t in rows]
    order = [float("inf") if d is None else d for d, _ in rows]
    least = {}
    for w, d in zip(words, order, strict=True):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, d), d)
    out = []
    for w, d in zip(words, order, strict=True):
        gone = {j for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def passages(seed, n):
    """Texts that share passages, whole or with changed words, at many offsets."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "x,", "é", "A", "a"]
    shared = [[rng.choice(vocabulary) for _ in range(rng.choice([12, 13, 14, 30, 80]))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 4)):
            part = list(rng.choice(shared))
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            text += [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))] + part
        rows.append((rng.choice([i, i, i, None, 3]), rng.choice([" ", "\n", " \t"]).join(text)))
    return rows


@pytest.mark.parametrize(("seed", "most", "window"), [(1, 4096, 13), (2, 2, 13), (3, 1, 13), (4, 3, 4)])
def test_removal_equals_all_windows(spark, seed, most, window, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SAMPLE_TEXTS", {1: 2, 2: 10**9, 3: 4, 4: 6}[seed])
    rows = passages(seed, 60) + [(1000, None), (1001, ""), (1002, " \n "), (1003, "one two"), (None, None)]
    rows += rows[:5] + [(2000, rows[7][1]), (None, rows[7][1])]
    names = "doc_id long, text string, a long, d string, own int, s int"
    df = spark.createDataFrame([(d, t, 1, "x", None, 2) for d, t in rows], names).repartition(5)
    found = Counter(tuple(r) for r in substring_dedup.remove(df, window, most).collect())
    assert found == Counter((d, *x) for (d, _), x in zip(rows, plain_removal(rows, window), strict=True))


def test_removal_in_long_texts_and_within_one(spark):
    rng = random.Random(5)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(150_000))
    part = " ".join(long.split()[70_000:70_040])
    rows = [(1, long), (2, part + " tail " + part), (3, "q" * 400_000 + " " + part), (4, "again " * 30), (0, "begin " + part.upper())]
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == dict(zip([d for d, _ in rows], plain_removal(rows, 13), strict=True))
    assert found[2][1] == 80 and found[4][1] == 0


def test_removal_of_nothing(spark):
    assert substring_dedup.remove(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_factors_cover_matches_and_cross_boundaries():
    a, b = np.arange(100, 120, dtype=np.uint64), np.arange(200, 220, dtype=np.uint64)
    reference = a.tolist() + [-1] + b.tolist() + [-1]
    index = {hash(tuple(reference[i : i + 4])): i for i in range(len(reference) - 3) if -1 not in reference[i : i + 4]}
    h = np.concatenate([a[3:9], b[:3], b[2:10], a[5:8]])
    keys = [hash(tuple(h[i : i + 4].tolist())) for i in range(len(h) - 3)]
    assert substring_dedup.factors(h, keys, index, reference, 4) == [(0, 6), (9, 8)]


def test_anchors_of_equal_windows_are_equal():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 1 << 60, 500).astype(np.uint64)
    other = np.concatenate([rng.integers(1, 1 << 60, 77).astype(np.uint64), h[100:160], h[:50]])
    at = [{}, {}]
    for own, words in zip(at, (h, other), strict=True):
        a, _, s, n = substring_dedup.phrases(words)
        assert s[0] == 0 and (s[1:] == s[:-1] + n[:-1]).all() and s[-1] + n[-1] == len(words) - 12
        for x, i, k in zip(a.tolist(), s.tolist(), n.tolist(), strict=True):
            own.update({words[j : j + 13].tobytes(): x for j in range(i, i + k)})
    both = at[0].keys() & at[1].keys()
    assert len(both) == 48 + 38 and all(at[0][w] == at[1][w] for w in both)


# ---- spelling variants ---------------------------------------------------------------------------------------------


def plain_words(rows):
    out = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return out


def variants(seed):
    """Texts of frequent words and their misspellings, in chains, with words of many lengths."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcéß×") for _ in range(rng.randint(6, 12))) for _ in range(30)] + ["aaaaaaaa", "aaaaaaaaa", "abababab", "a" * 400]
    bag = []
    for w in base:
        bag += [w] * rng.choice([2, 30, 300])
        for _ in range(6):
            i, c = rng.randrange(len(w)), rng.choice("abcéß×")
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
            bag += [v] * rng.choice([1, 2, 3, 25])
    rng.shuffle(bag)
    rows = []
    for i in range(0, len(bag), 25):
        words = [rng.choice([str.upper, str.lower, str.title])(w) if w.isascii() else w for w in bag[i : i + 25]]
        rows.append((rng.choice([i, i, None, 5]), rng.choice([" ", "1", "\n", "-"]).join(words)))
    return rows


@pytest.mark.parametrize(("seed", "most"), [(1, 256), (2, 2), (3, 7)])
def test_spelling_groups_equal_all_pairs(spark, seed, most):
    rows = variants(seed) + [(1, None), (2, ""), (None, "q" * 300_000 + " " + "q" * 300_000)]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, n int").repartition(3)
    counts = plain_words(rows)
    expected = plain_groups(counts)
    found = [(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.groups(df, most=most).collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_forms_are_followed_to_the_last(spark):
    words = [("abcdefgh", 2), ("abcdefgx", 20), ("abcdefyx", 200), ("abcdzfyx", 2000)]
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words)]
    rows = [(d, t) for d, t in rows if zlib.crc32(f"{d}:{t.split()[0]}".encode()) % 31]
    assert len(rows) == 4
    found = {r["word"]: r["root"] for r in spelling.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == dict.fromkeys([w for w, _ in words], "abcdzfyx")


def test_spelling_of_nothing(spark):
    assert spelling.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shards_stay_small(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(9)) for _ in range(400)})
    found = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    from quarry.llm import common

    common.prepare(spark)
    sizes = Counter(r["key"] for r in spelling.shards(found, most=4).collect())
    assert max(sizes.values()) <= 6


# ---- conversation repair -------------------------------------------------------------------------------------------


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """Cheapest edits by Dijkstra over (cost, edits so far), rows in order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, made = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        want = "assistant" if state == "u" else "user"
        heapq.heappush(queue, (cost + 5, audit + "I", i, want[0], (*made, want + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, made))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, want[0], (*made, f"{want}:{text}")))
                if role[:1] == want[0] or state == "" and role[:1] == "s":
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[:1], (*made, f"{role}:{text}")))
    count = Counter(faults)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


def talks(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "so", "", "  ", "\n", "É.\t", "a.b", "Well. ", None, "x:y\nz."]
    roles = ["user", "assistant", "user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"]
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 8, 13, 40])):
            turn = rng.choice([t, t, t, t + 1, None, t + 5])
            text = rng.choice(texts) if rng.random() < 0.5 else f"{rng.randrange(100)}{rng.choice(['.', '', '?'])}"
            rows.append((rng.choice([c, c, c, None]), turn, rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[t % 2], text))
    return rows + rows[:9]


@pytest.mark.parametrize(("seed", "most"), [(1, 512), (2, 3), (3, 1), (4, 8)])
def test_repair_equals_shortest_paths(spark, seed, most):
    rows = talks(seed, 40)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copies int, seq string").repartition(4)
    expected = {}
    for conv in {r[0] for r in rows}:
        expected[conv] = plain_repair([r[1:] for r in plain_damage(rows) if r[0] == conv])
    found = conversation_repair.audit(conversation_repair.damaged(df), most).collect()
    assert len(found) == len(expected)
    assert {r[0]: tuple(r[1:]) for r in found} == expected


def test_repair_of_dropped_and_no_rows(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    schema = "conv_id long, turn long, role string, text string"
    found = conversation_repair.audit(conversation_repair.damaged(spark.createDataFrame([(conv, 0, "user", "Hello.")], schema))).collect()
    assert [tuple(r) for r in found] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversation_repair.audit(conversation_repair.damaged(spark.createDataFrame([], schema))).collect() == []


def test_repair_of_one_hot_conversation_spreads(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(5000)] + [(7, 9, "user", "again.")] * 3000 + [(c, 0, "user", "Hi.") for c in range(50)]
    df = conversation_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    _, long = conversation_repair.pieces(df, 256)
    assert long.select("seq").distinct().count() >= 18
    found = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.audit(df, 256).collect()}
    own = defaultdict(list)
    for r in plain_damage(rows):
        own[r[0]].append(r[1:])
    assert found == {c: plain_repair(own.get(c, [])) for c in {r[0] for r in rows}}


def test_costs_of_chunks_multiply():
    rng = np.random.default_rng(4)
    role, fault, more = rng.integers(0, 4, (12, 6)).astype(np.int8), rng.choice([0, 1, 2, 3, 0, 0], (12, 6)).astype(np.int8), rng.integers(0, 2, (12, 6))
    whole = conversation_repair.backward(role, fault, more, np.tile(conversation_repair.END, (6, 1)))[0]
    end = np.tile(conversation_repair.END, (6, 1))
    for lo in (8, 4, 0):
        m = conversation_repair.matrices(role[lo : lo + 4], fault[lo : lo + 4], more[lo : lo + 4])
        end = (m + end[:, None, :]).min(2)
    assert (end == whole).all()


def test_queries_cover_their_tables(spark):
    data = "/root/testdata/sf0.001"
    for name, table, key in (("op11_substring_dedup", "documents", "doc_id"), ("op13_conversation_repair", "conversations", "conv_id")):
        own = {r[0] for r in spark.read.parquet(f"{data}/{table}.parquet").select(key).distinct().collect()}
        assert {r[key] for r in queries.QUERIES[name](spark, data).collect()} == own
