"""Every operator against a brute-force version, an exact round trip or planted cases, with nulls and empty tables."""

import gzip
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import common, decontaminate, embedding_dedup, language_id, mixing, ngram_join, quality, queries, scan, sharding, token_files, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the house stands near river with green trees and people walk along".split(), "fr": "la maison est près de rivière avec des arbres verts et les gens marchent".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "fr"
        text = prose(rng, lang, rng.randrange(8, 60)) + ("" if i % 7 else " you filthy moron")
        rows.append((i, text, lang, "big" if i % 3 else f"s{i % 4}", len(text)))
    rows += [(120, None, None, None, None), (121, "", "en", "big", 0), (122, "123 456", "en", "s1", 7), (123, rows[5][1], "en", "big", 1), (123, rows[5][1], "en", "big", 1), (124, rows[5][1] + " extra", "en", "s2", 1), (125, "x " * 30_000, "en", "s2", 1), (None, "the house stands", "en", "s1", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (5, 5), (6, None)]
    got = {r.id: r.label for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    # chains, hubs and cycles over many tasks, with chunks so small that several rounds are needed
    rng = random.Random(1)
    name = rng.sample(range(-(10**9), 10**9), 700)
    edges = [(i, i + 1) for i in range(299)] + [(300, 301 + i) for i in range(200)] + [(520 + i, 520 + (i + 1) % 50) for i in range(50)] + [(600 + rng.randrange(60), 600 + rng.randrange(60)) for _ in range(40)]
    a, b = (np.array(e) for e in zip(*edges, strict=True))
    low = common.unite(700, a, b)
    want = {name[i]: min(name[j] for j in np.flatnonzero(low == low[i])) for i, j in edges + [(j, i) for i, j in edges] if i != j}
    rows = spark.createDataFrame([(name[i], name[j]) for i, j in edges], "a long, b long").repartition(7)
    for chunk in (4, 1 << 17):
        assert {r.id: r.label for r in common.connected_components(rows, chunk).collect()} == want


def test_scan_long_texts():
    long = "word " * 500_000
    words = [scan.Words(g) for g in scan.pieces([None, "", long, "a-b 1"])]
    assert sum(len(w.hash) for w in words) == 500_002
    assert len(np.unique(np.concatenate([w.hash[w.doc == 2] for w in words]))) == 1


def test_toxicity(spark, corpus):
    labels = corpus.where("doc_id is not null and doc_id < 120").select("doc_id", F.lit(1).alias("quality"), F.contains("text", F.lit("moron")).cast("int").alias("toxic"))
    model = toxicity.fit(corpus, labels, F.lit(True))
    got = toxicity.score(corpus, model).join(labels, "doc_id").collect()
    hit = [r.score >= 0.5 for r in got if r.toxic]
    assert np.mean(hit) > 0.9 and np.mean([r.score >= 0.5 for r in got if not r.toxic]) < 0.1
    assert toxicity.score(corpus, model).count() == corpus.count() and toxicity.score(empty(spark), model).count() == 0
    none = toxicity.fit(corpus, labels.where("toxic = 0"), F.lit(True))
    assert {r.score for r in toxicity.score(corpus, none).collect()} == {0.0}


def test_quality(spark, corpus):
    junk = spark.createDataFrame([(1000 + i, "### $$$ !!! " * (i + 3), None, None, None) for i in range(40)], DOCS)
    both = corpus.unionByName(junk)
    labels = both.where("doc_id is not null").select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality"))
    stats = quality.statistics(both)
    model = quality.fit(stats, labels, F.lit(True))
    got = quality.score(stats, model).collect()
    assert all(r.score < 0.3 for r in got if r.doc_id is not None and r.doc_id >= 1000)
    assert np.mean([r.score >= 0.3 for r in got if r.doc_id is not None and r.doc_id < 120]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    bare = quality.fit(quality.statistics(empty(spark)), labels, F.lit(True))
    assert {r.score for r in quality.score(stats, bare).collect()} == {0.5}


def test_language(spark, corpus):
    model = language_id.fit(corpus)
    got = {r.doc_id: r for r in language_id.predict(corpus, model).collect()}
    want = {r.doc_id: r.lang for r in corpus.where("doc_id < 120").collect()}
    assert np.mean([got[i].lang_pred == want[i] for i in want]) > 0.97
    assert [got[i].lang_pred for i in (120, 121, 122)] == ["und"] * 3 and got[120].score == 0
    unseen = spark.createDataFrame([(1, "maisonette rivièrement arbresque"), (2, "housely walkery streamside")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.predict(unseen, model).orderBy("doc_id").collect()] == ["fr", "en"]
    nothing = language_id.fit(empty(spark))
    assert {r.lang_pred for r in language_id.predict(corpus, nothing).collect()} == {"und"}


def brute_jaccard(rows, words, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = defaultdict(int)
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * o >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), k), k)
    return {k: (len(sets[i]), links[i], low[find(i)]) for i, (k, _) in enumerate(rows)}


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80)])
def test_ngram_join(spark, words, num, monkeypatch):
    rng = random.Random(words)
    rows = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "one two"), (5, " \n")]
    for base in range(12):
        own = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 12, 40, 150]))]
        size = len(own)
        if base % 4 == 0:  # sizes on both sides of level bounds
            own += own[: size // 9]
        for _ in range(9):
            w = list(own)
            for _ in range(rng.randrange(0, max(2, len(w) // 20))):
                w[rng.randrange(len(w))] = f"v{rng.randrange(99)}"
            rows.append((len(rows), " ".join(w)))
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)  # groups of more than 8 classes spread over pairs of blocks
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in ngram_join.components(docs, words, num, 100).collect()}
    assert got == brute_jaccard(rows, words, num, 100)
    assert ngram_join.components(empty(spark), words, num, 100).count() == 0


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (50, 100)])
def test_signatures_lose_no_pair(num, den):
    """Pairs just above the threshold share as many signatures as they need, and one of the first of both."""
    rng = np.random.default_rng(num)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        cut, more = (int(x) for x in rng.integers(0, n * (den - num) // den + 1, 2))
        other = np.unique(np.concatenate([base[cut:], rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
        both = len(np.intersect1d(base, other))
        if not both or both * den < num * (len(base) + len(other) - both):
            continue
        found = []
        for s in (base, other):
            sig, tag = ngram_join.signatures(s, num, den)
            found.append(dict(zip(sig.tolist(), tag.tolist(), strict=True)))
        shared = [(found[0][x], found[1][x]) for x in found[0].keys() & found[1].keys()]
        levels = [(a >> 17, b >> 17) for a, b in shared]
        assert all(a == b for a, b in levels)
        good = False
        for level in {a for a, _ in levels}:
            here = [x for x, y in zip(shared, levels, strict=True) if y[0] == level]
            enough = all(len(here) >= ((x[i] >> 1) & 0xFFFF) for x in here for i in (0, 1))
            good |= enough and any(a & 1 and b & 1 for a, b in here)
        assert good


def test_keep_one(spark, corpus):
    kept = ngram_join.keep_one(corpus, 5, 80, 100)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == corpus.columns and 5 in ids and 123 not in ids and 124 not in ids and None in ids and len(ids) == len(set(ids))


def test_keep_one_where_an_id_has_several_texts(spark):
    text = lambda a: " ".join(f"{a}{i}" for i in range(60))
    rows = [(1, text("a")), (7, text("a")), (7, text("b")), (7, text("b")), (8, text("c")), (9, text("a")), (None, text("d"))]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept) == [(0, "d"), (1, "a"), (7, "b"), (8, "c")]


def test_decontamination(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (15, 20, 33, 33, 59)]
    rows, planted = [], set()
    for i in range(60):
        body = [word() for _ in range(rng.randrange(0, 200))]
        if i % 2:
            k = rng.randrange(len(items))
            edited = list(items[k])
            for _ in range(rng.randrange(0, decontaminate.max_edits(len(edited)) + 1)):
                at = rng.randrange(len(edited))
                if rng.random() < 0.5:
                    edited[at] = word()
                else:
                    edited.insert(at, word())
            at = rng.randrange(len(body) + 1)
            body[at:at] = edited
            planted.add((i, k))
        rows.append((i, " ".join(body).upper() if i % 5 == 0 else " ".join(body)))
    rows += [(100, None), (101, ""), (102, " ".join(items[1][:12]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    report = decontaminate.report(docs, bench, block=2).collect()
    found = {(r.doc_id, r.item_id) for r in report}
    assert found <= planted and len(found) >= 0.95 * len(planted)
    # exact: the reported edits are those of the dynamic programme over the whole text
    for r in report:
        h = decontaminate.words_of(dict(rows)[r.doc_id])
        assert decontaminate.edit_distance(decontaminate.words_of(" ".join(items[r.item_id])), h, 99)[0] == r.edits
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {i for i, _ in rows} - {i for i, _ in found}
    assert decontaminate.report(docs, bench.limit(0)).count() == 0 and decontaminate.report(docs.limit(0), bench).count() == 0


def test_edited_copies_of_long_items_are_found():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(600)] for _ in range(8)]
    texts = []
    for k in range(40):
        own = list(items[k % 8])
        for _ in range(decontaminate.max_edits(600)):
            at, kind = rng.randrange(len(own)), rng.randrange(3)
            own[at : at + (kind != 1)] = [] if kind == 2 else [word()]
        texts.append(" ".join([word() for _ in range(30)] + own + [word() for _ in range(30)]))
    index = decontaminate.build(list(range(8)), [" ".join(w) for w in items])
    assert [[x[0] for x in found] for found in decontaminate.batch_matches(index, texts)] == [[k % 8] for k in range(40)]


def brute_cosines(ids, vectors, threshold):
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for v in vectors]
    label, count = list(range(len(ids))), [0] * len(ids)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.asarray(vectors[i], float), np.asarray(vectors[j], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    count[i] += 1
                    count[j] += 1
                    label[root(i)] = root(j)
    lows: dict = {}
    for i, k in enumerate(ids):
        lows[root(i)] = min(lows.get(root(i), k), k)
    return {k: (count[i], lows[root(i)]) for i, k in enumerate(ids)}


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    vectors = [v.tolist() for v in base]
    for i in range(60):
        vectors.append((base[i % 6] + rng.normal(size=16) * rng.choice([0.05, 0.15, 0.3])).tolist())
    vectors += [vectors[0], [0.0] * 16, None, [], [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [x * 1e-3 for x in vectors[1]], vectors[2][:8]]
    ids = list(range(len(vectors)))
    rows = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<double>").repartition(4)
    want = brute_cosines(ids, vectors, 0.95)
    clash = rows.selectExpr("vec_id", "embedding", "1 as cls", "2 as low", "3 as task", "4 as v")
    for block, given in ((8192, rows), (9, clash)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.links(given, 0.95, block=block).collect()}
        assert got == want
    monkeypatch.setattr(embedding_dedup, "LEAST_BLOCK", 10)
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.links(rows, 0.95).collect()} == want
    assert embedding_dedup.links(rows.limit(0), 0.95).count() == 0


def test_embeddings_without_ids_and_repeated(spark):
    a, b, c = [1.0, 0.0, 0.1], [1.0, 0.01, 0.1], [0.0, 1.0, 0.0]
    rows = [(None, a), (None, c), (4, b), (4, b), (2, c), (9, None), (None, None)]
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == sorted([(-1, 2, 4, None), (-1, 1, 2, None), (4, 2, 4, True), (4, 2, 4, True), (2, 1, 2, True), (9, 0, 9, True), (-1, 0, None, None)], key=str)


def test_products_of_many_dimensions_are_exact():
    rng = np.random.default_rng(6)
    q = rng.integers(-127, 128, (40, 5000)).astype(np.int8)
    q[:2] = 127
    want = q.astype(np.int64) @ q.astype(np.int64).T
    assert (embedding_dedup._product(q.astype(np.float32), q.astype(np.float32)) == want).all()
    x = rng.normal(size=(60, 4096))
    x[30:] = x[:30] + rng.normal(size=(30, 4096)) * rng.choice([0.2, 0.33, 0.4], (30, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = {(i, j) for a, b in embedding_dedup.link_tiles(x, None, tile=16) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert found == {(i, j) for i in range(60) for j in range(i + 1, 60) if x[i] @ x[j] >= 0.95}


def test_quantisation_bound():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code, scale, norm, err = embedding_dedup.quantise(x)
    approx = (code * scale[:, None]) @ (code * scale[:, None]).T
    assert (np.abs(approx - x @ x.T) <= norm[:, None] * err[None, :] + err[:, None] + 1e-12).all()


def read_warc(data):
    """(fields, block) of the records of an archive by the standard alone: gzip members one by one, each one record."""
    out = []
    while data:
        gz = zlib.decompressobj(31)
        raw, data = gz.decompress(data) + gz.flush(), gz.unused_data
        assert gz.eof
        head, block = raw.split(b"\r\n\r\n", 1)
        version, *lines = head.decode().split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines)
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= fields.keys()
        assert block[int(fields["Content-Length"]) :] == b"\r\n\r\n"
        out.append((fields, block[: int(fields["Content-Length"])]))
    return out


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BLOCKS", 2)
    body = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhé" * 20
    html = [body, body, "short", "short", None, "", "é" * 5500, "line\r\n\r\n" * 700, body, "é" * 5500, "\x00" * 3000]
    rows = [(i, f"http://x/{i}\r\n", h) for i, h in enumerate(html)] + [(None, None, body), (None, "u" * 100_000, "é" * 5500), (2, "", "short"), (6, "http://x/6", "é" * 5500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as refers_to", "3 as value").repartition(3)
    for few in (500_000, 0):  # with revisits broadcast and joined by a shuffle
        monkeypatch.setattr(warc, "BROADCAST_REVISITS", few)
        path = tmp_path / f"a{few}"
        warc.write(pages, str(path), chunk=1000, block=3000)
        got = warc.records(spark, str(path)).collect()
        assert len(got) == len(rows) and all(r.intact for r in got)
        want = Counter((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
        assert sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit") == [(1, 0), (6, 6), (8, 0), (9, 6)]
        assert all(r.refers_to is None for r in got if r.record_type == "response")
        table = warc.chunks(spark, str(path)).where("page_id = 6").collect()
        assert sorted((r.chunk, r.bytes) for r in table) == sorted([(k, min(1000 * k, 11_000)) for k in range(1, 12)] + [(1, 0)])
        raw = html[6].encode()
        assert all(r.digest == hashlib.sha256(raw[: r.bytes]).hexdigest() for r in table if r.record_type == "response")
        # an independent reader: distinct ids, origins and totals of segments, references, payloads put together again
        found = [r for f in sorted(path.glob("part-*")) for r in read_warc(f.read_bytes())]
        names = [f["WARC-Record-ID"] for f, _ in found if f["WARC-Type"] != "continuation"]
        assert len(set(f["WARC-Record-ID"] for f, _ in found)) == len(found)
        whole = defaultdict(dict)
        for f, block in found:
            if f["WARC-Type"] == "revisit":
                assert f["WARC-Refers-To"] in names and b"\r\n\r\n" == block[-4:]
            else:
                assert f.get("WARC-Segment-Origin-ID", names[0]) in names
                whole[f["X-Row"]][int(f.get("WARC-Segment-Number", 1))] = (f, block)
        for parts in whole.values():
            joined = b"".join(parts[k][1] for k in sorted(parts))
            payload = joined.split(b"\r\n\r\n", 1)[1]
            assert hashlib.sha256(payload).hexdigest() == parts[1][0]["WARC-Payload-Digest"].removeprefix("sha256:")
            if len(parts) > 1:
                assert int(parts[len(parts)][0]["WARC-Segment-Total-Length"]) == len(joined) and sorted(parts) == list(range(1, len(parts) + 1))
                assert all("WARC-Segment-Total-Length" not in parts[k][0] for k in range(1, len(parts)))
    warc.write(pages.limit(0), str(tmp_path / "b"))
    assert warc.records(spark, str(tmp_path / "b")).count() == 0


def test_warc_reads_members_of_any_size():
    rng = random.Random(4)
    pages = [(i, "".join(rng.choice("abcdé <>/") for _ in range(rng.choice([0, 10, 900, 70_000, 400_000])))) for i in range(40)]

    def members(i, h):
        raw, size = memoryview(h.encode()), warc.CHUNK
        digest = hashlib.sha256(raw).hexdigest()
        return [warc.member(i, "u", raw[k * size : (k + 1) * size], k + 1, len(raw), digest, None, i, "2024-01-01T00:00:00Z") for k in range(max(1, -(-len(raw) // size)))]

    data = b"".join(m for i, h in pages for m in members(i, h))
    sizes, whole = defaultdict(int), defaultdict(bytes)
    for r in warc.parse(data):
        sizes[r["page_id"]] += r["bytes"]
        whole[r["page_id"]] += r["data"] or b""
        assert r["last"] == (sizes[r["page_id"]] == r["declared_bytes"])
    assert sizes == {i: len(h.encode()) for i, h in pages} and all(whole[i] in (b"", h.encode()) for i, h in pages)
    with pytest.raises(ValueError):
        list(warc.parse(data[: len(data) // 2]))
    again = b"".join(f"WARC/1.1\r\n{''.join(f'{k}: {v}' + chr(13) + chr(10) for k, v in f.items())}\r\n".encode() + b + b"\r\n\r\n" for f, b in read_warc(data))
    assert again == b"".join(gzip.decompress(m) for i, h in pages for m in members(i, h))


def test_warc_payload_of_many_chunks_stays_in_chunks(spark, tmp_path):
    """No row between Spark and Python, and no task of the writing side, holds more of a payload than a chunk."""
    pages = spark.createDataFrame([(1, "u", "small"), (2, "v", "seed")], "page_id long, url string, html string").selectExpr("page_id", "url", "case when page_id = 2 then repeat('0123456789abcdef', 2000000) else html end as html")
    table = warc.payload_chunks(pages)
    sizes = table.selectExpr("page_id", "k", "octet_length(data) as n").collect()
    assert max(r.n for r in sizes) == warc.CHUNK and sum(r.n for r in sizes if r.page_id == 2) == 32_000_000 and len(sizes) == 124
    warc.write(pages, str(tmp_path / "w"), archive_blocks=2)
    got = {r.page_id: r for r in warc.records(spark, str(tmp_path / "w")).collect()}
    assert got[2].intact and got[2].payload_bytes == 32_000_000 and got[2].payload_digest == hashlib.sha256(b"0123456789abcdef" * 2_000_000).hexdigest()


def poisson_count(u, rate):
    """Smallest k whose cumulative Poisson probability reaches u."""
    k, p = 0, math.exp(-rate)
    c = p
    while c < u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_mixing(spark, corpus):
    rate = {r.q_mix_source: r.repetition_rate for r in mixing.rates(corpus, {"big": 3.0, "s1": 1.0}).collect()}
    n = {r.source: r["count"] for r in corpus.groupBy("source").count().collect()}
    assert abs(rate["big"] - 0.75 * corpus.count() / n["big"]) < 1e-9 and rate["s2"] == 0
    got = mixing.replicate(corpus, total=2000)
    assert abs(got.count() - 2000) < 250
    # row by row against the distribution's own sum
    weight = {s: k**mixing.TEMPER for s, k in n.items()}
    want = Counter()
    for r in corpus.collect():
        key = f"{mixing.SEED}:{'' if r.doc_id is None else r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}"
        u = (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        for c in range(poisson_count(u, weight[r.source] / sum(weight.values()) * 2000 / n[r.source])):
            want[r.doc_id, r.text, c] += 1
    assert Counter((r.doc_id, r.text, r.copy_no) for r in got.collect()) == want
    again = mixing.replicate(corpus.repartition(7), total=2000)
    assert Counter((r.doc_id, r.text, r.copy_no) for r in again.collect()) == want and mixing.replicate(empty(spark)).count() == 0
    big = mixing.rates(spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source")), total=900_000).first()
    assert abs(big.q_mix_cdf[-1] - 1) < 1e-9


def test_mixing_keeps_columns_of_any_name(spark, corpus):
    taken = {"copies": 77, "Copy_No": 5, "repetition_rate": 6, "q_mix_copies": 8, "q_mix_source": 1, "q_mix_key": 2, "q_row": 3, "a.b": 4}
    docs = corpus
    for name, value in taken.items():
        docs = docs.withColumn(name, F.lit(value))
    got = mixing.replicate(docs, total=300)
    assert got.columns == [*docs.columns, "q_mix_repetition_rate", "q_mix_q_mix_copies", "q_mix_copy_no"]
    rows = got.collect()
    assert rows and all(r[name] == value for r in rows for name, value in taken.items())
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in mixing.replicate(corpus, total=300).collect())
    out = corpus_pipeline.mix_sources(spark, docs, "")
    assert out.columns == docs.columns and out.first()["copies"] == 77


def test_mixing_rows_without_an_id_of_their_own(spark):
    rows = [(None if i % 2 else 5, f"text {i}", "a") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.replicate(docs, total=4000, partitions=4).withColumn("part", F.spark_partition_id()).collect()
    assert abs(len(got) - 4000) < 300 and max(Counter(r.part for r in got).values()) < 1300
    assert len({r.copies for r in got if r.doc_id is None}) > 2


def library_rows(docs, path):
    """What ``token_files.read`` has to return, from the library alone."""
    whole = Tokenizer.from_file(path)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, np.array([*(whole.encode(t, add_special_tokens=False).ids), 1], "<u4")) for i, t in rows]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files(spark, corpus, tmp_path, name):
    path = public_tokenizers.path(name)
    long = "c" * 4095
    extra = [(200, "Don't <|endoftext|> İΣ ﬁ naïve x 12½"), (201, "aaaa " * 9000), (202, "a" + long + "b"), (203, "b" + long + "a"), (204, "a" + long + "b"), (205, "x" * 300_000), (206, "\u2028 mixed\u3000spaces\r\nand CAPS")]
    docs = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    token_files.write(docs, path, str(tmp_path / "t"), shard_ids=5000)
    got = sorted(token_files.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    start = 0
    for (doc_id, ids), g in zip(library_rows(docs, path), got, strict=True):
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    token_files.write(empty(spark), path, str(tmp_path / "e"))
    assert token_files.read(spark, str(tmp_path / "e")).count() == 0


def test_rows_of_one_id_spread_over_parts(spark, tmp_path):
    rows = [(7, f"text number {i}") for i in range(400)] + [(None, f"without id {i}") for i in range(400)] + [(9, "same")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).repartition(5)
    path = str(tmp_path / "t")
    token_files.write(docs, queries.tokenizer_path(), path, partitions=8)
    sizes = [len(r.doc_ids) for r in spark.read.parquet(path).collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 300
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 400 + [7] * 400 + [9] * 5
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def pair_counts(seq):
    """Occurrences of each adjacent pair, without overlap, from the left."""
    count, last = Counter(), {}
    for i in range(len(seq) - 1):
        p = (seq[i], seq[i + 1])
        if last.get(p) != i - 1:
            count[p] += 1
            last[p] = i
    return count


def test_repair():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 300, rng.integers(2, 9)) for _ in range(60)]
    prose = np.concatenate([words[i] for i in rng.zipf(1.3, 6000) % 60])
    for ids in (np.zeros(0, np.uint32), np.array([5]), np.full(1 << 12, 7), np.full(999, 7), rng.integers(0, 9, 20_000), prose, rng.integers(0, 70_000, 3000)):
        first = 70_000
        shard = token_files.pack([1], [ids.astype(np.uint32)], first)
        rules, symbols = token_files.loaded_rules(shard["rules"], shard["n_rules"]), token_files.loaded(shard["symbols"], shard["n_symbols"])
        assert (token_files.expand(rules, symbols, first) == ids).all()
        for a, b in ((0, len(ids)), (3, 17), (900, 950), (len(ids) - 3, len(ids) + 9)):
            a, b = max(0, min(a, len(ids))), min(b, len(ids))
            assert (token_files.decode_range(shard, a, b) == ids[a:b]).all()
        # to its end: no pair is frequent any more, every rule stands for its two sides, and each was worth making
        assert max(pair_counts(symbols.tolist()).values(), default=0) < token_files.LEAST
        assert (token_files.expansions(rules, first) == [len(token_files.expand(rules, np.array([first + i]), first)) for i in range(len(rules))]).all()
    run = token_files.repair(np.full(1 << 12, 7), 100)
    assert len(run[0]) == 8 and len(run[1]) == 16  # halved as long as the pair occurs so often: 16, 8 no more


def test_first_rule_is_the_most_frequent_pair():
    rng = np.random.default_rng(1)
    seq = rng.zipf(1.5, 5000) % 40
    rules, _ = token_files.repair(seq, 100)
    count = pair_counts(seq.tolist())
    assert count[tuple(rules[0].tolist())] == max(count.values())


def test_sharding(spark, corpus):
    got = sharding.assign(corpus, 7).collect()
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1 and all(sorted(s) == list(range(len(s))) for s in per.values())
    text = {r.doc_id: (r.text or "").encode() for r in corpus.collect()}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id])) for r in got)
    key = lambda rows: sorted((r.doc_id or -1, r.text_crc32, r.shard, r.slot) for r in rows)
    assert key(got) == key(sharding.assign(corpus.repartition(9), 7).collect()) and sharding.assign(empty(spark), 7).count() == 0


def test_sharding_of_rows_that_share_an_id(spark):
    rows = [(None, f"text {i}") for i in range(500)] + [(3, f"own {i}") for i in range(500)] + [(4, "same")] * 500 + [(5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "2 as shard", "3 as n").repartition(4)
    got = sharding.assign(docs, 7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t or "") + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert len(per) == 7 and max(map(len, per.values())) - min(map(len, per.values())) <= 1 and all(sorted(s) == list(range(len(s))) for s in per.values())
    # what repeats one id is spread over the ring
    assert max(Counter(r.shard for r in got if r.doc_id is None).values()) < 350


def test_very_many_equal_rows_become_rows_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 100)
    docs = spark.range(20_000).selectExpr("case when id < 19000 then 7 else id end as doc_id", "case when id < 19000 then 'same' else concat('t', id) end as text")
    got = sharding.assign(docs, 6).collect()
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert sorted(len(x) for x in per.values()) == [3333] * 4 + [3334] * 2 and all(sorted(s) == list(range(len(s))) for s in per.values())
    assert Counter(r.doc_id for r in got) == Counter([7] * 19_000 + list(range(19_000, 20_000)))


def test_rows_are_where_the_walk_puts_them(spark):
    """``assign`` end to end: every row's rank within its cell by its key hash, placed by the plan over the counted cells."""
    docs = spark.createDataFrame([(i, f"text {i % 900}") for i in range(1500)], "doc_id long, text string").repartition(5)
    raw = F.col("text").cast("binary")
    key = F.xxhash64(F.col("doc_id").cast("string"), (F.octet_length(raw) + 16).cast("long"), F.crc32(raw))
    keyed = sorted((r.k, r.doc_id) for r in docs.select("doc_id", key.alias("k")).collect())
    cells = defaultdict(list)
    for k, i in keyed:
        cells[((k & (1 << 64) - 1) >> 20) % 512].append(i)
    placed = sharding.plan({c: len(x) for c, x in cells.items()}, 9, 16, 512)
    want = {cells[c][r]: (s, f + r - a) for c, a, b, s, f in placed for r in range(a, b)}
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs, 9, 16, 512).collect()} == want


def test_one_more_shard_moves_few_rows():
    """Counts of a million rows by cell: with 41 instead of 40 shards few rows move, and most stand at their first node."""
    rng = np.random.default_rng(5)
    counts = dict(enumerate(np.bincount(rng.integers(0, sharding.RING, 1_000_000), minlength=sharding.RING).tolist()))

    def places(shards):
        out = np.full(1_000_000, -1)
        first = dict(zip(counts, np.cumsum([0, *counts.values()][:-1]).tolist(), strict=True))
        for c, a, b, s, _ in sharding.plan(counts, shards):
            out[first[c] + a : first[c] + b] = s
        return out, first

    (old, first), (new, _) = places(40), places(41)
    assert (old >= 0).all() and (new >= 0).all()
    moved = (old != new).mean()
    assert 1 / 41 < moved < 0.07
    nodes = sharding._points(40, sharding.VNODES, sharding.RING)
    at = np.searchsorted([c for c, _ in nodes], list(counts)) % len(nodes)
    home = np.repeat([nodes[i][1] for i in at.tolist()], list(counts.values()))
    assert (home == old).mean() > 0.9


def test_ring_against_a_walk():
    """Row by row and round by round: whoever finds its shard full walks on to the next virtual node with room."""
    for seed in range(20):
        rng = random.Random(seed)
        counts = {c: rng.randrange(1, 5) for c in rng.sample(range(256), 90)}
        placed = sharding.plan(counts, 5, vnodes=8, ring=256)
        nodes, total = sharding._points(5, 8, 256), sum(counts.values())
        room = [total // 5 + (s < total % 5) for s in range(5)]
        load, where = [0] * 5, {}
        waiting = [(c, k, next((i for i, x in enumerate(nodes) if x[0] >= c), 0)) for c in sorted(counts) for k in range(counts[c])]
        while waiting:
            later = []
            for c, k, at in waiting:
                if load[nodes[at][1]] < room[nodes[at][1]]:
                    where[c, k] = nodes[at][1], load[nodes[at][1]]
                    load[nodes[at][1]] += 1
                else:
                    while len(where) < total and load[nodes[at][1]] >= room[nodes[at][1]]:
                        at = (at + 1) % len(nodes)
                    later.append((c, k, at))
            waiting = later
        assert load == room and {(c, k): (s, f + k - a) for c, a, b, s, f in placed for k in range(a, b)} == where


def test_pipeline_stages(spark, tmp_path, corpus):
    spark.createDataFrame([(1, "nothing like that in here at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = corpus.withColumn("score", F.lit(1))  # a column whose name operators use themselves
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.saved(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns, name
        docs = out
    final = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert final.count() == docs.count()
