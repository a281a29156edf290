import numpy as np
from pyspark.sql import functions as F

from quarry.operators import compression, dedup, gold, ranking, sessions, training, vectors
from quarry.sources import html


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    q, r = rng.normal(size=(7, 5)), rng.normal(size=(60, 5))
    r[9] = r[3]
    r[11] = 0
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r)] + [(99, None)], "row_id long, vector array<double>")
    got = {}
    for x in vectors.top_k(queries, rows, 4, query_block=3, row_block=16).collect():
        got[x.query_id, x.rank] = x.row_id
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    sims = np.round(unit(q) @ unit(r).T, 9)
    for i in range(7):
        want = sorted(range(60), key=lambda j: (-sims[i, j], j))[:4]
        assert [got[i, k] for k in range(1, 5)] == want


def test_ensure_gold(spark):
    rows = [(1, 10, 0.9, 0.9, 2), (1, 11, 0.8, 0.8, 2), (1, 12, 0.5, 0.5, 0), (2, 10, 0.9, 0.9, 2), (2, 11, 0.8, 0.8, 2), (2, 12, 0.1, 0.1, 0)]
    found = spark.createDataFrame(rows, "query_id long, row_id long, sim double, boosted double, tier int")
    got = {(x.query_id, x.rank): x.row_id for x in ranking.ensure_gold(found, 2).collect()}
    assert got == {(1, 1): 10, (1, 2): 12, (2, 1): 10, (2, 2): 11}


def test_similar_pairs_and_greedy(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (3, "a b c d e f g h i j"), (4, ""), (5, None), (6, "z y")], "doc_id long, text string")
    assert [(x.a, x.b, round(x.jaccard, 4)) for x in dedup.similar_pairs(docs).collect()] == [(1, 2, round(9 / 11, 4))]
    ranked = spark.createDataFrame([(1, 1, "a b c d"), (1, 2, "a b c d"), (1, 3, "a b c e"), (1, 4, "x")], "query_id long, rank int, text string")
    assert sorted(x["rank"] for x in dedup.greedy_keep(ranked, 0.5).collect()) == [1, 4]
    assert sorted(x["rank"] for x in dedup.greedy_keep(ranked, 0.6).collect()) == [1, 3, 4]  # equal to the threshold stays
    assert sorted(x["rank"] for x in dedup.greedy_keep(ranked, 0.6, at_least=4).collect()) == [1, 2, 3, 4]


def test_gold(spark):
    records = spark.createDataFrame([("c:q1", "Q", "A", "u", [" n ", ""], ["p"]), ("x", "R", "B", "u", [], [])], "id string, query string, reference_answer string, url string, nuggets array<string>, gold_passages array<string>")
    q = records.select("id", "query", "reference_answer", "url", gold.category(F.col("id")).alias("category"))
    full = gold.with_children(q, gold.children(records, "nuggets", "nugget"), gold.children(records, "gold_passages", "passage"))
    got = {x.id: (x.category, x.nuggets, x.passages) for x in full.collect()}
    assert got == {"c:q1": ("c", ["n"], ["p"]), "x": ("uncategorized", [], [])}
    assert {x.title for x in gold.documents(full).collect()} == {"C Information", "Catalog Information"}


def test_downtimes_and_sessions(spark):
    events = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", "up"), (2, 1, "2024-01-01 00:01:00", "error"), (3, 1, "2024-01-01 00:02:00", "error"), (4, 1, "2024-01-01 00:03:05", "up"), (5, 2, "2024-01-01 00:00:00", "error")], "event_id long, user_id long, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {x.user_id: (x.seconds, x.duration) for x in sessions.downtimes(events, ["user_id"], F.col("kind") == "error").collect()}
    assert got[1] == (125, "00:02:05") and got[2][0] is None
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(8)], "conv_id long, turn long, role string, text string")
    assert {x.turn: x.question for x in sessions.previous_question(turns).collect()} == {1: "t0", 3: "t2", 5: "t4", 7: "t6"}
    assert sessions.state(turns).first().last_question == "t6"


def test_html(spark):
    page = '<html><nav><ul><li><a href="/a">a</a></li></ul></nav><main><h1>T</h1><p>one<p>two &amp; <a href="/b">b</a><h2>S</h2><ul><li>x y<li>z</ul><script>var p="</p>"</script></main><div id="coursetext"><h3>C</h3>loose</div></html>'
    blocks = html.page_blocks("http://x.example/p", page)
    assert [(b["tag"], b["text"], b["items"]) for b in blocks if not b["panel"]] == [("title", "T", []), ("p", "one", []), ("p", "two & b", []), ("h2", "S", []), ("ul", "", ["x y", "z"])]
    assert [b["text"] for b in blocks if b["panel"] == "coursetext"] == ["C", "loose"]
    pages = spark.createDataFrame([(1, "http://x.example/p", page), (2, "http://x.example/q", None)], "page_id long, url string, html string")
    found = {tuple(x.path): (x.text, x.lists) for x in html.sections(html.blocks(pages)).where("page_id = 1").collect()}
    assert found[("T",)][0] == ["one", "two & b"] and found[("T", "S")][1] == [["x y", "z"]]
    nav = html.parse('<div class="menu"><ul><li>a</li></ul></div>').find(lambda n: n.tag == "ul")
    assert html.navigational(nav)


def test_small_ones(spark):
    assert compression.surroundings("It takes 12 credits to finish.") == "It takes 12 credits to finish."
    t = training.triplets(spark.createDataFrame([(0, 1), (100, 2)], "query_id long, label int"), spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "row_id long, label int"))
    assert {x.query_id: (x.positive, x.negative) for x in t.collect()} == {0: (2, 1), 100: (1, 2)}


def test_references_without_a_semicolon_are_text():
    blocks = html.page_blocks("http://x.example/p", "<h1>a&amp;&amp</h1><p>R&D &copy 1 &ampx; &lt;b&gt; <a href='/q?a=1&copy=2'>c</a></p>")
    assert [b["text"] for b in blocks] == ["a&&amp", "R&D &copy 1 &ampx; <b> c"]
    assert blocks[1]["links"][0]["url"] == "http://x.example/q?a=1&copy=2"


def test_blocks_grow_with_both_sides_and_slices_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 8)))], "query_id long, vector array<double>")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "row_id long, vector array<double>")
    assert vectors.block_counts(queries, rows) == (1, 1)  # 45,000 queries took 45 copies of each row before, now a block has 64 MB
    want = {(x.query_id, x["rank"]): (x.row_id, x.sim) for x in vectors.top_k(queries, rows, 5).collect()}
    monkeypatch.setattr(vectors, "CELLS", 700)
    monkeypatch.setattr(vectors, "QUERY_BYTES", 1024)
    monkeypatch.setattr(vectors, "ROW_BYTES", 8192)
    assert vectors.block_counts(queries, rows) == (3, 3)
    assert {(x.query_id, x["rank"]): (x.row_id, x.sim) for x in vectors.top_k(queries, rows, 5).collect()} == want and len(want) == 200


def test_nearest_rows_of_copies_ties_and_queries_without_direction(spark):
    rng = np.random.default_rng(5)
    words = rng.integers(-1, 2, size=(3000, 6)).astype(float)  # few distinct vectors: copies and ties abound
    ids = rng.permutation(9000)[:3000] - 1000
    queries = [(i, v.tolist()) for i, v in enumerate([words[0], words[0], np.zeros(6), *rng.normal(size=(20, 6))])]
    rows = list(zip(ids.tolist(), words.tolist(), strict=True))
    made = vectors.top_k(spark.createDataFrame(queries, "query_id long, vector array<double>"), spark.createDataFrame(rows, "row_id long, vector array<double>"), 30)
    got = {(x.query_id, x["rank"]): (x.row_id, x.sim) for x in made.collect()}
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    sims = np.round(unit(np.array([v for _, v in queries])) @ unit(words).T, 9)
    assert len(got) == 30 * len(queries)
    for i, s in enumerate(sims):
        want = np.lexsort((ids, -s))[:30]
        assert [got[i, k + 1] for k in range(30)] == [(ids[j], s[j]) for j in want]


def test_equal_vectors_are_compared_once_and_few_cosines_are_made_in_double_precision(monkeypatch):
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(20_000, 16))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    place, ids, start, n = vectors.distinct(np.concatenate([rows, rows, -rows[:5]]), np.arange(40_005)[::-1].copy(), 3)
    assert len(place) == 20_005 and len(ids) == 40_005 and sorted(set(n.tolist())) == [1, 2]
    made = []
    real = np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: made.append(len(a)) or real(how, a, b))
    found = [x for _, r, _ in vectors.nearest_distinct(rows[:300], rows, 10) for x in r.reshape(-1, 10)[:, 0]]
    assert found == list(range(300)) and sum(made) < 300 * 20_000 // 50


def test_words_of_one_set_are_not_moved_and_keep_their_place(spark):
    import pyarrow as pa

    counts = np.array([1, 9, 2, 5, 1, 3, 7, 70], np.uint16)  # a word's bucket is the word modulo 8; 4 and 0 occur once
    got = dedup.rarest(pa.array([[0, 1, 2, 3, 4, -3], [7], [1, 2, 3, 6, 7, 9, 10, 11, 14, 15]], pa.list_(pa.int64())), counts, 0.5)
    assert got.to_pylist() == [[None, None, 2, -3], [7], [2, 10, 3, 11, 6, 14]]
    assert dedup.rarest(pa.array([], pa.list_(pa.int64())), counts, 0.5).to_pylist() == []


def test_similar_pairs_whatever_the_table_of_counts_and_groups(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.choice(60, size=int(rng.integers(1, 40)), replace=False)) for _ in range(60)]
    texts += [" ".join([*t.split()[: max(1, len(t.split()) - i % 4)], f"own{i}"]) for i, t in enumerate(texts)] + ["", None]
    sets = [set((t or "").split()) for t in texts]
    first = {frozenset(x): i for i, x in reversed(list(enumerate(sets))) if x}.values()
    want = {(a, b) for a in first for b in first if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.8}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert len(want) > 20
    for buckets, words, labelled in ((3, dedup.GROUP_WORDS, dedup.LABELLED), (1 << 22, 40, 1)):
        monkeypatch.setattr(dedup, "GROUP_WORDS", words)
        monkeypatch.setattr(dedup, "LABELLED", labelled)
        found = dedup.similar_pairs(docs, buckets=buckets).collect()
        assert {(x.a, x.b) for x in found} == want and len(found) == len(want)
        assert all(x.jaccard == len(sets[x.a] & sets[x.b]) / len(sets[x.a] | sets[x.b]) for x in found)


def test_term_weights_take_tasks_by_items(spark, monkeypatch):
    from quarry.operators import tfidf

    monkeypatch.setattr(tfidf, "TASK_ITEMS", 10)
    items = spark.createDataFrame([(i // 4, i % 4, i % 4 == 0, f"word{i % 3} other text") for i in range(100)], "group_id long, item_id long, is_query boolean, text string")
    found = tfidf.scores(items)
    assert found.count() == 75 and found.rdd.getNumPartitions() == 10  # whatever their sizes, tasks are not merged


def test_batches_are_cut_into_slices():
    import pyarrow as pa

    from quarry.sources import shared

    batch = pa.RecordBatch.from_arrays([pa.array(range(600))], ["x"])
    assert [b.num_rows for b in shared.slices([batch])] == [256, 256, 88]


def test_parities_differ_at_most_as_words_do(spark):
    rows = spark.createDataFrame([([1, 2, 3, 513], [1, 2, 3]), ([8, 16, -5], [8, -5, 99]), ([], [7])], "x array<long>, y array<long>")
    side = lambda c: F.array(*dedup.parities(F.col(c)))
    found = rows.select("x", "y", F.aggregate(F.zip_with(side("x"), side("y"), lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("int")), F.lit(0), lambda s, n: s + n).alias("d")).collect()
    assert [r.d for r in found] == [1, 2, 1] == [len(set(r.x) ^ set(r.y)) for r in found]
