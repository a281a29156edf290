"""Containment, token matching, beams, sentence choice and choices that were undefined, against plain versions."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.operators import beam, chunking, compression, containment, gold, tfidf, token_matching, training


def test_contained_strings_equal_all_pairs(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab/é.") for _ in range(n))
    hay = [word(rng.randrange(0, 60)) for _ in range(80)] + [None, "", "x" * 400, "a"]
    asked = [h[i : i + n] for h in hay if h for i, n in [(rng.randrange(len(h)), rng.randrange(1, 40))]] + [word(n) for n in range(1, 30)] + ["", None, "x" * 17, "x" * 401, "%_\\"]
    a, h = spark.createDataFrame([(x,) for x in asked], "part string").repartition(3), spark.createDataFrame([(x, 1) for x in hay], "url string, gram int")
    want = {(x, y) for x in asked if x for y in hay if y and x in y}
    assert {r.part for r in containment.contained(a, "part", h, "url").collect()} == {x for x, _ in want}
    found = [(r.needle, r.within) for r in containment.pairs(a, "part", h, "url").collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert containment.contained(a.limit(0), "part", h, "url").count() == containment.contained(a, "part", h.limit(0), "url").count() == 0


def plain_matching(reference, answer, weights, vector):
    def best(own, others):
        cos = lambda x, y: float(x @ y / math.sqrt((x @ x) * (y @ y)))
        each = [(weights.get(t, max(weights.values(), default=1.0)) if weights is not None else 1.0, max(cos(vector(t), vector(o)) for o in others)) for t in own]
        total = sum(w for w, _ in each)
        return sum(w * c for w, c in each) / total if total else 0.0

    if not reference or not answer:
        return 0.0, 0.0, 0.0
    p, r = best(answer, reference), best(reference, answer)
    return p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0


def test_greedy_matching_equals_a_loop_over_pairs(spark, monkeypatch):
    monkeypatch.setattr(token_matching, "STRIP_CELLS", 20)
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["credit", "credits", "course", "the", "a", "hour", "hours"]) for _ in range(rng.randrange(0, 9)))
    rows = [(i, text(), text()) for i in range(30)] + [(90, None, "the"), (91, "the", "!"), (92, "Zebra, the", "ZEBRA the the")]
    df = spark.createDataFrame(rows, "id long, reference string, answer string")
    weights = {r.token: r.weight for r in token_matching.document_weights(df).collect()}
    references = {r or "" for _, r, _ in rows}
    for t, w in weights.items():
        assert abs(w + math.log((sum(t in r.lower().replace(",", "").split() for r in references) + 1) / (len(references) + 1))) < 1e-12
    split = lambda t: "".join(c if c.isascii() and c.isalpha() else " " for c in (t or "").lower()).split()
    for given, vector in ((None, token_matching.gram_vector), (weights, token_matching.gram_vector), (weights, token_matching.letter_counts)):
        table = spark.createDataFrame(list(weights.items()), "token string, weight double") if given else None
        found = {r.id: (r.precision, r.recall, r.f1) for r in token_matching.scores(df, table, vector).collect()}
        for i, reference, answer in rows:
            assert np.allclose(found[i], plain_matching(split(reference), split(answer), given, vector), atol=1e-9), (reference, answer)
    whole = token_matching.scores(df.where("id = 92"), baseline=0.5).first()
    assert np.allclose([whole.recall, whole.precision], [1.0, 1.0])


def every_sequence(model, most, penalty):
    """All sequences a decoder may make, with their scores, by exhaustive search."""
    out, stack = [], [((), 0.0)]
    while stack:
        words, score = stack.pop()
        for word, p in model.get(words[-1] if words else beam.START, []):
            pairs = list(itertools.pairwise(words))
            if word == beam.END:
                out.append(((score + p) / (len(words) + 1), words))
            elif not words or (words[-1], word) not in pairs:
                grown = (*words, word), score + (p * penalty if word in words else p)
                if len(grown[0]) == most:
                    out.append((grown[1] / most, grown[0]))
                else:
                    stack.append(grown)
    return [" ".join(w) for _, w in sorted(out, key=lambda x: (-round(x[0], 12), x[1]))]


def test_full_width_equals_exhaustive_search():
    passages = ["The fee is due. The fee is high in May and the rent is due in full in June.", "In May the fee is due and the rent is high in full.", None, ""]
    model = beam.pair_model(passages, "When is the fee due?")
    every = every_sequence(model, 6, 1.2)
    assert beam.decode(model, 10**6, 10**6, 6, 1.2) == every and len(every) > 15
    narrow = beam.decode(model, 5, 3, 6)
    assert 0 < len(narrow) <= 3 and set(narrow) <= set(every)
    assert all(len(set(p := list(itertools.pairwise(c.split())))) == len(p) for c in beam.decode(beam.pair_model(["a b a b a b a."], ""), 5, 3, 50))
    assert beam.decode({}, 5, 3) == [] == beam.decode(beam.pair_model([None, " "], None))


def test_questions_lead_the_pairs():
    passages = ["Tuition is low. Housing is costly. Tuition rises."]
    assert beam.decode(beam.pair_model(passages, "What about housing, costly?"))[0] == "Housing is costly."


def test_a_sequence_has_few_continuations():
    """What a decoder does not come to is not put in order, and no sequence is grown by all that may follow."""
    asked = []

    class Told(beam.PairModel):
        def get(self, word, default=None):
            asked.append(word)
            return super().get(word, default)

    passage = " ".join(f"go w{i} w{i % 7} end." for i in range(3000)) + "\u00a0 Odd\tlast! ?x \x1c\u03a3\u03a3."
    told = Told([passage, None, ""], "go W1 \u03c3\u03c2?")
    found = beam.decode(told)
    assert found == beam.decode(beam.pair_model([passage, None, ""], "go W1 \u03c3\u03c2?")) and len(found) == 3 and len(set(asked)) < 60
    counted = beam.pair_model(["b a a. c a a! b", "b c"], "a")
    assert [w for w, _ in counted[beam.START]] == ["b", "c"] and counted["a"] == [("a!", math.log(0.5)), ("a.", math.log(0.5))] and counted["c"][0] == ("a", math.log(2 / 3))


def test_passages_are_dealt_by_their_bytes(spark):
    rows = spark.range(400).select("id", F.repeat(F.lit("x"), 40_000).alias("passage")).coalesce(1)
    dealt = beam.dealt(rows, "id", "passage")
    assert dealt.rdd.getNumPartitions() == max(4, -(-400 * 40_000 // beam.TASK_BYTES)) and dealt.count() == 400
    assert beam.dealt(rows.limit(0), "id", "passage").count() == 0


def test_best_candidate_by_score(spark):
    rows = [("q", ["The fee is due now. Pay the fee in May."]), ("q", []), (None, None)]
    df = spark.createDataFrame(rows, "question string, passages array<string>").withColumn("found", beam.candidates(F.col("question"), F.col("passages")))
    got = df.select("found", beam.best(F.col("found"), F.lit("fee due")).alias("best")).collect()
    assert got[0].best in got[0].found and [r.best for r in got[1:]] == [None, None]
    assert spark.range(1).select(beam.best(F.array(F.lit("I do"), F.lit("the fee now"), F.lit("a fee due")), F.lit("fee due soon")).alias("b")).first().b == "a fee due"


def test_sentences_by_column_weights(spark):
    """The sentence choice of a row has the weights of the grouped scores."""
    rng = random.Random(7)
    sentence = lambda: " ".join(rng.choice(["credit", "hours", "the", "course", "lab", "fee", "x"]) for _ in range(rng.randrange(3, 9)))
    rows = [(i, sentence(), rng.choice([". ", "! ", "?\n"]).join(sentence() for _ in range(rng.randrange(0, 12)))) for i in range(40)] + [(90, None, "Short. Tiny."), (91, "fee", None)]
    df = spark.createDataFrame(rows, "group_id long, query string, text string")
    items = []
    for i, query, passage in rows:
        parts = [s for s in (x.strip() for x in tfidf._END.split(passage or "")) if len(s) > 20]
        items += [(i, k, False, s) for k, s in enumerate(parts)] + [(i, -1, True, query)]
    scored = {(r.group_id, r.item_id): r.tfidf for r in tfidf.scores(spark.createDataFrame(items, "group_id long, item_id long, is_query boolean, text string"), max_features=500).collect()}
    for r in tfidf.relevant_sentences(df).collect():
        own = [(k, s) for i, k, q, s in items if i == r.group_id and not q]
        top = sorted(sorted(own, key=lambda x: (-round(scored[r.group_id, x[0]], 9), x[0]))[:3])
        assert r.extract == (". ".join(s for _, s in top) + "." if own else next(p or "" for i, _, p in rows if i == r.group_id))


def test_compression_of_each_passage(spark):
    long = "A sentence about nothing at all goes on. " * 12 + "The fee is 500 dollars in May. " + "More words about nothing follow here. " * 10
    rows = [(1, "fee", long, 2), (2, "fee", "short", 1), (3, None, None, 1), (4, "fee", long, 1), (5, "fee", "no sentence ends here " * 20, None)]
    found = {r.id: r.compressed for r in compression.compress(spark.createDataFrame(rows, "id long, query string, text string, tier int")).collect()}
    assert found[2] == "short" and found[3] is None and len(found[1]) < 0.6 * len(long) and found[5] == rows[4][2]
    assert len(rules.STOPWORDS) > 0


def test_imports_take_whole_records_in_order(spark):
    schema = "id string, query string, reference_answer string, url string, nuggets array<string>, position int"
    rows = [("a", "second", "s", "", ["n2"], 2), ("a", "first", "f", "", ["n1"], 1), (None, "x", "", "", [], 3), ("b", None, "", "", ["lost"], 4), ("a", "third", "t", "", ["n3"], 5)]
    records = spark.createDataFrame(rows, schema).repartition(4)
    none = gold.import_records(spark.createDataFrame([], schema), records, overwrite=True).limit(0)
    nuggets = spark.createDataFrame([], "question_id string, pos int, nugget string")
    for overwrite, query, nugget in ((False, "first", "n1"), (True, "third", "n3")):
        assert [(r.id, r.query) for r in gold.import_records(none, records, overwrite).collect()] == [("a", query)]
        assert [r.nugget for r in gold.import_children(nuggets, records, none.select("id"), "nuggets", "nugget", overwrite).collect()] == [nugget]
    assert {r.query for r in gold.import_records(none, records.drop("position")).collect()} == {"first"}  # the smallest record


def test_one_bad_tree_fails_no_other(spark):
    good = '[{"title": null, "text": ["a"], "subsections": [{"title": "deep", "text": ["b"]}]}]'
    pages = spark.createDataFrame([("P", "u1", good), ("Q", "u2", "JSON error: no rows"), (None, "u3", '[{"title": "t", "text": ["c"]}]'), ("R", "u4", None)], "page_title string, page_url string, tree string")
    assert {(r.page_url, r.title, r.text[0]) for r in chunking.sections(pages).collect()} == {("u1", "P", "a"), ("u1", "P - deep", "b"), ("u3", "t", "c")}


def test_a_seeded_draw_is_a_share_of_the_rows(spark):
    rows = spark.range(4000).select("id", training.drawn(F.col("id"), 0.2, 1).alias("a"), training.drawn(F.col("id"), 0.2, 2).alias("b"))
    again = rows.repartition(7)
    count = rows.agg(F.count_if("a"), F.count_if("b"), F.count_if(F.col("a") & F.col("b"))).first()
    assert 700 < count[0] < 900 and 700 < count[1] < 900 and count[2] < 250 and again.where("a").count() == count[0]
