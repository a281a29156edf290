"""The classifiers, the decontamination, the pipeline and edge cases against plain versions that share no code with them."""

import hashlib
import math
import os
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import common, decontaminate, embedding_dedup, language_id, mixing, ngram_join, quality, scan, sharding, token_files, toxicity
from test_llm import DOCS, brute_jaccard, corpus, library_rows, poisson_count, prose  # noqa: F401

DATA = "/root/testdata/sf0.01"


def letter_runs(text):
    """Runs of letters of a lower-cased text."""
    out, now = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def letter_and_digit_runs(text):
    """Runs of letters and digits of a lower-cased text."""
    return "".join(c if c.isalpha() or c.isdigit() or c.isnumeric() else " " for c in (text or "").lower()).split(" ")


@pytest.fixture(scope="module")
def long_text():
    """More than two pieces of the scanner, with words of any length in it."""
    rng = random.Random(9)
    return prose(rng, "en", 90_000) + " " + "q" * 300_000 + " " + prose(rng, "fr", 40_000) + "\n" + "end " * 3


# ---- scanner -------------------------------------------------------------------------------------------------------


def test_words_of_long_texts_are_told_apart(long_text):
    longs = ["a" + "c" * 4095 + "b", "b" + "c" * 4095 + "a", "ab" * 2048, "ba" * 2048]
    texts = [*longs, long_text, " ".join(longs), None, "É ế ß Ω x1y"]
    hashes = defaultdict(list)
    for group in scan.pieces(texts):
        words = scan.Words(group)
        for d, h in zip(words.doc.tolist(), words.hash.tolist(), strict=True):
            hashes[d].append(h)
    assert len({hashes[i][0] for i in range(4)}) == 4 and hashes[5] == [hashes[i][0] for i in range(4)]
    known = {}
    for i, t in enumerate(texts):
        own = letter_runs(t)
        assert len(own) == len(hashes[i])
        for w, h in zip(own, hashes[i], strict=True):
            assert known.setdefault(h, w) == w
    assert len(known) == len(set(known.values()))
    data = " ".join(longs).encode()
    assert len(set(ngram_join.shingles(" ".join(longs), 1).tolist())) == 4 and len(scan.space_words(data)[0]) == 4


# ---- toxicity ------------------------------------------------------------------------------------------------------


def plain_risk(z, n1, prior):
    loss = lambda x: math.log1p(math.exp(-x)) if x > 0 else -x + math.log1p(math.exp(x))
    as_positive = sum(loss(x) for x in z[:n1]) / n1
    negative = sum(loss(-x) for x in z[n1:]) / (len(z) - n1) - prior * sum(loss(-x) for x in z[:n1]) / n1
    return prior * as_positive, negative


def test_risk_and_its_direction():
    rng = np.random.default_rng(0)
    signs = set()
    for _ in range(60):
        n1, n0, prior = int(rng.integers(1, 9)), int(rng.integers(1, 9)), float(rng.uniform(0.05, 0.9))
        z = rng.normal(0, 3, n1 + n0)
        own = plain_risk(z.tolist(), n1, prior)
        assert np.allclose(toxicity.risk(z, n1, prior), own)
        signs.add(own[1] >= 0)
        descended = (lambda x: sum(plain_risk(x, n1, prior))) if own[1] >= 0 else (lambda x: -plain_risk(x, n1, prior)[1])
        g = toxicity.direction(z, n1, prior)
        for i in range(len(z)):
            up, down = z.tolist(), z.tolist()
            up[i] += 1e-5
            down[i] -= 1e-5
            assert abs((descended(up) - descended(down)) / 2e-5 - g[i]) < 1e-6
    assert signs == {True, False}


def test_cut_and_screen():
    rng = np.random.default_rng(1)
    for _ in range(30):
        p, u, prior = rng.normal(1, 1, 12), rng.normal(0, 1, 30), float(rng.uniform(0.1, 0.5))
        cut = toxicity._cut(p, u, prior)
        risk = lambda c: prior * np.mean(p < c) + max(0, np.mean(u >= c) - prior * np.mean(p >= c))
        values = np.sort(np.concatenate([p, u]))
        assert abs(risk(cut) - min(risk(c) for c in (values[1:] + values[:-1]) / 2)) < 1e-12
    keep = toxicity.screened(np.array([50, 5, 0]), 100, np.array([5, 5, 0]), 100)
    assert keep.tolist() == [True, False, False]


def test_features_are_the_distinct_words_and_beginnings(long_text):
    texts = ["Some some words; someone WORDS", None, "", long_text]
    doc, feature = toxicity.features(texts)
    for i, t in enumerate(texts):
        words = set(letter_runs(t))
        names = words | {("begin", w[:4]) for w in words if len(w) > 4}
        # two of them share a slot now and then
        assert len(names) * 0.97 <= (doc == i).sum() <= len(names)
    assert len(np.unique(doc << 20 | feature)) == len(doc)


def test_toxicity_without_labels_and_with_repeated_ids(spark, corpus):
    nothing = toxicity.fit(corpus, spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(True))
    assert {r.score for r in toxicity.score(corpus, nothing).collect()} == {0.0}
    many = spark.createDataFrame([(1, f"you moron {i}") for i in range(3000)] + [(2, f"kind words {i}") for i in range(3000)] + [(10 + i, prose(random.Random(i), "en", 20)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    ids = common.bounded_sample(many, "doc_id", 20)
    assert ids.count() == 20 and ids.distinct().count() == 20
    assert toxicity.score(many, toxicity.fit(many, labels, F.lit(True), 5, 20)).count() == many.count()


# ---- quality -------------------------------------------------------------------------------------------------------


def plain_statistics(text):
    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", data.lower()) if w]
    lower = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    words = [lower(w) for w in words]
    sizes = [len(w) for w in words]
    share = lambda a, b: math.log((a + 0.5) / (b + 1.0))
    capital, small = sum(65 <= c <= 90 for c in data), sum(97 <= c <= 122 or c >= 128 for c in data)
    mean = sum(sizes) / len(sizes) if sizes else 0
    spread = math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)) if sizes else 0
    marks = sum(chr(c) in "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~" for c in data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    n = len(words)
    return [
        math.log1p(len(data)), math.log1p(n), math.log1p(mean), math.log1p(spread), share(capital, small + capital), share(sum(48 <= c <= 57 for c in data), len(data)),
        share(sum(c in b",." for c in data), n), share(marks, len(data)), share(data.count(b"\n"), n), share(len(set(words)), n), share(max(Counter(words).values(), default=0), n),
        share(len(set(zip(words, words[1:], strict=False))), n), share(len(set(lines)), len(lines)), share(sum(s > 18 for s in sizes), n),
    ]


def test_statistics_of_whole_texts(long_text):
    for t in (None, "", " \n\n", "One, two.\nOne, two.\n\nÉtÉ 12 #!", "a" * 700_000, long_text, "line one\n" * 60_000):
        assert np.allclose(quality.text_statistics(t), plain_statistics(t), atol=1e-9), (t or "")[:40]


def test_discriminant_against_its_formula():
    rng = np.random.default_rng(3)
    k = quality.N_STATS
    mix = [rng.normal(size=(k, k)) for _ in range(2)]
    x = [rng.normal(size=(n, k)) @ m + c for n, m, c in ((80, mix[0], 0), (120, mix[1], 0.7))]
    model = quality.fit_moments(np.array([80.0, 120.0]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]), 0.1)
    both = np.concatenate(x)
    centre, scale = both.mean(0), both.std(0)
    log_p = []
    for c, a in enumerate(x):
        y = (a - centre) / scale
        cov = np.cov(y.T, bias=True)
        cov = 0.9 * cov + 0.1 * np.trace(cov) / k * np.eye(k)
        assert np.allclose(model.cholesky[c] @ model.cholesky[c].T, cov, atol=1e-8) and np.allclose(np.triu(model.cholesky[c], 1), 0)
        d = (both - centre) / scale - y.mean(0)
        log_p.append(math.log((81, 121)[c] / 202) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)))
    want = 1 / (1 + np.exp(np.clip(log_p[0] - log_p[1], -700, 700)))
    assert np.allclose(quality.score_statistics(model, both), want, atol=1e-6)
    low = np.tril(rng.normal(size=(k, k))) + 3 * np.eye(k)
    assert np.allclose(low @ quality.forward(low, both[:9].T), both[:9].T)


# ---- language ------------------------------------------------------------------------------------------------------


class PlainLanguage:
    """Dictionaries of counts by language: words first, then n-grams of the longest known length."""

    def __init__(self, texts, langs):
        self.names = sorted(set(langs))
        self.words, self.grams = Counter(), [Counter() for _ in range(language_id.MAX_N + 1)]
        for t, lang in zip(texts, langs, strict=True):
            for w in letter_runs(t):
                self.words[w, lang] += 1
        for w, lang in list(self.words):  # n-grams count once for each distinct word of a language
            for n in range(1, language_id.MAX_N + 1):
                for i in range(len(w) - n + 1):
                    self.grams[n][w[i : i + n], lang] += 1
        self.tables = [self._table(c) for c in [self.words, *self.grams[1:]]]

    def _table(self, counts):
        keys = {k for k, _ in counts}
        total = {x: sum(v for (_, lang), v in counts.items() if lang == x) for x in self.names}
        return {k: [math.log(counts[k, x] + 0.5) - math.log(total[x] + 0.5 * max(1, len(keys))) for x in self.names] for k in keys}

    def predict(self, text):
        words = letter_runs(text)
        if not words or not self.names:
            return "und", 0.0
        sums = [0.0] * len(self.names)
        for w in words:
            value = self.tables[0].get(w)
            for n in range(language_id.MAX_N, 0, -1):
                if value is not None:
                    break
                known = [self.tables[n][g] for g in (w[i : i + n] for i in range(len(w) - n + 1)) if g in self.tables[n]]
                if known:
                    value = [sum(k[j] for k in known) / len(known) - language_id.BACK_OFF * (language_id.MAX_N - n) for j in range(len(sums))]
            for j in range(len(sums)):
                sums[j] += value[j] if value else 0.0
        best = max(range(len(sums)), key=lambda j: (sums[j], -j))
        temper = max(1.0, math.sqrt(len(words)))
        return self.names[best], 1 / sum(math.exp((s - sums[best]) / temper) for s in sums)


def test_language_against_dictionaries(spark, corpus, long_text):
    rows = [(r.text, r.lang) for r in corpus.where("lang is not null and text is not null").dropDuplicates(["doc_id", "text"]).collect()]
    model, plain = language_id.fit_texts([t for t, _ in rows], [x for _, x in rows]), PlainLanguage([t for t, _ in rows], [x for _, x in rows])
    asked = [t for t, _ in rows] + [None, "", "12 !", "maisonette rivièrement", "zzz qqq", "house maison", long_text, "walk " * 5]
    names, score = language_id.score_texts(model, asked)
    for t, name, s in zip(asked, names, score.tolist(), strict=True):
        want = plain.predict(t)
        assert name == want[0] and abs(s - want[1]) < 1e-3, (t or "")[:50]
    tie = language_id.fit_texts(["aa bb", "aa bb"], ["y", "x"])
    assert language_id.score_texts(tie, ["aa", "bb aa", "cc"])[0] == ["x", "x", "x"]


def test_language_sample_is_bounded(spark):
    rows = [(None, f"word number {i}", "en") for i in range(400)] + [(7, "same text again", "en")] * 300 + [(i, f"mot numéro {i}", "fr") for i in range(40)] + [(9, "x " * 2000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    seen = []
    original = language_id.fit_texts

    def spy(texts, langs):
        seen.append((texts, langs))
        return original(texts, langs)

    language_id.fit_texts, both = spy, language_id.fit
    try:
        both(docs, None, 5)
        both(docs.repartition(3), None, 5)
        both(docs, None, 1000, 3000)
    finally:
        language_id.fit_texts = original
    assert [Counter(x) for _, x in seen[:2]] == [Counter({"en": 5, "fr": 5})] * 2
    assert sorted(seen[0][0]) == sorted(seen[1][0]) and len(set(seen[0][0])) == 10  # the same on every run, repeated rows once
    assert all(sum(len(t) for t, x in zip(*seen[2], strict=True) if x == lang) <= 3000 for lang in ("en", "fr"))


# ---- decontamination -----------------------------------------------------------------------------------------------


def least_edits(item, words):
    """Edits of an item against its nearest part of a text, cell by cell."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def contaminated(texts, items):
    """(text, item) of all items within their edits, by comparing all with all."""
    return {(i, k): d for i, t in enumerate(texts) for k, item in enumerate(items) if item and (d := least_edits(item, [w for w in letter_and_digit_runs(t) if w])) <= int(0.15 * len(item))}


def test_decontamination_of_items_with_numbers(spark):
    items = ["Compute 17 times 23 and add 5", "What is 12 + 34 ?", "1 2 3 4 5 6 7 8", "the", "On 2024-05-17 the store at 12 Elm St sold 340 units for $5 each", "?!"]
    texts = [
        "Compute 99 times 11 and add 7 please", "so compute 17 times 23, and add 5.", "what is it", "What is 12 34", "what is 12 - 35", "1 2 3 4 5 6 7 8 9", "1 2 3 4 5 6 77 8", "1 2 3 4 55 6 77 8",
        "On 2024-05-17 a store at 12 Elm St sold 340 units for $5 each", "On 2023-04-16 the store at 99 Elm St sold 10 units for $7 each", "x1 2 3", "THE end", "12 34 what is", "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.report(docs, bench).collect()}
    want = contaminated(texts, [[w for w in letter_and_digit_runs(t) if w] for t in items])
    assert got == want == {(1, 0): 0, (3, 1): 0, (5, 2): 0, (6, 2): 1, (8, 4): 1, (9, 3): 0, (11, 3): 0}
    assert {r.doc_id for r in decontaminate.clean(docs, bench.where("item_id <> 3")).collect()} == set(range(len(texts))) - {1, 3, 5, 6, 8}


def test_short_items_open_no_gate():
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 200)) for _ in range(50)] + ["here is the 7 word"]
    longer = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 20)) for _ in range(200)]
    index = decontaminate.build(list(range(203)), [*longer, "the", "is the", "w1 w2"])
    asked = []
    original = decontaminate._gated
    decontaminate._gated = lambda i, h: asked.append(len(h)) or original(i, h)
    try:
        found = decontaminate.batch_matches(index, texts)
    finally:
        decontaminate._gated = original
    assert found[-1] == [(200, 2, 3, 0), (201, 1, 3, 0)] and not asked
    assert [i for i, x in enumerate(found[:-1]) if any(k == 202 for k, *_ in x)] == [i for i, t in enumerate(texts[:-1]) if " w1 w2 " in f" {t} "]


def test_decontamination_against_all_windows(spark, long_text):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    items = [[word() for _ in range(n)] for n in (1, 2, 3, 6, 7, 9, 14, 21, 40)]
    items += [items[6], list(items[7][:14])]  # an equal item, and one that is part of another
    texts = []
    for i in range(70):
        body = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            item = rng.choice(items)
            own, n = list(item), rng.randrange(0, int(0.15 * len(item)) + 2)
            for _ in range(n):
                at, kind = rng.randrange(len(own)), rng.randrange(3)
                own[at : at + (kind != 1)] = [] if kind == 2 and len(own) > 1 else [word()]
            at = rng.randrange(len(body) + 1)
            body[at:at] = own
        texts.append(" ".join(body))
    texts += [None, "", texts[3], texts[3], "one"]
    hidden = long_text[:300_000] + " " + " ".join(items[8]) + " " + long_text[300_000:]
    want = contaminated(texts, items)
    docs = spark.createDataFrame(list(enumerate([*texts, hidden])), "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as item_text").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(77, None), (78, "?!")], "item_id long, text string")
    for block in (20_000, 4):
        got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.report(docs, bench, block).collect()}
        assert (len(texts), 8) in got
        got = {k: v for k, v in got.items() if k[0] < len(texts)}
        assert got.items() <= want.items() and len(got) >= 0.97 * len(want)
        kept = decontaminate.clean(docs, bench, block)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id < len(texts)} == set(range(len(texts))) - {i for i, _ in got}


def test_recall_holds_on_fresh_copies():
    rng = np.random.default_rng(123)
    for n in (7, 14, 27, 33, 59, 120):
        items = rng.integers(1, 1 << 62, (20, n)).astype(np.uint64)
        index = decontaminate._walks(items, decontaminate.max_edits(n))
        base = items[rng.integers(0, 20, 400)]
        other = np.array([(decontaminate.edited(r.tolist(), decontaminate.max_edits(n), rng) + rng.integers(1, 1 << 62, n).tolist())[:n] for r in base], np.uint64)
        met = np.zeros(400, bool)
        for w in range(index[0]):
            met |= (decontaminate.samples(decontaminate.embed(base, w), w) == decontaminate.samples(decontaminate.embed(other, w), w)).any(1)
        assert met.mean() >= decontaminate.RECALL - 0.01 and index[1] >= decontaminate.RECALL


# ---- n-gram join ---------------------------------------------------------------------------------------------------


def test_shingles_of_long_texts(long_text):
    for words in (1, 3, 5):
        own = long_text.encode().split()
        assert len(ngram_join.shingles(long_text, words)) == len({tuple(own[i : i + words]) for i in range(len(own) - words + 1)})


def test_join_of_rows_without_ids(spark):
    """Rows that lack an id, or share one, are told apart by their texts; none meets another's class."""
    base = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    near = [b.replace(f"w{i}x0 ", "") for i, b in enumerate(base)]
    rows = [(None, t) for t in base + near] + [(5, t) for t in base] + [(100 + i, t) for i, t in enumerate(near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as cls", "2 as low", "3 as n").repartition(6)
    got = ngram_join._components(docs, 3, 90, 100).collect()
    assert len(got) == len(rows) and {(r.n_shingles, r.n_links, r.component_id) for r in got} == {(38, 3, 5), (37, 3, 5)}


# ---- real tables ---------------------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_held_out_accuracy(spark):
    from quarry.llm import queries

    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    toxic = [(labels[r.doc_id].toxic, r.predicted) for r in queries.op1_toxicity(spark, DATA).where("held_out").collect() if r.doc_id in labels]
    assert np.mean([a == b for a, b in toxic]) > 0.95
    good = [(labels[r.doc_id].quality, r.predicted) for r in queries.op2_quality(spark, DATA).where("held_out").collect() if r.doc_id in labels]
    assert np.mean([a == b for a, b in good]) > 0.85
    told = [(langs[r.doc_id], r.lang_pred) for r in queries.op10_language_id(spark, DATA).where("held_out").collect() if r.lang_pred != "und" and langs[r.doc_id]]
    assert np.mean([a == b for a, b in told]) > 0.95


# ---- clashing names and nulls everywhere ---------------------------------------------------------------------------

TAKEN = "score stats sums packed q_positive q_label lang_pred cls low copies n grp label id sig tag need task home away own value digest refers_to shard slot size q_key q_cell s a b f c part before symbols start item_id edits doc held_out text_hash q_id q_hash q_rank q_n q_sum".split()


def test_other_columns_do_not_matter(spark, corpus):
    crowded = corpus
    for name in TAKEN:
        crowded = crowded.withColumn(name, F.lit("taken"))
    labels = corpus.where("doc_id is not null").select("doc_id", F.lit(1).alias("quality"), F.contains("text", F.lit("moron")).cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    bench = spark.createDataFrame([(1, "the house stands near river with green trees")], "item_id long, text string")
    model = toxicity.fit(corpus, labels, F.lit(True))
    languages = language_id.fit(corpus)
    calls = {
        "toxicity": lambda d: toxicity.score(d, model),
        "quality": quality.statistics,
        "decontaminate": lambda d: decontaminate.report(d, bench),
        "ngram_join": lambda d: ngram_join.components(d, 3, 90, 100),
        "sharding": lambda d: sharding.assign(d, 5),
        "language": lambda d: language_id.predict(d, languages),
    }
    for name, call in calls.items():
        assert sorted(map(str, call(crowded).collect())) == sorted(map(str, call(corpus).collect())), name
    # what keeps rows keeps them whole
    for keep in (lambda d: language_id.accepted(d, languages), lambda d: ngram_join.keep_one(d, 5, 80, 100), lambda d: decontaminate.clean(d, bench)):
        out = keep(crowded)
        assert out.columns == crowded.columns and sorted(map(str, out.select(*DOCS_COLUMNS).collect())) == sorted(map(str, keep(corpus).collect()))


DOCS_COLUMNS = [c.split()[0] for c in DOCS.split(", ")]


def test_null_columns(spark):
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, None, None, None, None), (None, "a b", None, None, None)], DOCS)
    none = spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score(nulls, toxicity.fit(nulls, none, F.lit(True))).count() == 5
    stats = quality.statistics(nulls)
    assert quality.score(stats, quality.fit(stats, none, F.lit(True))).count() == 5
    assert language_id.predict(nulls, language_id.fit(nulls)).count() == 5
    assert ngram_join.components(nulls, 3, 90, 100).count() == 5 and ngram_join.keep_one(nulls, 5, 80, 100).count() >= 3
    assert sharding.assign(nulls, 3).count() == 5 and mixing.replicate(nulls, total=50).count() > 0
    empty_bench = spark.createDataFrame([(None, None)], "item_id long, text string")
    assert decontaminate.report(nulls, empty_bench).count() == 0 and decontaminate.clean(nulls, empty_bench).count() == 5
    assert embedding_dedup.links(spark.createDataFrame([(None, None), (1, None)], "vec_id long, embedding array<float>")).count() == 2


# ---- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, corpus, tmp_path):
    """Each stage, on what the one before it kept, against the plain version of its operator."""
    rng = random.Random(21)
    secret = [f"{a}{i}" for i, a in enumerate("quiz item words that nobody else would ever write down here".split())]
    secret = [unicodedata.normalize("NFC", "".join(c for c in w if c.isalpha())) + "xyz"[i % 3] for i, w in enumerate(secret)]
    extra = [(500, prose(rng, "en", 30) + " " + " ".join(secret) + " " + prose(rng, "en", 10), "en", "s1", 1), (501, prose(rng, "en", 40), "en", "s2", 1)]
    extra += [(502, extra[1][1] + " more", "en", "s2", 1), (503, extra[1][1], "en", "s2", 1)]
    spark.createDataFrame([(1, " ".join(secret))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = corpus.unionByName(spark.createDataFrame(extra, DOCS))
    key = lambda rows: Counter((r.doc_id, r.text) for r in rows)
    stages = dict(corpus_pipeline.STAGES)

    before = docs.collect()
    told = sorted({(r.doc_id, r.text, r.lang) for r in before if r.lang and r.text and len(r.text) <= 200_000}, key=str)
    plain = PlainLanguage([t for _, t, _ in told], [x for *_, x in told])
    out = common.saved(stages["language_id"](spark, docs, str(tmp_path)), "p1")
    verdict = {r.text: plain.predict(r.text) for r in before}
    assert key(out.collect()) == key(r for r in before if verdict[r.text][0] != "und" and verdict[r.text][1] >= 0.5)

    before = out.collect()
    order = sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    low = brute_jaccard([(i, r.text) for i, r in enumerate(order)], 5, 80, 100)
    want, seen = [], set()
    for i, r in enumerate(order):
        least = order[low[i][2]].doc_id
        if (r.doc_id, r.text) not in seen and (r.doc_id is None or r.doc_id == least):
            want.append(r)
            seen.add((r.doc_id, r.text))
    out = common.saved(stages["ngram_jaccard"](spark, out, str(tmp_path)), "p2")
    assert key(out.collect()) == key(want) and {501} <= {r.doc_id for r in want} and not {502, 503} & {r.doc_id for r in want}

    before = out.collect()
    bad = {before[i].text for i, _ in contaminated([r.text for r in before], [secret])}
    out = common.saved(stages["decontamination"](spark, out, str(tmp_path)), "p3")
    assert bad and key(out.collect()) == key(r for r in before if r.text not in bad)

    before = out.collect()
    n = Counter(r.source for r in before)
    weight = {s: k**mixing.TEMPER for s, k in n.items()}
    want = Counter()
    for r in before:
        name = f"{mixing.SEED}:{'' if r.doc_id is None else r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}"
        u = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        want[r.doc_id, r.text] += poisson_count(u, weight[r.source] / sum(weight.values()) * len(before) / n[r.source])
    out = common.saved(stages["mixing"](spark, out, str(tmp_path)), "p4")
    assert key(out.collect()) == +want and out.columns == docs.columns

    got = Counter((r.doc_id, r.n_tokens) for r in stages["token_files"](spark, out, str(tmp_path)).collect())
    from quarry.llm.queries import tokenizer_path

    assert got == Counter((i, len(ids)) for i, ids in library_rows(out, tokenizer_path()))
    assert token_files.END_ID == 1
