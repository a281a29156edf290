import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from quarry.functions import rules, text, web
from quarry.operators import chunking, evaluation, ranking


def test_repeated_words_and_space(one):
    assert one(text.merge_repeated_words(F.lit("audit option Option option?"))) == "audit option?"
    assert one(text.clean_space(F.lit(" a  b\n c "))) == "a b c"


def test_domain_rules(one):
    assert one(text.domain_rules(F.lit("what is the gpa"))) == "what is the minimum GPA requirement"
    assert one(text.domain_rules(F.lit("GPA requirement"))) == "GPA requirement"  # a word of the expansion is near
    assert one(text.domain_rules(F.lit("academic probation rules"))) == "academic probation rules"
    assert one(text.transform_query(F.lit(" Phd Time Limit? "), {"phd time limit?": "x"})) == "x"


def test_query_helpers(one):
    assert one(text.clarify(F.lit("visa?"))) == "visa? visa full-time enrollment requirement"
    assert one(text.clarify(F.lit("nothing"))) is None
    assert one(text.intent(F.lit("what GPA"))) == "grading"
    assert one(text.boosted(F.lit("degree credits"))) == "degree credits credits degree"
    assert one(text.key_terms(F.lit("the thesis option"))) == ["thesis", "option", "thesis option"]
    assert one(text.valid_rewrite(F.lit("CS 725 credits"), F.lit("credits of CS 725"))) is True
    assert one(text.valid_rewrite(F.lit("CS 725 credits"), F.lit("credits of the course"))) is False
    assert one(text.canned_reply(F.lit("Hi there, thanks!"))) == f"{rules.REPLIES['greeting']} {rules.REPLIES['thanks']}"
    assert one(text.canned_reply(F.lit("bye"), replies={"farewell": "x"})) == "x"
    assert one(text.canned_reply(F.lit("zzz"))) is None


def test_passages(one):
    p = F.lit("First one here. The credits matter most! End.")
    assert one(text.snippet(p, F.lit("credits matter"))) == "The credits matter most!"
    assert one(text.snippet(F.lit("aa bb cc"), None, 5)) == "aa"
    assert one(text.fragment_url(F.lit("http://x/y#z"), F.lit("a b"))) == "http://x/y#:~:text=a%20b"
    assert one(text.fragment_url(F.lit("http://x/y.PDF"), F.lit("a b"))) == "http://x/y.PDF"
    assert one(text.clean_answer(F.lit("[Source 1] A. B. C. D."))) == "A. B. C."
    assert one(text.clean_question(F.lit("1. What is the fee for CS? Next"))) == "What is the fee for CS?"
    assert one(text.clean_question(F.lit("What is the process?"))) is None
    assert one(text.credits_of(F.lit("x Credits: 4 y"))) == "4"
    assert one(text.clock(F.lit(3725))) == "01:02:05"
    assert one(text.band(F.lit(50.0))) == "yellow"
    assert one(text.run_date(F.lit("20250102_030405"))) == "2025-01-02 03:04:05"
    assert one(text.hyde_clean(F.lit("Answer: the rule\nis this."))) == "The rule is this"


def test_addresses(one):
    g = "http://x.example/graduate/"
    tier = lambda u, t="": one(web.tier(F.lit(u), F.lit(t)))
    assert [tier(g + p) for p in ("academic-regulations-degree-requirements/a", "general-information/a", "course-descriptions/a", "programs-study/a")] == [1, 2, 3, 4]
    assert tier("http://x.example/search/?P=CS") == 3 and tier("http://x.example/a") == 2 and tier("http://x.example/a", "Graduate Grading") == 1
    assert one(web.slug(F.lit("http://x.example/a/b.html"))) == "b" and one(web.slug(F.lit("http://x.example/"))) == "catalog"
    assert one(web.same_family(F.lit(g + "programs-study/s/p/q"), F.lit(g + "programs-study/s/p"))) is True
    aliases = one(web.program_aliases(F.lit("Information Technology (MS)"), F.lit(g + "programs-study/it-ms/")))
    assert {"it", "ms", "ms it", "ms in information technology", "information technology"} <= set(aliases)
    level = lambda t, u="http://x", lines=(): one(web.program_level(F.lit(t), F.lit(u), F.array(*[F.lit(x) for x in lines]).cast("array<string>")))
    assert level("Chemistry (Ph.D.)") == "phd" and level("X", "http://x/y-ms/") == "grad" and level("X", "http://x", ["a doctoral study"]) == "phd" and level("X") == "unknown"


def test_chunking(one):
    windows = lambda n: one(chunking.overlapping(F.array(*[F.lit(str(i)) for i in range(n)]).cast("array<string>"), 3, 1))
    assert windows(0) == [] and windows(1) == ["0"] and windows(3) == ["0 1 2"] and windows(4) == ["0 1 2", "2 3"]
    assert windows(7) == ["0 1 2", "2 3 4", "4 5 6"]
    assert one(chunking.header(F.lit("A - A - B"))) == "A - B"
    assert one(chunking.good_chunk(F.lit("one two"))) is False and one(chunking.good_chunk(F.lit("one two three."))) is True


def test_metrics(one):
    ids = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<string>")
    assert one(evaluation.recall_at(ids("a", "b", "b"), ids("b", "c"), 3)) == 0.5 and one(evaluation.recall_at(ids("a"), ids(), 3)) == 0.0
    assert round(one(evaluation.ndcg_retrieved(ids("a", "b", "c"), ids("b"), 3)), 5) == 0.63093
    assert round(one(evaluation.ndcg_standard(ids("b", "a"), ids("b", "c"), 2)), 5) == round(1 / (1 + 0.6309297535714575), 5)
    assert round(one(ranking.position_bias(F.lit(1.0), F.lit(0))), 6) == 1.0
    assert one(ranking.tier_boost(F.lit(0))) == 3.0 and one(ranking.tier_boost(F.lit(0), gold_on=False)) == 1.2
    assert round(one(ranking.tier_boost(F.lit(1), F.lit("the grading policy"))), 6) == 1.95
    assert one(ranking.answer_score(F.lit(text.UNKNOWN), F.lit("x"))) == -100.0


def test_enhanced_queries_and_their_parts(one):
    assert one(text.policy_rewrite(F.lit("Can I drop? How many credits? What are the rules?"))) == "student policy for drop? requirement for credits? policy regarding rules?"
    both = one(text.enhance(F.lit("What is the degree?"), "policy"))
    assert both["original"] == "What is the degree?" and both["rewritten"] == "policy regarding degree? degree" and both["key_terms"] == ["degree?"]
    assert one(text.enhance(F.lit("fees")))["rewritten"] == "fees" == one(text.enhance(F.lit("fees")))["expanded"]
    assert one(text.sub_queries(F.lit("fees and housing"))) == ["fees and housing", "fees", "housing"]
    assert one(text.sub_queries(F.lit("What is due? When is it due? Thanks."))) == ["What is due? When is it due? Thanks.", "What is due", "When is it due"]
    assert one(text.sub_queries(F.lit("a and b and c"))) == ["a and b and c"] and one(text.sub_queries(F.lit(""))) == []


def test_course_codes_and_colours(one):
    assert tuple(one(text.course_code(F.lit("take comp - 725a or CS 101")))) == ("COMP", "725A", "COMP 725A")
    assert one(text.course_code(F.lit("no code 12"))) is None
    assert one(text.url_has_course(F.lit("https://x/search/?P=COMP%20725"), F.lit("COMP 725"))) and not one(text.url_has_course(F.lit("https://x/COMP"), F.lit("COMP 725")))
    assert one(text.title_starts_with(F.lit(" comp 725 Networks"), F.lit("COMP 725")))
    value = 0
    for c in "a longer category name, é":
        value = (value * 31 + ord(c) + (1 << 31)) % (1 << 32) - (1 << 31)
    assert one(text.category_colour(F.lit("a longer category name, é"))) == abs(value) % 10
    assert tuple(one(text.source_line(F.lit("- A title (http://x)")))) == ("A title", "http://x")


def test_vectors_of_many_texts_at_once(spark):
    """Each text has the vector that it has alone, word by word, whatever the batch; null and wordless texts have zeros."""
    from quarry.plans import models

    told = ["Fees are due, FEES!", "", None, "123 \u00c9\u00c8", "\u212a \u0130x Stra\u00dfe z\u00e9z", "a b " * 700, *(f"w{i} go{'a' * (i % 9)}" for i in range(2500))]
    want = []
    for t in told:
        own = np.zeros(64)
        for w in re.findall("[a-z]+", (t or "").lower()):
            h = zlib.crc32(w.encode())
            own[h % 64] += 1.0 if h >> 31 else -1.0
        want.append((own / np.sqrt(own @ own) if own.any() else own).tolist())
    assert models.vectors_of(told).tolist() == want and models.vectors_of([]).shape == (0, 64)
    df = spark.createDataFrame(list(enumerate(told)), "i int, t string").withColumn("v", models.hashed_vector(F.col("t")))
    assert df.schema["v"].dataType.simpleString() == "array<double>" and [r.v for r in df.orderBy("i").collect()] == want
    assert df.where("i < 0").count() == 0


def test_three_words_of_any_white_space(spark):
    """What ``good_chunk`` counts as words is what ``split_words`` makes."""
    rng = random.Random(2)
    told = ["".join(rng.choice(["a", "bc", ".", " ", "\t", "\u00a0", "\u3000", "\x85", "\x1c", "\U0001f600", "\n"]) for _ in range(rng.randrange(0, 16))) for _ in range(800)] + [None, "x" * 40, "a  b  c."]
    df = spark.createDataFrame([(t,) for t in told], "t string")
    want = (F.size(text.split_words(text.text("t"))) >= 3) & (text.text("t").rlike("[.!?]") | (F.length("t") >= 30))
    got = df.select("t", want.alias("want"), chunking.good_chunk(F.col("t")).alias("got"))
    assert got.where("not want <=> got").count() == 0 and got.where("got").count() > 50
