import io
import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text, web
from quarry.operators import chunking, evaluation, gold, ranking, sessions, synthetic, training, vectors
from quarry.plans import answering
from quarry.plans.models import Models, letter_vector
from quarry.sources import files, html, shared
from quarry.streaming import stateful

# ---- sources and sinks ---------------------------------------------------------------------------------------------


def test_catalog_round_trip(spark, tmp_path):
    sections = [{"title": "S", "text": ["one is here.", " two words there "], "lists": [["a b c.", ""]], "subsections": [{"title": "T", "page_url": "http://x.example/t", "text": ["deep inside it."]}]}]
    pages = [{"page_title": "P", "page_url": "http://x.example/p", "sections": sections, "meta": {"tier": 3, "program_level": "grad"}, "aliases": ["p"]}, {"page_title": "Q", "page_url": "http://x.example/q", "sections": [], "meta": {"tier": 2}}]
    (tmp_path / "c.json").write_text(json.dumps({"pages": pages}, indent=2))
    (tmp_path / "bad.json").write_text("{ no json")
    first = files.catalog(spark, str(tmp_path / "c.json"))
    assert files.catalog(spark, str(tmp_path / "bad.json")).count() == 0
    files.write_catalog(first, str(tmp_path / "again"))
    again = files.catalog(spark, str(tmp_path / "again"), lines=True)
    rows = {r.page_title: r for r in again.collect()}
    assert {k: (r.page_url, r.tier, r.program_level, r.aliases) for k, r in rows.items()} == {"P": ("http://x.example/p", 3, "grad", ["p"]), "Q": ("http://x.example/q", 2, None, None)}
    assert json.loads(rows["P"].tree) == sections
    # all the way to chunks: parents first, titles joined, addresses inherited
    index = answering.build_index(chunking.sections(again), None)
    got = [(r.chunk_idx, r.title, r.url, r.text.split("\n\n")[1]) for r in index.orderBy("chunk_idx").collect()]
    assert got == [(0, "P - S", "http://x.example/p", "one is here."), (1, "P - S", "http://x.example/p", "a b c."), (2, "P - S - T", "http://x.example/t", "deep inside it.")]
    files.write_index(index, str(tmp_path / "index"))
    assert files.read_index(spark, str(tmp_path / "index"), gold_on=False).count() == len(got)
    assert files.read_index(spark, str(tmp_path / "none"), gold_on=False) is None
    files.write_index(index.withColumn("tier", F.lit(0)), str(tmp_path / "with_gold"))
    assert files.read_index(spark, str(tmp_path / "with_gold"), gold_on=False) is None and files.read_index(spark, str(tmp_path / "with_gold"), gold_on=True).count()


def workbook(rows, active=0):
    """A minimal xlsx: strings shared, numbers as they are, cells left out where None."""
    strings, sheet = [], []
    for i, row in enumerate(rows, 1):
        cells = []
        for j, v in enumerate(row):
            if v is None:
                continue
            if isinstance(v, str):
                strings.append(v)
                cells.append(f'<c r="{chr(65 + j)}{i}" t="s"><v>{len(strings) - 1}</v></c>')
            else:
                cells.append(f'<c r="{chr(65 + j)}{i}"><v>{v}</v></c>')
        sheet.append(f'<row r="{i}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><bookViews><workbookView activeTab="{active}"/></bookViews><sheets><sheet name="a" sheetId="1" r:id="r1"/><sheet name="b" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{s}</t></si>' for s in strings)}</sst>")
        for k in (0, 1):
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f"<worksheet {ns}><sheetData>{''.join(sheet) if k == active else ''}</sheetData></worksheet>")
    return out.getvalue()


def test_sitemaps(spark, tmp_path):
    rows = [["level 1", "level 2", "url"], ["A", None, "/a"], ["A", "B", "/a/b"], ["C", "D", None], [7, "E", " /e "]]
    for active in (0, 1):
        (tmp_path / f"m{active}.xlsx").write_bytes(workbook(rows, active))
        got = [(r.title, r.url) for r in files.sitemap_workbook(spark, str(tmp_path / f"m{active}.xlsx")).collect()]
        assert got == [("A", "/a"), ("A > B", "/a/b"), ("7 > E", "/e")]
    (tmp_path / "m.csv").write_text("l1,l2,url\nA,,/a\nA,B,/a/b\nC,D,\n")
    assert [(r.title, r.url) for r in files.sitemap(spark, str(tmp_path / "m.csv")).collect()] == [("A", "/a"), ("A > B", "/a/b")]


def test_json_lines_and_inputs(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id": "c:1", "query": " q ", "nuggets": ["n"]}\n\nnot json\n{"id": "x", "query": "r"}\n')
    rows = files.json_lines(spark, str(tmp_path / "g.jsonl"), "gold")
    assert files.clean(rows).count() == 2 and files.broken(rows).count() == 1
    assert [r.question for r in files.popular_questions(files.clean(rows)).orderBy("question").collect()] == ["q", "r"]
    (tmp_path / "data").mkdir()
    for n in (1, 2):
        (tmp_path / "data" / f"{n}.json").write_text(json.dumps([{"query": f"q{n}", "answer": "a", "url": "u"}] * n))
    assert files.clean(files.json_arrays(spark, str(tmp_path / "data"), "training")).count() == 3
    (tmp_path / "in.jsonl").write_text('{"id": "1", "query": "", "text": "the text"}\n{"id": "2", "question": "CS 725 credits?"}\n{"id": "3"}\n')
    assert [r.query for r in files.manual_inputs(files.json_lines(spark, str(tmp_path / "in.jsonl"), "rewrite_inputs")).collect()] == ["the text"]


def test_reports(spark, tmp_path):
    for run, value in (("20250101_000000", 0.5), ("20250201_000000", 1.0)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "report.json").write_text(json.dumps({"per_question": [{"id": "a", "recall@1": value}, {"id": "b", "recall@1": 0.0}], "summary": {"count": 2, "recall@1": value / 2}}))
    (tmp_path / "20250101_000000" / "preds.jsonl").write_text("{}\n")
    found = files.reports(spark, str(tmp_path)).collect()
    assert [r.run_id for r in found] == ["20250201_000000", "20250101_000000"]
    for r in found:  # the summary is the mean of the questions
        assert r.summary["recall@1"] == np.mean([float(q["recall@1"]) for q in r.per_question]) and r.summary["count"] == len(r.per_question)
    assert [r.run_id for r in files.latest_run(spark, str(tmp_path)).collect()] == ["20250101_000000"]  # only this one has predictions
    numbers = evaluation.run_numbers(files.reports(spark, str(tmp_path))).collect()
    assert {(r.run_id, r.number, r.date) for r in numbers} == {("20250101_000000", 1, "2025-01-01 00:00:00"), ("20250201_000000", 2, "2025-02-01 00:00:00")}


def test_logs(spark, tmp_path):
    said = spark.createDataFrame([("t", 'he said "no"\nthen', "a, b", ["- X (u)"])], "timestamp string, question string, answer string, sources array<string>")
    path = str(tmp_path / "chat")
    files.log_header(spark, path)
    files.append_csv(files.chat_log(said), path)
    files.append_csv(files.chat_log(said), path)
    files.log_header(spark, path)  # is there already
    got = files.csv_log(spark, path, "chat_log").where("timestamp is not null").collect()
    assert [(r.question, r.answer, json.loads(r.sources_json)) for r in got] == [('he said "no"\nthen', "a, b", ["- X (u)"])] * 2
    (tmp_path / "old.csv").write_text("timestamp,session_id\n1,s\n")
    rows, old = files.migrated_log(spark, str(tmp_path / "old.csv"), backup=str(tmp_path / "old.backup"))
    assert old and rows.first().question == "" and rows.first().session_id == "s" and spark.read.option("header", True).csv(str(tmp_path / "old.backup")).count() == 1
    files.write_json(said, str(tmp_path / "j"))
    files.write_json(said, str(tmp_path / "j"), "append")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    rows = spark.range(50).select("id", F.col("id").alias("x"))
    assert [r.id for r in files.first_n(rows, 3, "id").collect()] == [0, 1, 2]
    assert files.sample(rows, 4, 1, "id").collect() == files.sample(rows.repartition(5), 4, 1, "id").collect() != files.sample(rows, 4, 2, "id").collect()


def test_monitor_texts(spark):
    events = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", True), (2, 1, "2024-01-01 00:01:05", False), (3, 2, "2024-01-01 00:00:00", True)], "event_id long, k long, ts string, down boolean").withColumn("ts", F.to_timestamp("ts"))
    intervals = sessions.downtimes(events, ["k"], F.col("down"))
    assert files.status(intervals, F.lit("now")).first() == (True, "2024-01-01 00:00:00", "now")
    assert files.status(intervals.where("up_at is not null"), F.lit("now")).first() == (False, "", "now")
    assert "Duration: 00:01:05 (65 seconds)" in files.downtime_log(intervals).first().value
    lines = spark.createDataFrame([(1, i, line, 137) for i, line in enumerate(["ok", "ERROR: out of memory", "fatal end"])], "k long, n int, line string, exit_code int")
    classed = sessions.classify_log(lines).groupBy("k").agg(F.max("exit_meaning").alias("exit_meaning"), F.array_compact(F.array(*[F.max(F.when(F.col(c), F.lit(c))) for c in ("out_of_memory", "panic", "segfault")])).alias("causes"))
    errors = sessions.last_errors(lines, ["k"], "n").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("errors"))
    value = files.crash_reports(intervals, classed.join(errors, "k"), "k").first().value
    assert "killed" in value and "out_of_memory, panic" in value and value.index("fatal end") < value.index("ERROR: out of memory")
    example = spark.createDataFrame([("q " * 60, "yes", "one\n\n\n\ntwo"), ("q", "no", None)], "question string, output string, context string")
    told = [r.value for r in files.verification_text(example).collect()]
    assert max(map(len, told[0].split("\n"))) <= 80 and "[1] one" in told[0] and "[2] two" in told[0] and "No context found" in told[1]


def test_shared_folder(spark, monkeypatch):
    df = shared.saved(spark.range(5).withColumn("part", F.lit("x")), "t")
    assert df.count() == 5 and df.columns == ["id", "part"] and shared.path(spark, "a") != shared.path(spark, "a")


# ---- pages to index ------------------------------------------------------------------------------------------------


def test_pages_to_sections(spark):
    tab = '<main><h1>T</h1><p>Intro words here.</p></main><div id="coursetext"><h3>CS 725 Topics</h3><ul><li>credits: 4</li><li>more about it all.</li></ul></div>'
    bare = "<html><body>only loose words, nothing else at all</body></html>"
    span = "<html><body><span>only a span of words</span></body></html>"
    pages = spark.createDataFrame([(1, "http://x.example/p", tab), (2, "http://x.example/q", bare), (3, "http://x.example/r", span), (4, "http://x.example/s", "")], "page_id long, url string, html string")
    found = {(r.page_id, r.path[-1]): r for r in html.sections(html.blocks(pages)).collect()}
    assert found[1, "CS 725 Topics"].section_url == "http://x.example/p#coursetext" and found[1, "T"].section_url == "http://x.example/p"
    assert found[1, "CS 725 Topics"].course.course_code == "CS 725" and found[1, "CS 725 Topics"].course.credits == 4
    assert found[2, "Page"].text == ["only loose words, nothing else at all"] and found[3, "Page"].text == ["only a span of words"]
    told = spark.createDataFrame([("c:1", "Question: a?\n\nAnswer: b.", "C Information", "")], "gold_id string, text string, title string, url string")
    index = answering.build_index(answering.sections_of_pages(pages), told).orderBy("chunk_idx").collect()
    assert index[0].gold_id == "c:1" and index[0].tier == 0 and [r.chunk_idx for r in index] == list(range(len(index)))
    assert any(r.url.endswith("#coursetext") for r in index) and all(abs(r.norm - np.linalg.norm(r.embedding)) < 1e-9 for r in index)


# ---- questions and rewrites ----------------------------------------------------------------------------------------


def test_synthetic_questions(spark):
    long = "words " * 12
    chunks = spark.createDataFrame([(1, long, "A", "http://x/a", 1), (2, long + "b", "A", "http://x/b", 1), (3, "short", "B", "http://x/c", 1), (4, long, "C", "http://x/d", 4), (5, long, "D", "http://x/prog/e", 4)], "chunk_idx long, text string, title string, url string, tier int")
    ask = lambda c, title: F.array(F.concat(F.lit("1. What about title "), title, F.lit("? yes")), F.lit("Q: what is the fee for CS?"), F.lit("no"))
    asked = synthetic.questions(chunks, ask, 3, [1], ["/prog/"])
    assert {(r.chunk_idx, r.question) for r in asked.collect()} == {(1, "What about title A?"), (1, "what is the fee for CS?"), (5, "What about title D?")}
    made = synthetic.qa_chunks(chunks, asked)
    assert {r.original_chunk_index: r.num_questions for r in made.collect()} == {1: 2, 5: 1}
    assert synthetic.statistics(chunks, made, [1], ["/prog/"]).first() == (5, 1, 1, 2, 3, 1.5)


def test_rewrites(one):
    asked = F.lit("transfer credits phd")
    good, better = "Which transfer rules hold for doctoral work?", "How many transfer credits count for a phd?"
    bad = ["Transfer credits.", "How do visa rules and transfer credits for phd work?", "You rewrite user questions to be precise and graduate catalog-specific transfer credits phd?"]
    assert one(text.best_rewrite(asked, F.array(*[F.lit(x) for x in [*bad, good, better, better + " "]]))) == better
    assert one(text.best_rewrite(asked, F.array(*[F.lit(x) for x in bad]))) == "transfer credits phd"
    assert one(text.best_rewrite(asked, F.array(F.lit(better)), lambda a, b: F.lit(0.1))) == "transfer credits phd"
    assert one(text.transform_query(F.lit(" PhD time limit? "), school="X")) == "What is the time limit for completing a X Ph.D. program?"
    assert one(text.transform_query(F.lit("phd time limit?"))) == "What is the time limit for completing a Ph.D. program?"
    assert one(text.transform_query(F.lit("transfer phd credits"), {}, [], lambda q, p: F.array(F.lit(better)))) == better
    assert one(text.rewrite_prompt(F.lit("what gpa"))) != one(text.rewrite_prompt(F.lit("visa rules")))
    flags = lambda a, b: tuple(one(text.rewrite_flags(F.lit(a), F.lit(b))))
    assert flags("the gpa", "the minimum GPA requirement") == (True, False, True, "rule_fallback")
    assert flags("visa rules", "How do I get a new house in town?") == (False, False, True, "lost_tokens")
    assert flags("visa rules", "visa rules of external graduate transfer credits here?")[3] == "forbidden_phrase"
    assert flags("visa rules", "which visa visa rules are there today?")[3] == "duplicate_words" and flags("visa rules", "visa?")[3] == "length_out_of_range"


def test_small_texts(one):
    line = lambda s: tuple(one(text.source_line(F.lit(s))))
    assert line("- A title (http://x/y)") == ("A title", "http://x/y") and line("- A title") == ("A title", None) and line("--") == ("--", None)
    assert "href=\"http://x/y\"" in one(text.linked(F.lit("see http://x/y now"))) and ">b</a>" in one(text.linked(F.lit("[b](http://x/y)")))
    assert one(text.wrapped(F.lit("aa bb cccccc d"), 5)) == "aa bb\nccccc\nc d"
    pointer = one(text.calendar_fallback(F.lit("when does spring term start"), F.lit("soon"), F.array(F.lit("Page")), "u"))
    assert pointer.endswith("u") and one(text.calendar_fallback(F.lit("when does spring term start"), F.lit("on May 5, 2026"), F.array(F.lit("Page")), "u")) is None
    assert one(text.calendar_fallback(F.lit("appeal deadline"), F.lit("x"), F.array(F.lit("P")), "u")) is None and one(text.calendar_fallback(F.lit("ad-drop"), F.lit("x"), F.array(F.lit("P")), "u")) and one(text.calendar_fallback(F.lit("add-drop"), F.lit("x"), F.array(F.lit("P")), "u")) is None
    assert one(web.degree_flags(F.lit("Biology (M.S.)"), F.lit("http://x/phd"))) == (True, True, False) and one(web.degree_intent(F.lit("a certificate or a master's"))) == (True, False, True)


# ---- retrieval and evaluation --------------------------------------------------------------------------------------


def test_cosine_guards(one):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert all(abs(one(vectors.cosine(a, b, g)) - 0.5**0.5) < 1e-7 for g in ("zero", "product", "each", "none"))
    assert one(vectors.cosine(a, zero)) == 0 == one(vectors.cosine(a, zero, "product")) and one(vectors.cosine(a, zero, "none")) is None


def test_counts_and_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 4))
    v[7] = v[3]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(40, None), (41, [None, 1.0, 2.0, 3.0])], "row_id long, vector array<double>")
    queries = rows.where("row_id % 10 = 3").withColumnRenamed("row_id", "query_id")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 9)
    counts = {r.query_id: (r.hits, r.n) for r in vectors.similar_counts(queries, rows, 0.5).collect()}
    near = {(r.query_id, r["rank"]): r.row_id for r in vectors.nearest_others(queries, rows, 3).collect()}
    for q in (3, 13, 23, 33):
        others = [j for j in range(40) if j != q]
        assert counts[q] == (sum(sim[q, j] >= 0.5 for j in others), 41)
        want = sorted([*others, 40, 41], key=lambda j: (-(sim[q, j] if j < 40 else 0), j))[:3]
        assert [near[q, k] for k in (1, 2, 3)] == want


def test_program_match_pools(spark):
    vector = [1.0, 0.0]
    programs = spark.createDataFrame([(1, [1.0, 0.1], ["zebra"], (True, False, False)), (2, vector, ["zebra", "stripes"], (False, False, False)), (3, [-1.0, 0.0], [], (False, True, False))], "row_id long, vector array<double>, tokens array<string>, flags struct<ms:boolean,phd:boolean,cert:boolean>")
    messages = spark.createDataFrame([(1, vector, ["zebra", "stripes"], (False, False, False)), (2, vector, ["zebra"], (True, False, False)), (3, vector, [], (False, True, False)), (4, [0.0, 1.0], [], (False, False, True))], "query_id long, vector array<double>, tokens array<string>, degree struct<ms:boolean,phd:boolean,cert:boolean>")
    assert {r.query_id: r.row_id for r in ranking.program_match(messages, programs).collect()} == {1: 2, 2: 1, 3: 2}
    chunks = spark.createDataFrame([(5, "Zebra (M.S.)", "http://x/graduate/programs-study/z-ms/", 4), (6, "Zebra again", "http://x/graduate/programs-study/z-ms/", 4), (7, "Moon", "http://x/ink", 4)], "chunk_idx long, title string, url string, tier int")
    built = ranking.build_program_index(chunks).collect()
    assert [r.row_id for r in built] == [5] and built[0].flags.ms
    found = chunks.select(F.lit("zebra").alias("question"), "title", "url", "tier").unionByName(spark.createDataFrame([("zebra", "qqq", "", 2)], "question string, title string, url string, tier int"))
    assert {r.title for r in ranking.near_title(found, letter_vector, 0.3).collect()} == {"Zebra (M.S.)", "Zebra again", "qqq"}


def test_retrieval_with_gold(spark):
    own = Models(embed=letter_vector)
    rows = [(1, "zzzz yyyy", "T1", "http://x/a/b", 2, None, False), (2, "aabb", "T2", "", 2, None, False), (3, "Question: aabb?\n\nAnswer: yes", "G", "", 0, "g1", False), (4, "aaab", "T3", "http://x/q", 2, None, True), (5, "ccc dddd", "G2", "", 0, "g2", False)]
    chunks = spark.createDataFrame(rows, "chunk_idx long, text string, title string, url string, tier int, gold_id string, is_synthetic_qa boolean").withColumn("embedding", letter_vector(F.col("text")))
    known = spark.createDataFrame([("g1", "aabb", "yes", "http://x/q/deep"), ("g2", "ccdd", "no", "")], "gold_id string, query string, reference_answer string, url string").withColumn("vector", letter_vector(F.col("query")))
    asked = spark.createDataFrame([(1, "aabb"), (2, "aaab zz")], "query_id long, question string")
    path = answering.retrieve(asked, chunks, answering.Config(k=3, topn=5), own, known).collect()
    sure = [r for r in path if r.query_id == 1]
    assert [(r.row_id, r["rank"], r.title, r.tier) for r in sure] == [(3, 1, "Gold Q&A: g1", 0)]  # as near as 0.95: its chunk is all there is
    other = {r.row_id: r for r in path if r.query_id == 2}
    assert abs(other[4].boosted / other[4].sim - 1.3 * 1.5) < 1e-6  # generated question, address begins a gold one
    free = answering.retrieve(asked, chunks, answering.Config(k=2, topn=5, gold_on=False, rerank_on=True), own).collect()
    assert {(r.query_id, r["rank"]) for r in free} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    made = {r.query_id: r for r in answering.answer_batch(asked, chunks, known.drop("vector"), answering.Config(k=2, topn=5), own).collect()}
    assert made[1].answer_mode == "gold_only" and made[1].answer == "yes" and made[2].answer_mode in ("retrieval_only", "gold_only")


def test_configuration():
    cfg = answering.read_config('{"k": 4, "boosts": {"1": 2}, "what": 1}')
    assert cfg.k == 4 and cfg.boosts == {1: 2.0} and cfg.topn == 120 and answering.read_config("") == answering.Config() == answering.read_config("[1")
    assert answering.read_rules('{"a": "b"}') == [("a", "b")] and len(answering.read_rules("no")) > 20


def test_evaluation(spark):
    g = spark.createDataFrame([("a:1", "q", "aab", ["aab", "zz", " "], ["p"], "u"), ("a:2", "q", "b", [], ["p", "r"], "u"), ("b:3", "q", "", ["n"], [], "u")], "id string, query string, reference_answer string, nuggets array<string>, gold_passages array<string>, url string")
    p = spark.createDataFrame([("a:1", " aab ", [(0, "http://x/p.html", "aab"), (1, "http://x/q", "zz"), (2, "http://x/p", "")]), ("a:2", None, None)], "id string, model_answer string, retrieved array<struct<idx:long,url:string,text:string>>")
    rows = {r.id: r for r in evaluation.evaluate(g, p, Models(embed=letter_vector), 0.7).collect()}
    assert len(rows) == 3 and rows["a:1"].asDict() | {"ndcg@3": 0, "ndcg@5": 0, "sbert_cosine": 0, "sbert_cosine_chunk": 0} == {"id": "a:1", "nugget_precision": 1.0, "nugget_recall": 0.5, "nugget_f1": 2 / 3, "sbert_cosine": 0, "sbert_cosine_chunk": 0, "bertscore_f1": 1.0, "recall@1": 1.0, "recall@3": 1.0, "recall@5": 1.0, "ndcg@1": 1.0, "ndcg@3": 0, "ndcg@5": 0}
    assert abs(rows["a:1"].sbert_cosine - 1) < 1e-12 and abs(rows["a:1"].sbert_cosine_chunk - 1) < 1e-12 and abs(rows["a:1"]["ndcg@3"] - (1 + 0.5) / (1 + 1 / np.log2(3))) < 1e-12
    assert (rows["a:2"].nugget_recall, rows["a:2"].bertscore_f1, rows["a:2"]["recall@5"]) == (1.0, 0.0, 0.0) and rows["b:3"].nugget_recall == 0.0
    per_question = evaluation.evaluate(g, p, Models(embed=letter_vector), 0.7)
    made = evaluation.report(per_question).first()
    assert [r.id for r in made.per_question] == ["a:1", "a:2", "b:3"] and made.summary["count"] == 3 and abs(made.summary["nugget_recall"] - 0.5) < 1e-12
    joined = {r.id: r for r in evaluation.prediction_metrics(p, g, per_question.where("id <> 'a:2'")).collect()}
    assert joined["a:1"].category == "a" and joined["a:2"]["recall@1"] == 0.0 and "b:3" not in joined
    assert evaluation.timed(lambda q: None, ["x"], 2)[0][0] == "x" and evaluation.summary(per_question.limit(0), ["recall@1"]).first()[1] == 0.0


def test_latencies_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(["a", "b", None][i % 3] if i % 7 else "a", float(rng.integers(0, 60))) for i in range(500)] + [("one", 5.0), ("a", None)]
    got = {r.g: r for r in evaluation.latency_percentiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", ["g"]).collect()}
    for g in ("a", "b", None, "one"):
        v = np.sort([x for k, x in rows if k == g and x is not None])
        at = lambda p, v=v: v[max(int(p * len(v)), 1) - 1]
        assert (got[g].n, got[g].p50, got[g].p95, got[g].p99) == (len(v), np.median(v), at(0.95), at(0.99))


def test_gold_stores(spark):
    q = spark.createDataFrame([("b:1", "x", "b"), ("a:2", "y", "a"), ("a:1", "z", "a")], "id string, query string, category string")
    assert [r.id for r in gold.in_order(q).collect()] == ["a:1", "a:2", "b:1"]
    old = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "question_id string, embedding array<double>")
    assert [(r.question_id, r.embedding) for r in gold.embeddings_in_order(gold.store_embeddings(old, old.where("question_id = 'b'").withColumn("embedding", F.array(F.lit(9.0))))).collect()] == [("a", [1.0]), ("b", [9.0])]
    records = spark.createDataFrame([("a", "q", ["n1", " "]), ("c", "q", ["n2"])], "id string, query string, nuggets array<string>")
    have = spark.createDataFrame([("a", 0, "old")], "question_id string, pos int, nugget string")
    assert {(r.question_id, r.nugget) for r in gold.import_children(have, records, old.select(F.col("question_id").alias("id")), "nuggets", "nugget").collect()} == {("a", "old"), ("c", "n2")}
    assert {r.nugget for r in gold.import_children(have, records, old.select(F.col("question_id").alias("id")), "nuggets", "nugget", overwrite=True).collect()} == {"n1", "n2"}


def test_training_sets(spark):
    marco = spark.createDataFrame([("q", ["p", "n"], [1, 0]), ("q2", ["p"], [1]), ("", ["p", "n"], [1, 0])], "query string, passages array<string>, selected array<int>")
    assert [(r.query, r.positive, r.negative) for r in training.selected_triplets(marco).collect()] == [("q", "p", "n")]
    squad = spark.createDataFrame([("q", "c", ["a"]), ("q", "c", [])], "question string, context string, answers array<string>")
    assert [r.output for r in training.answerable(squad).collect()] == ["a"]


# ---- streams -------------------------------------------------------------------------------------------------------


def test_streams(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    for i, rows in enumerate([[(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "x")], [(1, 3, "user", "d"), (1, 2, "reset", None)], [(2, 9, "user", "z")] + [(2, k, "user", str(k)) for k in range(1, 9)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = []
    stateful.last_turns(read).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).foreachBatch(lambda b, i: out.append(b.collect())).start().awaitTermination(60)
    last = {}
    for batch in out:
        for conv in {r.conv_id for r in batch}:
            last[conv] = [(r.turn, r.text, r.recency) for r in sorted(batch, key=lambda r: r.turn) if r.conv_id == conv]
    assert last[1] == [(3, "d", 1)] and [t for t, *_ in last[2]] == [5, 6, 7, 8, 9]
    asked = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    stateful.answer_stream(asked, lambda b: b.select("conv_id", F.upper("text").alias("answer")), str(tmp_path / "sink"), str(tmp_path / "c2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "sink")).where("answer = 'D'").count() == 1


@pytest.mark.parametrize("ms", [None, 60_000])
def test_state_times_out_only_where_asked(ms):
    assert stateful._timeout(ms) == ("NoTimeout" if ms is None else "ProcessingTimeTimeout")


def test_a_scope_deletes_its_own_tables(spark):
    rows = spark.range(10)
    before = shared.saved(rows, "kept")
    with pytest.raises(ValueError), shared.scope(spark):
        made = shared.saved(rows, "gone")
        with shared.scope(spark):
            inner = shared.path(spark, "inner")
            rows.write.parquet(inner)
        assert made.count() == 10 and not os.path.exists(inner)
        files = made.inputFiles()
        raise ValueError
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files) and before.count() == 10


def test_cosine_of_a_text_without_letters(spark):
    g = spark.createDataFrame([(1, "aab", ["aab", "11"], ["p"])], "id long, reference_answer string, nuggets array<string>, gold_passages array<string>")
    p = spark.createDataFrame([(1, "aab", [(0, "http://x/p", "22")])], "id long, model_answer string, retrieved array<struct<idx:long,url:string,text:string>>")
    plain = evaluation.evaluate(g, p, Models(embed=letter_vector), 0.9).first()
    divided = evaluation.evaluate(g, p, Models(embed=letter_vector), 0.9, float("nan")).first()
    assert (plain.nugget_recall, plain.sbert_cosine_chunk) == (0.5, 0.0)
    assert divided.nugget_recall == 1.0 and np.isnan(divided.sbert_cosine_chunk)
