"""Readers and writers: catalogs, gold records, predictions, reports, logs and index tables, all with explicit schemas.

JSON is read permissively: malformed lines land in ``_corrupt_record`` and are dropped by ``clean``, counted by ``broken``.
"""

from __future__ import annotations

import functools
import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.sources import shared

#: Names in the XML of workbooks.
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

RETRIEVED = "array<struct<rank:int,idx:bigint,score:double,title:string,url:string,tier:int,tier_name:string,text:string,is_gold:boolean,gold_id:string,reranked:boolean>>"
SCHEMAS: dict[str, str] = {
    "gold": "id string, query string, reference_answer string, nuggets array<string>, gold_passages array<string>, url string",
    "predictions": f"id string, query string, model_answer string, retrieved_ids {RETRIEVED}, transformed_query string",
    "generated": "index int, original_chunk_index int, tier int, questions array<string>, num_questions int, original_text string, title string, full_qa_chunk string",
    "rewrite_inputs": "id string, query string, text string, question string",
    "training": "query string, answer string, url string",
    "status": "is_down boolean, down_since string, last_check string",
    "report": "per_question array<map<string,string>>, summary map<string,double>",
    "chat_log": "timestamp string, question string, answer string, sources_json string",
    "selection_log": "timestamp string, session_id string, selected_version string, answer_mode string, question string, primary_answer string, alternative_answer string, gold_similarity string",
}
CORRUPT = "_corrupt_record"


def json_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped. The parsed rows are written once, as Spark asks for where what could not
    be read is looked at alone."""
    return shared.saved(spark.read.schema(f"{SCHEMAS[kind]}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path), "json")


def json_arrays(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Files that each hold one JSON array of objects."""
    return shared.saved(spark.read.schema(f"{SCHEMAS[kind]}, {CORRUPT} string").option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT).json(path), "json")


def clean(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def broken(rows: DataFrame) -> DataFrame:
    """Rows that could not be read, with what stands in the corrupt column."""
    return rows.where(F.col(CORRUPT).isNotNull())


PAGE = "page_title string, page_url string, sections variant, meta struct<tier:int,program_level:string>, aliases array<string>"


def catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Pages of a catalog: title, url, section tree as JSON text, tier, level and aliases.

    A file is one document {"pages": [...]}, or with ``lines`` one such document a line, as ``write_catalog`` makes them.
    A file that cannot be read has no pages.
    """
    reader = spark.read.schema(f"pages array<struct<{PAGE.replace(' ', ':').replace(',:', ',')}>>, {CORRUPT} string").option("multiLine", not lines).option("columnNameOfCorruptRecord", CORRUPT)
    page = reader.json(path).select(F.explode("pages").alias("p"))
    return page.select("p.page_title", "p.page_url", F.to_json("p.sections").alias("tree"), "p.meta.tier", "p.meta.program_level", "p.aliases")


def write_catalog(pages: DataFrame, path: str) -> None:
    """Pages (page_title, page_url, tree, tier, program_level, aliases) as catalog documents, one a line."""
    page = F.struct("page_title", "page_url", F.try_parse_json("tree").alias("sections"), F.struct("tier", "program_level").alias("meta"), "aliases")
    pages.select(F.to_json(F.struct(F.array(page).alias("pages"))).alias("value")).write.mode("overwrite").text(path)


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """A sitemap exported as CSV: the last cell is the address, the others the title chain."""
    lines = spark.read.option("header", True).csv(path)
    cells = F.array(*[F.col(f"`{c}`") for c in lines.columns[:-1]])
    url = F.col(f"`{lines.columns[-1]}`")
    return lines.where(url.isNotNull() & (F.trim(url) != "")).select(F.array_join(F.filter(cells, lambda c: c.isNotNull() & (c != "")), " > ").alias("title"), F.trim(url).alias("url"))


def sitemap_workbook(spark: SparkSession, path: str) -> DataFrame:
    """``title``, ``url`` of the rows of a spreadsheet's (xlsx) active sheet from the second on, as ``sitemap`` reads them from CSV.

    A workbook is a zip of XML files, which Python reads; one row a file, so spreadsheets have to fit a task.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = [(" > ".join(c for c in cells[:-1] if c), cells[-1].strip()) for cells in sheet_rows(content.as_py())[1:] if cells and cells[-1].strip()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["title", "url"])

    shared.workers(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "title string, url string")


def sheet_rows(workbook: bytes) -> list[list[str]]:
    """Cells of the active sheet of a workbook, row by row, all as wide as the widest; empty ones are empty strings."""
    with zipfile.ZipFile(io.BytesIO(workbook)) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name))
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in tree("xl/sharedStrings.xml").findall(f"{_SHEET}si")]
        book = tree("xl/workbook.xml")
        view = book.find(f"{_SHEET}bookViews/{_SHEET}workbookView")
        sheet = book.findall(f"{_SHEET}sheets/{_SHEET}sheet")[int(view.get("activeTab", 0)) if view is not None else 0]
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        name = targets[sheet.get(_RELATION + "id")]
        out = []
        for row in tree(name.lstrip("/") if name.startswith("/") else f"xl/{name}").iter(f"{_SHEET}row"):
            cells: dict[int, str] = {}
            for c in row.findall(f"{_SHEET}c"):
                letters = re.match("[A-Z]*", c.get("r", "")).group()
                at = functools.reduce(lambda n, x: n * 26 + ord(x) - 64, letters, 0) - 1 if letters else len(cells)
                value = c.find(f"{_SHEET}v")
                inline = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                cells[at] = inline if value is None else strings[int(value.text)] if c.get("t") == "s" else value.text or ""
            out.append(cells)
        width = max((max(c) + 1 for c in out if c), default=0)
        return [[c.get(i, "") for i in range(width)] for c in out]


def reports(spark: SparkSession, root: str) -> DataFrame:
    """Stored reports, newest run first: run_id, summary and per-question metrics."""
    rows = spark.read.schema(SCHEMAS["report"]).option("multiLine", True).json(f"{root}/*/report.json")
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/report\.json$", 1).alias("run_id"), "summary", "per_question").orderBy(F.desc("run_id"))


def write_report(report: DataFrame, path: str) -> None:
    """A report (one row of per_question and summary) as a JSON document."""
    report.coalesce(1).write.mode("overwrite").json(path)


def latest_run(spark: SparkSession, root: str) -> DataFrame:
    """``run_id`` of the newest run below ``root`` that has predictions; no row without one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "preds.jsonl").load(root).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)/preds\.jsonl$", 1).alias("run_id")).orderBy(F.desc("run_id")).limit(1)


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first rows in a given order, as subsets of public data sets are taken."""
    return rows.orderBy(*order).limit(n)


def sample(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """``n`` rows by a seeded hash of their key: random, and the same on every run."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def manual_inputs(rows: DataFrame) -> DataFrame:
    """First non-empty of query, text and question; without blanks and rows that name a course."""
    first = F.coalesce(*[F.nullif(text.strip(text.text(c)), F.lit("")) for c in ("query", "text", "question")])
    return rows.select("id", first.alias("query")).where(F.col("query").isNotNull() & ~F.col("query").rlike(text.COURSE_CODE))


def popular_questions(gold: DataFrame) -> DataFrame:
    return gold.select(F.trim("query").alias("question")).where(F.length("question") > 0)


def csv_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[kind]).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).option("escape", '"').csv(path)


def chat_log(rows: DataFrame) -> DataFrame:
    return rows.select("timestamp", "question", "answer", F.to_json("sources").alias("sources_json"))


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; with mode "append" a further part beside those there are, so work is kept as it gets done."""
    rows.write.mode(mode).json(path)


def verification_text(examples: DataFrame, width: int = 80) -> DataFrame:
    """``value``: question, answer and numbered contexts of training examples (question, output, context) in wrapped lines."""
    parts = F.filter(F.split(text.text("context"), "\n\n"), lambda x: F.trim(x) != "")
    told = F.transform(parts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), text.wrapped(F.trim(x), width)))
    shown = F.when(F.size(parts) > 0, F.array_join(told, "\n\n")).otherwise("No context found")
    return examples.select(F.concat_ws("\n\n", F.concat(F.lit("QUESTION:\n"), text.wrapped(F.col("question"), width)), F.concat(F.lit("ANSWER:\n"), text.wrapped(F.col("output"), width)), F.concat(F.lit("CONTEXT:\n"), shown), F.lit("=" * width)).alias("value"))


def status(intervals: DataFrame, checked: Column) -> DataFrame:
    """One row as the status file has it: whether any interval is open, since when, and when that was looked up."""
    open_ = F.max(F.when(F.col("up_at").isNull(), F.col("down_since").cast("string")))
    return intervals.agg(open_.alias("q_since")).select(F.col("q_since").isNotNull().alias("is_down"), F.coalesce("q_since", F.lit("")).alias("down_since"), checked.cast("string").alias("last_check"))


def downtime_log(intervals: DataFrame) -> DataFrame:
    """``value``: an entry for each closed interval (down_since, up_at, seconds, duration)."""
    lines = F.format_string("---\nDown Since: %s\nRecovered At: %s\nDuration: %s (%d seconds)\n---\n", F.col("down_since").cast("string"), F.col("up_at").cast("string"), F.col("duration"), F.col("seconds"))
    return intervals.where("up_at is not null").select(lines.alias("value"))


def crash_reports(intervals: DataFrame, crashes: DataFrame, key: str) -> DataFrame:
    """``value``: a report for each closed interval with the exit meaning, flags of causes and last errors of its key.

    ``crashes`` (key, exit_meaning, causes, errors): one row a key, as ``sessions.classify_log`` and ``last_errors`` tell.
    """
    joined = intervals.where("up_at is not null").join(crashes, key, "left")
    rows = [("Started", F.col("down_since").cast("string")), ("Subject", F.col(key).cast("string")), ("Downtime", F.concat(F.col("duration"), F.lit(" ("), F.col("seconds").cast("string"), F.lit(" seconds)"))), ("Recovered", F.col("up_at").cast("string")), ("Reason", F.coalesce("exit_meaning", F.lit("unknown"))), ("Indicators", F.coalesce(F.array_join("causes", ", "), F.lit("none")))]
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), value) for name, value in rows])
    return joined.select(F.concat(head, F.lit("\nLast errors:\n"), F.coalesce(F.array_join("errors", "\n"), F.lit("none")), F.lit("\n" + "=" * 80)).alias("value"))


def write_index(chunks: DataFrame, path: str) -> None:
    """The index table: chunks with vectors, norms and tiers, as Parquet."""
    chunks.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, gold_on: bool) -> DataFrame | None:
    """A stored index, or None if it is missing, empty, or holds gold rows while gold is off."""
    try:
        chunks = spark.read.parquet(path)
    except AnalysisException:
        return None
    if chunks.isEmpty() or (not gold_on and not chunks.where("tier = 0").isEmpty()):
        return None
    return chunks


def migrated_log(spark: SparkSession, path: str, kind: str = "selection_log", backup: str | None = None) -> tuple[DataFrame, bool]:
    """A log read with today's columns, and whether its header is an older, shorter one; such a log is first copied as it is
    to ``backup`` if that is given."""
    wanted = [c.split()[0] for c in SCHEMAS[kind].split(", ")]
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    old = len(rows.columns) < len(wanted)
    if old and backup:
        rows.write.mode("errorifexists").option("header", True).option("escape", '"').csv(backup)
    return rows.select(*[F.col(f"`{c}`") if c in rows.columns else F.lit("").alias(c) for c in wanted]), old


def log_header(spark: SparkSession, path: str, kind: str = "chat_log") -> None:
    """Create a log with its header alone, unless it is there."""
    try:
        spark.read.option("header", True).csv(path)
    except AnalysisException:
        spark.createDataFrame([], SCHEMAS[kind]).coalesce(1).write.option("header", True).csv(path)
