"""Composed pipelines: building the index of chunks and answering a batch of questions.

Every stage that several others read is written to the shared folder once: plans stay short, and no vector or rewrite is
made twice.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import rules, text, web
from quarry.operators import chunking, compression, containment, dedup, ranking, tfidf, vectors
from quarry.plans.models import Models
from quarry.sources import html, shared


@dataclass(frozen=True)
class Config:
    """Switches and numbers of the pipeline, with the values in use as defaults."""

    k: int = 2
    topn: int = 120
    tiers_on: bool = False
    gold_on: bool = True
    ensure_gold: bool = True
    dual: bool = False
    direct_threshold: float = 0.85
    short_circuit: float = 0.95
    match_threshold: float = 0.85
    synthetic_boost: float = 1.3
    hyde_on: bool = False
    rerank_on: bool = False
    diversity: float = 0.7
    calendar_on: bool = False
    calendar_url: str = ""
    school: str = ""
    boosts: dict[int, float] = field(default_factory=lambda: dict(rules.TIER_BOOSTS))


def read_config(source: str) -> Config:
    """A configuration from JSON text, or YAML where a YAML library is at hand; unknown keys are ignored, missing ones default.

    An empty or unreadable text gives the defaults.
    """
    try:
        found = json.loads(source)
    except ValueError:
        try:
            import yaml
        except ImportError:
            found = None
        else:
            try:
                found = yaml.safe_load(source)
            except yaml.YAMLError:
                found = None
    found = found if isinstance(found, dict) else {}
    known = {f.name for f in fields(Config)}
    boosts = {int(k): float(v) for k, v in (found.get("boosts") or {}).items()} or dict(rules.TIER_BOOSTS)
    return Config(**{k: v for k, v in found.items() if k in known and k != "boosts"}, boosts=boosts)


def read_rules(source: str, default: Sequence[tuple[str, str]] = tuple(rules.DOMAIN_RULES)) -> list[tuple[str, str]]:
    """Domain rules from a JSON object, in its order; the default where it cannot be read."""
    try:
        found = json.loads(source)
    except ValueError:
        return list(default)
    return [(str(k), str(v)) for k, v in found.items()] if isinstance(found, dict) else list(default)


def sections_of_pages(pages: DataFrame, domain: str | None = None) -> DataFrame:
    """Sections of HTML pages as ``chunking.chunk_sections`` takes them."""
    found = html.sections(html.blocks(pages, domain))
    return found.select(F.col("url").alias("page_url"), F.array("section").alias("path"), F.array_join("path", " - ").alias("title"), "section_url", "text", "lists").withColumnRenamed("section_url", "url")


def build_index(found: DataFrame, gold: DataFrame | None = None, models: Models | None = None, size: int | None = None, overlap: int = 1) -> DataFrame:
    """Chunks of sections with tier, vector and norm; gold documents come first. Write the result once as Parquet."""
    own = models or Models()
    chunks = chunking.chunk_sections(found, size, overlap)
    chunks = chunks.withColumn("q_order", F.struct("page_url", "path", "pos"))
    chunks = chunking.first_of_equals(chunks, "text", "q_order")
    base = chunks.select(F.lit(1).alias("q_kind"), F.col("q_order.page_url").alias("q_url"), F.col("q_order.path").alias("q_path"), F.col("q_order.pos").alias("q_pos"), "text", "title", "url", web.tier(F.col("url"), F.col("title")).alias("tier"), F.lit(None).cast("string").alias("gold_id"))
    if gold is not None:
        first = gold.select(F.lit(0).alias("q_kind"), F.col("gold_id").cast("string").alias("q_url"), F.array(F.lit(0)).alias("q_path"), F.lit(0).alias("q_pos"), "text", "title", "url", F.lit(0).alias("tier"), F.col("gold_id").cast("string").alias("gold_id"))
        base = first.unionByName(base)
    numbered = chunking.number(base, ["q_kind", "q_url", "q_path", "q_pos"]).drop("q_kind", "q_url", "q_path", "q_pos")
    embedded = numbered.withColumn("embedding", own.embed(F.col("text")))
    return embedded.withColumns({"norm": vectors.norm(F.col("embedding")), "is_synthetic_qa": F.lit(False)})


def gold_matches(questions: DataFrame, gold: DataFrame, least: float) -> DataFrame:
    """``query_id``, ``gold_id``, ``gold_similarity``, ``reference_answer``, ``gold_url`` of the nearest gold question, if near enough.

    ``questions`` (query_id, vector), ``gold`` (gold_id, reference_answer, url, vector).
    """
    known = gold.withColumn("row_id", F.xxhash64("gold_id"))
    best = vectors.best_match(questions.select("query_id", "vector"), known.select("row_id", "vector"), least)
    return best.join(known.select("row_id", "gold_id", "reference_answer", F.col("url").alias("gold_url")), "row_id").select("query_id", "gold_id", F.col("sim").alias("gold_similarity"), "reference_answer", "gold_url")


def retrieve(questions: DataFrame, chunks: DataFrame, cfg: Config, models: Models | None = None, gold: DataFrame | None = None) -> DataFrame:
    """``query_id``, ``row_id``, ``rank``, ``sim``, ``boosted`` and the chunk's columns: the best chunks of each question.

    ``questions`` (query_id, question), ``gold`` (gold_id, query, reference_answer, url, vector). A gold question as near as
    ``short_circuit`` settles it: its chunk is all there is. For the others, twice ``topn`` nearest chunks are boosted by tier,
    generated questions and gold, ordered, and a gold chunk is moved to position 2 if none is among the first k. With
    re-ranking on, the first 20 are fused with metadata, cross and term scores; of the best those that differ enough stay.
    """
    own = models or Models()
    imagined = text.hyde_clean(own.imagine(F.col("question")))
    search = F.when(text.hyde_wanted(F.col("question")), imagined).otherwise(F.col("question")) if cfg.hyde_on else F.col("question")
    asked = questions.select("query_id", "question", own.embed(F.col("question")).alias("vector"), *([own.embed(search).alias("search")] if cfg.hyde_on else []))
    asked = shared.saved(asked if cfg.hyde_on else asked.withColumn("search", F.col("vector")), "asked")
    columns = set(chunks.columns)
    generated = F.coalesce("is_synthetic_qa", F.lit(False)) if "is_synthetic_qa" in columns else F.lit(False)
    info = chunks.select(F.col("chunk_idx").alias("row_id"), "text", "title", "url", "tier", "gold_id", generated.alias("is_synthetic_qa"))
    direct = match = None
    if cfg.gold_on and gold is not None:
        match = shared.saved(gold_matches(asked, gold, cfg.match_threshold), "matches")
        sure = match.where(F.col("gold_similarity") >= cfg.short_circuit)
        first = info.where("gold_id is not null").groupBy("gold_id").agg(F.min_by(F.struct("row_id", "text"), "row_id").alias("c"))
        direct = sure.join(first, "gold_id").join(questions.select("query_id", "question"), "query_id")
        direct = direct.select("query_id", "question", F.col("c.row_id").alias("row_id"), F.col("gold_similarity").alias("sim"), F.col("c.text").alias("text"), F.concat(F.lit("Gold Q&A: "), "gold_id").alias("title"), F.col("gold_url").alias("url"), F.lit(0).alias("tier"), "gold_id", F.lit(False).alias("is_synthetic_qa"), F.col("gold_similarity").alias("boosted"), F.lit(1).alias("rank"))
        direct = shared.saved(direct, "direct")
        asked = asked.join(direct.select("query_id"), "query_id", "left_anti")
    rows = chunks.select(F.col("chunk_idx").alias("row_id"), F.col("embedding").alias("vector"))
    near = shared.saved(vectors.top_k(asked.select("query_id", F.col("search").alias("vector")), rows, 2 * cfg.topn).drop("rank"), "near")
    # candidates are many: they carry ids and what decides, texts are joined to the few that stay
    signs = info.select("row_id", "tier", "gold_id", "url", "is_synthetic_qa")
    told = questions.select("query_id", "question")
    factor = ranking.tier_boost(F.col("tier"), F.col("question") if cfg.tiers_on else None, cfg.boosts, cfg.tiers_on, cfg.gold_on)
    factor = factor * F.when(F.col("is_synthetic_qa"), cfg.synthetic_boost).otherwise(1.0)
    if cfg.gold_on:
        signs, told, says = _gold_signs(near, info, signs, told, gold, match)
        factor = factor * ranking.gold_boost(F.col("tier") == 0, F.col("q_known"), F.col("q_says"), F.col("gold_id") == F.col("q_match"))
    joined = near.join(told if cfg.tiers_on else told.drop("question"), "query_id").join(signs.drop("url"), "row_id")
    if cfg.gold_on:
        joined = joined.join(says, ["query_id", "row_id"], "left") if says is not None else joined.withColumn("q_says", F.lit(False))
    boosted = shared.saved(joined.select("query_id", "row_id", "sim", "tier", F.round(F.col("sim") * factor, 9).alias("boosted")), "boosted")
    deep = min(cfg.topn, 20) if cfg.rerank_on else cfg.k
    best = ranking.ensure_gold(boosted, deep).drop("original_rank", "moved") if cfg.gold_on and cfg.ensure_gold else ranking.rank_boosted(boosted, deep)
    best = best.join(info.drop("tier"), "row_id").join(questions.select("query_id", "question"), "query_id")
    if cfg.rerank_on:
        best = rerank(best, cfg, own)
    return best if direct is None else best.unionByName(direct.select(*best.columns))


def _gold_signs(near: DataFrame, info: DataFrame, signs: DataFrame, told: DataFrame, gold: DataFrame | None, match: DataFrame | None):
    """What tells of gold: of chunks whether the address lies within one of a gold question (``q_known``), of questions the matched
    gold question (``q_match``), and of the pairs of questions that are gold ones whether the text holds the answer (``q_says``)."""
    if gold is None:
        return signs.withColumn("q_known", F.lit(False)), told.withColumn("q_match", F.lit(None).cast("string")), None
    inside = containment.contained(signs, "url", gold, "url")
    same = gold.select(F.lower("query").alias("q_asked"), F.lower("reference_answer").alias("q_answer")).where("q_answer <> ''").dropDuplicates(["q_asked"])
    answered = told.withColumn("q_asked", F.lower("question")).join(same, "q_asked").select("query_id", "q_answer")
    pairs = near.join(answered, "query_id").join(info.select("row_id", "text"), "row_id")
    says = pairs.select("query_id", "row_id", F.contains(F.lower("text"), F.col("q_answer")).alias("q_says"))
    known = signs.join(inside.withColumn("q_known", F.lit(True)), "url", "left")
    return known, told.join(match.select("query_id", F.col("gold_id").alias("q_match")), "query_id", "left"), says


def rerank(path: DataFrame, cfg: Config, models: Models | None = None) -> DataFrame:
    """The best chunks of each question by fused scores: twice k, of which those that differ enough from better ones, k in all.

    Questions with k chunks or fewer stay as they are.
    """
    own = models or Models()
    path = shared.saved(path, "path")
    n = path.withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    few, many = n.where(F.col("n") <= cfg.k).drop("n"), n.where(F.col("n") > cfg.k).drop("n")
    asked = many.select(F.col("query_id").alias("group_id"), F.lit(-1).cast("long").alias("item_id"), F.lit(True).alias("is_query"), F.col("question").alias("text")).distinct()
    items = many.select(F.col("query_id").alias("group_id"), F.col("row_id").alias("item_id"), F.lit(False).alias("is_query"), "text").unionByName(asked)
    terms = tfidf.scores(items).select(F.col("group_id").alias("query_id"), F.col("item_id").alias("row_id"), "tfidf")
    meta = ranking.metadata_score(F.col("question"), F.col("title"), F.col("url"), F.col("tier"))
    given = many.join(terms, ["query_id", "row_id"]).withColumns({"position": F.col("rank") - 1, "metadata": meta, "cross": own.cross(F.col("question"), F.col("text"))}).drop("rank")
    fused = shared.saved(ranking.fuse(given, 2 * cfg.k), "fused")
    kept = dedup.greedy_keep(fused, cfg.diversity, at_least=3)
    again = Window.partitionBy("query_id").orderBy("rank")
    out = kept.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= cfg.k)
    return out.select(*few.columns).unionByName(few)


def compressed(path: DataFrame) -> DataFrame:
    """A path without chunks that nearly repeat a better one, and with texts cut to what the question needs."""
    kept = shared.saved(dedup.greedy_keep(path, 0.8).withColumn("id", F.xxhash64("query_id", "row_id")), "kept")
    short = compression.compress(kept.select("id", F.col("question").alias("query"), "text", "tier"))
    again = Window.partitionBy("query_id").orderBy("rank")
    return kept.drop("text").join(short.withColumnRenamed("compressed", "text"), "id").drop("id").withColumn("rank", F.row_number().over(again))


def context(path: DataFrame) -> DataFrame:
    """``query_id``, ``context``: passages with questions and answers first, only their answers, numbered sources."""
    is_qa = F.contains("text", F.lit("Question:")) & F.contains("text", F.lit("Answer:"))
    w = Window.partitionBy("query_id").orderBy(F.desc("q_qa"), "rank")
    ordered = path.withColumn("q_qa", is_qa).withColumn("i", F.row_number().over(w))
    shown = F.when(F.col("q_qa"), text.strip(F.regexp_replace("text", r"(?s)^.*?Answer:", ""))).otherwise(F.col("text"))
    title = F.element_at(F.split(F.coalesce("title", F.lit("Source")), " - "), -1)
    part = F.concat(F.lit("[Source "), F.col("i").cast("string"), F.lit("] "), title, F.lit("\n"), shown)
    return ordered.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("context"))


def citations(path: DataFrame, most: int = 160) -> DataFrame:
    """``query_id``, ``sources``: a line for each chunk with a fragment link, then chunks from the fourth on as they are.

    Of equal titles and links the first stays.
    """
    link = F.when((text.text("url") == "") | text.is_label(F.col("text")), F.col("url")).otherwise(text.fragment_url(F.col("url"), text.snippet(F.col("text"), F.col("question"), most)))
    first = F.struct(F.col("rank").alias("i"), "title", link.alias("url"))
    again = F.struct((F.col("rank") + (1 << 20)).alias("i"), "title", "url")
    each = path.select("query_id", F.explode(F.when(F.col("rank") > 3, F.array(first, again)).otherwise(F.array(first))).alias("x")).select("query_id", "x.*")
    w = Window.partitionBy("query_id", "title", "url").orderBy("i")
    own = each.withColumn("p", F.row_number().over(w)).where("p = 1")
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("Source")), F.when(text.text("url") != "", F.concat(F.lit(" ("), F.col("url"), F.lit(")"))).otherwise(""))
    return own.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("l")))), lambda x: x["l"]).alias("sources"))


def apply_fallbacks(answer, question, passages):
    """Credits and course fields from passages (in rank order) where the question asks and the answer lacks them."""
    q, a = F.lower(text.text(question)), text.text(answer)
    first = lambda f: F.try_element_at(F.filter(F.transform(passages, f), lambda x: x.isNotNull()), F.lit(1))
    points = first(text.degree_credits_of)
    idk = text.strip(a) == text.UNKNOWN
    out = F.when(text.any_in(q, ["credits required", "how many credits", "total credits", "credit requirement"]) & points.isNotNull() & (idk | ~a.rlike(r"\b\d{1,3}\b")), F.concat(points, F.lit("."))).otherwise(a)
    fields_ = {"Credits": first(text.credits_of), "Prerequisite(s)": first(text.prerequisites_of), "Grade Mode": first(text.grade_mode_of)}
    said = F.concat_ws(". ", *[F.concat(F.lit(f"{k}: "), v) for k, v in fields_.items()])
    need = text.text(question).rlike(r"\b[A-Z]{2,4}\s*\d{3,4}\b") & ((text.strip(out) == text.UNKNOWN) | ~out.rlike("(?i)credits|prereq|grade")) & (said != "")
    return F.when(need, F.concat(said, F.lit("."))).otherwise(out)


def answer_batch(questions: DataFrame, chunks: DataFrame, gold: DataFrame | None = None, cfg: Config | None = None, models: Models | None = None) -> DataFrame:
    """One row a question: answer, sources, context, rewritten query, mode and gold similarity.

    ``questions`` (query_id, question), ``chunks`` an index, ``gold`` (gold_id, query, reference_answer, url). Equal questions
    are answered once. Canned replies and direct gold matches skip retrieval unless both answers are wanted.
    """
    cfg, own = cfg or Config(), models or Models()
    keyed = questions.withColumn("q_key", F.sha2(text.text("question"), 256))
    distinct = keyed.groupBy("q_key").agg(F.min("query_id").alias("query_id"), F.first("question").alias("question"))
    distinct = distinct.withColumn("canned", text.canned_reply(F.col("question")))
    distinct = shared.saved(distinct.withColumn("transformed", F.when(F.col("canned").isNull(), own.rewrite(F.col("question")))), "questions")
    open_ = distinct.where("canned is null").select("query_id", "question", "transformed")
    direct = known = None
    if gold is not None and cfg.gold_on:
        url = F.col("url") if "url" in gold.columns else F.lit("")
        known = shared.saved(gold.select("gold_id", "query", "reference_answer", url.alias("url"), own.embed(F.col("query")).alias("vector")), "gold")
        direct = shared.saved(gold_matches(open_.select("query_id", own.embed(F.col("transformed")).alias("vector")), known, cfg.direct_threshold), "direct")
        if not cfg.dual:
            open_ = open_.join(direct.select("query_id"), "query_id", "left_anti")
    clear = F.when(F.col("transformed") == F.col("question"), text.clarify(F.col("question")))
    named = F.array(F.struct(F.lit(0).alias("variant"), F.col("question").alias("v")), F.struct(F.lit(1).alias("variant"), F.col("transformed").alias("v")), F.struct(F.lit(2).alias("variant"), clear.alias("v")))
    each = open_.select("query_id", F.explode(named).alias("x")).select("query_id", "x.variant", "x.v").where("v is not null")
    first = Window.partitionBy("query_id", "v").orderBy("variant")
    variants = each.withColumn("q_first", F.row_number().over(first)).where("q_first = 1").drop("q_first")
    if cfg.rerank_on:
        variants = variants.withColumn("v", text.enhance(F.col("v"))["rewritten"])
    variants = shared.saved(variants.withColumn("q_variant", F.xxhash64("query_id", "variant")), "variants")
    path = retrieve(variants.select(F.col("q_variant").alias("query_id"), F.col("v").alias("question")), chunks, cfg, own, known)
    path = shared.saved(compressed(path) if cfg.rerank_on else path, "path")
    passages = path.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("passages"), F.collect_list("title").alias("titles"), F.count("*").alias("n_path"))
    made = passages.join(context(path), "query_id").join(citations(path), "query_id").withColumnRenamed("query_id", "q_variant").join(variants, "q_variant")
    raw = own.generate(F.col("v"), F.element_at("passages", 1))
    answered = made.withColumn("answer", apply_fallbacks(text.clean_answer(raw), F.col("v"), F.col("passages")))
    if cfg.calendar_on:
        pointer = text.calendar_fallback(F.col("v"), F.col("answer"), F.col("titles"), cfg.calendar_url)
        answered = answered.withColumn("q_pointer", pointer).withColumns({"answer": F.coalesce("q_pointer", "answer"), "sources": F.when(F.col("q_pointer").isNull(), F.col("sources")).otherwise(text.lits([]))})
    scored = answered.withColumn("score", ranking.retrieval_score(F.col("answer"), F.size("sources"), F.col("n_path"), F.col("v")))
    best = shared.saved(ranking.best_variant(scored).select("query_id", F.col("answer").alias("r_answer"), "sources", "context"), "answers")
    out = distinct.join(best, "query_id", "left")
    if direct is not None:
        out = out.join(direct, "query_id", "left")
    else:
        out = out.withColumns({"gold_similarity": F.lit(None).cast("double"), "reference_answer": F.lit(None).cast("string"), "gold_id": F.lit(None).cast("string")})
    has_gold = F.col("reference_answer").isNotNull()
    mode = F.when(F.col("canned").isNotNull(), "canned").when(has_gold & F.col("r_answer").isNotNull(), "dual").when(has_gold, "gold_only").otherwise("retrieval_only")
    done = out.select("q_key", F.coalesce("canned", "reference_answer", "r_answer", F.lit(text.UNKNOWN)).alias("answer"), F.when(has_gold, F.col("r_answer")).alias("alternative_answer"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "context", F.col("transformed").alias("transformed_query"), mode.alias("answer_mode"), "gold_similarity")
    return keyed.join(done, "q_key").drop("q_key")
