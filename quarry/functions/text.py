"""Text functions on columns: normalising, rewriting, checking and cutting of queries, passages and answers.

Java patterns are ASCII unless ``(?U)`` is given; it is, wherever Unicode white space or word classes matter.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import rules

WS = r"(?U)\s+"
COURSE_CODE = r"\b[A-Z]{2,4}\s?\d{3}[A-Z]?\b"
UNKNOWN = "I don't have that information."


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def trim(c: Column) -> Column:
    return F.trim(c)


def lits(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def split_words(c: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(c, WS), lambda w: w != "")


def any_in(c: Column, needles: Sequence[str]) -> Column:
    """Whether any of the phrases occurs as a substring."""
    # the text is bound by a lambda: within one, Spark would make an expression again for each phrase
    return F.exists(F.array(c), lambda t: F.exists(lits(needles), lambda n: F.contains(t, n))) if needles else F.lit(False)


def found_in(c: Column, needles: Sequence[str]) -> Column:
    """Those of the phrases that occur as substrings."""
    return F.transform(F.array(c), lambda t: F.filter(lits(needles), lambda n: F.contains(t, n)))[0]


def clean_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, WS, " "), "\u00a0", " "))


def generic_norm(c: Column) -> Column:
    return F.regexp_replace(strip(F.lower(c)), r"(?U)[^\w\s]", "")


def program_norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def alpha_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z]+"), F.lit(0))


def content_tokens(c: Column, stop: Sequence[str] = rules.CONTENT_STOPWORDS) -> Column:
    return F.filter(F.array_distinct(alpha_words(c)), lambda w: ~w.isin(list(stop)))


def has_repeated_word(c: Column) -> Column:
    w = alpha_words(c)
    return F.exists(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False)))


def merge_repeated_words(c: Column) -> Column:
    """Runs of one word, ignoring case, become one."""
    return F.regexp_replace(c, r"(?iU)\b(\w+)(\s+\1\b)+", "$1")


def _escaped(s: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}/-])", r"\\\1", s)


def _apply_rule(out: Column, rule: Column, reach: int) -> Column:
    """One keyword rule: its whole-word matches are expanded unless its expansion or one of its words is near."""
    low = F.lower(out)
    parts = F.split(low, rule["word"])

    def near(i):
        start = F.length(F.array_join(F.slice(parts, 1, i + 1), "")) + i * rule["size"]
        begin = F.greatest(F.lit(0), start - reach)
        return F.arrays_overlap(split_words(F.substring(low, begin + 1, start + rule["size"] + reach - begin)), rule["others"])

    keep = (F.size(parts) < 2) | F.contains(low, rule["expansion"]) | F.exists(F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0))), near)
    return F.when(keep, out).otherwise(F.regexp_replace(out, rule["word"], rule["value"]))


def domain_rules(c: Column, pairs: Sequence[tuple[str, str]] = rules.DOMAIN_RULES, reach: int = 30) -> Column:
    """Expand keywords in order, unless the expansion is there already or one of its words is near a match.

    A fold over the rules as data: as nested expressions each rule would repeat the whole text expression several times.
    """
    table = [
        F.struct(
            F.lit(rf"(?iU)\b{_escaped(key)}\b").alias("word"),
            F.lit(len(key)).alias("size"),
            F.lit(value.lower()).alias("expansion"),
            F.lit(value.replace("\\", "\\\\").replace("$", "\\$")).alias("value"),
            lits(sorted(set(value.lower().split()) - {key.lower()})).alias("others"),
        )
        for key, value in pairs
    ]
    return F.aggregate(F.array(*table), c, lambda out, rule: _apply_rule(out, rule, reach)) if table else c


def of_school(phrases: Sequence[str], school: str) -> list[str]:
    """Fixed phrases with the caller's institution in its place, lower-cased and without blanks it leaves behind."""
    return [" ".join(p.replace("{school}", school).lower().split()) for p in phrases]


def special_rewrites(school: str = "") -> dict[str, str]:
    return {k: " ".join(v.replace("{school}", school).split()) for k, v in rules.SPECIAL_REWRITES.items()}


def transform_query(c: Column, special: dict[str, str] | None = None, pairs: Sequence[tuple[str, str]] = rules.DOMAIN_RULES, candidates=None, school: str = "") -> Column:
    """Exact special rewrites first, else white space, domain rules and repeated words.

    ``candidates`` (question, prompt) -> array of a model's rewrites: the best one that passes all guards and keeps codes
    and numbers of the original is taken instead. Their prompt depends on the intent.
    """
    ruled = merge_repeated_words(domain_rules(clean_space(text(c)), pairs))
    out = ruled
    if candidates is not None:
        best = best_rewrite(ruled, candidates(ruled, rewrite_prompt(ruled, school)), school=school)
        out = F.when(valid_rewrite(c, best), best).otherwise(ruled)
    known = special_rewrites(school) if special is None else special
    if known:
        table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        out = F.coalesce(F.try_element_at(table, strip(F.lower(text(c)))), out)
    return out


def rewrite_prompt(c: Column, school: str = "") -> Column:
    """What a rewriting model is given: the task, the hint of the question's intent, and the question."""
    task = f"Turn the message into one clear question about graduate study{' at ' + school if school else ''}. Keep its meaning and its key words, add no facts."
    hints = F.create_map(*[F.lit(x) for pair in rules.INTENT_HINTS.items() for x in pair])
    return F.concat(F.lit(task + " "), F.element_at(hints, intent(c)), F.lit("\nMessage: "), text(c), F.lit("\nQuestion:"))


def best_rewrite(original: Column, candidates: Column, similarity=None, least: float = 0.6, school: str = "") -> Column:
    """Of an array of candidates the one that keeps most content words among those all guards accept, the first of equals;
    without one, the original. ``similarity`` (original, candidate) -> number, at least ``least`` if given."""

    def scored(candidate, i):
        said = strip(text(candidate))
        repaired = F.when(has_repeated_word(said), merge_repeated_words(said)).otherwise(said)
        ok = accepted_rewrite(original, said, school=school)
        if similarity is not None:
            ok = ok & (similarity(original, repaired) >= least)
        return F.when(ok, F.struct((-rewrite_score(original, repaired)).alias("score"), i.alias("i"), repaired.alias("said")))

    passed = F.filter(F.transform(candidates, scored), lambda x: x.isNotNull())
    return F.when(F.size(passed) > 0, F.array_min(passed)["said"]).otherwise(text(original))


def rewrite_flags(original: Column, transformed: Column, least: int = 5, most: int = 25, forbidden: Sequence[str] = ("external graduate transfer credits",)) -> Column:
    """Struct of kept_tokens_ok, forbidden_hit, dup_words_fixed and the reason why a rewrite counts as fallen back."""
    before, after = content_tokens(original), content_tokens(transformed)
    kept = (F.size(before) == 0) | F.arrays_overlap(before, after)
    hit = any_in(F.lower(text(transformed)), list(forbidden)) & ~F.array_contains(before, "transfer")
    fixed = ~has_repeated_word(transformed)
    n = F.size(F.regexp_extract_all(text(transformed), F.lit("[a-zA-Z]+"), F.lit(0)))
    by_rules = text(transformed) == domain_rules(clean_space(text(original)))
    reason = F.when(by_rules, "rule_fallback").when(~kept, "lost_tokens").when(hit, "forbidden_phrase").when(~fixed, "duplicate_words").when(~n.between(least, most), "length_out_of_range").otherwise("")
    return F.struct(kept.alias("kept_tokens_ok"), hit.alias("forbidden_hit"), fixed.alias("dup_words_fixed"), reason.alias("fallback_reason"))


def valid_rewrite(original: Column, rewritten: Column) -> Column:
    """No course code and no number of the original is lost, and at least three words stay."""
    codes = lambda c: F.regexp_extract_all(c, F.lit(COURSE_CODE), F.lit(0))
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    lost = lambda f: F.size(F.array_except(f(text(original)), f(text(rewritten)))) == 0
    return lost(codes) & lost(numbers) & (F.size(split_words(text(rewritten))) >= 3)


def key_tokens(c: Column) -> Column:
    return found_in(F.lower(text(c)), rules.KEY_TOKEN_HINTS)


def policy_nouns(c: Column) -> Column:
    return found_in(F.lower(text(c)), rules.POLICY_NOUNS)


def sane(original: Column, rewritten: Column, school: str = "") -> Column:
    """No listed phrase occurs twice, and some key token of the original survives if it has any."""
    low = F.lower(text(rewritten))
    keys = key_tokens(original)
    ok = (F.size(keys) == 0) | F.exists(keys, lambda k: F.contains(low, k))
    for phrase in of_school(rules.ONCE_PHRASES, school):
        ok = ok & (F.regexp_count(low, F.lit(_escaped(phrase))) <= 1)
    return ok


def rewrite_score(original: Column, rewritten: Column) -> Column:
    """Share of the original's content tokens that the rewrite keeps."""
    a, b = content_tokens(original), content_tokens(rewritten)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def accepted_rewrite(original: Column, rewritten: Column, least: int = 5, most: int = 25, echoes: Sequence[str] | None = None, forbidden: Sequence[str] | None = None, school: str = "") -> Column:
    """All guards a generated rewrite has to pass, but for the one on similarity."""
    echoes = of_school(rules.ECHO_PHRASES, school) if echoes is None else list(echoes)
    forbidden = of_school(rules.TRANSFER_PHRASES, school) if forbidden is None else list(forbidden)
    low, said = F.lower(text(rewritten)), F.lower(text(original))
    repaired = F.when(has_repeated_word(rewritten), merge_repeated_words(rewritten)).otherwise(rewritten)
    a, b = content_tokens(original), content_tokens(repaired)
    pa, pb = policy_nouns(original), policy_nouns(repaired)
    n = F.size(F.regexp_extract_all(text(repaired), F.lit("[a-zA-Z]+"), F.lit(0)))
    return (
        ~any_in(low, echoes)
        & ~(any_in(low, forbidden) & ~F.contains(said, F.lit("transfer")))
        & ~(F.contains(low, F.lit("are not eligible")) & ~F.contains(said, F.lit("not eligible")))
        & ((F.size(a) == 0) | F.arrays_overlap(a, b))
        & ((F.size(pa) == 0) | F.arrays_overlap(pa, pb))
        & (F.size(F.array_except(pb, pa)) == 0)
        & n.between(least, most)
        & sane(original, repaired, school)
        & strip(text(repaired)).endswith("?")
    )


def intent(c: Column, table: Sequence[tuple[str, list[str]]] = rules.INTENTS) -> Column:
    low = F.lower(text(c))
    out = F.lit("general")
    for label, words in reversed(table):
        out = F.when(any_in(low, words), label).otherwise(out)
    return out


def expand_acronyms(c: Column, pairs: Sequence[tuple[str, str]] = rules.ACRONYMS) -> Column:
    out = F.lower(text(c))
    for pattern, value in pairs:
        out = F.regexp_replace(out, f"(?iU){pattern}", value)
    return out


def key_terms(c: Column, stop: Sequence[str] = rules.KEY_TERM_STOPWORDS) -> Column:
    """Words longer than two letters that are no stop words, then adjacent pairs without a stop word."""
    w = split_words(F.lower(text(c)))
    stops = list(stop)
    single = F.filter(w, lambda x: ~x.isin(stops) & (F.length(x) > 2))
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.when(b.isNotNull() & ~a.isin(stops) & ~b.isin(stops), F.concat_ws(" ", a, b)))
    return F.concat(single, F.filter(pairs, lambda p: p.isNotNull()))


def boosted(c: Column, terms: Sequence[str] = rules.PROGRAM_TERMS) -> Column:
    """The query with each program term it has appended once more."""
    hits = found_in(F.lower(text(c)), terms)
    return F.when(F.size(hits) > 0, F.concat(text(c), F.lit(" "), F.array_join(hits, " "))).otherwise(text(c))


def policy_rewrite(c: Column) -> Column:
    out = text(c)
    for pattern, value in rules.POLICY_REWRITES:
        out = F.regexp_replace(out, f"(?i){pattern}", value)
    return out


def enhance(c: Column, kind: str = "general") -> Column:
    """Struct of the original, its expansion, key terms and the rewritten query."""
    expanded = boosted(expand_acronyms(c))
    rewritten = policy_rewrite(expanded) if kind == "policy" else expanded
    return F.struct(text(c).alias("original"), expand_acronyms(c).alias("expanded"), key_terms(c).alias("key_terms"), rewritten.alias("rewritten"))


def sub_queries(c: Column) -> Column:
    """The query, the halves of a single " and ", and sentences with a question word: the first three distinct."""
    q = text(c)
    halves = F.split(q, "(?i) and ")
    asked = F.filter(F.split(q, r"[.!?]+"), lambda s: s.rlike(r"(?i)\b(what|how|when|where|who|why|which)\b"))
    parts = F.concat(F.array(q), F.when(F.size(halves) == 2, F.transform(halves, trim)).otherwise(F.array().cast("array<string>")), F.transform(asked, trim))
    return F.slice(F.array_distinct(F.filter(parts, lambda s: s != "")), 1, 3)


def clarify(c: Column, pairs: Sequence[tuple[str, str]] = rules.CLARIFIERS) -> Column:
    """The query with the expansions of its keywords appended, or null if nothing is added."""
    low = F.lower(text(c))
    extra = F.array(*[F.when(F.contains(low, F.lit(k)) & ~F.contains(low, F.lit(v.lower())), F.lit(v)) for k, v in pairs])
    added = F.filter(extra, lambda x: x.isNotNull())
    return F.when((F.size(added) > 0) & (text(c) != ""), F.concat(text(c), F.lit(" "), F.array_join(added, " ")))


def _span(parts: Column, n: int, reply: str):
    """Start, end and reply of the i-th match of a phrase of ``n`` characters that split the text into ``parts``."""

    def make(i):
        at = F.length(F.array_join(F.slice(parts, 1, i + 1), "")) + i * n
        return F.struct(at.alias("start"), F.lit(-n).alias("neg"), (at + n).alias("end"), F.lit(reply).alias("reply"))

    return make


def canned_reply(c: Column, phrases: Sequence[tuple[str, str]] = rules.CANNED, replies: dict[str, str] | None = None) -> Column:
    """Replies to all whole phrases found, from left to right, longest first, without overlap; null if none is."""
    said = replies or rules.REPLIES
    t = generic_norm(text(c))
    spans = []
    for phrase, kind in phrases:
        if not said.get(kind):
            continue
        parts = F.split(t, rf"(?U)\b{_escaped(phrase)}\b")
        n = len(phrase)
        hit = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), _span(parts, n, said[kind]))
        empty = F.array().cast("array<struct<start:int,neg:int,end:int,reply:string>>")
        spans.append(F.when(F.size(parts) > 1, hit.cast("array<struct<start:int,neg:int,end:int,reply:string>>")).otherwise(empty))
    ordered = F.array_sort(F.concat(*spans))
    start = F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("replies"))
    # spans that touch the last one kept count as overlapping
    kept = F.aggregate(ordered, start, lambda acc, s: F.when(s["start"] > acc["end"], F.struct(s["end"].alias("end"), F.concat(acc["replies"], F.array(s["reply"])).alias("replies"))).otherwise(acc))
    return F.when(F.size(kept["replies"]) > 0, F.array_join(kept["replies"], " "))


def course_code(c: Column) -> Column:
    """Struct of subject, number and normal form of the first course code, or null."""
    up = F.upper(text(c))
    pattern = r"\b([A-Z]{2,5})\s*-?\s*(\d{3}[A-Z]?)\b"
    subject, number = F.regexp_extract(up, pattern, 1), F.regexp_extract(up, pattern, 2)
    return F.when(subject != "", F.struct(subject.alias("subj"), number.alias("num"), F.concat_ws(" ", subject, number).alias("norm")))


def course_search_url(norm: Column, base: str) -> Column:
    return F.concat(F.lit(f"{base}/search/?P="), F.url_encode(norm))


def url_has_course(url: Column, norm: Column) -> Column:
    low, u = F.lower(norm), F.lower(text(url))
    return F.contains(u, F.concat(F.lit("/search/?p="), F.replace(low, F.lit(" "), F.lit("%20")))) | F.contains(u, F.concat(F.lit("/search/?p="), F.replace(low, F.lit(" "), F.lit("+")))) | F.contains(u, F.concat(F.lit("/search/?p="), low))


def title_starts_with(title: Column, norm: Column) -> Column:
    return strip(F.upper(text(title))).startswith(F.upper(norm))


def title_subject(title: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(strip(text(title))), r"^\s*([A-Z]{2,5})\s*[- ]?\s*\d{3}[A-Z]?", 1), F.lit(""))


def credits_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(text(c), r"(?i)\bCredits:\s*([0-9]+)\b", 1), F.lit(""))


def prerequisites_of(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text(c), r"(?i)\bPrerequisite\(s\):\s*(.+?)(?:\.\s*$|$)", 1)), F.lit(""))


def grade_mode_of(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text(c), r"(?i)\bGrade\s*Mode:\s*([A-Za-z/ \-]+)$", 1)), F.lit(""))


def degree_credits_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(text(c), r"(?i)(\d{1,3})\s*(credits|credit hours?)", 1), F.lit(""))


def encode_fragment(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(clean_space(text(c))), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def snippet(passage: Column, hint: Column | None = None, most: int = 140) -> Column:
    """The sentence that shares most words with the hint (the first of several), cut at a blank."""
    p = clean_space(text(passage))
    parts = sentences(p)
    chosen = F.try_element_at(parts, F.lit(1))
    if hint is not None:
        words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), F.lit(0)))
        wanted = F.filter(words(clean_space(text(hint))), lambda w: F.length(w) > 2)
        ranked = F.transform(F.array(wanted), lambda own: F.transform(parts, lambda s, i: F.struct((-F.size(F.array_intersect(words(s), own))).alias("k"), i.alias("i"), s.alias("s"))))[0]
        chosen = F.array_min(ranked)["s"]
    s = F.coalesce(chosen, p)
    cut = F.substring(s, 1, most)
    at = F.length(cut) - F.instr(F.reverse(cut), " ") + 1
    return F.when(F.length(s) <= most, s).when(F.instr(cut, " ") == 0, cut).otherwise(F.substring(cut, F.lit(1), at - 1))


def fragment_url(url: Column, passage: Column, prefix: Column | None = None, suffix: Column | None = None) -> Column:
    low = F.lower(url)
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    parts = [F.concat(encode_fragment(prefix), F.lit("-,"))] if prefix is not None else []
    parts.append(encode_fragment(passage))
    if suffix is not None:
        parts.append(F.concat(F.lit(",-"), encode_fragment(suffix)))
    skip = url.isNull() | (url == "") | low.endswith(".pdf") | F.contains(low, F.lit("content=pdf"))
    return F.when(skip, url).otherwise(F.concat(bare, F.lit("#:~:text="), *parts))


def is_label(passage: Column) -> Column:
    return F.coalesce(F.lower(clean_space(passage)).startswith("links:"), F.lit(False))


def clean_answer(c: Column, unknown: str = UNKNOWN, most: int = 400) -> Column:
    """Without source marks; the first three sentences, or one or two if these are too long."""
    bare = strip(F.regexp_replace(F.regexp_replace(c, r"\[Source \d+\]", ""), r"\bSource \d+\b", ""))
    parts = F.split(bare, r"(?U)(?<=[.!?])\s+")
    short = F.when(F.size(parts) > 3, F.array_join(F.slice(parts, 1, 3), " ")).otherwise(bare)
    again = F.split(short, r"(?U)(?<=[.!?])\s+")
    one = F.element_at(again, 1)
    two = F.concat(one, F.lit(" "), F.try_element_at(again, F.lit(2)))
    cut = F.when(F.length(short) <= most, short).when((F.size(again) > 1) & (F.length(two) <= most), two).otherwise(one)
    return F.when(c.isNull() | (c == "") | (strip(c) == unknown), c).otherwise(strip(cut))


def calendar_fallback(question: Column, answer: Column, titles: Column, url: str) -> Column:
    """A pointer to the calendar for questions on dates that neither answer nor sources settle; else null."""
    ask, joined = text(question), F.lower(F.array_join(titles, " | "))
    asks = ask.rlike("(?i)" + "|".join(rules.CALENDAR_WORDS)) & ~ask.rlike("(?i)" + "|".join(_escaped(p) for p in rules.CALENDAR_NEVER))
    dated = text(answer).rlike("(?i)" + "|".join(rules.DATE_PATTERNS))
    return F.when(asks & ~dated & ~any_in(joined, rules.CALENDAR_TITLES), F.lit(f"Dates vary by year and program. For official dates see the academic calendar: {url}"))


def remove_boilerplate(c: Column) -> Column:
    out = text(c)
    for pattern in rules.BOILERPLATE:
        out = F.regexp_replace(out, f"(?is){pattern}", "")
    return strip(out)


def hyde_clean(c: Column) -> Column:
    """A generated passage without labels and prompt leftovers: lines up to more than 100 characters, capitalised."""
    out = text(c)
    for label in ("Answer:", "Output:", "Question:"):
        out = strip(F.replace(out, F.lit(label), F.lit("")))
    for fragment in rules.PROMPT_FRAGMENTS:
        out = F.regexp_replace(out, f"(?i){_escaped(fragment)}", "")
    out = F.regexp_replace(out, r"^[.:;,\- \n\t]+|[.:;,\- \n\t]+$", "")
    lines = F.filter(F.transform(F.split(out, "\n"), strip), lambda s: s != "")
    joined = F.aggregate(lines, F.lit(""), lambda acc, s: F.when(F.length(acc) > 100, acc).when(acc == "", s).otherwise(F.concat(acc, F.lit(" "), s)))
    return F.concat(F.upper(F.substring(joined, 1, 1)), F.substring(joined, 2, 1 << 30))


def hyde_wanted(c: Column, least: int = 3) -> Column:
    return (F.size(split_words(text(c))) >= least) & ~text(c).rlike(r"^\s*[A-Z]{2,5}\s*\d{3}[A-Z]?\s*$")


def clean_question(c: Column) -> Column:
    """A generated question: cut, stripped of labels, numbers and quotes, ending in "?"; null if unfit."""
    q = F.when(F.contains(text(c), F.lit("?")), F.concat(F.split_part(text(c), F.lit("?"), F.lit(1)), F.lit("?"))).otherwise(text(c))
    for label in ("Question:", "Student question:", "Answer:", "Q:", "A:"):
        q = F.regexp_replace(q, rf"(?i)^{label}\s*", "")
    q = strip(F.split_part(q, F.lit("\n"), F.lit(1)))
    q = F.regexp_replace(F.regexp_replace(q, r"^\d+[.)]\s*", ""), r"^[-•*]\s*", "")
    q = strip(F.regexp_replace(q, "^[\"']|[\"']$", ""))
    q = F.when((q != "") & ~q.endswith("?"), F.concat(q, F.lit("?"))).otherwise(q)
    low = F.lower(q)
    generic = F.exists(F.array(low), lambda t: F.exists(lits(rules.GENERIC_STARTS), lambda s: t.startswith(s))) & ~any_in(low, rules.SPECIFIC_MARKERS)
    return F.when(F.length(q).between(10, 150) & ~any_in(low, rules.META_TERMS) & ~generic, q)


def qa_chunk(passage: Column, questions: Column) -> Column:
    clean = clean_space(text(passage))
    many = F.array_join(F.transform(questions, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n")
    return F.when(F.size(questions) == 1, F.concat(F.lit("Question: "), F.element_at(questions, 1), F.lit("\n\nAnswer: "), clean)).otherwise(F.concat(F.lit("Questions:\n"), many, F.lit("\n\nAnswer: "), clean))


def prompt_parts(unknown: str = UNKNOWN) -> tuple[str, str, str]:
    """What stands before the context, between it and the question, and behind that."""
    head = f"Answer from the context alone, in two or three full sentences. Mention requirements, deadlines or procedures it has. If it does not suffice, say exactly: {unknown}\n\nContext: "
    return head, "\n\nQuestion: ", "\n\nAnswer:"


def prompt(question: Column, context: Column, unknown: str = UNKNOWN) -> Column:
    head, between, tail = prompt_parts(unknown)
    return F.concat(F.lit(head), text(context), F.lit(between), text(question), F.lit(tail))


def selection_log_text(c: Column) -> Column:
    return F.translate(text(c), "\n\r", "  ")


def clock(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def band(share: Column) -> Column:
    """Colour of a metric in percent."""
    return F.when(share >= 70, "green").when(share >= 50, "yellow").otherwise("red")


def run_date(run_id: Column) -> Column:
    return F.date_format(F.try_to_timestamp(run_id, F.lit("yyyyMMdd_HHmmss")), "yyyy-MM-dd HH:mm:ss")


def category_colour(c: Column, colours: int = 10) -> Column:
    """Stable colour number: a 31-hash in 32 bits, modulo ``colours``."""
    codes = F.transform(F.filter(F.split(text(c), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    wrapped = lambda v: F.pmod(v + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return (F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda acc, x: wrapped(acc * 31 + x))) % colours).cast("int")


def source_line(c: Column) -> Column:
    """Struct of title and url of a line "- Title (url)"; without an address the line less its dash, url null."""
    pattern = r"^-\s*(.+?)\s*\(([^)]+)\)\s*$"
    t = text(c)
    bare = F.trim(F.regexp_replace(t, r"^-+\s*", ""))
    both = F.struct(F.regexp_extract(t, pattern, 1).alias("title"), F.regexp_extract(t, pattern, 2).alias("url"))
    alone = F.struct(F.when(bare == "", t).otherwise(bare).alias("title"), F.lit(None).cast("string").alias("url"))
    return F.when(t.rlike(pattern), both).otherwise(alone)


def linked(c: Column) -> Column:
    """Markdown links, or else bare addresses, as anchors."""
    anchor = lambda href, label: f'<a href="{href}" target="_blank" rel="noopener noreferrer">{label}</a>'
    marked = r"\[([^\]]+)\]\((https?://[^\s)]+)\)"
    t = text(c)
    return F.when(t.rlike(marked), F.regexp_replace(t, marked, anchor("$2", "$1"))).otherwise(F.regexp_replace(t, r"(https?://[^\s)]+)(\)?)", anchor("$1", "$1")))


def wrapped(c: Column, width: int = 80) -> Column:
    """Lines of whole words of at most ``width`` characters; a longer word is cut."""
    pieces = F.flatten(F.transform(split_words(text(c)), lambda w: F.regexp_extract_all(w, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(acc, w):
        fits = (acc["line"] == "") | (F.length(acc["line"]) + 1 + F.length(w) <= width)
        longer = F.when(acc["line"] == "", w).otherwise(F.concat(acc["line"], F.lit(" "), w))
        return F.when(fits, F.struct(acc["done"].alias("done"), longer.alias("line"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["line"])).alias("done"), w.alias("line")))

    return F.aggregate(pieces, start, step, lambda acc: F.array_join(F.concat(acc["done"], F.filter(F.array(acc["line"]), lambda x: x != "")), "\n"))
