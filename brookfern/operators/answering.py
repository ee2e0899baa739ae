"""Answers taken from evidence, and whether they may stand: facts, kinds of answers, coverage, rejection, verification.

Facts are rows; each kind of answer scores the facts of a query by its own markers, keeps the best and joins them;
the first candidate without a reason against it is the answer.  One pattern serves all kinds; the phrasing of single
questions (excerpts around fixed phrases, rewritten items) is not there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions import sentences as st
from ..session import materialized, settled, spread, written
from . import answer, cleaning, evaluate

# Phrases of questions that ask for lists, and stop words of the terms of an answer's query.
LIST_QUESTIONS = ["what are", "what types", "what kinds", "what limitations", "what capabilities", "what approaches", "what steps", "what first steps", "what three", "what roles", "main pipeline", "pipeline", "formula", "setup", "commands", "which", "mentioned", "reasons", "list"]
NOT_SECTIONS = ["contents", "references", "unknown"]
OTHER_SECTIONS = ["application", "discussion", "conclusion", "introduction", "opportunities", "limitations", "safety", "concern", "reference"]


def is_list(query: Column) -> Column:
    return text.any_of(F.lower(query), LIST_QUESTIONS)


def is_explanation(query: Column) -> Column:
    q = F.lower(query)
    return q.startswith("why") | (q.contains("article") & (q.contains("mean by") | (q.startswith("what does") & q.contains("mean"))))


def is_insufficient(body: Column) -> Column:
    return text.any_of(F.lower(body), ["does not contain enough information", "not enough information", "retrieved context does not directly answer"])


def phrase_score(body: Column, phrases: Column, low: Column | None = None) -> Column:
    """10 a phrase that stands in the text, 5 if only all its words do, and 8 for its acronym.  low: the text's lower case, where it is at hand."""
    low = F.lower(body) if low is None else low
    padded = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))

    def one(total: Column, phrase: Column) -> Column:
        words = F.split(phrase, " ")
        short = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
        named = padded.contains(F.concat(F.lit(" "), short, F.lit(" "))) | padded.contains(F.concat(F.lit(" "), short, F.lit("s ")))
        whole = F.when(low.contains(phrase), 10).when((F.size(words) >= 2) & F.forall(words, lambda w: low.contains(w)), 5).otherwise(0)
        return total + whole + F.when((F.size(words) >= 2) & named, 8).otherwise(0)

    return F.aggregate(phrases, F.lit(0), one)


def relevance(body: Column, terms: Column, intents: Column, low: Column | None = None) -> Column:
    """1 a term, 2 an intent term, 1 for markers of order and 1 for those of topics.  low: the text's lower case, where it is at hand."""
    low = F.lower(body) if low is None else low
    count = lambda units: F.size(F.filter(units, lambda t: low.contains(t)))
    return count(terms) + count(intents) * 2 + F.when(text.any_of(low, answer.ORDER_MARKERS), 1).otherwise(0) + F.when(text.any_of(low, answer.TOPIC_MARKERS), 1).otherwise(0)


def query_terms(query: Column) -> Column:
    words = F.regexp_extract_all(F.lower(query), F.lit(r"(?<![\p{L}\p{N}_])[a-z](?:[a-z0-9-]{1,}[a-z0-9])(?![\p{L}\p{N}_])"), F.lit(0))
    return F.array_distinct(text.without(words, fixed.WINDOW_STOPS))


def _listed(words: list[str]) -> Column:
    return F.split(F.lit("\x1f".join(words)), "\x1f")


def term_intents(terms: Column) -> Column:
    """What sentences are expected to hold by the terms of a question, each once, in order."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.when(F.arrays_overlap(terms, _listed(named)), _listed(held)).otherwise(none) for named, held in fixed.TERM_INTENTS)))


def fact_intents(query: Column) -> Column:
    """What sentences are expected to hold by what a lower-cased question says, each once, in order."""
    none = F.array().cast("array<string>")
    groups = []
    for ways, held in fixed.FACT_INTENTS:
        said = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (text.any_of(query, words) for words in way)) for way in ways))
        if held[0] == "limitation":
            said = said | (query.contains("challenge") & ~query.rlike(fixed.PRACTICE_CHALLENGE))
        groups.append(F.when(said, _listed(held)).otherwise(none))
    return F.array_distinct(F.concat(*groups))


def _asked(items: DataFrame) -> DataFrame:
    q = F.col("query")
    low = F.lower(q)
    broad = is_list(q) | text.any_of(low, fixed.BROAD_QUERIES)
    asked = settled(items.select("query").distinct(), terms=query_terms(q), phrases=text.focus_phrases(q), intents=fact_intents(low), broad=broad)
    return asked.withColumns({"implied": term_intents(F.col("terms")), "whole": F.array_join(F.array_sort("terms"), " ")})


def section_facts(items: DataFrame) -> DataFrame:
    """(query_id, query, rank, n, sentence): section titles, of items and in the headers of their texts, that answer a question for
    a list of applications or kinds, each once."""
    q = F.lower("query")
    asked = is_list(F.col("query")) | text.any_of(q, ["application", "areas", "types", "kinds", "categories"])
    headed = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\[child chunk \d+ \| page [^\]|]+ \| section ([^\]]+)\]"), F.lit(1))
    titles = F.concat(F.array(F.coalesce("section_title", F.lit(""))), headed)
    each = items.filter(asked).select("query_id", "query", "rank", F.posexplode(titles).alias("n", "title"))
    each = settled(each, title=st.section_clean(F.col("title")))
    low = F.lower("title")
    uses = text.any_of(q, ["application", "areas", "use case", "uses"]) & ~text.any_of(low, OTHER_SECTIONS)
    kinds = ~text.any_of(q, ["application", "areas", "use case", "uses"]) & text.any_of(q, ["types", "kinds", "categories", "name some"]) & ~text.any_of(low, ["discussion", "conclusion", "introduction"])
    found = each.filter((F.col("title") != "") & ~low.isin(NOT_SECTIONS) & (uses | kinds)).withColumn("low", low)
    first = found.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", "low").orderBy("rank", "n"))).filter("copy = 1")
    return first.select("query_id", "query", "rank", "n", F.concat(F.lit("The retrieved document section identifies this relevant item/category: "), "title", F.lit(".")).alias("sentence"))


def fact_list(items: DataFrame, limit: int = 28) -> DataFrame:
    """(query_id, query, fact_no, rank, sentence, score): section titles first, then the best sentences of each item, in item
    order, each once: five of an item, eight where the question is broad.

    Sentences score by relevance, focus phrases, intents, examples and, in relevant items, structure; those with strong
    signs among the first of the leading items have a score of their own.  Code stays only if it is asked for.
    items may carry their cleaned text as ``body``."""
    # What a question asks for is worked out once for each different one, and goes to the items: their texts are not dealt out.
    rows = items.join(written(_asked(items)), "query")
    rows = rows if "body" in items.columns else settled(rows, body=st.evidence_clean(F.coalesce("text", F.lit(""))))
    context = F.concat_ws(" ", F.coalesce("section_title", F.lit("")), F.coalesce("title", F.lit("")), "body")
    hits = lambda low, units, worth: F.size(F.filter(units, lambda t: low.contains(t))) * worth
    # What all terms say together, and what they imply, counts as the terms do.
    related = lambda body, low: relevance(body, F.col("terms"), F.col("implied"), low) + F.when((F.col("whole") != "") & low.contains(F.col("whole")), 2).otherwise(0)
    rows = settled(rows, low_context=F.lower(context))
    low_context = F.col("low_context")
    rows = settled(rows, context_score=related(low_context, low_context) + phrase_score(low_context, F.col("phrases"), low_context) + hits(low_context, F.col("intents"), 1)).drop("low_context")
    split = st.with_fact_sentences(rows, F.col("body"))
    each = split.select("query_id", "query", "rank", "terms", "phrases", "intents", "implied", "whole", "broad", "context_score", F.posexplode("sentences").alias("at", "sentence"))
    s, low = F.col("sentence"), F.col("low")
    each = settled(each, low=F.lower(s))
    own = related(s, low) + phrase_score(s, F.col("phrases"), low) + hits(low, F.col("intents"), 2)
    own = own + F.when(st.is_example(s, F.concat("terms", "intents"), low), 5).otherwise(0) + F.when((F.col("context_score") > 0) & st.is_structured(s, low), F.least(F.lit(6), "context_score")).otherwise(0)
    focused = (F.size("phrases") == 0) | F.exists("phrases", lambda p: low.contains(p))
    early = F.when((F.col("rank") <= 4) & (F.col("at") < 5), 7).when(F.col("at") < 2, 6).otherwise(0)
    signal = F.when((early > 0) & focused & st.is_high_signal(s, low), early).otherwise(0)
    scored = settled(settled(each, own=own, signal=signal), score=F.greatest("own", "signal")).filter("score > 0")
    # Whether a sentence is code takes many patterns: only those that count are asked.
    scored = settled(scored, code=st.is_code(s, low) & ~st.keeps_code(F.col("query"), s)).filter(~F.col("code")).drop("code", "low")
    inner = Window.partitionBy("query_id", "rank").orderBy(F.desc("score"), "at")
    best = scored.withColumn("n", F.row_number().over(inner)).filter(F.col("n") <= F.when(F.col("broad"), 8).otherwise(5))
    titled = section_facts(items).withColumns({"part": F.lit(0), "score": F.lit(0)})
    both = titled.unionByName(best.select("query_id", "query", "rank", "sentence", "n", "score").withColumn("part", F.lit(1)))
    once = both.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", F.lower("sentence")).orderBy("part", "rank", "n"))).filter("copy = 1")
    numbered = once.withColumn("fact_no", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank", "n")))
    return numbered.filter(F.col("fact_no") <= limit).select("query_id", "query", "fact_no", "rank", "sentence", "score")


def _line(sentence: Column, rank: Column, words: Column) -> Column:
    """A fact of at most so many words, ended and cited."""
    parts = F.split(sentence, " ")
    cut = F.when(F.size(parts) > words, F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), words), " "), r"[ ,;:]+$", "")).otherwise(sentence)
    return F.concat(F.when(cut.rlike(r"[.!?]$"), cut).otherwise(F.concat(cut, F.lit("."))), F.lit(" ["), rank.cast("string"), F.lit("]"))


@dataclass(frozen=True)
class Kind:
    """A kind of answer: its markers, what stands before it, how many facts it takes, of how many words."""

    name: str
    markers: tuple[str, ...]
    lead: str = ""
    limit: int = 4
    words: int = 38
    bullets: bool = False


#: Kinds in the order in which their answers are tried.
KINDS = [
    Kind("best_practices", ("best practice", "recommend", "should", "avoid", "keep", "schedule", "configure"), "Recommended practices: ", 6, 30, True),
    Kind("recommended_items", ("recommend", "tool", "library", "package", "service"), "Recommended: ", 5, 30, True),
    Kind("capability", ("simulate", "simulation", "world", "physical", "digital", "environment", "consistency", "coherence", "persistence", "interaction"), "", 5, 38, False),
    Kind("limitation", tuple(fixed.LIMITATION_WORDS), "The highlighted limitations are: ", 7, 34, True),
    Kind("definition", tuple(fixed.RELATIONS), "", 2, 45, False),
    Kind("used_for", ("used for", "useful", "purpose", "application", "helps", "allows"), "", 3, 38, False),
    Kind("meaning", ("means", "refers to", "in other words", "that is"), "", 3, 38, False),
    Kind("pipeline", ("load", "input", "process", "generate", "output", "export", "preview"), "The pipeline: ", 6, 34, True),
    Kind("challenge", ("day", "practice", "mirror", "friend", "feedback", "step"), "", 6, 34, True),
    Kind("command", tuple(fixed.COMMAND_USES), "", 4, 34, False),
    Kind("example", tuple(fixed.EXAMPLE_MARKERS), "", 3, 38, False),
    Kind("why", ("because", "so that", "instead", "due to", "therefore", "helps", "allows", "enables", "reason"), "", 4, 38, False),
    Kind("list", ("include", "such as", "first", "second", "finally", "types", "features"), "", 7, 34, True),
    Kind("mechanism", ("by ", "using", "through", "process", "convert", "generate", "steps"), "", 4, 38, False),
    Kind("focused_entity", (" is ", " are ", "called"), "", 3, 38, False),
]


def wanted_kinds(query: Column) -> Column:
    """Names of the kinds that a query asks for, in order."""
    q = F.lower(query)
    has = lambda *ws: text.any_of(q, list(ws))
    practice = q.rlike(fixed.PRACTICE_CHALLENGE)
    applies = {
        "best_practices": has("best practice"),
        "recommended_items": has("tool", "librar") & (has("recommend") | q.startswith("which")),
        "capability": has("capabilit", "simulat", "ability"),
        "limitation": has("limitation", "weakness") | (has("challenge") & ~practice),
        "definition": st.definition_entity(query) != "",
        "used_for": has("used for", "useful for", "purpose"),
        "meaning": has("mean by") | (q.startswith("what does") & has(" mean")),
        "pipeline": has("pipeline", "workflow", "processing app", "app flow"),
        "challenge": practice,
        "command": q.rlike(fixed.COMMAND_QUERY),
        "example": has("example"),
        "why": is_explanation(query),
        "list": is_list(query),
        "mechanism": q.startswith("how") | has(" turn ", "convert", "transform", "detect"),
        "focused_entity": F.size(text.focus_phrases(query)) > 0,
    }
    return F.filter(F.array(*(F.when(applies[k.name], k.name) for k in KINDS)), lambda k: k.isNotNull())


def candidates(facts: DataFrame, kinds: list[Kind] = KINDS) -> DataFrame:
    """(query_id, query, source, place, candidate): an answer of each kind that the query asks for, from its facts.

    A fact scores 3 a marker of the kind, with its own score; limitations take the best fact of each category first."""
    spark = facts.sparkSession
    rows = [(k.name, i, list(k.markers), k.lead, k.limit, k.words, k.bullets) for i, k in enumerate(kinds)]
    table = spark.createDataFrame(rows, "source string, place int, markers array<string>, lead string, most int, words int, bullets boolean")
    asked = facts.select("query_id", "query").distinct().withColumn("source", F.explode(wanted_kinds(F.col("query")))).drop("query")
    low = F.lower("sentence")
    usable = settled(facts, low_value=st.is_low_value(F.col("sentence")), other_topic=st.competing(F.col("query"), F.col("sentence"))).filter("not low_value").drop("low_value")
    met = usable.join(asked, "query_id").join(table, "source").withColumn("hits", F.size(F.filter("markers", lambda m: low.contains(m)))).withColumn("worth", F.col("hits") * 3 + F.col("score"))
    category, fits = F.lit(None).cast("int"), F.lit(0)
    for i, (_, words) in reversed(list(enumerate(fixed.LIMITATION_CATEGORIES))):
        category = F.when(text.any_of(low, words), i).otherwise(category)
        fits = F.when(F.col("category") == i, answer.hits_in(low, words) * 3).otherwise(fits)
    met = met.withColumn("category", F.when(F.col("source") == "limitation", category)).filter("(hits > 0 or category is not null or source in ('list', 'focused_entity', 'definition')) and not (source = 'list' and other_topic)")
    # In a category its own markers count, and what the question says, not what it is taken to mean.
    terms = query_terms(F.col("query"))
    met = met.withColumn("fits", F.when(F.col("category").isNotNull(), fits + relevance(F.col("sentence"), terms, term_intents(terms), low)).otherwise(0))
    first = (F.col("category").isNotNull()) & (F.row_number().over(Window.partitionBy("query_id", "source", "category").orderBy(F.desc("fits"), "fact_no")) == 1)
    order = Window.partitionBy("query_id", "source").orderBy("later", F.desc("worth"), "fact_no")
    kept = met.withColumn("later", F.when(first, F.col("category")).otherwise(99)).withColumn("n", F.row_number().over(order)).filter("n <= most")
    label = F.lit("")
    for name, words, tag in fixed.LIMITATION_LABELS:
        own = [n for n, _ in fixed.LIMITATION_CATEGORIES].index(name)
        label = F.when((F.col("later") == own) & ~text.any_of(low, words), tag).otherwise(label)
    shown = F.concat(F.when(F.col("bullets"), "- ").otherwise(""), label, _line(F.col("sentence"), F.col("rank"), F.col("words")))
    joined = kept.groupBy("query_id", "query", "source", "place", "lead").agg(F.array_sort(F.collect_list(F.struct("n", shown.alias("line")))).alias("found"))
    return joined.select("query_id", "query", "source", "place", F.concat("lead", F.array_join(F.transform("found", lambda f: f["line"]), " ")).alias("candidate"))


# Coverage


def _groups(body: Column, groups: list[list[str]]) -> Column:
    return sum((F.when(text.any_of(body, words), 1).otherwise(0) for words in groups), F.lit(0))


def _marks(body: Column, words: list[str]) -> Column:
    return answer.hits_in(body, words)


def coverage(query: Column, candidate: Column) -> dict[str, Column]:
    """What of its question a candidate covers, by name: each is true only for questions of its kind."""
    q, c = F.lower(query), F.lower(candidate)
    has = lambda body, *ws: text.any_of(body, list(ws))
    numbered = F.regexp_count(candidate, F.lit(r"\b\d{1,2}\.\s+"))
    cited = text.citation_count(candidate)
    bullets = F.regexp_count(candidate, F.lit(r"(?:^|\s)-\s+"))
    names = F.array_distinct(F.filter(st.names(candidate, 3), lambda n: ~n.isin(fixed.NOT_NAMES)))
    phrases = F.array_union(text.focus_phrases(query), F.slice(st.entities(query), 1, 1))
    setup = has(q, "setup", "install", "commands", "run commands", "setup and run")
    entity = st.definition_entity(query)
    return {
        "definition": (entity != "") & st.names_entity(candidate, entity) & text.any_of(c, fixed.RELATIONS),
        "large_number": ((q.contains("large") & has(q, "number", "integer")) | has(q, "very large", "big number")) & (_groups(c, fixed.NUMBER_COVERAGE) >= 4),
        "formula": has(q, "formula", "part formula", "three-part", "three part") & (c.contains("formula") | candidate.rlike(r"\b\d{1,2}\.\s+\w+")) & ((_marks(c, fixed.FORMULA_PARTS) >= 2) | (numbered >= 2)),
        "pipeline": has(q, "pipeline", "workflow", "processing app", "app flow") & (_groups(c, fixed.PIPELINE_COVERAGE) >= 4),
        "recommended_items": has(q, "tool", "library", "libraries") & (q.contains("recommend") | q.startswith("which")) & c.contains("recommend") & has(c, "tool", "library", "libraries") & (F.size(names) >= 2),
        "focused_list": text.any_of(q, fixed.LIST_FOCUS) & (cited >= 1) & (bullets >= 2) & ((F.size(phrases) == 0) | (phrase_score(candidate, phrases) > 0)) & (_marks(c, fixed.LIST_DETAILS) >= 2),
        "limitation": has(q, "limitation", "limitations", "weakness", "challenge") & (cited >= 1) & (bullets >= 3) & (_groups(c, fixed.LIMITATION_COVERAGE) >= 4),
        "command": F.when(setup, _groups(c, fixed.SETUP_COVERAGE) >= 3).otherwise(candidate.rlike(fixed.COMMAND) & (_marks(c, fixed.COMMAND_USES) >= 2)),
        "practice": c.rlike(r"\bday(?:s)?\s+\d") & (_marks(c, fixed.PRACTICE_MARKERS) >= 2),
    }


def is_unfocused(query: Column, candidate: Column) -> Column:
    """Headings of essays, sections that were not asked for, long answers to short questions, or none of the question's words."""
    q, c = F.lower(query), F.lower(candidate)
    n = st.word_count(candidate)
    terms = answer.evidence_terms(query)
    start = st.first_words(c, 120)
    headings = [*fixed.BROAD_MARKERS, "### challenges"]
    drift = text.any_of(q, ["different", "earlier", "previous", "compared"]) & text.any_of(c, ["applications in various domains", "healthcare", "robotics", "marketing", "education sector"])
    features = c.contains("key features:") & ~text.any_of(q, ["feature", "different"])
    lost = (F.size(terms) > 0) & ~F.exists(terms, lambda t: start.contains(t)) & (n > 120)
    return text.any_of(c, headings) | (~q.contains("application") & c.rlike(r"\bapplications?:")) | drift | ((q.startswith("what is") | q.contains("what type of")) & (n > 90)) | features | lost


def misses_shape(query: Column, candidate: Column) -> Column:
    q, c = F.lower(query), F.lower(candidate)
    has = lambda body, *ws: text.any_of(body, list(ws))
    numbers = ["memory", "dynamically", "dynamic", "allocat", "int", "long", "digit", "10**", "arbitrary", "precision"]
    return (
        F.when(q.contains("what type of input"), ~has(st.first_words(c, 30), "input", "prompt", "instruction", "text", "natural language"))
        .when(q.contains("role"), ~has(st.first_words(c, 80), "role", "agent", "planning", "coding", "testing", "debugging", "documentation"))
        .when(has(q, "architecture", "framework", "components"), ~has(st.first_words(c, 80), "architecture", "framework", "component", "part", "module"))
        .when(has(q, "represent", "before feeding", "model input"), ~has(c, "represent", "latent", "token", "patch", "compress"))
        .when(has(q, "large number", "large integer", "very large"), _marks(c, numbers) < 2)
        .when(has(q, "limitation", "challenges"), ~has(c, "limitation", "challenge", "constraint", "failure", "issue"))
        .otherwise(F.lit(False))
    )


def rejection(query: Column, candidate: Column, results: Column) -> Column:
    """Why a candidate may not stand, by the first reason that holds; empty if none does.  results: how many items may be cited."""
    q, c = F.lower(query), F.lower(candidate)
    covers = coverage(query, candidate)
    numbers = F.transform(F.regexp_extract_all(candidate, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("long"))
    phrases = text.focus_phrases(query)
    command, definition = q.rlike(fixed.COMMAND_QUERY), st.definition_entity(query) != ""
    sentences = st.split(candidate)
    code = ~st.keeps_code(query, candidate) & F.exists(sentences, lambda s: st.is_code(s) & ~st.keeps_code(query, s))
    parts = F.slice(F.split(candidate, r"\s+-\s+"), 2, 1000)
    bare = F.transform(parts, lambda p: F.btrim(text.squeeze(F.regexp_replace(p, r"\[\d+\]", "")), F.lit(" .:-")))
    low_items = F.exists(bare, lambda p: (p == "") | st.is_low_value(p) | p.contains("!!"))
    terms = F.filter(answer.evidence_terms(query), lambda t: ~t.isin("document", "article", "paper"))
    missing = (F.size(terms) > 0) & ~F.exists(terms, lambda t: c.contains(t)) & ((F.size(phrases) == 0) | (phrase_score(candidate, phrases) == 0))
    n = F.regexp_count(candidate, F.lit(text.WORD))
    reasons = [
        ("empty_candidate", F.btrim(F.coalesce(candidate, F.lit(""))) == ""),
        ("insufficient_candidate", is_insufficient(candidate)),
        ("raw_context_leak", text.any_of(c, fixed.ANSWER_LEAK_MARKERS)),
        ("unrequested_code", code),
        ("practice_challenge_coverage_missing", q.rlike(fixed.PRACTICE_CHALLENGE) & ~covers["practice"]),
        ("unfocused_candidate", is_unfocused(query, candidate)),
        ("intent_shape_missing", misses_shape(query, candidate)),
        ("focus_phrase_missing", (F.size(phrases) > 0) & ~F.exists(phrases, lambda p: c.contains(p))),
        ("competing_named_topic", st.competing(query, candidate)),
        ("missing_citation", F.size(numbers) == 0),
        ("invalid_citation", F.exists(numbers, lambda x: (x < 1) | (x > results))),
        ("command_coverage_missing", command & ~covers["command"]),
        ("low_value_candidate_items", ~command & low_items),
        ("definition_coverage_missing", definition & ~covers["definition"]),
        ("distinctive_query_terms_missing", missing),
        ("definition_length_out_of_bounds", definition & ~n.between(8, 95)),
        ("list_answer_too_short", ~definition & is_list(query) & (n < 14)),
        ("explanation_answer_too_short", ~definition & ~is_list(query) & (is_explanation(query) | q.startswith("how")) & (n < 18)),
        ("answer_too_short", ~definition & (n < 8)),
    ]
    return F.coalesce(*(F.when(holds, name) for name, holds in reasons), F.lit(""))


def first_accepted(found: DataFrame) -> DataFrame:
    """The first candidate of each query without a reason against it.  found: candidates with results."""
    # Kept, a few rows a query: each of many reasons reads the cleaned answer.
    cleaned = materialized(cleaning.cleaned(spread(found, "query_id"), "candidate", F.col("results")))
    judged = cleaned.withColumn("reason", rejection(F.col("query"), F.col("candidate"), F.col("results"))).filter("reason = ''")
    order = Window.partitionBy("query_id").orderBy("place")
    return judged.withColumn("n", F.row_number().over(order)).filter("n = 1").select("query_id", "source", F.col("candidate").alias("answer"))


# Verification


def drifts(query: Column, reply: Column) -> Column:
    """An answer speaks of another prominent entity than the one asked about."""
    asked, phrases = st.entities(query), text.focus_phrases(query)
    low, tight, n = F.lower(reply), text.compact(reply), st.word_count(reply)
    held = lambda e: low.contains(e) | ((text.compact(e) != "") & tight.contains(text.compact(e)))
    any_entity, any_phrase = F.exists(asked, held), F.exists(phrases, held)
    allowed = F.array_distinct(F.concat(asked, F.transform(st.names(query, 3), F.lower), st.acronyms(phrases)))
    compacted = F.transform(allowed, text.compact)
    plain = F.regexp_replace(F.regexp_replace(reply, r"\[\d+\]", " "), r"(?:^|[\n.;]\s*|\s+-\s+)[A-Z][A-Za-z0-9 _/&-]{1,48}:\s*", " ")
    others = F.filter(
        F.array_distinct(st.names(plain, 4)),
        lambda e: ~F.array_contains(allowed, F.lower(e)) & ~F.array_contains(compacted, text.compact(e)) & ~F.lower(e).isin(fixed.GENERIC_ENTITIES) & ~F.lower(query).contains(F.lower(e)) & ~text.compact(query).contains(text.compact(e)),
    )
    verbs = r"\b\s+(?:is|are|was|were|can|helps|allows|provides|offers|includes|include|monitors|detects)\b"
    heads = r"(?i)\b(?:features|benefits|limitations|capabilities|components|architecture)\s+of\s+"
    subject = lambda e: F.regexp_like(plain, F.concat(F.lit(r"\b"), e, F.lit(verbs))) | F.regexp_like(plain, F.concat(F.lit(heads), e, F.lit(r"\b")))
    prominent = F.exists(others, lambda e: (F.regexp_count(low, F.concat(F.lit(r"\b"), F.lower(e), F.lit(r"\b"))) >= 2) | subject(e))
    broad = text.any_of(F.lower(query), ["limitation", "challenge", "feature", "capability", "component", "architecture", "how"])
    return (
        F.when(F.size(asked) == 0, False)
        .when((F.size(phrases) > 0) & any_phrase & (n < 160), False)
        .when(~any_entity, True)
        .when((n < 180) | broad, False)
        .otherwise(prominent)
    )


def _content(body: Column, more: int) -> Column:
    words = F.regexp_extract_all(F.lower(body), F.lit(rf"(?<![\p{{L}}\p{{N}}_])[a-z](?:[a-z0-9-]{{{more - 1},}}[a-z0-9])(?![\p{{L}}\p{{N}}_])"), F.lit(0))
    return F.array_distinct(text.without(words, fixed.VERIFIER_STOPS))


def low_overlap(query: Column, reply: Column, evidence: Column) -> Column:
    """An answer shares few words with the evidence (texts of the first items) and with its best sentences."""
    asked, said = _content(query, 2), _content(reply, 3)
    texts = F.transform(F.slice(evidence, 1, 8), lambda t: text.squeeze(F.regexp_replace(F.coalesce(t, F.lit("")), r"\[child chunk \d+ \| page [^\]]+\]\s*", " ")))
    grounded = F.size(F.array_intersect(said, _content(F.array_join(texts, " "), 3)))
    sentences = F.flatten(F.transform(texts, lambda t: st.split(t, 40)))
    scored = F.transform(sentences, lambda s, i: F.struct((-F.size(F.filter(asked, lambda t: F.lower(s).contains(t)))).alias("minus"), i.alias("at"), s.alias("s")))
    kept = F.filter(scored, lambda x: (x["minus"] < 0) & ~text.any_of(F.lower(x["s"]), fixed.PUBLISHER_MARKERS))
    best = F.transform(F.slice(F.array_sort(kept), 1, 6), lambda x: x["s"])
    terms = F.array_except(_content(F.array_join(best, " "), 3), asked)
    shared = F.size(F.array_intersect(terms, said))
    enough = grounded >= F.least(F.lit(4), F.greatest(F.lit(2), F.floor(F.size(said) / 3)))
    few = shared < F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.size(terms) / 8)))
    return (F.size(asked) > 0) & ~enough & (F.size(best) > 0) & (F.size(terms) >= 5) & few


def verified(rows: DataFrame) -> DataFrame:
    """``evaluate.verifier_flags`` with drift and low overlap.  rows: query, answer, retrieved_count, evidence (texts, best first)."""
    flags = evaluate.verifier_flags(rows)
    said = F.btrim("answer") != ""
    out = flags.withColumns({"drift": said & drifts(F.col("query"), F.col("answer")), "low_overlap": said & (F.col("retrieved_count") > 0) & low_overlap(F.col("query"), F.col("answer"), F.col("evidence"))})
    return out.withColumn("status", F.when(F.col("drift") | F.col("low_overlap"), "needs_more_info").otherwise(F.col("status")))


def single_source(items: DataFrame) -> DataFrame:
    """Items of the source of each query's first item, by its title without punctuation; all of them for a question about several."""
    key = text.phrase_form(F.coalesce("title", F.lit("")))
    first = F.first(key).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return items.withColumn("_first", first).filter(st.is_multi_source(F.col("query")) | (F.col("_first") == "") | (F.col("_first") == key)).drop("_first")


def prompts(rows: DataFrame, most: int = 16) -> DataFrame:
    """A prompt for each query from its facts and the shape its answer should have."""
    q = F.lower("query")
    shape = (
        F.when(is_list(F.col("query")), "Use concise bullets, one for each item that the facts support.")
        .when(q.startswith("why"), "Give the reason and its consequences.")
        .when(q.startswith("how"), "Explain the process in order.")
        .otherwise("Give a concise paragraph.")
    )
    facts = rows.filter(F.col("fact_no") <= most).groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("fact_no", F.concat(F.lit("- "), "sentence", F.lit(" ["), F.col("rank").cast("string"), F.lit("]")).alias("line")))).alias("f"))
    return facts.select("query_id", "query", F.concat(F.lit("Answer from the facts only, and cite them as [n].\n"), shape, F.lit("\n\nQuestion:\n"), "query", F.lit("\n\nFacts:\n"), F.array_join(F.transform("f", lambda x: x["line"]), "\n")).alias("prompt"))
