"""Evidence scoring and extractive answers for many queries at once.

Items: (query_id, rank, chunk_id, title, section_title, text, hybrid_score).  Sentences are
rows; scores are column expressions over marker lists; selection is a window per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..session import materialized

# Stop words, shape words, thresholds and markers of evidence scoring.
EVIDENCE_STOPS = ["the", "and", "for", "with", "what", "does", "review", "discuss", "are", "how", "why", "this", "that", "from", "into", "about", "they", "their", "before", "after", "using", "uses"]
PIPELINE_WORDS = ["pipeline", "workflow", "processing app", "app flow"]
FORMULA_WORDS = ["formula", "part formula", "three-part", "three part"]
LIMIT_WORDS = ["limitation", "limitations", "challenge", "risk", "weakness", "constraint"]
LIST_WORDS = ["feature", "features", "capability", "capabilities", "strength", "strengths", "advantage", "advantages", "benefit", "benefits", "approaches", "types", "kinds", "steps", "setup", "role", "roles", "component", "components"]
SPECULATIVE = ["we speculate", "may ", "might ", "likely ", "reverse engineering", "possible "]
ORDER_MARKERS = ["first", "second", "third", "finally", "include", "includes", "consists", "composed", "such as", "it has three parts", "(1)", "(2)", "(3)"]
TOPIC_MARKERS = ["limitation", "challenge", "benefit", "approach", "method", "architecture", "prompt", "compression", "released", "model", "called", "known as"]
THRESHOLDS = {"definition": 14.0, "limitation": 13.0, "list": 13.0, "mechanism": 14.0, "explanation": 14.0, "usage": 13.0, "pipeline": 13.0}
ABSTAIN = "The provided context does not contain enough information."

DIRECT = fixed.DIRECT_MARKERS
#: Categories of facts by shape for category answers; a corpus can bring its own.
CATEGORIES = {
    "limitation": {"physical": ["cause", "effect", "physical"], "spatial": ["spatial", "placement", "direction"], "temporal": ["temporal", "sequence", "flow"], "access": ["usage", "access", "release", "safety"]},
    "list": {"first": ["first", "one"], "more": ["include", "such as"], "last": ["finally", "last"]},
}


def hits(body: Column, words: list[str]) -> Column:
    return sum((F.when(body.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def evidence_terms(query: Column) -> Column:
    return F.array_distinct(text.without(text.tokens(query), EVIDENCE_STOPS, 4))


def shape_of(query: Column) -> Column:
    q = F.btrim(F.lower(query))
    has = lambda ws: text.any_of(q, ws)
    return (
        F.when(has(["compare", "across documents", "both papers", "each document"]), "")
        .when(has(PIPELINE_WORDS), "pipeline")
        .when(has(FORMULA_WORDS), "list")
        .when(q.startswith("what is") | q.startswith("define ") | q.contains("definition of"), "definition")
        .when(has(LIMIT_WORDS), "limitation")
        .when(has(LIST_WORDS), "list")
        .when(q.startswith("how"), "mechanism")
        .when(q.startswith("why"), "explanation")
        .when(has(["used for", "useful for", "useful", "usefulness", "purpose"]) | (q.contains("command") & has(["why", "start", "run", "provide"])), "usage")
        .otherwise("")
    )


def intent_terms(query: Column, intents: list[tuple[list[str], list[str]]] = fixed.EVIDENCE_INTENTS) -> Column:
    """Terms that evidence for the intents of a lower-cased query is expected to hold, each once, in order."""
    none = F.array().cast("array<string>")
    groups = []
    for words, terms in intents:
        named = text.any_of(query, words)
        if "limitation" in words:
            named = named | (query.contains("challenge") & ~query.rlike(fixed.PRACTICE_CHALLENGE))
        groups.append(F.when(named, F.split(F.lit("|".join(terms)), r"\|")).otherwise(none))
    return F.array_distinct(F.concat(*groups))


def asked_phrases(query: Column) -> Column:
    """What follows about, say about, does or do in a lower-cased query, if it is two words or more, and its pairs of words."""
    none = F.array().cast("array<string>")
    tails = []
    for mark in (" about ", " say about ", " does ", " do "):
        at = F.instr(query, mark)
        tail = F.btrim(F.regexp_replace(F.substring(query, at + len(mark), F.length(query)), r"\?$", ""))
        tails.append(F.when((at > 0) & tail.rlike(r"\S\s+\S"), F.array(tail)).otherwise(none))
    words = text.without(text.ascii_words(query, "a-zA-Z", "a-zA-Z0-9-"), EVIDENCE_STOPS, 4)
    return F.array_distinct(F.concat(*tails, text.ngrams(words, 2)))


def directness(shape: Column, evidence: Column, markers: dict[str, list[str]] = DIRECT) -> Column:
    """How many markers of its shape a lower-cased text holds; numbered items and cues count for lists, stages for pipelines."""
    score = F.lit(0)
    for name, words in markers.items():
        score = F.when(shape == name, hits_in(evidence, words)).otherwise(score)
    numbered = F.least(F.lit(4), F.regexp_count(evidence, F.lit(r"(?<!\d)\b\d{1,2}\.\s+")))
    cue = F.when(evidence.rlike(fixed.LIST_CUE), 1).otherwise(0)
    return score + F.when(shape == "list", numbered + cue).when(shape == "pipeline", stages(evidence) * 2).otherwise(0)


def hits_in(body: Column, words: list[str]) -> Column:
    """How many of the words are substrings: a loop over a constant array, so that code does not grow with it."""
    return F.size(F.filter(F.split(F.lit("\x1f".join(words)), "\x1f"), lambda w: body.contains(w)))


def stages(evidence: Column) -> Column:
    return sum((F.when(text.any_of(evidence, words), 1).otherwise(0) for words in fixed.PIPELINE_STAGES), F.lit(0))


def with_relevance(items: DataFrame) -> DataFrame:
    """items (with column query) plus overlap, intent_hits and relevance: 2 a term, 6 or 3 a phrase in the section or
    anywhere, 4 if all terms are there, 5 and 2 an intent term in the section and anywhere."""
    body = F.lower(F.concat_ws(" ", F.coalesce("section_title", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    section = F.lower(F.concat_ws(" ", F.coalesce("section_title", F.lit("")), F.coalesce("title", F.lit(""))))
    # What a query asks for is worked out once for each query.
    low = F.lower("query")
    asked = items.select("query").distinct().withColumns({"terms": evidence_terms(F.col("query")), "phrases": asked_phrases(low), "intents": intent_terms(low)})
    staged = items.withColumns({"evidence": body, "section_text": section}).join(asked, "query")
    count = lambda units, place: F.size(F.filter(units, lambda t: F.col(place).contains(t)))
    counted = staged.withColumns({"overlap": count("terms", "evidence"), "intent_hits": count("intents", "evidence")})
    whole = F.when((F.size("terms") > 0) & (F.col("overlap") == F.size("terms")), 4).otherwise(0)
    relevance = F.col("overlap") * 2 + count("phrases", "section_text") * 6 + count("phrases", "evidence") * 3 + whole + count("intents", "section_text") * 5 + F.col("intent_hits") * 2
    return counted.withColumn("relevance", relevance)


def _bonus(column: str, items: DataFrame, times: float, most: float | None = None) -> Column:
    worth = F.coalesce(F.col(column).cast("double"), F.lit(0.0)) * times if column in items.columns else F.lit(0.0)
    return worth if most is None else F.least(F.lit(most), worth)


def fast_path(items: DataFrame, limit: int = 8, markers: dict[str, list[str]] = DIRECT) -> DataFrame:
    """Evidence chosen without a model: threshold of the shape, then 45 % of the best score, at least three; nothing
    for a query whose choice does not suffice for its shape.  place: by score; order: by relevance."""
    thresholds = F.create_map(*(F.lit(x) for pair in THRESHOLDS.items() for x in pair))
    scored = with_relevance(items).withColumn("shape", shape_of(F.col("query"))).filter("shape <> ''")
    scored = scored.withColumns({"direct": directness(F.col("shape"), F.col("evidence"), markers), "threshold": thresholds[F.col("shape")]})
    guess = F.when(text.any_of(F.col("evidence"), SPECULATIVE), 4.0).otherwise(0.0)
    score = F.col("relevance") + F.col("direct") * 3.0 + F.col("intent_hits") * 2.0 + F.col("overlap") * 2.0 + _bonus("reranker_score", items, 2, 8.0) + _bonus("hybrid_score", items, 20, 6.0) - guess
    met = "(size(terms) = 0 or overlap > 0 or intent_hits >= 2) and (direct > 0 or intent_hits >= 2)"
    kept = scored.filter(met).withColumn("score", score).filter("score >= threshold")
    w = Window.partitionBy("query_id")
    once = kept.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), "rank"))).filter("copy = 1").drop("copy")
    once = once.withColumn("best", F.max("score").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "rank")))
    label = F.when((F.col("shape") == "definition") & (F.col("direct") >= 6), "DEFINITIVE").when((F.col("direct") >= 4) | (F.col("relevance") >= 8), "MAIN_ANSWER").otherwise("SUPPORTING_DETAIL")
    enough = (F.col("score") >= F.greatest("threshold", F.col("best") * 0.45)) | (F.col("place") <= min(3, limit))
    chosen = once.filter(enough).withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "rank"))).filter(F.col("place") <= limit).withColumn("label", label)
    return _sufficient(chosen, markers).withColumn("order", F.row_number().over(w.orderBy(F.desc("relevance"), "place")))


def _sufficient(chosen: DataFrame, markers: dict[str, list[str]]) -> DataFrame:
    joined = lambda most: F.array_join(F.transform(F.slice(F.col("found"), 1, most), lambda s: s["evidence"]), " ")
    found = F.array_sort(F.collect_list(F.struct("place", "evidence", "direct"))).alias("found")
    whole = chosen.groupBy("query_id", "shape").agg(found, F.first("intents").alias("asked_intents"), F.max("direct").alias("most"))
    whole = whole.withColumns({"two": joined(2), "every": joined(1 << 30)})
    intents = F.size(F.filter("asked_intents", lambda t: F.col("two").contains(t)))
    suffices = (
        F.when(F.col("shape") == "definition", F.col("most") >= 2)
        .when(F.col("shape").isin("list", "limitation"), (F.size("found") >= 2) | (F.col("found")[0]["direct"] >= 3))
        .when(F.col("shape") == "pipeline", stages(F.col("every")) >= 3)
        .otherwise((intents >= 2) | (directness(F.col("shape"), F.col("two"), markers) >= 5))
    )
    return chosen.join(whole.filter(suffices).select("query_id"), "query_id", "left_semi")


def with_prefilter_score(items: DataFrame) -> DataFrame:
    """items plus relevance and the cheap score by which candidates of a model's judgement are chosen."""
    rated = with_relevance(items)
    named = lambda c, value, worth: F.when(F.col(c) == value, worth).otherwise(0.0) if c in items.columns else F.lit(0.0)
    overlaps = (F.size("terms") > 0) & ((F.col("overlap") >= F.least(F.lit(2), F.size("terms"))) | (F.col("intent_hits") >= 1))
    score = F.col("relevance") + _bonus("reranker_score", items, 2) + _bonus("hybrid_score", items, 20) + named("source", "parent_context", 2.0) + named("neighbor_role", "anchor", 1.0)
    score = score + F.when(overlaps, 3.0).otherwise(0.0) + F.when(text.any_of(F.col("evidence"), fixed.PREFILTER_MARKERS), 1.0).otherwise(0.0)
    return rated.withColumns({"overlaps": overlaps, "prefilter": score})


def prefiltered(items: DataFrame, max_items: int = 8, most: int = 10) -> DataFrame:
    """The first three items and then the best by ``prefilter``, max(most, max_items) in all; ``candidate`` numbers them."""
    rated = with_prefilter_score(items)
    w = Window.partitionBy("query_id")
    target = max(most, max_items)
    size = F.count("*").over(w)
    first = F.when(F.col("rank") <= 3, 0).otherwise(1)
    order = F.when(size <= most, F.col("rank").cast("double")).otherwise(F.when(first == 0, F.col("rank") - 1e9).otherwise(-F.col("prefilter")))
    placed = rated.withColumn("sorting", order).withColumn("candidate", F.row_number().over(w.orderBy("sorting", "rank")))
    return placed.filter(F.col("candidate") <= target).drop("sorting")


def merged_judgements(judged: DataFrame, every: DataFrame, limit: int = 8) -> DataFrame:
    """Evidence from labelled candidates: main answers, then details, then background that overlaps; the best
    ``limit`` by relevance.  Queries without any get the best of ``every`` (with prefilter) instead.

    judged: candidates with label; without one (the model failed): two terms make a MAIN_ANSWER, one BACKGROUND, none is IRRELEVANT."""
    label = F.coalesce("label", F.when(F.col("overlap") >= 2, "MAIN_ANSWER").when(F.col("overlap") == 1, "BACKGROUND").otherwise("IRRELEVANT"))
    stage = F.when(label.isin("MAIN_ANSWER", "DEFINITIVE"), 0).when(label == "SUPPORTING_DETAIL", 1).when((label == "BACKGROUND") & F.col("overlaps"), 2)
    kept = judged.withColumns({"label": label, "stage": stage}).filter("stage is not null")
    by = lambda *keys: Window.partitionBy("query_id", *keys)
    once = kept.withColumn("copy", F.row_number().over(by("chunk_id").orderBy("stage", "candidate"))).filter("copy = 1")
    chosen = once.withColumn("order", F.row_number().over(by().orderBy(F.desc("relevance"), "stage", "candidate"))).filter(F.col("order") <= limit)
    left = every.join(chosen.select("query_id").distinct(), "query_id", "left_anti").filter("prefilter > 0")
    left = left.withColumn("copy", F.row_number().over(by("chunk_id").orderBy(F.desc("prefilter"), "rank"))).filter("copy = 1")
    fallback = left.withColumn("order", F.row_number().over(by().orderBy(F.desc("prefilter"), "rank"))).filter(F.col("order") <= limit)
    columns = ["query_id", "chunk_id", "order"]
    return chosen.select(*columns, "label").unionByName(fallback.select(*columns, F.lit(None).cast("string").alias("label")))


def sufficiency(items: DataFrame) -> DataFrame:
    """Per query over its first three items: share of terms found, +0.2 for the whole query, thresholds by intent."""
    q = F.lower("query")
    terms = F.array_distinct(text.without(text.tokens(F.col("query")), EVIDENCE_STOPS, 3))
    top = items.filter("rank <= 3").groupBy("query_id", "query").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), " ")).alias("body"))
    has = lambda ws: text.any_of(q, ws)
    least = F.when(has(["types", "categories", "list", "kinds"]), 0.25).when(has(["safety", "risk", "concern", "trustworthiness"]), 0.45).when(has(["instruction", "follow"]), 0.35).otherwise(0.45)
    found = top.withColumn("terms", terms).withColumn("matched", F.size(F.filter("terms", lambda t: F.col("body").contains(t))))
    ratio = F.col("matched") / F.greatest(F.size("terms"), F.lit(1))
    exact = F.col("body").contains(q)
    out = found.withColumn("overlap_ratio", ratio)
    return out.withColumn("quality", F.least(F.lit(1.0), F.col("overlap_ratio") + F.when(exact, 0.2).otherwise(0.0))).withColumn("sufficient", (F.size("terms") == 0) | exact | (F.col("overlap_ratio") >= least)).drop("terms", "body")


def shortened(sentence: Column, words: int = 34) -> Column:
    parts = F.split(sentence, " ")
    return F.when(F.size(parts) > words, F.regexp_replace(F.array_join(F.slice(parts, 1, words), " "), r"[ ,;:]+$", "")).otherwise(sentence)


def extractive(found: DataFrame, categories: dict[str, dict[str, list[str]]] = CATEGORIES, plain: int = 4) -> DataFrame:
    """One answer for each query of ``answering.fact_list``: best fact of each category of the query's shape, then the first facts."""
    found = materialized(found)  # a few rows a query, used four times
    spark = found.sparkSession
    parts = [(shape, i, words) for shape, groups in categories.items() for i, words in enumerate(groups.values())]
    table = spark.createDataFrame(parts, "shape string, part int, words array<string>")
    asked = found.select("query_id", "query").distinct().withColumn("shape", shape_of(F.col("query"))).drop("query")
    shaped = found.join(asked, "query_id")
    low = F.lower("sentence")
    hit = shaped.join(table, "shape").withColumn("hits", F.size(F.filter("words", lambda w: low.contains(w)))).filter("hits > 0")
    best = Window.partitionBy("query_id", "part").orderBy(F.desc(F.col("hits") * 3 + F.col("score")), "fact_no")
    chosen = hit.withColumn("n", F.row_number().over(best)).filter("n = 1").select("query_id", "fact_no", "part")
    first = shaped.filter(F.col("fact_no") <= plain).select("query_id", "fact_no", (F.col("fact_no") + 100).alias("part"))
    place = chosen.unionByName(first).groupBy("query_id", "fact_no").agg(F.min("part").alias("part"))
    line = F.concat(shortened(F.col("sentence")), F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))
    rows = place.join(shaped, ["query_id", "fact_no"]).select("query_id", "query", "shape", F.struct("part", "fact_no", line.alias("line")).alias("f"))
    return rows.groupBy("query_id", "query", "shape").agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["line"]), " ").alias("answer"), F.count("*").alias("facts"))
