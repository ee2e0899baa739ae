"""The answer policy as staged routing: each stage takes the queries that are still unanswered, and says why it passes one on.

``chain`` holds the state: answered rows are written, the rest goes on by an anti-join, and every step leaves a line in the
query's trace.  Main answers, repairs, direct answers and answers from tool results are chains or column rules over one row a
query; candidates by kind arrive as a map (some fifteen kinds).
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions import sentences as st
from ..session import materialized, settled, spread
from . import answer, answering, backends, cleaning, relations, runs, windows

Stage = Callable[[DataFrame], DataFrame]


def chain(asked: DataFrame, stages: list[tuple[str, Stage]]) -> DataFrame:
    """(query_id, answer, source, trace): the answer of the first stage that gives one; trace: (stage, reason) in order.

    A stage takes the open rows of ``asked`` and returns (query_id, answer, source, reason) of any of them: a null answer
    passes the query on, and so does a missing row (reason ``not_applicable``).  Queries that no stage answers have a null answer."""
    step = "array<struct<stage:string,reason:string>>"
    left = asked.withColumn("trace", F.array().cast(step))
    done = None
    for name, stage in stages:
        found = stage(left.drop("trace")).select("query_id", "answer", F.coalesce("source", F.lit(name)).alias("source"), "reason")
        line = F.array(F.struct(F.lit(name).alias("stage"), F.coalesce("reason", F.when(F.col("answer").isNotNull(), "answered").otherwise("not_applicable")).alias("reason")))
        state = materialized(left.join(found, "query_id", "left").withColumn("trace", F.concat("trace", line)))
        own = state.filter("answer is not null").select("query_id", "answer", "source", "trace")
        done = own if done is None else done.unionByName(own)
        left = state.filter("answer is null").select(*asked.columns, "trace")
    none = F.lit(None).cast("string")
    return done.unionByName(left.select("query_id", none.alias("answer"), none.alias("source"), "trace"))


def candidates(items: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, by_kind): cleaned candidates of each query by kind; empty ones are left out."""
    most = items.groupBy("query_id").agg(F.max("rank").alias("results"))
    plain = answering.candidates(facts).select("query_id", F.col("source").alias("kind"), F.col("candidate").alias("answer"), F.lit(1).alias("later"))
    best = windows.answers(items).select("query_id", F.lit("source_window").alias("kind"), "answer", F.lit(0).alias("later"))
    own = [runs.pipeline_answers(items).withColumn("kind", F.lit("pipeline")), runs.challenge_answers(items).withColumn("kind", F.lit("challenge")), relations.definition_answers(items).withColumn("kind", F.lit("definition"))]
    every = plain.unionByName(best)
    for df in own:  # those that read the source stand before those of facts
        every = every.unionByName(df.select("query_id", "kind", "answer", F.lit(0).alias("later")))
    first = every.groupBy("query_id", "kind").agg(F.min_by("answer", "later").alias("answer"))
    tidy = cleaning.cleaned(spread(first.join(most, "query_id"), "query_id"), "answer", F.col("results")).filter("answer <> ''")
    return tidy.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "answer")))).alias("by_kind"), F.first("results").alias("results"))


# Judgements of an answer


def under_specific(reply: Column, terms: Column) -> Column:
    """Of four or more names and numbers of the evidence, an answer has fewer than two, or than a fifth."""
    held = F.size(F.filter(terms, lambda t: F.lower(reply).contains(F.lower(t))))
    return (F.size(terms) >= 4) & (held < F.greatest(F.lit(2), F.floor(F.size(terms) / 5)))


def specific_terms(evidence: Column) -> Column:
    """Names, years, durations and compounds of a text, the first forty."""
    names = F.filter(F.regexp_extract_all(evidence, F.lit(r"\b[A-Z][A-Za-z0-9]*(?:[-·][A-Z]?[A-Za-z0-9]+)*\b"), F.lit(0)), lambda n: (F.length(n) >= 3) & ~F.lower(n).isin(fixed.SPECIFIC_STOPS))
    others = F.regexp_extract_all(F.lower(evidence), F.lit(r"\b\d{4}\b|\b\d+\s*minute\b|\btext-to-[a-z-]+\b|\b[a-z]+-[a-z]+(?:-[a-z]+)?\b"), F.lit(0))
    return F.slice(F.array_distinct(F.concat(names, others)), 1, 40)


def leaks(reply: Column) -> Column:
    return text.any_of(F.lower(reply), fixed.ANSWER_LEAK_MARKERS)


def _more(a: Column, b: Column) -> Column:
    """How many content words the first has that the second lacks."""
    return F.size(F.array_except(runs.content_terms(a), runs.content_terms(b)))


def prefers(query: Column, reply: Column, other: Column) -> Column:
    """A question for a mechanism is better served by another answer: three more content words, or two more words that its intent expects."""
    q = F.lower(query)
    asks = q.startswith("how") | text.any_of(q, ["turn", "convert", "transform", "detect"])
    missed = F.filter(answer.intent_terms(q), lambda t: F.lower(other).contains(t) & ~F.lower(reply).contains(t))
    return asks & ((_more(other, reply) >= 3) | (F.size(missed) >= 2))


def with_subject(query: Column, reply: Column) -> Column:
    """An answer that names what was asked about, before it if it does not say so itself."""
    entity = windows.subject(query)
    low = F.lower(reply)
    held = (entity == "") | low.contains(F.lower(entity)) | windows.holds_entity(low, windows.entity_terms(F.lower(entity)))
    label = F.when(F.lower(query).contains("feature"), "'s key features are: ").otherwise("'s main points are: ")
    return F.when((reply == "") | answering.is_insufficient(reply) | held, reply).when(answering.is_list(query), F.concat(entity, label, reply)).otherwise(F.concat(entity, F.lit(": "), reply))


def weak(query: Column, reply: Column, terms: Column) -> Column:
    return under_specific(reply, terms) | answering.is_unfocused(query, reply) | answering.misses_shape(query, reply)


# The main policy


def replaced(rows: DataFrame) -> DataFrame:
    """rows (query, reply, by_kind) with the reply that stands after all replacements, and its source.

    Specific kinds replace in order, the last one that is there wins; the general ones only where the reply is unfocused, misses
    the shape of the question or says less."""
    q, reply, has = F.col("query"), F.col("reply"), lambda kind: F.col("by_kind")[kind].isNotNull()
    always = [k for k in fixed.REPLACED_ALWAYS if k != "capability"]
    last = F.coalesce(*(F.when(has(k) & (text.any_of(F.lower(q), ["simulator", "simulation", "simulate"]) if k == "capability" else F.lit(True)), k) for k in reversed([*always[:2], "capability", *always[2:]])))
    now = settled(rows, source=F.coalesce(last, F.lit("llm_generation")))
    now = settled(now, reply=F.coalesce(F.col("by_kind")[F.col("source")], reply))
    unfocused, misses = answering.is_unfocused(q, reply), answering.misses_shape(q, reply)
    no_list = ~F.exists(F.map_keys("by_kind"), lambda k: k.isin(fixed.NO_LIST_AFTER))
    prefer_named = (F.size(text.focus_phrases(q)) > 0) & text.any_of(F.lower(q), fixed.FOCUSED_QUERIES)
    rules = {
        "example": lambda other: F.lower(q).contains("example") | F.col("unfocused") | (_more(other, reply) >= 3),
        "why": lambda other: ~has("meaning") & answering.is_explanation(q) & (F.col("unfocused") | F.col("misses") | prefers(q, reply, other) | (_more(other, reply) >= 3)),
        "list": lambda other: no_list & (answering.is_list(q) | F.col("unfocused") | F.col("misses") | prefers(q, reply, other)),
        "mechanism": lambda other: F.col("misses") | under_specific(reply, F.col("specific")) | prefers(q, reply, other),
        "focused_entity": lambda other: F.col("unfocused") | F.col("misses") | ((F.size(text.focus_phrases(q)) > 0) & ~F.exists(text.focus_phrases(q), lambda p: F.lower(reply).contains(p))) | (prefer_named & ((F.size(runs.content_terms(other)) >= F.size(runs.content_terms(reply))) | (_more(other, reply) >= 3))),
        "source_window": lambda other: text.any_of(F.lower(q), fixed.PREFERRED_WINDOWS) | (_more(other, reply) >= 4),
    }
    for kind, rule in rules.items():
        other = F.col("by_kind")[kind]
        now = settled(now, unfocused=unfocused, misses=misses)
        now = settled(now, taken=has(kind) & rule(other))
        now = settled(now, reply=F.when(F.col("taken"), other).otherwise(reply), source=F.when(F.col("taken"), kind).otherwise(F.col("source")))
    return now.drop("unfocused", "misses", "taken")


def _named(source: Column) -> Column:
    return F.when(source == "llm_generation", source).otherwise(F.concat(source, F.lit("_replacement")))


def _finished(rows: DataFrame, column: str) -> DataFrame:
    """The answer of each row in its final form."""
    tidy = cleaning.cleaned(rows, column, F.col("results"))
    return settled(tidy, **{column: with_subject(F.col("query"), F.col(column))})


def repairs(rows: DataFrame) -> DataFrame:
    """(query_id, answer, source): the first candidate in the order of repair that answers, cites and leaks nothing. rows: query_id, query, by_kind, results."""
    tried = F.filter(F.transform(F.split(F.lit(",".join(fixed.REPAIRED_BY)), ","), lambda k: F.struct(k.alias("kind"), F.col("by_kind")[k].alias("answer"))), lambda c: c["answer"].isNotNull())
    each = materialized(rows.select("query_id", "query", "results", F.posexplode(tried).alias("place", "c")).select("query_id", "query", "results", "place", "c.kind", "c.answer"))
    shown = materialized(_finished(each, "answer"))
    a = F.col("answer")
    fits = (a != "") & ~answering.is_insufficient(a) & (text.citation_count(a) > 0) & ~leaks(a) & ~(answering.is_unfocused(F.col("query"), a) & (st.word_count(a) > 120))
    best = shown.filter(fits).groupBy("query_id").agg(F.min_by(F.struct("answer", "kind"), "place").alias("best"))
    return best.select("query_id", "best.answer", F.col("best.kind").alias("source"))


def _asked_of_model(prompts: DataFrame, factory: Callable[[], backends.ModelBackend]) -> DataFrame:
    """(query_id, reply, error): a backend's answer to each prompt, or the kind of error that it raised."""

    def call(backend: backends.ModelBackend, texts: list[str]) -> list[dict]:
        try:
            return [{"reply": (x or "").strip(), "error": None} for x in backend.generate(texts)]
        except Exception as error:  # any backend: what went wrong is kept, and the chain goes on without a model
            return [{"reply": "", "error": type(error).__name__}] * len(texts)

    kind = pa.struct([("reply", pa.string()), ("error", pa.string())])
    found = backends._in_batches(prompts.select("query_id", "prompt"), ["prompt"], "said", "struct<reply:string,error:string>", kind, factory, call)
    return found.select("query_id", "said.reply", "said.error")


def answered(items: DataFrame, factory: Callable[[], backends.ModelBackend] = backends.StandIn) -> DataFrame:
    """(query_id, answer, source, trace): the whole policy over a batch.  items: as in ``windows``, with section_title.

    Fast path, model, repair where the model failed, replacements and fallbacks; a query without items is not answered."""
    # Texts are cleaned once, for all that reads them.
    items = materialized(windows.with_body(answering.single_source(items)))
    facts = materialized(answering.fact_list(items))
    generic = materialized(answer.extractive(facts).select("query_id", "answer"))
    evidence = items.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("all"))
    known = settled(candidates(items, facts).join(evidence, "query_id", "right"), specific=specific_terms(F.coalesce("all", F.lit("")))).drop("all")
    known = materialized(known.withColumn("by_kind", F.coalesce("by_kind", F.create_map().cast("map<string,string>"))))
    intro = windows.feature_intro(windows.evidence(items))
    asked = items.groupBy("query_id", "query").agg(F.max("rank").alias("results"))

    def fast(open_: DataFrame) -> DataFrame:
        found = open_.join(known.select("query_id", F.explode("by_kind").alias("source", "candidate")), "query_id")
        place = F.array_position(F.split(F.lit(",".join([*(k.name for k in answering.KINDS), "source_window"])), ","), F.col("source"))
        best = answering.first_accepted(found.withColumn("place", place))
        return best.select("query_id", "answer", F.lit("extractive_fast_path").alias("source"), F.concat(F.lit("accepted_"), "source").alias("reason"))

    bare = F.concat(F.lit("Answer from the context only, and cite it as [n].\n\nQuestion:\n"), "query")
    worded = asked.join(answering.prompts(facts).select("query_id", "prompt"), "query_id", "left").withColumn("prompt", F.coalesce("prompt", bare))
    replies = materialized(_asked_of_model(worded, factory))
    none = F.lit(None).cast("string")

    def generic_for(open_: DataFrame, reason: Column) -> DataFrame:
        said = open_.join(generic, "query_id", "left")
        return said.select("query_id", F.coalesce("answer", F.lit(answer.ABSTAIN)).alias("answer"), F.lit("generic_extractive_fallback").alias("source"), reason.alias("reason"))

    def repaired(open_: DataFrame) -> DataFrame:
        failed = open_.join(replies.filter("error is not null").select("query_id", "error"), "query_id").join(known.select("query_id", "by_kind"), "query_id")
        found = repairs(failed)
        return failed.select("query_id", "error").join(found, "query_id", "left").select("query_id", "answer", F.when(F.col("answer").isNotNull(), "deterministic_repair_fallback").alias("source"), F.concat(F.lit("llm_generation_exception:"), "error").alias("reason"))

    def silent(open_: DataFrame) -> DataFrame:
        said = open_.join(replies, "query_id", "left").filter("coalesce(reply, '') = ''")
        return generic_for(said.select(*open_.columns), F.lit("empty_llm_answer"))

    def judged(open_: DataFrame) -> DataFrame:
        rows = open_.join(replies.select("query_id", "reply"), "query_id").join(known.drop("results"), "query_id")
        rows = settled(spread(rows, "query_id"), reply=cleaning.without_abstention(F.col("reply")))
        rows = materialized(replaced(rows))
        rows = settled(rows, weak=weak(F.col("query"), F.col("reply"), F.col("specific")), short=answering.is_insufficient(F.col("reply")), cites=text.citation_count(F.col("reply")) > 0)
        by_kind = F.col("by_kind")
        stand_in = F.coalesce(*(F.when(by_kind[k].isNotNull(), k) for k in fixed.STANDS_IN))
        practice = F.when(by_kind["best_practices"].isNotNull(), "best_practices")
        reason = F.when(F.col("weak"), "llm_answer_unfocused_or_under_specific").when(F.col("short"), "insufficient_llm_answer").when(~F.col("cites"), "missing_citations")
        chosen = F.when(F.col("weak"), stand_in).when(F.col("short"), none).when(~F.col("cites"), practice).otherwise(F.col("source"))
        rows = settled(rows, reason=reason, chosen=chosen)
        rows = settled(rows, reply=F.when(F.col("reason").isNull(), F.col("reply")).otherwise(by_kind[F.col("chosen")]))
        led = rows.join(intro.withColumnRenamed("rank", "intro_rank"), "query_id", "left")
        wants = text.any_of(F.lower("query"), ["feature", "capabil"]) & F.col("intro").isNotNull() & ~windows._normal(F.col("reply")).contains(windows._normal(F.col("intro")))
        led = settled(led, reply=F.when(wants, F.concat("intro", F.lit(". ["), F.col("intro_rank").cast("string"), F.lit("] "), "reply")).otherwise(F.col("reply")))
        shown = _finished(led, "reply")
        return shown.select("query_id", F.when(F.col("reply") != "", F.col("reply")).alias("answer"), F.when(F.col("reply") != "", _named(F.col("chosen"))).alias("source"), F.coalesce("reason", F.lit("accepted")).alias("reason"))

    def last(open_: DataFrame) -> DataFrame:
        return generic_for(open_, F.lit("no_candidate"))

    return chain(asked, [("fast_path", fast), ("repair", repaired), ("silent_model", silent), ("judged_model", judged), ("generic", last)])


# Direct answers and answers from tool results


def direct(asked: DataFrame, factory: Callable[[], backends.ModelBackend] = backends.StandIn) -> DataFrame:
    """(query_id, answer, source, trace) of questions without retrieval: greetings, the model, or a request to rephrase."""
    greeting = F.create_map(*(F.lit(x) for pair in fixed.GREETINGS.items() for x in pair))
    none = F.lit(None).cast("string")

    def greeted(open_: DataFrame) -> DataFrame:
        return open_.select("query_id", greeting[F.lower(F.btrim("query"))].alias("answer"), none.alias("source"), none.alias("reason"))

    def modelled(open_: DataFrame) -> DataFrame:
        said = _asked_of_model(open_.select("query_id", F.concat(F.lit("Answer the question directly and briefly.\n- "), "query").alias("prompt")), factory)
        return said.select("query_id", F.when(F.col("reply") != "", F.col("reply")).alias("answer"), none.alias("source"), F.when(F.col("error").isNotNull(), F.concat(F.lit("llm_generation_exception:"), "error")).when(F.col("reply") == "", "empty_llm_answer").alias("reason"))

    def rephrase(open_: DataFrame) -> DataFrame:
        return open_.select("query_id", F.lit(fixed.DIRECT_FALLBACK).alias("answer"), none.alias("source"), F.lit("nothing_answered").alias("reason"))

    return chain(asked, [("greeting", greeted), ("model", modelled), ("fallback", rephrase)])


def _short(value: Column) -> Column:
    flat = F.btrim(F.replace(value, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(flat) <= 120, flat).otherwise(F.concat(F.substring(flat, 1, 117), F.lit("...")))


_PAYLOAD = "struct<tool:string,source:string,tool_name:string,location:string,temperature:string,apparent_temperature:string,condition:string,time:string,timezone:string,result:string>"
_RESULT = """struct<tool:string,success:boolean,error:string,tables:array<struct<name:string,row_count:string>>,table:string,columns:array<string>,rows:array<map<string,string>>,
traces:array<struct<trace_id:string,verification_json:string,query:string>>,total_count:bigint,like_count:bigint,dislike_count:bigint,dislike_rate:double,issue_counts:map<string,string>,
path:string,entries:array<struct<type:string,path:string,name:string>>,truncated:boolean,content:string,is_dir:boolean,size_bytes:bigint,modified_at:string>"""


def tool_texts(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """``rows`` with said: what a tool's JSON result says in words; null if it is no result that is known."""
    held = settled(rows, p_=F.from_json(payload, _PAYLOAD))
    held = settled(held, r_=F.from_json(F.get_json_object(payload, "$.result"), _RESULT))
    p, r = F.col("p_"), F.col("r_")
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    place = F.when(given(p["location"]), p["location"]).otherwise("the requested location")
    weather = F.concat(
        F.lit("The current temperature in "), place, F.lit(" is "), p["temperature"],
        F.when(given(p["apparent_temperature"]), F.concat(F.lit(", with an apparent temperature of "), p["apparent_temperature"])).otherwise(""),
        F.when(given(p["condition"]), F.concat(F.lit(". Conditions: "), p["condition"], F.lit("."))).otherwise("."),
        F.when(given(p["time"]), F.concat(F.lit(" Reported at "), p["time"], F.when(given(p["timezone"]), F.concat(F.lit(" ("), p["timezone"], F.lit(")"))).otherwise(""), F.lit("."))).otherwise(""),
    )
    lines = lambda found, one: F.array_join(F.transform(found, one), "\n")
    some = lambda found: F.coalesce(F.size(found), F.lit(0)) > 0
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    table = F.when(given(r["table"]), r["table"]).otherwise("the requested table")
    row = lambda m, i: F.concat((i + 1).cast("string"), F.lit(". "), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), _short(F.coalesce(e["value"], F.lit("None"))))), "; "))
    status = lambda t: F.coalesce(F.get_json_object(t["verification_json"], "$.status"), F.lit(""))
    trace = lambda t: F.concat(F.lit("- Trace "), F.coalesce(t["trace_id"], F.lit("None")), F.lit(": "), F.when(status(t) != "", status(t)).otherwise("no verifier"), F.lit(" - "), _short(F.coalesce(t["query"], F.lit(""))))
    where = lambda other: F.when(given(r["path"]), r["path"]).otherwise(other)
    entry = lambda e: F.concat(F.lit("- "), F.coalesce(F.when(given(e["path"]), e["path"]), e["name"], F.lit("")), F.lit(" ("), F.when(given(e["type"]), e["type"]).otherwise("item"), F.lit(")"))
    cut = F.coalesce(r["truncated"], F.lit(False))
    rate = F.concat(F.round(F.coalesce(r["dislike_rate"], F.lit(0.0)) * 100, 0).cast("int").cast("string"), F.lit("%"))
    said = {
        "list_tables": F.when(some(r["tables"]), F.concat(F.lit("SQLite tables:\n"), lines(r["tables"], lambda t: F.concat(F.lit("- "), F.coalesce(t["name"], F.lit("None")), F.lit(" ("), F.coalesce(t["row_count"], F.lit("0")), F.lit(" rows)"))))).otherwise("No SQLite tables were found."),
        "preview_table": F.when(some(r["rows"]), F.concat(F.lit("Preview of SQLite table "), table, F.lit(":\n"), lines(F.slice(r["rows"], 1, 10), row))).otherwise(F.concat(F.lit("Table "), table, F.lit(" has no rows. Columns: "), F.when(some(r["columns"]), F.array_join(r["columns"], ", ")).otherwise("no columns"), F.lit("."))),
        "recent_traces": F.when(some(r["traces"]), F.concat(F.lit("Recent SQLite traces:\n"), lines(F.slice(r["traces"], 1, 20), trace))).otherwise("No recent traces were found in SQLite."),
        "feedback_summary": F.concat(F.lit("Feedback summary: "), number(r["total_count"]), F.lit(" total, "), number(r["like_count"]), F.lit(" liked, "), number(r["dislike_count"]), F.lit(" disliked, dislike rate "), rate, F.lit("."), F.when(F.coalesce(F.size(r["issue_counts"]), F.lit(0)) > 0, F.concat(F.lit(" Issue counts: "), F.array_join(F.transform(F.map_entries(r["issue_counts"]), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", "), F.lit("."))).otherwise("")),
        "list_directory": F.when(some(r["entries"]), F.concat(F.lit("Files in "), where("the allowed File MCP roots"), F.lit(":\n"), lines(F.slice(r["entries"], 1, 30), entry), F.when(cut, "\nThe list was truncated.").otherwise(""))).otherwise(F.concat(F.lit("No entries were found in "), where("the requested location"), F.lit("."))),
        "read_text_file": F.when(cut, F.concat(F.lit("Here is the beginning of "), where("the requested file"), F.lit(":\n\n"), F.coalesce(r["content"], F.lit("")), F.lit("\n\nThe file was truncated."))).otherwise(F.concat(F.lit("Here is the content of "), where("the requested file"), F.lit(":\n\n"), F.coalesce(r["content"], F.lit("")))),
        "file_info": F.concat(where("the requested path"), F.lit(" is a "), F.when(F.coalesce(r["is_dir"], F.lit(False)), "directory").otherwise("file"), F.lit("."), F.coalesce(F.concat(F.lit(" Size: "), r["size_bytes"].cast("string"), F.lit(" bytes.")), F.lit("")), F.when(given(r["modified_at"]), F.concat(F.lit(" Modified: "), r["modified_at"], F.lit("."))).otherwise("")),
    }
    tool = F.coalesce(F.when(given(r["tool"]), r["tool"]), F.when(given(p["tool_name"]), p["tool_name"]), F.lit("mcp_tool"))
    failed = F.concat(F.lit("The MCP tool could not complete the request: "), F.when(given(r["error"]), r["error"]).otherwise("The tool could not complete the request."))
    mcp = F.when(r["success"] == F.lit(False), failed)
    for name, words in said.items():
        mcp = mcp.when(tool == name, words)
    known = F.when(p["tool"] == "get_current_weather", F.when(given(p["temperature"]), weather).otherwise("The weather tool did not return a current temperature.")).when((p["source"] == "mcp") & r.isNotNull(), mcp)
    return settled(held, said=known).drop("p_", "r_")


def from_tools(asked: DataFrame, factory: Callable[[], backends.ModelBackend] = backends.StandIn) -> DataFrame:
    """(query_id, answer, source, trace) of questions with a tool's result (query_id, query, payload): its words, the model, or that it does not answer."""
    none = F.lit(None).cast("string")

    def structured(open_: DataFrame) -> DataFrame:
        return tool_texts(open_).select("query_id", F.col("said").alias("answer"), none.alias("source"), F.when(F.col("said").isNull(), "no_structured_result").alias("reason"))

    def modelled(open_: DataFrame) -> DataFrame:
        prompt = F.concat(F.lit("Answer from the tool result only.\n"), F.lit("Question:\n"), "query", F.lit("\nTool result:\n- "), F.coalesce("payload", F.lit("")))
        said = _asked_of_model(open_.select("query_id", prompt.alias("prompt")), factory)
        return said.select("query_id", F.when(F.col("reply") != "", F.col("reply")).alias("answer"), none.alias("source"), F.when(F.col("error").isNotNull(), F.concat(F.lit("llm_generation_exception:"), "error")).when(F.col("reply") == "", "empty_llm_answer").alias("reason"))

    def unanswered(open_: DataFrame) -> DataFrame:
        return open_.select("query_id", F.lit(fixed.TOOL_FALLBACK).alias("answer"), none.alias("source"), F.lit("nothing_answered").alias("reason"))

    return chain(asked, [("structured", structured), ("model", modelled), ("fallback", unanswered)])
