"""Rubrics of answers and retrievals, verification flags, planning and guardrails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text


def words(body: Column) -> Column:
    return F.size(F.filter(F.split(body, r"\s+"), lambda w: w != ""))


def met(answer: Column, requirements: Column) -> Column:
    """How many requirements (arrays of alternatives) the answer meets."""
    return F.size(F.filter(requirements, lambda alternatives: F.exists(alternatives, lambda a: text.has_requirement(answer, a))))


def rag_rubric(items: DataFrame) -> DataFrame:
    """Out of ten: facts 5, optional 1, citation 1, routing 1, verifier 1, focus 1.

    items: id, answer, must, should, must_not (arrays of arrays), citations, expected_title, titles, verified, max_words.
    """
    a = F.col("answer")
    share = lambda c: met(a, F.col(c)) / F.greatest(F.size(c), F.lit(1))
    bad = met(a, F.col("must_not")) > 0
    expected = text.normalize(F.col("expected_title"))
    routed = (expected == "") | F.exists("titles", lambda t: text.normalize(t).contains(expected))
    focus = 1.0 - F.when(bad, 0.75).otherwise(0.0) - F.when(words(a) > F.col("max_words"), 0.25).otherwise(0.0)
    focus = F.when(text.normalize(a).contains("does not contain enough information"), 0.0).otherwise(F.greatest(F.lit(0.0), focus))
    scored = items.select(
        "*",
        (5.0 * share("must")).alias("fact_score"),
        F.when(F.size("should") > 0, share("should")).otherwise(1.0).alias("optional_score"),
        F.when((text.citation_count(a) > 0) & (F.col("citations") > 0), 1.0).otherwise(0.0).alias("citation_score"),
        F.when(routed, 1.0).otherwise(0.0).alias("routing_score"),
        F.when(F.col("verified"), 1.0).otherwise(0.0).alias("verifier_score"),
        focus.alias("focus_score"),
    )
    total = sum((F.col(c) for c in ("optional_score", "citation_score", "routing_score", "verifier_score", "focus_score")), F.col("fact_score"))
    return scored.withColumn("score", total)


def answer_rubric(items: DataFrame) -> DataFrame:
    """Out of ten: facts 5.5, optional 1, citation 1.5, focus 2."""
    a = F.col("answer")
    share = lambda c: met(a, F.col(c)) / F.greatest(F.size(c), F.lit(1))
    focus = 2.0 - F.when(met(a, F.col("must_not")) > 0, 1.5).otherwise(0.0) - F.when(words(a) > 180, 0.5).otherwise(0.0)
    focus = F.when(text.normalize(a).contains("does not contain enough information"), 0.0).otherwise(focus)
    cited = F.when((text.citation_count(a) > 0) & (F.col("citations") > 0), 1.5).otherwise(0.0)
    return items.withColumn("score", 5.5 * share("must") + share("should") + cited + focus)


def retrieval_recall(items: DataFrame) -> DataFrame:
    """4 x page recall + 6 x keyword recall.  items: expected_pages, found_pages, keywords, retrieved."""
    pages = F.size(F.array_intersect("expected_pages", "found_pages")) / F.greatest(F.size("expected_pages"), F.lit(1))
    flat, tight = text.normalize(F.col("retrieved")), text.compact(F.col("retrieved"))
    hit = F.filter("keywords", lambda k: flat.contains(text.normalize(k)) | tight.contains(text.compact(k)))
    return items.withColumn("page_score", pages).withColumn("keyword_score", F.size(hit) / F.greatest(F.size("keywords"), F.lit(1))).withColumn("score", F.col("page_score") * 4.0 + F.col("keyword_score") * 6.0)


def verifier_flags(items: DataFrame) -> DataFrame:
    """Issues of answers.  items: query, answer, retrieved_count."""
    q, a = F.lower("query"), F.lower("answer")
    has = lambda c, ws: text.any_of(c, ws)
    cited = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("long"))
    n = F.col("retrieved_count")
    empty = F.btrim("answer") == ""
    lists = has(q, ["main message", "formula", "steps", "features", "best practices", "challenge"])
    unfocused = has(a, fixed.BROAD_MARKERS) | (~q.contains("application") & a.rlike("(^|[^a-z0-9_])applications?:")) | ((q.startswith("what is") | q.contains("what type of")) & ~lists & (words(a) > 120))
    shape = (
        F.when(q.contains("what type of input"), ~has(a, ["input", "prompt", "instruction", "text", "natural language"]))
        .when(has(q, ["architecture", "framework", "components"]), ~has(a, ["architecture", "framework", "component", "part", "module", "model"]))
        .when(has(q, ["represent", "representation", "before feeding", "model input"]), ~has(a, ["representation", "represent", "latent", "token", "patch", "compress"]))
        .when(has(q, ["limitations", "limitation", "challenges"]), ~has(a, ["limitation", "challenge", "constraint", "failure", "issue"]))
        .when(q.startswith("why"), ~has(a, ["because", "helps", "allows", "enables", "so that", "due to", "reason"]))
        .otherwise(F.lit(False))
    )
    flags = {
        "uncited": (n > 0) & ~F.col("answer").contains("["),
        "empty": empty,
        "leak": text.leaks_context(F.col("answer")),
        "bad_citation": (n > 0) & F.exists(cited, lambda x: (x < 1) | (x > n)),
        "unfocused": ~empty & unfocused,
        "wrong_shape": ~empty & shape,
    }
    out = items.select("*", *(v.alias(k) for k, v in flags.items()))
    grounded = ~(F.col("uncited") | F.col("empty") | F.col("leak") | F.col("bad_citation"))
    clean = grounded & ~(F.col("unfocused") | F.col("wrong_shape"))
    return out.withColumn("grounded", grounded).withColumn("status", F.when(clean, "verified").otherwise("needs_more_info"))


def planned(queries: DataFrame) -> DataFrame:
    """Mode and tool of each query: casual talk, weather, tables, files, else retrieval."""
    low = F.btrim(F.lower("query"))
    tidy = low
    for wrong, right in fixed.TABLE_SPELLINGS:
        tidy = F.replace(tidy, F.lit(wrong), F.lit(right))
    # What is read many times stands in columns of its own, so that it is not worked out for each rule.
    staged = queries.withColumns({"_q": low, "_flat": text.squeeze(tidy), "_path": F.regexp_extract("query", fixed.FILE_PATH, 1)})
    q, flat, path = F.col("_q"), F.col("_flat"), F.col("_path")
    has = lambda c, ws: text.any_of(c, ws)
    base = ["database", "sqlite", "db"]
    weather = q.contains("weather") | (q.contains("temperature") & has(q, ["current", "now", "today", "outside", "forecast", " in ", " for ", " at ", " near ", " of "]))
    tables = has(flat, ["list tables", "show tables"]) | (has(flat, base) & flat.contains("tables"))
    feedback = has(flat, ["feedback summary", "feedback analytics"]) | (flat.contains("feedback") & has(flat, ["summary", "stats", "statistics", "counts"]))
    traces = has(flat, ["recent traces", "latest traces", "show traces"])
    named = F.regexp_extract(q, r"(?:^|[^a-z0-9_])(?:table|from)\s+([a-z_][a-z0-9_]*)", 1) != ""
    known = has(flat, ["answer_feedback", "chunks", "conversation_turns", "documents", "healthcheck", "memory_items", "sessions", "traces"])
    shown = has(flat, [*base, "table"]) & has(flat, ["preview", "show", "inspect", "view"]) & (named | known)
    listed = has(q, ["list", "show", "what files", "which files"]) & has(q, ["files", "directory", "folder"])
    info = (path != "") & has(q, ["info", "metadata", "size", "details"]) & has(q, [" file", " directory", " folder", " mcp"])
    read = (path != "") & has(q, ["read", "show", "open", "display"]) & has(q, [" file", " mcp", " docs/", " data/", " tests/", " benchmarks/"])
    tool = (
        F.when(q.isin(fixed.CASUAL), "")
        .when(weather, "get_current_weather")
        .when(tables, "mcp.sqlite.list_tables")
        .when(feedback, "mcp.sqlite.feedback_summary")
        .when(traces, "mcp.sqlite.recent_traces")
        .when(shown, "mcp.sqlite.preview_table")
        .when(listed, "mcp.local_files.list_directory")
        .when(info, "mcp.local_files.file_info")
        .when(read, "mcp.local_files.read_text_file")
        .otherwise("")
    )
    named_tool = staged.withColumn("tool_name", tool)
    mode = F.when(q.isin(fixed.CASUAL), "direct_answer").when(F.col("tool_name") != "", "tool_only").otherwise("retrieve_only")
    return named_tool.withColumn("mode", mode).select(*queries.columns, "mode", "tool_name")


def guarded(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Guardrail status of tool calls (call_id, tool_name, path, approved) against specs
    (tool_name, source, requires_approval, root, write_enabled, allow_delete)."""
    joined = calls.join(tools, "tool_name", "left")
    category = F.when(text.any_of(F.lower("tool_name"), ["delete", "remove", "unlink"]), "delete_file").when(text.any_of(F.lower("tool_name"), ["write", "save", "create", "update"]), "write_file").otherwise("local_read")
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    hidden = F.col("path").rlike(r"(^|/)\.")
    sensitive = ~name.endswith(".env.example") & (name.isin(fixed.SENSITIVE_FILES) | F.lower("path").rlike(r"\.(key|p12|pem|pfx)$") | hidden)
    outside = F.col("root").isNotNull() & ~((F.col("path") == F.col("root")) | F.col("path").startswith(F.concat("root", F.lit("/"))) | (F.col("root") == ""))
    writes = category.isin("write_file", "delete_file")
    status = (
        F.when(F.col("source").isNull(), "deny")
        .when(F.col("root").isNotNull() & (outside | F.col("path").contains("..") | sensitive), "deny")
        .when(writes & (~F.col("write_enabled") | F.col("root").isNull()), "deny")
        .when((category == "delete_file") & ~F.col("allow_delete"), "deny")
        .when((writes | F.col("requires_approval")) & ~F.col("approved"), "needs_approval")
        .otherwise("allow")
    )
    return joined.select("call_id", "tool_name", category.alias("category"), status.alias("status"))
