"""Column functions over text: tokens, normal forms, predicates, redaction, categories."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: Words are runs of letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"


def any_of(text: Column, words: list[str]) -> Column:
    """One of the words is a substring of ``text``: one pattern, so that code does not grow with the list.

    Words are a tree of letters behind a look at the first one: most places are left at once."""
    if not words or "" in words:
        return text.rlike("") if words else F.lit(False)
    tree: dict = {}
    for word in words:
        at = tree
        for letter in word:
            at = at.setdefault(letter, {})
        at[""] = {}

    def shown(at: dict) -> str:
        # Of two words of which one starts the other, the shorter decides.
        parts = [] if "" in at else [re.escape(letter) + shown(more) for letter, more in at.items()]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""

    return text.rlike(f"(?=[{''.join(map(re.escape, tree))}]){shown(tree)}")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is read there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """``text`` with each first string replaced by its second, in order.

    replace() compares at every byte, so it runs only where one of the strings may stand: where their first letters do, or
    they themselves if they begin with plain letters."""
    signs = sorted({w if w[0].isascii() else w[0] for w, _ in pairs})

    def told(b: Column) -> Column:
        out = b
        for wrong, right in pairs:
            out = F.replace(out, F.lit(wrong), F.lit(right))
        return F.when(reduce(lambda x, y: x | y, (b.contains(s) for s in signs)), out).otherwise(b)

    return bound(text, told)


def matches_any(text: Column, patterns: list[str]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    # Single blanks stay as they are: a text without other runs is not built anew.
    return F.btrim(F.regexp_replace(text, r" \s+|[^\S ]\s*", " "))


def normalize(text: Column) -> Column:
    return squeeze(F.lower(text))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def phrase_form(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def without(words: Column, stops: list[str], at_least: int = 0) -> Column:
    stop = F.array(*map(F.lit, stops))
    return F.filter(words, lambda w: (F.length(w) >= at_least) & ~F.array_contains(stop, w))


def meaningful_terms(query: Column) -> Column:
    return F.array_distinct(without(tokens(query), fixed.MEANINGFUL_STOPS, 4))


def content_tokens(query: Column) -> Column:
    words = F.transform(F.regexp_extract_all(query, F.lit(r"[a-zA-Z0-9][a-zA-Z0-9_-]*"), F.lit(0)), F.lower)
    return F.array_distinct(without(words, fixed.ROUTING_STOPS, 2))


def ascii_words(text: Column, first: str, more: str) -> Column:
    """Words of two letters or more of a class, where no letter, digit or underscore stands beside them."""
    return F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_])[{first}](?:[{more}]*[{more.removesuffix('-')}])(?![\p{{L}}\p{{N}}_])"), F.lit(0))


def focus_terms(query: Column) -> Column:
    words = F.regexp_extract_all(query, F.lit(r"[A-Za-z][A-Za-z0-9_-]{3,}"), F.lit(0))
    kept = F.filter(words, lambda w: w.rlike("[A-Z]") | (F.length(w) >= 8))
    return F.array_sort(F.array_distinct(without(F.transform(kept, F.lower), fixed.FOCUS_GENERIC)))


def focus_phrases(query: Column) -> Column:
    """Runs of capitalised words, lower-cased, without generic words; and the singular of a plural last word."""
    word = r"(?<![\p{L}\p{N}_])[A-Z](?:[A-Za-z0-9_-]*[A-Za-z0-9_])?(?![\p{L}\p{N}_])"
    runs = F.regexp_extract_all(query, F.lit(rf"{word}(?:\s+{word})+"), F.lit(0))
    kept = F.filter(F.transform(runs, lambda r: without(F.split(F.lower(r), r"\s+"), fixed.PHRASE_GENERIC)), lambda ws: F.size(ws) >= 2)
    phrases = F.transform(kept, lambda ws: F.array_join(ws, " "))
    singular = F.transform(F.filter(phrases, lambda p: p.rlike(r"[^\s]{4,}s$")), lambda p: F.regexp_replace(p, "s$", ""))
    return F.array_sort(F.array_distinct(F.concat(phrases, singular)))


def memory_terms(text: Column) -> Column:
    return F.array_distinct(without(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9_-]{2,}"), F.lit(0)), fixed.MEMORY_STOPS))


def ngrams(words: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1)))
    return F.when(F.size(words) >= size, F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))).otherwise(F.array().cast("array<string>"))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def chunk_id(doc_id: Column, page: Column, index: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("-p"), page.cast("string"), F.lit("-c"), index.cast("string"))


def point_id(chunk: Column) -> Column:
    return F.conv(F.substring(F.md5(chunk.cast("binary")), 1, 12), 16, 10).cast("long")


def is_boilerplate(line: Column) -> Column:
    flat = squeeze(line)
    byline = flat.contains(" | by ") & (F.length(flat) > 90)
    return (flat != "") & (matches_any(flat, fixed.BOILERPLATE) | byline)


def is_terminal(line: Column) -> Column:
    return matches_any(squeeze(line), fixed.TERMINAL)


def is_low_value(text: Column) -> Column:
    flat = squeeze(text)
    return (F.length(flat) < 80) & ~flat.rlike(r"[.!?]") & ~flat.rlike(r"[=(){}\[\]#<>]")


def is_heading(line: Column) -> Column:
    """A numbered heading, or a short title-cased line without a full stop."""
    flat = squeeze(line)
    words = F.split(flat, " ")
    titled = F.size(F.filter(words, lambda w: w.rlike("^[A-Z0-9]")))
    title = (F.size(words) <= 12) & ~flat.endswith(".") & (titled >= F.greatest(F.lit(1.0), F.size(words) / 2))
    return (flat != "") & (F.length(flat) <= 120) & ~is_boilerplate(line) & (flat.rlike(r"^\d+(\.\d+)*\.?\s+[A-Z]") | title)


def redact(text: Column) -> Column:
    for pattern, replacement in fixed.REDACTIONS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def is_sensitive(text: Column) -> Column:
    found = any_of(F.lower(text), fixed.SENSITIVE_WORDS)
    for pattern in fixed.SENSITIVE:
        found = found | text.rlike(pattern)
    return found


def has_memory_signal(text: Column) -> Column:
    return any_of(F.lower(text), fixed.MEMORY_SIGNALS)


def memory_kind(text: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(any_of(t, ["eval", "benchmark", "score", "pass", "failed"]), "evaluation_result")
        .when(any_of(t, ["next step", "todo", "remaining", "completed", "done"]), "task_status")
        .when(any_of(t, ["issue", "bug", "problem", "regression"]), "known_issue")
        .when(any_of(t, ["i prefer", "i want", "my preference"]), "user_preference")
        .otherwise("project_decision")
    )


def memory_importance(text: Column) -> Column:
    t = F.lower(text)
    rule = F.when(any_of(t, ["do not", "don't", "dont", "never", "always", "keep in mind"]), 1.0).otherwise(0.0)
    goal = F.when(any_of(t, ["target", "goal", "eval", "benchmark", "quality", "general purpose"]), 0.5).otherwise(0.0)
    return F.least(F.lit(3.0), F.lit(1.0) + rule + goal)


def memory_text(text: Column) -> Column:
    flat = F.regexp_replace(F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" -")), r"(?i)^(please|kindly)\s+", "")
    return F.when(F.size(F.split(flat, " ")) > 80, "").otherwise(F.rtrim(F.substring(flat, 1, 500)))


def has_requirement(text: Column, requirement: Column) -> Column:
    """A short plain word must stand alone; anything else may be a substring, also without punctuation."""
    phrase = normalize(requirement)
    short = phrase.rlike(r"^[a-z0-9][a-z0-9-]{1,12}$")
    alone = F.concat(F.lit(" "), F.regexp_replace(normalize(text), r"[^\p{L}\p{N}_-]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))
    loose = normalize(text).contains(phrase) | compact(text).contains(compact(requirement))
    return (phrase != "") & F.when(short, alone).otherwise(loose)


def citation_count(answer: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1))))


def leaks_context(answer: Column) -> Column:
    return any_of(F.lower(answer), fixed.LEAK_MARKERS)



def owner(raw: Column) -> Column:
    flat = F.substring(squeeze(F.coalesce(raw, F.lit(""))), 1, 80)
    return F.when(flat == "", "global").otherwise(flat)


def tool_category(name: Column, source: Column, server: Column | None = None) -> Column:
    n, server = F.lower(name), F.lower(server) if server is not None else F.lit("")
    return (
        F.when(any_of(n, ["delete", "remove", "unlink"]), "delete_file")
        .when(any_of(n, ["write", "save", "create", "update"]), "write_file")
        .when(n.contains("weather"), "web_read")
        .when(n.contains("sqlite") | (n == "list_documents") | (server == "sqlite"), "read_db")
        .when(n.contains("file") | n.contains("directory") | server.isin("local_files", "file_server"), "read_file")
        .when(source == "mcp", "mcp_read")
        .otherwise("local_read")
    )


def risk_level(status: Column, category: Column, requires_approval: Column) -> Column:
    s = F.lower(status)
    return (
        F.when(category.isin("write_file", "delete_file") | (s == "deny"), "high")
        .when((s == "needs_approval") | requires_approval, "medium")
        .otherwise("low")
    )


def safe_id(raw: Column, width: int, fallback: str) -> Column:
    """Identifier characters only, none of -_.: at the ends, cut to ``width``."""
    flat = F.btrim(F.regexp_replace(F.btrim(F.coalesce(raw, F.lit(""))), "[^a-zA-Z0-9_.:-]+", "-"), F.lit("-_.:"))
    return F.when(flat == "", fallback).otherwise(F.substring(flat, 1, width))


def namespaced_session(user: Column, session: Column) -> Column:
    return safe_id(F.concat(safe_id(user, 48, "local"), F.lit(":"), safe_id(session, 80, "default")), 80, "local")


def token_fingerprint(token: Column) -> Column:
    return F.substring(F.sha2(token, 256), 1, 12)


def clean_citations(answer: Column, most: Column) -> Column:
    """[1, 2] becomes [1] [2]; numbers that name no evidence go; so does an abstention beside an answer."""
    apart = F.regexp_replace(answer, r"(?<=[\[,\d])\s*,\s*(?=[\d\s,]*\])", "] [")
    pieces = F.split(apart, r"(?=\[\d+\])")
    kept = F.transform(pieces, lambda p: F.when(p.rlike(r"^\[\d+\]") & ~F.regexp_extract(p, r"^\[(\d+)\]", 1).cast("long").between(1, most), F.regexp_replace(p, r"^\[\d+\]", "")).otherwise(p))
    lines = F.filter(F.split(F.array_join(kept, ""), "\n"), lambda x: ~F.lower(x).contains("does not contain enough information"))
    joined = F.btrim(F.array_join(lines, "\n"))
    return F.when(joined == "", answer).otherwise(joined)


def context_block(number: Column, title: Column, section: Column, page: Column, score: Column, body: Column, most: int = 1800) -> Column:
    flat = F.btrim(F.coalesce(body, F.lit("")))
    cut = F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("..."))).otherwise(flat)
    return F.concat(F.lit("["), number.cast("string"), F.lit("]\nTitle:"), F.coalesce(title, F.lit("Untitled")), F.lit("\nSection:"), F.coalesce(section, F.lit("Unknown")), F.lit("\nPage:"), F.coalesce(page.cast("string"), F.lit("?")), F.lit("\nScore:"), F.format_string("%.4f", score), F.lit("\nText:"), cut, F.lit("\n"))


def citation_line(number: Column, title: Column, page: Column, path: Column) -> Column:
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.coalesce(title, F.lit("Untitled")), F.lit(", page "), F.coalesce(page.cast("string"), F.lit("?")), F.lit(" ("), F.coalesce(path, F.lit("")), F.lit(")"))
