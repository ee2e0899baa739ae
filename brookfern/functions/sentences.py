"""Column functions over answers and sentences: predicates, entities, cleaning, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from . import fixed, text

_BOUND, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# A capital is looked for before what stands before it: that is slower to tell.
_CAPITAL = f"(?=[A-Z]){_BOUND}"


def word_count(body: Column) -> Column:
    return F.size(F.filter(F.split(text.squeeze(body), " "), lambda w: w != ""))


def first_words(body: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text.squeeze(body), " "), lambda w: w != ""), 1, n), " ")


# Sentences


def is_structured(sentence: Column, low: Column | None = None) -> Column:
    """Numbered, ordered, labelled near its start, or with an identifier.  low, here and below: its lower case, where that is at hand."""
    return F.substring(sentence, 1, 100).contains(":") | _low(sentence, low).rlike(fixed.STRUCTURED) | has_identifier(sentence)


def _low(body: Column, low: Column | None) -> Column:
    return F.lower(body) if low is None else low


def has_identifier(body: Column) -> Column:
    """A class-like name, or two capitalised words in a row."""
    name = rf"{_CAPITAL}[A-Z](?:[A-Za-z0-9_-]+[A-Za-z0-9_]){_END}"
    return (F.size(class_names(body)) > 0) | body.rlike(rf"{name}\s+{name}")


def class_names(body: Column) -> Column:
    words = F.regexp_extract_all(body, F.lit(rf"{_CAPITAL}[A-Z][A-Za-z0-9_]{{3,}}{_END}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: w.rlike("(Document|Model|Config|Settings|Field|Choice|Choices|Tag|Tags)$")))


def is_high_signal(sentence: Column, low: Column | None = None) -> Column:
    return text.any_of(_low(sentence, low), fixed.HIGH_SIGNAL)


def is_example(sentence: Column, terms: Column, low: Column | None = None) -> Column:
    """An example that names one of the terms or an identifier."""
    low = _low(sentence, low)
    return text.any_of(low, fixed.EXAMPLE_MARKERS) & (F.exists(terms, lambda t: low.contains(t)) | has_identifier(sentence))


def _count(body: Column, literal: str) -> Column:
    return F.length(body) - F.length(F.replace(body, F.lit(literal), F.lit("")))


def is_metadata(sentence: Column, low: Column | None = None) -> Column:
    low = _low(sentence, low)
    marks = sum((F.when(low.contains(m), 1).otherwise(0) for m in fixed.AUTHOR_MARKERS), F.lit(0))
    names = F.regexp_count(sentence, F.lit(rf"{_CAPITAL}[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+{_END}"))
    return text.any_of(low, ["@article", "copyright", "all rights reserved"]) | ((marks >= 2) & (names >= 4))


def is_code(sentence: Column, low: Column | None = None) -> Column:
    """Source code or metadata rather than prose."""
    low = _low(sentence, low)
    signs, opens = _count(sentence, "="), _count(sentence, "(")
    # Signs are counted before patterns are tried.
    keyword = (sentence.contains("=") | (opens >= 2)) & low.rlike(r"\b(?:return|for|while|if|else)\s+[\w_(]") & ~low.contains("used for")
    assigned = sentence.contains("=") & (opens >= 2) & sentence.rlike(r"\b\w+\s*=\s*[^.!?]{1,90}")
    constants = sentence.contains("=") & (F.regexp_count(sentence, F.lit(r"\b[A-Z][A-Z0-9_]{2,}\s*=")) >= 2)
    return text.any_of(low, fixed.CODE_MARKERS) | keyword | assigned | constants | ((signs >= 2) & (word_count(sentence) > 90)) | is_metadata(sentence, low)


def keeps_code(query: Column, sentence: Column) -> Column:
    """Code that the query asks for."""
    return text.any_of(F.lower(query), fixed.CODE_QUERIES) & (text.any_of(F.lower(sentence), fixed.CODE_KEPT) | has_identifier(sentence))


def is_low_value(sentence: Column) -> Column:
    """Headings, announcements and calls to follow or share."""
    flat = text.squeeze(sentence)
    low = F.lower(flat)
    starts = lambda *ws: low.rlike("^(?:" + "|".join(ws) + ")")
    return (
        flat.rlike(r"^\d+(?:\.\d+)*\s+[A-Z][A-Za-z0-9 -]{2,70}\.?$")
        | (starts("we discuss ") & (word_count(flat) < 24))
        | starts("based on public", "where can you use this", "when to use")
        | (low.contains("comprehensive review") & low.contains("current limitations"))
        | text.any_of(low, ["follow publication", "click here", "followers", "tag your", "clap if", "comment below", "share this"])
        | low.rlike(r"\b\d+(?:\.\d+)?k?\s+following\b")
    )


def split(body: Column, longer_than: int = 0) -> Column:
    """Sentences, with white space collapsed; only those of more characters than ``longer_than``."""
    return F.filter(F.transform(F.split(text.squeeze(body), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: F.length(s) > longer_than)


_LISTED = r"(?:^|\s)(?:[-*]|\d+[.)])\s+([^.!?]{12,220}[.!?])"
_COMMANDS = r"(?i)\b(?:python\s+-m\s+[-\w.]+(?:\s+\d+)?|docker\s+run\b[^.!?]{0,160}|pip\s+install\s+[-\w.]+|uv\s+run\b[^.!?]{0,120}|npm\s+install\s+[-\w.]+|brew\s+install\s+[-\w.]+)"


def positions(body: Column, pattern: str | Column) -> Column:
    """Zero-based starts of all places that match, overlapping ones included, in one pass.

    The text is split before each match; ends of the parts, summed up, are the starts."""
    before = F.concat(F.lit("(?="), pattern, F.lit(")")) if isinstance(pattern, Column) else F.lit(f"(?={pattern})")
    sizes = F.transform(F.split(F.concat(F.lit("\x01"), body), before, F.lit(-1)), F.length)
    summed = F.aggregate(sizes, F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("ends")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["ends"], F.array(s["at"] + n)).alias("ends")))["ends"]
    return F.slice(summed, 1, F.greatest(F.size(summed) - 1, F.lit(0)))


def stops(body: Column) -> Column:
    """Places of the ends of sentences in a text."""
    return positions(body, r"[.?!] ")


def with_fact_sentences(df: DataFrame, body: Column, name: str = "sentences") -> DataFrame:
    """``df`` with list items, commands and sentences, each once: those of more than 40 characters, items of three words, and
    short ones with a marker.  Each list is worked out once a row."""
    flat = text.squeeze(body)
    held = settled(df, flat_=flat)
    listed = F.transform(F.regexp_extract_all("flat_", F.lit(_LISTED), F.lit(1)), lambda x: F.trim(x))
    held = settled(held, listed_=listed, commands_=F.transform(F.regexp_extract_all("flat_", F.lit(_COMMANDS), F.lit(0)), lambda x: F.trim(x)), parts_=F.transform(F.split("flat_", r"(?<=[.!?])\s+"), lambda x: F.trim(x)))
    parts = F.concat("listed_", "commands_", F.filter("parts_", lambda s: F.length(s) > 0))
    held = settled(held, kept_=F.filter(parts, lambda s: (F.length(s) > 40) | (F.array_contains("listed_", s) & (F.size(F.split(s, " ")) >= 3)) | text.any_of(F.lower(s), fixed.SHORT_SIGNAL)))
    held = settled(held, keyed_=F.transform("kept_", F.lower))
    held = settled(held, **{name: F.filter("kept_", lambda s, i: F.array_position("keyed_", F.get("keyed_", i)) == i + 1)})
    return held.drop("flat_", "listed_", "commands_", "parts_", "kept_", "keyed_")


def definition_sentences(body: Column) -> Column:
    """Sentences that may define: split at ends and semicolons, eight words at least."""
    return F.filter(F.transform(F.split(text.squeeze(body), r"(?<=[.!?;])\s+"), lambda x: F.trim(x)), lambda s: F.size(F.split(s, " ")) >= 8)


def is_multi_source(query: Column) -> Column:
    return text.any_of(F.lower(query), ["compare", "across documents", "across all", "all documents", "multiple documents", "both papers", "each paper", "each document"])


# Entities


def entities(query: Column) -> Column:
    """Words of four letters or more with a capital in them, without generic ones."""
    words = F.regexp_extract_all(query, F.lit(rf"{_BOUND}[A-Za-z](?:[A-Za-z0-9_-]{{2,}}[A-Za-z0-9_]){_END}"), F.lit(0))
    kept = F.transform(F.filter(words, lambda w: w.rlike("[A-Z]")), F.lower)
    return F.array_distinct(text.without(kept, fixed.ENTITY_GENERIC))


def acronyms(phrases: Column) -> Column:
    """First letters of each phrase of several words, and their plural."""
    letters = F.transform(phrases, lambda p: F.array_join(F.transform(F.split(p, " "), lambda w: F.substring(w, 1, 1)), ""))
    kept = F.filter(letters, lambda a: F.length(a) >= 2)
    return F.array_distinct(F.concat(kept, F.transform(kept, lambda a: F.concat(a, F.lit("s")))))


def names(body: Column, least: int) -> Column:
    """Capitalised words of ``least`` letters or more, in order."""
    return F.regexp_extract_all(body, F.lit(rf"{_CAPITAL}[A-Z](?:[A-Za-z0-9_-]{{{max(0, least - 2)},}}[A-Za-z0-9_]){_END}"), F.lit(0))


def definition_entity(query: Column) -> Column:
    """What a query asks the definition of; empty if it asks for something else."""
    q = F.regexp_replace(F.btrim(query), r"^[?!. ]+|[?!. ]+$", "")
    found = F.regexp_extract(q, r"(?i)^(?:what\s+do\s+you\s+mean\s+by|what\s+is|what\s+are|define|definition\s+of)\s+(.+)$", 1)
    meant = F.regexp_extract(q, r"(?i)^what\s+does\s+(.+?)\s+mean$", 1)
    entity = text.squeeze(F.btrim(F.when(found != "", found).otherwise(meant), F.lit(" '\"“”‘’")))
    low = F.lower(entity)
    head = F.get(F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(fixed.DEFINITION_MODIFIERS)), F.lit(0))
    other = low.isin("the article", "article", "it", "this", "that", "thing", "point", "idea", "concept", "topic", "subject") | low.rlike("^(?:the )?(?:article|paper)'s ") | F.coalesce(head.isin(fixed.NOT_DEFINED), F.lit(True))
    return F.when((entity == "") | other, "").otherwise(entity)


def names_entity(body: Column, entity: Column) -> Column:
    """A text holds an entity without its punctuation, or all of its words."""
    terms = F.regexp_extract_all(F.lower(entity), F.lit("[a-z0-9]+"), F.lit(0))
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(body), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    whole = text.compact(body).contains(F.array_join(terms, ""))
    return (F.size(terms) > 0) & (whole | F.forall(terms, lambda t: padded.contains(F.concat(F.lit(" "), t, F.lit(" ")))))


def subject(query: Column) -> Column:
    """What a question is about, as it is written there: its subject, its longest name, or its last capitalised word."""
    none = F.lit("")
    asked = none
    for pattern in reversed(fixed.SUBJECT_QUERIES):
        found = F.btrim(text.squeeze(F.regexp_extract(query, pattern, 1)), F.lit(" '\"“”‘’"))
        asked = F.when(F.exists(entity_terms(found), lambda t: ~t.isin(fixed.ENTITY_GENERIC)), found).otherwise(asked)
    phrases = F.array_sort(F.transform(text.focus_phrases(query), lambda p: F.struct((-F.length(p)).alias("minus"), p.alias("p"))))
    words = F.filter(names(query, 4), lambda w: ~F.lower(w).isin(fixed.ENTITY_GENERIC))
    return F.when(asked != "", asked).otherwise(F.coalesce(F.get(phrases, F.lit(0))["p"], F.get(words, F.size(words) - 1), none))


def entity_terms(entity: Column) -> Column:
    return text.without(F.regexp_extract_all(F.lower(entity), F.lit(r"[a-z0-9](?:[a-z0-9_-]*[a-z0-9_])?"), F.lit(0)), fixed.ENTITY_TERM_STOPS)


def competing(query: Column, body: Column) -> Column:
    """A text brings up a named topic other than the one that a question about features, strengths, roles or parts asks for.

    Names that hold the asked one, or its initials, or are held by it, do not compete; neither do generic headings.  A
    name of several words competes if it opens the text, heads a part of it or is the subject of a clause; a word
    if it is written like the name of a tool or heads a part."""
    asked = F.array_distinct(F.concat(text.focus_phrases(query), F.filter(F.array(F.lower(subject(query))), lambda s: s != "")))
    own = F.filter(F.concat(F.transform(asked, text.compact), acronyms(asked)), lambda c: c != "")
    plain = lambda c: ~F.exists(own, lambda o: c.contains(o) | o.contains(c))
    escaped = lambda n: F.regexp_replace(n, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    runs = F.regexp_extract_all(body, F.lit(r"\b[A-Z][A-Za-z0-9_-]{2,}\b(?:\s+\(?[A-Z][A-Za-z0-9_-]{1,}\)?\b){1,5}"), F.lit(0))
    words = F.regexp_extract_all(body, F.lit(r"\b[A-Z][A-Za-z0-9_-]{2,}\b"), F.lit(0))

    def heads(n: Column) -> Column:
        return F.regexp_like(body, F.concat(F.lit(r"(?:^|[.;]\s*)"), escaped(n), F.lit(r"\s*[:\-–—]")))

    def introduced(n: Column) -> Column:
        verbs = r"\b(?:\s+\([A-Z0-9]+\))?\s+(?:is|are|can|helps|allows|provides|offers|includes|include|monitors|detects|updates|discovers|uses|utilizes)\b"
        return F.instr(body, n).between(1, 13) | heads(n) | F.regexp_like(body, F.concat(F.lit(r"\b"), escaped(n), F.lit(verbs)))

    generic = F.split(F.lit(",".join(fixed.TOPIC_GENERIC)), ",")
    topic = lambda n: F.size(F.array_except(F.regexp_extract_all(F.lower(n), F.lit(r"[a-z][a-z0-9_-]*"), F.lit(0)), generic)) > 0
    several = F.exists(runs, lambda n: topic(n) & plain(text.compact(n)) & introduced(n))
    tool = lambda w: F.substring(w, 2, 1000).rlike("[A-Z]") & w.rlike("[a-z]")
    single = F.exists(words, lambda w: ~F.array_contains(generic, F.lower(w)) & plain(text.compact(w)) & (tool(w) | F.regexp_like(body, F.concat(F.lit(r"\b"), escaped(w), F.lit(r"\b\s*[:\-–—]")))))
    return text.any_of(F.lower(query), fixed.TOPIC_QUERIES) & (F.size(own) > 0) & (several | single)


# Cleaning


def repaired(body: Column) -> Column:
    """Text whose typographic signs were read in the wrong encoding."""
    return text.replaced(body, fixed.MOJIBAKE)


def rejoined(body: Column) -> Column:
    return text.replaced(body, fixed.BROKEN_WORDS)


def without_headers(body: Column) -> Column:
    """Text without the headers of child chunks and the numbers before them."""
    plain = F.regexp_replace(body, r"\b\d+\s+(?=\[child chunk)", "")
    return F.regexp_replace(plain, r"\[child chunk \d+ \| page [^\]]+\]\s*", " ")


def evidence_clean(body: Column) -> Column:
    """Evidence from its abstract on, without headers, with broken words rejoined, on one line."""

    def begun(plain: Column) -> Column:
        at = F.regexp_instr(F.substring(plain, 1, 800), F.lit(r"(?i)\bAbstract\b"))
        return F.when(at > 0, F.substring(plain, at, F.length(plain))).otherwise(plain)

    trimmed = text.bound(F.regexp_replace(repaired(body), r"\r\n|\r", "\n"), begun)
    return text.squeeze(rejoined(F.regexp_replace(without_headers(trimmed), r"(?i)\bAbstract\b\s*", "")))


def section_clean(title: Column) -> Column:
    return F.btrim(text.squeeze(F.regexp_replace(F.btrim(title), r"^\d+(?:\.\d+)*\s*", "")), F.lit(" :-"))


# What goes from an answer, in order, and what stands for it.
ANSWER_PATTERNS = [
    (r"(?im)^\s*(?:Title|Section|Page|Score|Text)\s*:\s*.*$", ""),
    (r"(?i)\b(?:Follow publication|Published in|Get an email whenever|By signing up)[^.!?]{0,180}", ""),
    (r"(?i)\b(?:\d+(?:\.\d+)?K\s+)?Followers?\s*(?:·\s*\d+\s+Following)?[^.!?]{0,120}", ""),
    (r"(?i)^\s*Based on (?:the )?(?:provided )?(?:context|evidence|retrieved evidence)(?: provided)?[:,]?\s*", ""),
    (r"(?i)(\[\d+\])\s+[A-Z][^.\n]{10,}\|\s*by\s+[^.\n]+$", "$1"),
    (r"\s+-\s+(?=[A-Z][A-Za-z0-9 /&-]{0,48}:)", "\n- "),
    (r"(?i)(?:^|\n)-?\s*Some (?:of )?the key features(?: of [^:]+)? include:\s*", "\n"),
    (r"(?is)\s+Citations:\s+\[\d+\].*$", ""),
]
# Empty list items and blanks before signs.
AFTER_CITATIONS = [(r"(?:^|\s)-\s*(?:\[\d+\]\s*)+(?=$|\s+-)", " "), (r"\s+([,])", "$1"), (r"\s+\.(?=(?:\s|$|\[\d+\]))", ".")]


def excerpt(body: Column, units: Column, radius: int = 2200) -> Column:
    """The text around the first of the units: a third of ``radius`` before it and ``radius`` after, out to whole sentences; empty without one."""
    low = F.lower(body)
    spots = F.filter(F.transform(units, lambda u: F.instr(low, u)), lambda at: at > 0)
    anchor = F.array_min(spots) - 1
    start = F.greatest(F.lit(0), anchor - radius // 3)
    end = F.least(F.length(body), anchor + radius)
    last = lambda mark: F.length(F.regexp_extract(F.substring(body, F.lit(1), start), f"(?s)^(.*){mark}", 1))
    before = F.substring(body, F.lit(1), start)
    found = F.greatest(*(F.when(before.contains(m), last(p)).otherwise(-1) for m, p in ((". ", r"\. "), ("\n", r"\n"))))
    begin = F.when(found >= 0, found + 1).otherwise(start)
    rest = F.substring(body, end + 1, F.length(body))
    ahead = F.array_min(F.filter(F.array(F.instr(rest, F.lit(". ")), F.instr(rest, F.lit("\n"))), lambda at: at > 0))
    stop = F.coalesce(end + ahead, end)
    return F.when(F.size(spots) > 0, F.btrim(F.substring(body, begin + 1, stop - begin), F.lit(" \t\r\n"))).otherwise("")

