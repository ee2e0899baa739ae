"""Ordered runs in texts: numbered and ordinal markers as rows, runs as islands, items cut between markers; steps and pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions import sentences as st
from ..session import materialized, settled
from . import answer, cleaning, windows

#: What opens an item, and its number: a number with a stop or bracket, or an ordinal.  \x01 stands before a text.
MARKERS = {
    "numbered": (r"(?<![^\s\x01])\d{1,4}[.)]\s", r"^(\d+)"),
    "ordinal": rf"(?<![\p{{L}}\p{{N}}_])(?i:{'|'.join(fixed.ORDINALS)})(?![\p{{L}}\p{{N}}_])",
}


def markers(items: DataFrame, body: str, *keys: str) -> DataFrame:
    """(*keys, kind, place, at, number, item): a row of each marker, in order, with the text up to the next one of its kind.

    One split before every marker gives the items; nothing but them is carried on.  Null texts have no markers."""
    found = None
    for kind, pattern in MARKERS.items():
        opens = pattern[0] if kind == "numbered" else pattern
        pieces = settled(items.select(*keys, F.split(F.concat(F.lit("\x01"), F.col(body)), f"(?={opens})", -1).alias("pieces")), sizes=F.transform("pieces", F.length))
        each = pieces.select(*keys, F.length(F.col("pieces")[0]).alias("head"), F.posexplode(F.slice("pieces", 2, 1 << 30)).alias("place", "piece"))
        number = F.regexp_extract("piece", r"^(\d+)", 1).cast("int") if kind == "numbered" else F.array_position(F.split(F.lit(",".join(fixed.ORDINALS)), ","), F.lower(F.regexp_extract("piece", r"^(\p{L}+)", 1))).cast("int")
        before = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        item = F.btrim(text.squeeze(F.regexp_replace("piece", r"^(?:\d+[.)]|\p{L}+)", "")), F.lit(" .:,-"))
        rows = each.select(*keys, F.lit(kind).alias("kind"), "place", (F.col("head") - 1 + before).cast("int").alias("at"), number.alias("number"), item.alias("item"))
        found = rows if found is None else found.unionByName(rows)
    return found


def runs(items: DataFrame, body: str, *keys: str, least: int = 2) -> DataFrame:
    """(*keys, kind, run, step, steps, at, number, item): markers that count on by one, ``least`` of them or more in a row."""
    order = Window.partitionBy(*keys, "kind").orderBy("place")
    opened = markers(items, body, *keys).withColumn("opens", F.coalesce(F.col("number") - F.lag("number").over(order) != 1, F.lit(True)).cast("int"))
    island = opened.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = Window.partitionBy(*keys, "kind", "run")
    counted = island.withColumns({"steps": F.count("*").over(whole), "step": F.row_number().over(whole.orderBy("place"))})
    return counted.filter(F.col("steps") >= least).select(*keys, "kind", F.col("run").cast("int").alias("run"), "step", F.col("steps").cast("int").alias("steps"), "at", "number", "item")


def longest(found: DataFrame, *keys: str) -> DataFrame:
    """The rows of the longest run of each key: the first of equal ones, numbered before ordinal."""
    best = found.groupBy(*keys).agg(F.min(F.struct((-F.col("steps")).alias("minus"), "kind", "run")).alias("best"))
    return found.join(best, list(keys)).filter("kind = best.kind and run = best.run").drop("best")


def series(items: DataFrame) -> DataFrame:
    """(query_id, answer): the items of the longest run of a query's texts in the order of the source, each cited; named series and lists."""
    rows = windows.ordered_texts(items)
    found = longest(runs(rows, "body", "query_id", "rank"), "query_id", "rank").filter("item <> ''")
    best = found.groupBy("query_id", "rank").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.min(F.struct((-F.col("n")).alias("minus"), "rank")).alias("best"))
    own = found.join(best, "query_id").filter(F.col("rank") == F.col("best.rank"))
    line = F.concat(F.lit("- "), windows._ended(F.col("item"), 34), F.lit(". ["), F.col("rank").cast("string"), F.lit("]"))
    lines = own.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))).alias("found"))
    return lines.select("query_id", F.concat(F.lit("The steps are: "), F.array_join(F.transform("found", lambda x: x["line"]), " ")).alias("answer"))


# Steps of a challenge


def _steps(found: Column) -> Column:
    """Steps of three words or more, each once, eight at most, as (flat, step)."""
    tidy = F.transform(found, lambda s: F.btrim(text.squeeze(s), F.lit(" .:-")))
    return F.transform(F.filter(tidy, lambda s: F.size(F.split(s, " ")) >= 3), lambda s: F.struct(windows._normal(s).alias("flat"), s.alias("step")))


def _once(df: DataFrame, column: str) -> DataFrame:
    flats = F.transform(column, lambda x: x["flat"])
    held = settled(df, flats_=flats)
    kept = F.filter(column, lambda x, i: F.array_position(F.col("flats_"), x["flat"]) == i + 1)
    return settled(held, **{column: F.transform(F.slice(kept, 1, 8), lambda x: x["step"])}).drop("flats_")


def challenge_answers(items: DataFrame) -> DataFrame:
    """(query_id, answer): the steps of a challenge from the item that lists most of them, in order."""
    q, low = F.lower("query"), F.col("low")
    asked = items.filter(q.contains("challenge") & text.any_of(q, fixed.STEP_QUERY_WORDS))
    held = settled(windows.with_body(asked), low=F.lower("body"))
    held = settled(held, at=windows.first_of(low, ["challenge"])).filter("at >= 0")
    end, start = windows.first_of(low, fixed.STEP_ENDS, F.col("at") + 120), F.greatest(F.lit(0), F.col("at") - 80)
    held = settled(held, stop=F.when(end >= 0, end).otherwise(F.least(F.length("body"), F.col("at") + 900)))
    held = settled(held, excerpt=text.squeeze(F.substring("body", start + 1, F.col("stop") - start)))
    after = F.substring("excerpt", windows.first_of(F.lower("excerpt"), ["challenge"]) + 1, F.length("excerpt"))
    days = _once(settled(held, days=_steps(F.regexp_extract_all("excerpt", F.lit(fixed.DAY_STEPS), F.lit(1))), plain=_steps(F.regexp_extract_all(after, F.lit(fixed.NUMBERED_STEPS), F.lit(1)))), "days")
    both = settled(_once(days, "plain"), steps=F.when(F.size("days") >= 2, F.col("days")).otherwise(F.col("plain"))).filter("size(steps) >= 2")
    joined = F.lower(F.array_join("steps", " "))
    scored = both.withColumn("score", F.size("steps") * 8 + answer.hits_in(joined, fixed.STEP_MARKS) * 3)
    most = F.max("rank").over(Window.partitionBy("query_id"))
    best = scored.withColumns({"n": F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")), "most": most}).filter("n = 1")
    length = F.regexp_replace(F.regexp_extract(q, r"\b(\d+\s*[- ]?\s*day)\b", 1), r"\s+", "-")
    label = F.when(length != "", F.concat(length, F.lit(" challenge"))).otherwise("challenge")
    lines = F.transform(F.slice("steps", 1, 7), lambda s: F.concat(F.lit("- "), s, F.lit(". ["), F.col("rank").cast("string"), F.lit("]")))
    shown = best.select("query_id", F.concat(F.lit("The "), label, F.lit(" steps are: "), F.array_join(lines, " ")).alias("answer"))
    return cleaning.cleaned(shown, "answer")


# Pipelines


def content_terms(body: Column) -> Column:
    words = F.regexp_extract_all(F.lower(body), F.lit(r"(?<![\p{L}\p{N}_])[a-z](?:[a-z0-9-]{2,}[a-z0-9])(?![\p{L}\p{N}_])"), F.lit(0))
    return F.array_distinct(text.without(words, fixed.CONTENT_STOPS))


def pipeline_answers(items: DataFrame) -> DataFrame:
    """(query_id, answer): the stages that the items of a query name, in the order of a pipeline; commented steps of code fill up.

    A stage that shares three content words with an earlier one (or all of its words) is left out; each cites the item that
    holds most of its words."""
    asked = items.filter(text.any_of(F.lower("query"), fixed.PIPELINE_QUERIES))
    rows = windows.with_body(asked)
    comments = F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n|\r", "\n"), F.lit(r"#\s*([^#\n]{8,120})"), F.lit(1)), lambda c: F.btrim(text.squeeze(c), F.lit(" .:-")))
    named = F.filter(comments, lambda c: (c != "") & text.any_of(F.lower(c), fixed.PIPELINE_COMMENTS))
    upper = F.transform(named, lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 200)))
    whole = settled(rows, comments=upper).groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "body", "comments"))).alias("items"))
    whole = settled(whole, body=text.squeeze(F.array_join(F.transform("items", lambda i: i["body"]), " ")), lows=F.transform("items", lambda i: F.struct(i["rank"].alias("rank"), F.lower(i["body"]).alias("low"))), focus=windows.subject(F.col("query")))
    whole = settled(whole, low=F.lower("body")).filter(answer.hits_in(F.col("low"), fixed.PIPELINE_MARKERS) >= 4)
    low = F.col("low")
    has = lambda *ws: text.any_of(low, list(ws))
    names = lambda pattern, group: F.array_distinct(F.regexp_extract_all("body", F.lit(pattern), F.lit(group)))
    made = F.filter(names(r"\b([A-Z][A-Za-z0-9]*(?:Tags?|Markup|Output))\b", 1), lambda n: F.length(n) > 3)
    classes = F.array_distinct(F.concat(names(r"\b([A-Z][A-Za-z0-9]*Document)\b(?=\s*(?:[.(]|=))", 1), names(r"(?<![\"'])\b([A-Z][A-Za-z0-9]*Document)\b(?![\"'])", 1)))
    whole = settled(whole, made=made, classes=F.slice(classes, 1, 3), formats=names(r"\b(?:Markdown|HTML|JSON|CSV|XML|TXT|PDF)\b", 0))
    words = lambda *ws: F.split(F.lit(",".join(ws)), ",")
    step = lambda when, body, terms: F.when(when, F.struct(body.alias("step"), terms.alias("terms")))
    stages = F.array(
        step(has("local", "upload", "file") & has("url") & has("pdf", "image"), F.lit("Load PDFs or images from a local file/upload or a URL"), words("local", "url", "pdf", "image")),
        step(has("load") & has("model"), F.when(F.col("focus") != "", F.concat(F.lit("Load the "), "focus", F.lit(" model"))).otherwise("Load the model"), words("load", "model")),
        step(has("generate", "stream", "output"), F.when(F.size("made") > 0, F.concat(F.lit("Generate "), F.array_join(F.slice("made", 1, 2), ", "), F.lit(" for each page or image"))).otherwise("Generate structured output for each page or image"), words("generate", "output", "page", "image")),
        step(F.size("classes") > 0, F.concat(F.lit("Create "), F.array_join("classes", " and "), F.lit(" from the generated output")), F.col("classes")),
        step(F.size("formats") > 0, F.concat(F.lit("Export the result as "), F.array_join("formats", ", ")), F.col("formats")),
        step(has("preview", "download", "interface", "ui", "gradio"), F.when(has("gradio"), "Render a preview and provide download controls in the Gradio UI").otherwise("Render a preview and provide download controls in the UI"), words("preview", "download", "ui", "interface")),
    )
    whole = settled(whole, stages=F.filter(stages, lambda s: s.isNotNull()))

    def cited(terms: Column) -> Column:
        best = F.array_max(F.transform("lows", lambda i: F.struct(F.size(F.filter(terms, lambda t: i["low"].contains(F.lower(t)))).alias("score"), (-i["rank"]).alias("minus"))))
        return F.when(best["score"] > 0, -best["minus"]).otherwise(1)

    each = F.transform("stages", lambda s: F.struct(s["step"].alias("step"), cited(s["terms"]).cast("int").alias("rank"), content_terms(s["step"]).alias("content")))
    extra = F.flatten(F.transform("items", lambda i: F.transform(i["comments"], lambda c: F.struct(c.alias("step"), i["rank"].cast("int").alias("rank"), content_terms(c).alias("content")))))
    whole = settled(whole, each=each, extra=extra)
    kind = "array<struct<step:string,rank:int,content:array<string>>>"

    def added(kept: Column, x: Column) -> Column:
        near = F.exists(kept, lambda k: (F.size(k["content"]) > 0) & (F.size(x["content"]) > 0) & (F.size(F.array_intersect(k["content"], x["content"])) >= F.least(F.lit(3), F.size(k["content"]), F.size(x["content"]))))
        return F.when(near, kept).otherwise(F.concat(kept, F.array(x)))

    whole = settled(whole, kept=F.aggregate("each", F.array().cast(kind), added))
    filled = F.aggregate("extra", F.col("kept"), lambda kept, x: F.when(F.size(kept) >= 6, kept).otherwise(added(kept, x)))
    whole = settled(whole, kept=F.when(F.size("kept") >= 3, F.col("kept")).otherwise(filled)).filter("size(kept) >= 3")
    lines = F.transform(F.slice("kept", 1, 7), lambda s: F.concat(F.lit("- "), s["step"], F.lit(". ["), s["rank"].cast("string"), F.lit("]")))
    shown = whole.select("query_id", F.concat(F.lit("The main pipeline is: "), F.array_join(lines, " ")).alias("answer"))
    return cleaning.cleaned(materialized(shown), "answer")
