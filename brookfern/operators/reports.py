"""Reports of evaluations, runs and corpora: joins of expectations with results, rollups, rubrics, recommendations."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

# Scores from which an item passes, and sizes and times from which a change is recommended.
PASS_SCORE, MEMORY_PASS_SCORE = 8.0, 9.0
WARM_ROUTING, WARM_EMBEDDING, SLOW_MS = 0.5, 0.2, 1000.0


@F.pandas_udf(T.DoubleType())
def round_half_even(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounding of the exact binary value, halves to even: 2.675 becomes 2.67, as in Python."""
    return pd.Series([None if pd.isna(v) else round(float(v), int(d)) for v, d in zip(x, digits, strict=True)], dtype="float64")


def rounded(x: Column, digits: int = 2) -> Column:
    return round_half_even(x.cast("double"), F.lit(digits))


def raw_files(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Each raw file (path) with its document, found by its path in lower case; doc_id is null for one that is not indexed."""
    known = docs.select(F.lower("source_path").alias("_low"), "doc_id", "title")
    return files.withColumn("_low", F.lower("path")).join(known, "_low", "left").drop("_low")


def with_predictions(gold: DataFrame, predictions: DataFrame, empty: str = "") -> DataFrame:
    """Gold items with their predictions (id, answer); a missing one is empty."""
    return gold.join(predictions.select("id", "answer"), "id", "left").withColumn("answer", F.coalesce("answer", F.lit(empty)))


def rollup(scored: DataFrame, keys: list[str] | None = None, least: float = PASS_SCORE) -> DataFrame:
    """Mean score to two places, how many items pass, and how many there are."""
    out = scored.groupBy(*(keys or [])).agg(F.avg("score").alias("mean"), F.count_if(F.col("score") >= least).alias("pass_count"), F.count("*").alias("total_count"))
    return out.withColumn("average", rounded(F.coalesce("mean", F.lit(0.0)))).drop("mean")


def offline_rubric(rows: DataFrame) -> DataFrame:
    """Out of ten for a predicted answer: 4 for required phrases, 3 for likeness to the expected one, 2 for focus, 1 for a citation.

    rows: answer, expected, must, must_not (arrays).  Focus loses 1 for a forbidden phrase and a half each for length and for half of the phrases missing."""

    @F.pandas_udf(T.DoubleType())
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])

    flat, expected = text.normalize(F.col("answer")), text.normalize(F.col("expected"))
    found = lambda c: F.filter(c, lambda m: flat.contains(text.normalize(m)))
    words = lambda t: F.size(F.filter(F.split(t, " "), lambda w: w != ""))
    missing = F.size("must") - F.size(found("must"))
    keys = F.when(F.size("must") == 0, 4.0).otherwise((F.size("must") - missing) / F.size("must") * 4.0)
    lost = (
        F.when(F.size(found("must_not")) > 0, 1.0).otherwise(0.0)
        + F.when(words(flat) > F.greatest(F.lit(120), words(expected) * 2), 0.5).otherwise(0.0)
        + F.when(missing >= F.greatest(F.lit(1), F.floor(F.size("must") / 2)), 0.5).otherwise(0.0)
    )
    parts = rows.withColumns({"key_score": keys, "alike_score": rounded(likeness(expected, flat) * 3.0), "focus_score": F.greatest(F.lit(0.0), F.lit(2.0) - lost), "citation_score": F.when(F.col("answer").rlike(r"\[\d+\]"), 1.0).otherwise(0.0)})
    return parts.withColumn("score", rounded(F.col("key_score") + F.col("alike_score") + F.col("focus_score") + F.col("citation_score")))


def slowest(samples: DataFrame, keys: list[str], ms: str, name: str) -> DataFrame:
    """The sample of each group that took longest; the greatest name of equal ones."""
    return samples.groupBy(*keys).agg(F.max_by(F.struct(name, ms), F.struct(ms, name)).alias("s")).select(*keys, f"s.{name}", f"s.{ms}")


def path_counts(samples: DataFrame, path: str = "path") -> DataFrame:
    """How many samples took each path; those without one count under an empty name."""
    return samples.groupBy(F.coalesce(F.col(path), F.lit("")).alias("path")).agg(F.count("*").alias("samples"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """Counters over the coverage of documents (items, status, needed)."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_count")
    return coverage.agg(F.count("*").alias("documents"), *map(count, ("missing", "undercovered", "minimum", "target")), F.coalesce(F.sum("needed"), F.lit(0)).alias("needed"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"))


def taxonomy_items(failing: DataFrame) -> DataFrame:
    """Failures (category, id) with counts and the ids of each category as text, the commonest first."""
    ids = F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",")
    return failing.groupBy("category").agg(F.count("*").alias("failures"), ids.alias("items")).orderBy(F.desc("failures"), "category")


def profile_recommendations(runs: DataFrame) -> DataFrame:
    """Cold and warm means of each phase and what they say.  runs: phase, warm (boolean), ms; p95 over the warm ones."""
    out = runs.groupBy("phase").agg(
        F.avg(F.when(~F.col("warm"), F.col("ms"))).alias("cold_ms"),
        F.avg(F.when(F.col("warm"), F.col("ms"))).alias("warm_ms"),
        F.expr("percentile(if(warm, ms, null), 0.95)").alias("p95_ms"),
    )
    least = F.when(F.col("phase") == "embedding", WARM_EMBEDDING).otherwise(WARM_ROUTING)
    helps = F.col("cold_ms").isNotNull() & (F.col("warm_ms") <= F.col("cold_ms") * least)
    advice = F.concat_ws(",", F.when(helps, "keep_cache").otherwise("check_cache"), F.when(F.col("p95_ms") > SLOW_MS, "slow"))
    return out.withColumns({"saved_ms": F.col("cold_ms") - F.col("warm_ms"), "advice": advice})


def cleaned_requirements(raw: Column) -> Column:
    """Nested requirements without empty texts and groups: white space collapsed, a group without any left dropped."""
    groups = F.transform(raw, lambda g: F.filter(F.transform(g, text.squeeze), lambda x: x != ""))
    return F.filter(groups, lambda g: F.size(g) > 0)


def evidence_summary(items: DataFrame, most: int = 5, width: int = 240) -> DataFrame:
    """The first items of each query as JSON of title, page and a cut text, and the first title that is not empty."""
    brief = F.struct("rank", F.coalesce("title", F.lit("")).alias("title"), "page_number", F.substring(text.squeeze(F.coalesce("text", F.lit(""))), 1, width).alias("text"))
    kept = items.filter(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(brief)).alias("found"))
    titles = F.filter(F.transform("found", lambda f: f["title"]), lambda t: t != "")
    return kept.select("query_id", F.to_json("found").alias("evidence_json"), F.coalesce(F.get(titles, F.lit(0)), F.lit("")).alias("title"))


def one_candidate(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """The life of evaluation candidates: draft, reviewed once an expected answer is there, promoted once gold has it."""
    filled = F.btrim(F.coalesce("expected_answer", F.lit(""))) != ""
    state = F.when(F.col("_gold"), "promoted").when(filled, "reviewed").otherwise("draft")
    return candidates.join(gold.select("id", F.lit(True).alias("_gold")), "id", "left").withColumn("status", state).drop("_gold")
