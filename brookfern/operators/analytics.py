"""Relational analytics over traces, latency runs, audits and gold sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

STEP = "array<struct<type: string, step: int, tool_name: string, status: string, reason: string, requires_approval: boolean, approved: boolean, success: boolean, tool_source: string, duration_ms: double>>"
RESULT = "array<struct<tool_name: string, success: boolean>>"


def parsed(column: str, schema: str):
    """JSON array, empty where it is null or broken."""
    return F.coalesce(F.from_json(column, schema), F.from_json(F.lit("[]"), schema))


def latency(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, least, greatest and linearly interpolated percentiles of each group."""
    p = lambda q: F.percentile(value, F.lit(q))
    return samples.groupBy(*keys).agg(F.count("*").alias("samples"), F.avg(value).alias("mean_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"))


def stability(samples: DataFrame, run: str, value: str) -> DataFrame:
    """Spread of the runs' means and 95th percentiles."""
    runs = latency(samples, [run], value)
    return runs.agg(F.count("*").alias("runs"), F.sum("samples").alias("samples"), (F.max("mean_ms") - F.min("mean_ms")).alias("mean_spread"), (F.max("p95_ms") - F.min("p95_ms")).alias("p95_spread"))


def tool_audit(traces: DataFrame, tools: DataFrame) -> DataFrame:
    """One row for each guardrail step with the tool call it led to.

    A call of the same tool and step comes first, then the first call of that tool; the success is that of the
    first result of the tool, else of the call.
    """
    rows = traces.select("trace_id", "session_id", parsed("steps_json", STEP).alias("steps"), parsed("tool_results_json", RESULT).alias("results"))
    guards = rows.select("trace_id", "session_id", "steps", "results", F.posexplode("steps").alias("at", "g")).filter("g.type = 'guardrail'")
    calls = F.filter("steps", lambda s: (s["type"] == "tool_call") & (s["tool_name"] == F.col("g.tool_name")))
    exact = F.filter(calls, lambda s: s["step"].eqNullSafe(F.col("g.step")))
    call = F.coalesce(F.get(exact, F.lit(0)), F.get(calls, F.lit(0)))
    result = F.get(F.filter("results", lambda r: r["tool_name"] == F.col("g.tool_name")), F.lit(0))
    joined = guards.withColumn("call", call).withColumn("result", result).withColumn("tool_name", F.coalesce("g.tool_name", F.lit(""))).join(tools.select("tool_name", F.col("source").alias("spec_source")), "tool_name", "left")
    source = F.coalesce("call.tool_source", "spec_source", F.lit("unknown"))
    category = text.tool_category(F.col("tool_name"), source)
    status, asks = F.coalesce("g.status", F.lit("unknown")), F.coalesce("g.requires_approval", F.lit(False))
    return joined.select(
        "trace_id",
        "at",
        "session_id",
        "tool_name",
        source.alias("tool_source"),
        category.alias("tool_category"),
        status.alias("status"),
        asks.alias("requires_approval"),
        F.coalesce("g.approved", F.lit(False)).alias("approved"),
        F.col("call").isNotNull().alias("executed"),
        F.when(F.col("result").isNotNull(), F.coalesce("result.success", F.lit(False))).otherwise(F.col("call.success")).alias("success"),
        text.risk_level(status, category, asks).alias("risk_level"),
        (F.lower(status).isin("deny", "needs_approval") & F.col("call").isNull()).alias("blocked"),
    )


def audit_summary(events: DataFrame) -> DataFrame:
    n = F.count_if
    return events.agg(
        F.count("*").alias("total_count"),
        *(n(F.col("status") == s).alias(f"{s}_count") for s in ("allow", "deny", "needs_approval")),
        *(n(F.col(c)).alias(f"{c}_count") for c in ("approved", "executed", "blocked")),
        *(n(F.col("risk_level") == s).alias(f"{s}_risk_count") for s in ("high", "medium", "low")),
        n(F.col("tool_category").isin("write_file", "delete_file")).alias("write_delete_count"),
    )


def step_counts(traces: DataFrame) -> DataFrame:
    steps = traces.select(F.explode(parsed("steps_json", STEP)).alias("s"))
    return steps.groupBy(F.col("s.type").alias("step_type")).agg(F.count("*").alias("steps"), F.countDistinct("s.tool_name").alias("tools"))


def coverage(docs: DataFrame, gold: DataFrame, least: int = 2, target: int = 3) -> DataFrame:
    """Gold items of each document (key ``label``): how many, whether enough, and which."""
    counted = gold.groupBy("label").agg(F.count("*").alias("items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    joined = docs.join(counted, "label", "left").withColumn("items", F.coalesce("items", F.lit(0)))
    status = F.when(F.col("items") == 0, "missing").when(F.col("items") < least, "undercovered").when(F.col("items") < target, "minimum").otherwise("target")
    return joined.withColumn("status", status).withColumn("needed", F.greatest(F.lit(0), least - F.col("items"))).withColumn("item_ids", F.coalesce(F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ","), F.lit("")))


def unmatched(gold: DataFrame, docs: DataFrame) -> DataFrame:
    return gold.join(docs.select("label").distinct(), "label", "left_anti")


def failure_taxonomy(items: DataFrame, threshold: float = 8.0) -> DataFrame:
    """Failing items by category.  items: id, score, routing_score, citation_score, verified, answer, missing, triggered."""
    lower = F.lower("answer")
    words = F.size(F.filter(F.split("answer", r"\s+"), lambda w: w != ""))
    rules = [
        ("routing", F.col("routing_score") <= 0),
        ("citation", F.col("citation_score") <= 0),
        ("verification", ~F.col("verified")),
        ("raw_context_leak", text.leaks_context(F.col("answer"))),
        ("focus_or_drift", F.col("triggered") > 0),
        ("missing_required_facts", F.col("missing") > 0),
        ("abstention", lower.contains("does not contain enough information")),
        ("too_verbose", words > 180),
    ]
    named = F.filter(F.array(*(F.when(rule, name) for name, rule in rules)), lambda c: c.isNotNull())
    named = F.when(F.size(named) == 0, F.array(F.lit("low_score_uncategorized"))).otherwise(named)
    failing = items.filter((F.col("score") < threshold) | ~F.col("verified"))
    return failing.select("id", F.explode(named).alias("category")).groupBy("category").agg(F.count("*").alias("failures"), F.min("id").alias("first_id"))


def consecutive_distinct(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Rows that differ from the one before them."""
    before = F.lag(column).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_before", before).filter(~F.col(column).eqNullSafe(F.col("_before"))).drop("_before")
