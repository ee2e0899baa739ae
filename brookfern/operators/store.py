"""Relational state: access, search, upserts as folds over append-only logs, summaries, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text


def accessible(df: DataFrame, owner_id: str | None, include_global: bool = True) -> DataFrame:
    if owner_id is None:
        return df
    own = F.col("owner_id") == owner_id
    return df.filter((F.col("visibility") == "global") | own if include_global else own)


def restricted(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """IN-list: None is no restriction, an empty list keeps nothing."""
    if values is None:
        return df
    return df.filter(F.col(column).isin(list(dict.fromkeys(values)))) if values else df.filter(F.lit(False))


def search_documents(docs: DataFrame, query: str, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Title, path or id LIKE %query%, letters of either case; newest first."""
    pattern = f"%{query}%".replace("\\", "\\\\")
    found = docs.filter(F.col("title").ilike(pattern) | F.col("source_path").ilike(pattern) | F.col("doc_id").cast("string").ilike(pattern))
    found = found.orderBy(F.desc("indexed_at"), "doc_id")
    return found.offset(max(0, offset)).limit(min(100, max(1, limit))) if limit is not None else found


def latest(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: max_by is a partial aggregate, so the log is reduced before it is shuffled."""
    rest = [c for c in log.columns if c not in keys]
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row")).select(*keys, "_row.*")


def merged(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: incoming rows replace existing ones that share any of the keys."""
    kept = existing
    for k in keys:
        kept = kept.join(incoming.select(k), k, "left_anti")
    return kept.select(*incoming.columns).unionByName(incoming)


def replaced(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that come in are replaced."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def upserted_memory(log: DataFrame) -> DataFrame:
    """memory log (scope, session_id, kind, content, importance, source, seq): greatest importance, last source."""
    return log.groupBy("scope", "session_id", "kind", "content").agg(F.max("importance").alias("importance"), F.max_by("source", "seq").alias("source"), F.max("seq").alias("updated_seq"))


def memory_in_scope(items: DataFrame, session_id: str) -> DataFrame:
    return items.filter((F.col("scope") == "global") | ((F.col("scope") == "session") & (F.col("session_id") == session_id)))


def folded_feedback(log: DataFrame) -> DataFrame:
    """Feedback log (trace_id, rating, issue_type, seq) to one row a trace: the last rating; a like clears the issue,
    a dislike without one keeps the last since the last like."""
    liked = log.groupBy("trace_id").agg(F.max(F.when(F.col("rating") == "like", F.col("seq"))).alias("liked"), F.max_by("rating", "seq").alias("last_rating"), F.max("seq").alias("last_seq"))
    after = log.join(liked, "trace_id").filter("issue_type is not null and rating = 'dislike' and (liked is null or seq > liked)")
    issue = after.groupBy("trace_id").agg(F.max_by("issue_type", "seq").alias("issue"))
    state = liked.join(issue, "trace_id", "left")
    return state.select("trace_id", F.col("last_rating").alias("rating"), F.when(F.col("last_rating") == "like", "").otherwise(F.coalesce("issue", F.lit(""))).alias("issue_type"), F.col("last_seq").alias("seq"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    count = lambda r: F.count_if(F.col("rating") == r)
    out = feedback.agg(F.count("*").alias("total_count"), count("like").alias("like_count"), count("dislike").alias("dislike_count"), F.max("seq").alias("latest_seq"))
    return out.withColumn("dislike_rate", F.when(F.col("total_count") > 0, F.col("dislike_count") / F.col("total_count")).otherwise(0.0))


def feedback_issues(feedback: DataFrame) -> DataFrame:
    return feedback.filter("rating = 'dislike' and issue_type <> ''").groupBy("issue_type").agg(F.count("*").alias("issue_count"))


def ingestion_summary(status: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_count")
    return status.agg(F.count("*").alias("total_count"), *map(count, ("running", "indexed", "skipped", "failed")))


def recent_turns(turns: DataFrame, limit: int = 6) -> DataFrame:
    """The last turns of each session; ``place`` counts them oldest first."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn_id"))
    kept = turns.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= limit)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("turn_id"))).drop("back")


#: Memory items that a query is ranked against: its most important and newest ones.
MEMORY_POOL = 200


def ranked_memory(items: DataFrame, queries: DataFrame, limit: int = 6) -> DataFrame:
    """Memory items of each query by shared terms, phrases, kind and importance; only positive scores.

    Each session (or the one global scope, if queries have none) offers its ``MEMORY_POOL`` most important and newest items: that
    pool is the operator's limit, and it bounds what a query meets, so one row holds a session's pool."""
    session = ["session_id"] if "session_id" in queries.columns else []
    place = Window.partitionBy(*session) if session else Window.partitionBy(F.lit(0))
    order = [F.desc("importance"), *([F.desc("updated_at")] if "updated_at" in items.columns else []), F.desc("memory_id")]
    held = items.withColumn("m_terms", text.memory_terms(F.col("content")))
    pool = held.withColumn("n", F.row_number().over(place.orderBy(*order))).filter(F.col("n") <= MEMORY_POOL).filter(F.size("m_terms") > 0)
    pools = pool.groupBy(*session).agg(F.collect_list(F.struct("memory_id", "kind", "importance", "content", "m_terms")).alias("pool"))
    asked = queries.select("query_id", *session, F.lower("query").alias("q"), text.memory_terms(F.col("query")).alias("q_terms"))
    words = text.without(F.regexp_extract_all("q", F.lit(r"[a-z][a-z0-9_-]{2,}"), F.lit(0)), text.fixed.MEMORY_STOPS)
    asked = asked.withColumn("phrases", F.slice(F.concat(text.ngrams(words, 3), text.ngrams(words, 2)), 1, 20)).filter(F.size("q_terms") > 0)
    # Without sessions there is one pool of at most MEMORY_POOL items: a single row, read as a subquery.
    met = asked.join(pools, session) if session else asked.withColumn("pool", pools.select("pool").scalar())
    pairs = met.select("query_id", "q", "q_terms", "phrases", F.explode("pool").alias("m")).select("query_id", "q", "q_terms", "phrases", "m.*")
    body = F.lower("content")
    asks = lambda ws: text.any_of(F.col("q"), ws)
    score = (
        F.size(F.array_intersect("q_terms", "m_terms")) * 2.0
        + F.size(F.filter("phrases", lambda p: body.contains(p))) * 3.0
        + F.when(F.col("kind").isin("project_decision", "user_preference"), 1.0).otherwise(0.0)
        + F.when((F.col("kind") == "task_status") & asks(["next", "todo", "remaining", "done"]), 3.0).otherwise(0.0)
        + F.when((F.col("kind") == "evaluation_result") & asks(["eval", "score", "benchmark", "quality"]), 3.0).otherwise(0.0)
        + F.when((F.col("importance") >= 2.0) & asks(["implement", "fix", "optimize", "quality", "rag", "general", "memory", "agent"]), F.col("importance")).otherwise(0.0)
    )
    scored = pairs.withColumn("score", score).filter("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("importance"), F.desc("memory_id"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query_id", "memory_id", "kind", "score", "rank")


def preview(df: DataFrame, limit: int = 20, width: int = 500) -> DataFrame:
    """Rows with long strings cut and binary shown as its size."""
    shown = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f.name)
        if kind == "binary":
            c = F.concat(F.lit("<"), F.length(c).cast("string"), F.lit(" bytes>"))
        elif kind == "string":
            c = F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)
        shown.append(c.alias(f.name))
    return df.select(*shown).limit(min(50, max(1, limit)))


def table_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count): one aggregate a table, as one plan."""
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionAll(one)
    return out
