"""State kept as append-only logs: ingestion runs, sessions, vectors, memory, traces, and who may see them.

Every state is the fold of a log by key (max_by and partial aggregates), so an upsert never rewrites
rows of other keys and a log is reduced before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..sources import files

# Columns that tables gained later, with their types and defaults.
ADDED_COLUMNS = {
    "documents": {"owner_id": ("string", "global"), "visibility": ("string", "global"), "ingestion_status": ("string", "indexed"), "parser_version": ("string", ""), "chunking_version": ("string", ""), "embedding_model": ("string", ""), "chunk_size": ("int", 0), "chunk_overlap": ("int", 0), "chunk_count": ("int", 0), "ingest_started_at": ("timestamp", None), "ingest_completed_at": ("timestamp", None), "last_ingest_error": ("string", "")},
    "chunks": {"section_title": ("string", None)},
    "answer_feedback": {"issue_type": ("string", ""), "source": ("string", "web")},
}
# The issues that a dislike may name, and the longest error that is kept.
ISSUES = ["wrong_answer", "missing_information", "bad_citation", "too_long", "off_topic", "other"]
ERROR_WIDTH = 2000


def evolved(df: DataFrame, table: str) -> DataFrame:
    """``df`` with every column that its table gained later: missing ones get their default, nulls too where there is one."""
    for name, (kind, default) in ADDED_COLUMNS[table].items():
        value = F.lit(default).cast(kind)
        if name not in df.columns:
            df = df.withColumn(name, value)
        elif default is not None:
            df = df.withColumn(name, F.coalesce(F.col(name).cast(kind), value))
    return df


def upserted_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming documents replace those of their doc_id or source_path, but keep when these were first begun.

    Both: doc_id, source_path, indexed_at, ingest_started_at and others."""
    begun = lambda key: existing.select(key, F.col("ingest_started_at").alias(f"_{key}")).groupBy(key).agg(F.min(f"_{key}").alias(f"_{key}"))
    merged = incoming.join(begun("doc_id"), "doc_id", "left").join(begun("source_path"), "source_path", "left")
    merged = merged.withColumn("ingest_started_at", F.coalesce("_doc_id", "_source_path", "ingest_started_at"))
    kept = existing.join(incoming.select("doc_id"), "doc_id", "left_anti").join(incoming.select("source_path"), "source_path", "left_anti")
    return kept.select(*incoming.columns).unionByName(merged.select(*incoming.columns))


def ingestion_state(log: DataFrame) -> DataFrame:
    """Log (source_path, seq, event, at, error; event: started, completed, skipped or failed) to one row a path.

    A start clears the end and the error of the run before; an error is one line of at most ``ERROR_WIDTH`` characters."""
    started = F.when(F.col("event") == "started", F.col("seq"))
    ended = F.when(F.col("event") != "started", F.col("seq"))
    flat = F.substring(text.squeeze(F.coalesce("error", F.lit(""))), 1, ERROR_WIDTH)
    folded = log.groupBy("source_path").agg(
        F.max(started).alias("begun"),
        F.max_by("at", started).alias("started_at"),
        F.max(ended).alias("over"),
        F.max_by("at", ended).alias("ended_at"),
        F.max_by("event", ended).alias("end"),
        F.max_by(flat, ended).alias("why"),
    )
    running = F.col("over").isNull() | (F.col("begun") > F.col("over"))
    status = F.when(running, "running").when(F.col("end") == "completed", "indexed").otherwise(F.col("end"))
    return folded.select(
        "source_path",
        status.alias("status"),
        "started_at",
        F.when(~running, F.col("ended_at")).alias("completed_at"),
        F.when(~running & (F.col("end") == "failed"), F.col("why")).otherwise("").alias("error"),
    )


def ingestion_list(state: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """Runs of one status, the last touched first."""
    found = state if status is None else state.filter(F.col("status") == status)
    return found.orderBy(F.coalesce("completed_at", "started_at").desc(), "source_path").limit(min(200, max(1, limit)))


def sessions(turns: DataFrame) -> DataFrame:
    """Turns (session_id, turn_id, at) to one row a session: created by its first turn, updated by its last."""
    return turns.groupBy("session_id").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.max("turn_id").alias("last_turn"))


def appended_turns(turns: DataFrame, fresh: DataFrame) -> DataFrame:
    """``turns`` and ``fresh`` (session_id, role, content, at), numbered on from each session's last turn in order of time."""
    last = turns.groupBy("session_id").agg(F.max("turn_id").alias("_last"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("at", "role", "content"))
    added = fresh.join(last, "session_id", "left").withColumn("turn_id", F.coalesce("_last", F.lit(0)) + place)
    return turns.unionByName(added.select(*turns.columns))


VECTORS = T.StructType([T.StructField("point_id", T.LongType()), T.StructField("doc_id", T.StringType()), T.StructField("chunk_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def collection(spark: SparkSession, path: str) -> DataFrame:
    """The vectors stored at ``path``, which is made if it is not there."""
    if not files.exists(spark, path):
        spark.createDataFrame([], VECTORS).write.parquet(path)
    return spark.read.schema(VECTORS).parquet(path)


def upserted_points(points: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming points replace those of their id; one of another width than the collection is refused."""
    width = points.agg(F.max(F.size("embedding")).alias("w")).select("w").scalar()
    fits = F.coalesce(F.size("embedding") == width, F.lit(True))
    checked = incoming.withColumn("embedding", F.when(fits, F.col("embedding")).otherwise(F.raise_error(F.lit("a vector of another width"))))
    return points.join(incoming.select("point_id"), "point_id", "left_anti").unionByName(checked.select(*points.columns))


def without_documents(points: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return points.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def touched_memory(items: DataFrame, accesses: DataFrame, deletions: DataFrame) -> DataFrame:
    """Items (memory_id, ...) that were not deleted, with how often and when last they were read."""
    read = accesses.groupBy("memory_id").agg(F.count("*").alias("access_count"), F.max("at").alias("last_accessed_at"))
    left = items.join(deletions.select("memory_id").distinct(), "memory_id", "left_anti")
    return left.join(read, "memory_id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)))


def deleted_memory(items: DataFrame, deletions: DataFrame) -> DataFrame:
    """What a deletion returns: the items that it found."""
    return items.join(deletions.select("memory_id").distinct(), "memory_id", "left_semi")


def trace_rows(runs: DataFrame) -> DataFrame:
    """Runs (trace_id, session_id, query, top_k, retrieved, final_answer, steps, tool_results, verification) as rows with four JSON columns."""
    encoded = {"retrieved": "[]", "steps": "[]", "tool_results": "[]", "verification": "{}"}
    columns = [F.coalesce(F.to_json(c), F.lit(empty)).alias(f"{c}_json") for c, empty in encoded.items()]
    return runs.select("trace_id", F.coalesce("session_id", F.lit("default")).alias("session_id"), "query", "top_k", "final_answer", *columns)


def trace_detail(traces: DataFrame, trace_id: int) -> DataFrame:
    return traces.filter(F.col("trace_id") == trace_id)


def trace_audit(traces: DataFrame, session_id: str | None = None, limit: int = 200) -> DataFrame:
    """The newest traces with what an audit reads."""
    found = traces if session_id is None else traces.filter(F.col("session_id") == session_id)
    return found.orderBy(F.desc("trace_id")).limit(min(200, max(1, limit))).select("trace_id", "session_id", "query", "steps_json", "tool_results_json")


def accepted_feedback(log: DataFrame, traces: DataFrame, issues: list[str] = ISSUES) -> DataFrame:
    """Feedback on traces that exist, with a rating of like or dislike and no unknown issue."""
    known = F.coalesce("issue_type", F.lit(""))
    return log.filter(F.col("rating").isin("like", "dislike") & ((known == "") | known.isin(issues))).join(traces.select("trace_id"), "trace_id", "left_semi")


def visibility(raw: Column) -> Column:
    """global or user; anything else is refused."""
    flat = F.lower(text.squeeze(F.coalesce(raw, F.lit("global"))))
    return F.when(flat.isin("global", "user"), flat).otherwise(F.raise_error(F.concat(F.lit("unknown visibility "), flat)))


def may_see(df: DataFrame, who: DataFrame, scoped: bool = False) -> DataFrame:
    """``df`` with user_id: once for each identity (user_id, session_id, enabled) that may see a row.

    An identity sees the rows of its session; one that is not enabled sees all, and rows of scope global are seen by all
    where ``scoped``.  ``who`` is the identities of one request or batch of them, which bounds what a row is repeated for."""
    bound = who.filter("enabled").select("user_id", "session_id")
    own = df.join(bound, "session_id")
    ids = lambda kept: who.agg(F.array_sort(F.collect_set(F.when(kept, F.col("user_id")))).alias("ids")).select("ids").scalar()
    out = own.unionByName(df.withColumn("user_id", F.explode(ids(~F.col("enabled")))).select(*own.columns))
    if scoped:
        out = out.unionByName(df.filter("scope = 'global'").withColumn("user_id", F.explode(ids(F.lit(True)))).select(*own.columns)).distinct()
    return out


def candidates_seen(candidates: DataFrame, traces: DataFrame, who: DataFrame) -> DataFrame:
    """Evaluation candidates that an identity may see: those of its session's traces."""
    owned = traces.select("trace_id", "session_id").join(who.filter("enabled").select("user_id", "session_id"), "session_id")
    return candidates.join(owned.select("trace_id", "user_id"), "trace_id")


def ordered_memory(durable: DataFrame, session: DataFrame) -> DataFrame:
    """Durable items and then those of the session, in one numbered list a session."""
    both = durable.withColumn("part", F.lit(0)).unionByName(session.withColumn("part", F.lit(1)))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("part", F.desc("importance"), "memory_id")))


def utc_text(at: Column) -> Column:
    """A time as ISO 8601 text in UTC, to the second."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
