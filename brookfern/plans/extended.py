"""Queries of stored state, reports, sources and tools, context expansion, answers and their verification."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions import sentences as st
from ..session import materialized, shared_folder
from ..operators import answering, backends, cleaning, ingest, reports, retrieval, state, store, tools
from ..sources import files
from ..sources import fixtures as fx
from .registry import _ANCHORS, _ASKED, _CHUNKS, _DOCS, _EVIDENCE, _GENERIC, _TURNS, _anchors, _evidence, _has, _six, query


def _events(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "events")


# Stored state


@query(f"WITH {_DOCS} SELECT doc_id, CASE WHEN doc_no % 2 = 0 THEN owner_id ELSE 'global' END AS owner_id, 'global' AS visibility, 'indexed' AS ingestion_status, 0 AS chunk_count, '' AS last_ingest_error FROM docs")
def schema_evolution(spark, sf_dir):
    """Documents of an older table, without the columns that came later and with nulls in one."""
    old = fx.documents(spark, sf_dir).select("doc_id", "source_path", F.expr("if(doc_no % 2 = 0, owner_id, null)").alias("owner_id"))
    return state.evolved(old, "documents").select("doc_id", "owner_id", "visibility", "ingestion_status", "chunk_count", "last_ingest_error")


@query(f"WITH {_DOCS} SELECT doc_id, source_path, CASE WHEN doc_no % 3 = 0 THEN doc_no + 1000 ELSE doc_no END AS indexed_at, CASE WHEN doc_no % 3 = 0 AND doc_no % 2 <> 0 THEN doc_no + 500 ELSE doc_no END AS ingest_started_at FROM docs WHERE doc_no % 2 = 0 OR doc_no % 3 = 0")
def document_upsert_times(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    old = docs.filter("doc_no % 2 = 0").selectExpr("doc_id", "source_path", "doc_no as indexed_at", "doc_no as ingest_started_at")
    new = docs.filter("doc_no % 3 = 0").selectExpr("doc_id", "source_path", "doc_no + 1000 as indexed_at", "doc_no + 500 as ingest_started_at")
    return state.upserted_documents(old, new)


_RUNS = """runs AS (SELECT 'f' || (user_id % 200)::VARCHAR AS source_path, event_id AS seq, CASE event_type WHEN 'click' THEN 'started' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'completed' ELSE 'skipped' END AS event, event_id * 10 AS tick, event_type || '   at ' || event_id::VARCHAR AS error FROM events),
folded AS (SELECT source_path, max(seq) FILTER (WHERE event = 'started') AS begun, arg_max(tick, seq) FILTER (WHERE event = 'started') AS started_at, max(seq) FILTER (WHERE event <> 'started') AS over, arg_max(tick, seq) FILTER (WHERE event <> 'started') AS ended_at, arg_max(event, seq) FILTER (WHERE event <> 'started') AS ending, arg_max(error, seq) FILTER (WHERE event <> 'started') AS why FROM runs GROUP BY source_path),
state AS (SELECT source_path, CASE WHEN over IS NULL OR coalesce(begun, -1) > over THEN 'running' WHEN ending = 'completed' THEN 'indexed' ELSE ending END AS status, started_at, CASE WHEN over IS NULL OR coalesce(begun, -1) > over THEN NULL ELSE ended_at END AS completed_at,
  CASE WHEN NOT (over IS NULL OR coalesce(begun, -1) > over) AND ending = 'failed' THEN regexp_replace(why, '\\s+', ' ', 'g') ELSE '' END AS error FROM folded)"""


def _runs(spark, sf_dir) -> DataFrame:
    event = "case event_type when 'click' then 'started' when 'error' then 'failed' when 'view' then 'completed' else 'skipped' end as event"
    log = _events(spark, sf_dir).selectExpr("concat('f', user_id % 200) as source_path", "event_id as seq", event, "event_id * 10 as at", "concat(event_type, '   at ', event_id) as error")
    return state.ingestion_state(log)


@query(f"WITH {_RUNS} SELECT * FROM state")
def ingestion_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(f"WITH {_RUNS} SELECT source_path, status, coalesce(completed_at, started_at) AS touched FROM state WHERE status = 'failed' ORDER BY touched DESC, source_path LIMIT 20")
def ingestion_failed(spark, sf_dir):
    found = state.ingestion_list(_runs(spark, sf_dir), "failed", 20)
    return found.select("source_path", "status", F.coalesce("completed_at", "started_at").alias("touched"))


@query(f"WITH {_TURNS} SELECT session_id, min(turn_id * 60) AS created_at, max(turn_id * 60) AS updated_at, max(turn_id) AS last_turn FROM turns GROUP BY session_id")
def session_upsert(spark, sf_dir):
    return state.sessions(fx.turns(spark, sf_dir).withColumn("at", F.col("turn_id") * 60))


@query(f"WITH {_TURNS}, lasts AS (SELECT session_id, max(turn_id) AS l FROM turns GROUP BY session_id), fresh AS (SELECT session_id, turn_id * 60 + 9000 AS tick, role FROM turns WHERE role = 'user') SELECT session_id, turn_id, role, turn_id * 60 AS tick FROM turns UNION ALL SELECT session_id, l + row_number() OVER (PARTITION BY session_id ORDER BY tick) AS turn_id, role, tick FROM fresh JOIN lasts USING (session_id)")
def turn_append(spark, sf_dir):
    turns = fx.turns(spark, sf_dir).select("session_id", "turn_id", "role", "content", (F.col("turn_id") * 60).alias("at"))
    fresh = turns.filter("role = 'user'").select("session_id", "role", "content", (F.col("at") + 9000).alias("at"))
    return state.appended_turns(turns, fresh).select("session_id", F.col("turn_id").cast("long").alias("turn_id"), "role", F.col("at").cast("long").alias("tick"))


@query("SELECT vec_id AS point_id, 'd' || (vec_id % 40)::VARCHAR AS doc_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS chunk_id FROM embeddings WHERE (vec_id % 3 = 0 OR vec_id % 2 = 0) AND vec_id % 40 <> 7")
def vector_upsert(spark, sf_dir):
    points = lambda n, mark: fx.table(spark, sf_dir, "embeddings").filter(f"vec_id % {n} = 0").selectExpr("vec_id as point_id", "concat('d', vec_id % 40) as doc_id", f"'{mark}' as chunk_id", "embedding")
    whole = state.upserted_points(points(2, "old"), points(3, "new"))
    gone = spark.createDataFrame([("d7",)], "doc_id string")
    return state.without_documents(whole, gone).select("point_id", "doc_id", "chunk_id")


@query("SELECT o_orderkey AS memory_id, o_totalprice AS importance, coalesce(access_count, 0) AS access_count, last_accessed_at FROM orders LEFT JOIN (SELECT user_id AS o_orderkey, count(*) AS access_count, max(event_id) AS last_accessed_at FROM events GROUP BY user_id) USING (o_orderkey) WHERE o_orderkey NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def memory_touch(spark, sf_dir):
    items = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey as memory_id", "o_totalprice as importance")
    events = _events(spark, sf_dir)
    return state.touched_memory(items, events.selectExpr("user_id as memory_id", "event_id as at"), events.filter("event_type = 'error'").selectExpr("event_id as memory_id"))


@query("SELECT o_orderkey AS memory_id FROM orders WHERE o_orderkey IN (SELECT event_id FROM events WHERE event_type = 'error')")
def memory_delete(spark, sf_dir):
    items = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey as memory_id")
    return state.deleted_memory(items, _events(spark, sf_dir).filter("event_type = 'error'").selectExpr("event_id as memory_id"))


@query("""SELECT event_id AS trace_id, CASE WHEN event_id % 5 = 0 THEN 'default' ELSE 's' || user_id::VARCHAR END AS session_id, event_type AS query, '[{"rank":1,"doc_id":' || user_id::VARCHAR || '}]' AS retrieved_json, CASE WHEN event_id % 2 = 0 THEN '[]' ELSE '["plan","' || event_type || '"]' END AS steps_json, '[]' AS tool_results_json, '{"status":"verified"}' AS verification_json FROM events""")
def trace_append(spark, sf_dir):
    retrieved = F.array(F.struct(F.lit(1).alias("rank"), F.col("user_id").alias("doc_id"))).alias("retrieved")
    steps = F.when(F.col("event_id") % 2 == 1, F.array(F.lit("plan"), "event_type")).alias("steps")
    runs = _events(spark, sf_dir).select(F.col("event_id").alias("trace_id"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("s"), "user_id")).alias("session_id"), F.col("event_type").alias("query"), F.lit(5).alias("top_k"), retrieved, F.lit("").alias("final_answer"), steps, F.lit(None).cast("array<string>").alias("tool_results"), F.struct(F.lit("verified").alias("status")).alias("verification"))
    return state.trace_rows(runs).select("trace_id", "session_id", "query", "retrieved_json", "steps_json", "tool_results_json", "verification_json")


@query("SELECT event_id AS trace_id, 's' || user_id::VARCHAR AS session_id, event_type AS query FROM events ORDER BY event_id DESC LIMIT 200")
def trace_audit_list(spark, sf_dir):
    return state.trace_audit(fx.traces(spark, sf_dir), limit=1000).select("trace_id", "session_id", "query")


@query("SELECT event_id AS trace_id, event_type AS query, value AS latency_ms FROM events WHERE event_id = 17")
def trace_detail(spark, sf_dir):
    return state.trace_detail(fx.traces(spark, sf_dir), 17).select("trace_id", "query", "latency_ms")


@query("SELECT event_id AS seq, user_id AS trace_id, event_type AS rating, issue_type FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'other' WHEN 1 THEN '' WHEN 2 THEN 'unheard_of' END AS issue_type FROM events) WHERE event_type IN ('click', 'view') AND (coalesce(issue_type, '') IN ('', 'other')) AND user_id IN (SELECT event_id FROM events WHERE event_id % 2 = 0)")
def feedback_accepted(spark, sf_dir):
    issue = "case event_id % 4 when 0 then 'other' when 1 then '' when 2 then 'unheard_of' end as issue_type"
    log = _events(spark, sf_dir).selectExpr("event_id as seq", "user_id as trace_id", "event_type", "case event_type when 'click' then 'like' when 'view' then 'dislike' else 'other' end as rating", issue)
    known = _events(spark, sf_dir).filter("event_id % 2 = 0").selectExpr("event_id as trace_id")
    return state.accepted_feedback(log, known).select("seq", "trace_id", F.col("event_type").alias("rating"), "issue_type")


@query("SELECT c_custkey, CASE WHEN trim(c_name) = '' THEN 'global' ELSE substr(regexp_replace(trim(c_name || '  ' || c_mktsegment), '\\s+', ' ', 'g'), 1, 80) END AS owner_id, CASE WHEN c_custkey % 2 = 0 THEN 'user' ELSE 'global' END AS visibility FROM customer")
def owner_normalise(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat(c_name, '  ', c_mktsegment) as raw", "if(c_custkey % 2 = 0, ' USER', null) as seen")
    return rows.select("c_custkey", text.owner(F.col("raw")).alias("owner_id"), state.visibility(F.col("seen")).alias("visibility"))


_WHO = [("ada", "s3", True), ("bob", "s7", True), ("root", "s0", False)]
_WHO_SQL = "who AS (SELECT * FROM (VALUES ('ada', 's3', true), ('bob', 's7', true), ('root', 's0', false)) AS w(user_id, session_id, enabled))"


@query(f"WITH {_WHO_SQL}, t AS (SELECT event_id AS trace_id, 's' || user_id::VARCHAR AS session_id, CASE WHEN event_id % 9 = 0 THEN 'global' ELSE 'session' END AS scope FROM events) SELECT trace_id, user_id FROM t, who WHERE NOT enabled OR who.session_id = t.session_id OR scope = 'global'")
def access_by_identity(spark, sf_dir):
    who = spark.createDataFrame(_WHO, "user_id string, session_id string, enabled boolean")
    rows = _events(spark, sf_dir).selectExpr("event_id as trace_id", "concat('s', user_id) as session_id", "if(event_id % 9 = 0, 'global', 'session') as scope")
    return state.may_see(rows, who, scoped=True).select("trace_id", "user_id")


@query(f"WITH {_TURNS}, d AS (SELECT session_id, turn_id AS memory_id, 0 AS part, 1.0 + turn_id % 3 AS importance FROM turns WHERE role = 'assistant'), s AS (SELECT session_id, turn_id AS memory_id, 1 AS part, 1.0 + turn_id % 2 AS importance FROM turns WHERE role = 'user') SELECT session_id, memory_id, part, row_number() OVER (PARTITION BY session_id ORDER BY part, importance DESC, memory_id) AS place FROM (SELECT * FROM d UNION ALL SELECT * FROM s)")
def memory_union(spark, sf_dir):
    rows = lambda role, n: fx.turns(spark, sf_dir).filter(f"role = '{role}'").selectExpr("session_id", "turn_id as memory_id", f"1.0 + turn_id % {n} as importance")
    return state.ordered_memory(rows("assistant", 3), rows("user", 2)).select("session_id", "memory_id", "part", F.col("place").cast("long").alias("place"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM events")
def utc_times(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", state.utc_text(F.col("ts").cast("timestamp")).alias("at"))


_PLAN = f"""WITH {_DOCS}, have AS (SELECT source_path, CASE WHEN doc_no % 4 = 0 THEN 'x' || doc_id ELSE doc_id END AS old, owner_id, visibility, CASE WHEN doc_no % 5 = 0 THEN 'old' ELSE checksum END AS checksum FROM docs WHERE doc_no % 7 <> 0),
j AS (SELECT d.doc_id, d.checksum, h.* EXCLUDE (checksum), h.checksum AS had FROM docs d LEFT JOIN have h USING (source_path)),
a AS (SELECT doc_id, old, owner_id, visibility, CASE WHEN old IS NULL THEN 'new' WHEN NOT (visibility = 'global' OR owner_id = 'user1') THEN 'refuse' WHEN had = checksum THEN 'skip' ELSE 'replace' END AS action FROM j)
SELECT doc_id, action, coalesce(owner_id, 'user1') AS owner_id, coalesce(visibility, 'user') AS visibility, CASE WHEN action = 'replace' AND old <> doc_id THEN old END AS old_doc_id FROM a"""


def _ingestion_plan(spark, sf_dir) -> DataFrame:
    same = {"parser_version": F.lit("1"), "chunking_version": F.lit("1"), "embedding_model": F.lit("hash"), "chunk_size": F.lit(900), "chunk_overlap": F.lit(120)}
    docs = fx.documents(spark, sf_dir).withColumns(same)
    have = docs.filter("doc_no % 7 <> 0").selectExpr("source_path", "if(doc_no % 4 = 0, concat('x', doc_id), doc_id) as doc_id", "owner_id", "visibility", "if(doc_no % 5 = 0, 'old', checksum) as checksum", *same, "3 as chunk_count", "'indexed' as ingestion_status")
    incoming = docs.select("doc_id", "source_path", "checksum", *same, F.lit("user1").alias("owner_id"), F.lit("user").alias("visibility"))
    return ingest.ingestion_plan(incoming, have)


@query(_PLAN)
def ingestion_plan(spark, sf_dir):
    return _ingestion_plan(spark, sf_dir).select("doc_id", "action", "owner_id", "visibility", "old_doc_id")


# Predicates and joins


@query(f"WITH {_CHUNKS} SELECT chunk_id FROM chunks WHERE text ILIKE '%benchmark%' OR text ILIKE '%thing%' OR text ILIKE '%erre%'")
def term_scan(spark, sf_dir):
    patterns = ["%benchmark%", "%thing%", "%erre%"]
    return fx.chunks(spark, sf_dir).filter(" or ".join(f"text ilike '{p}'" for p in patterns)).select("chunk_id")


@query(f"WITH {_CHUNKS}, {_DOCS.replace('docs AS', 'd2 AS')} SELECT c.chunk_id, d.title, c.page_number, d.owner_id FROM chunks c JOIN d2 d USING (doc_id) WHERE (d.visibility = 'global' OR d.owner_id = 'user1') AND d.doc_no % 4 = 0")
def chunks_of_documents(spark, sf_dir):
    docs = store.accessible(fx.documents(spark, sf_dir), "user1").filter("doc_no % 4 = 0").select("doc_id", "owner_id")
    return fx.chunks(spark, sf_dir).join(docs, "doc_id").orderBy("title", "page_number", "chunk_index").select("chunk_id", "title", "page_number", "owner_id")


@query(f"WITH {_DOCS} SELECT count(*) AS documents FROM docs WHERE (title ILIKE '%src1%' OR source_path ILIKE '%src1%' OR doc_id ILIKE '%src1%') AND (visibility = 'global' OR owner_id = 'user1')")
def count_documents(spark, sf_dir):
    return store.search_documents(store.accessible(fx.documents(spark, sf_dir), "user1"), "src1", None).agg(F.count("*").alias("documents"))


@query(f"WITH {_DOCS}, f AS (SELECT upper(source_path) AS path FROM docs WHERE doc_no % 2 = 0 UNION ALL SELECT 'raw/' || doc_id || '.pdf' FROM docs WHERE doc_no % 5 = 0) SELECT path, doc_id FROM f LEFT JOIN docs ON lower(path) = lower(source_path)")
def raw_file_match(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    raw = docs.filter("doc_no % 2 = 0").selectExpr("upper(source_path) as path").unionAll(docs.filter("doc_no % 5 = 0").selectExpr("concat('raw/', doc_id, '.pdf') as path"))
    return reports.raw_files(raw, docs).select("path", "doc_id")


@query("SELECT b.item_id AS id, coalesce(d.lang, '') AS answer FROM benchmark b LEFT JOIN (SELECT doc_id AS item_id, lang FROM documents WHERE doc_id % 2 = 0) d USING (item_id)")
def gold_predictions(spark, sf_dir):
    gold = fx.table(spark, sf_dir, "benchmark").selectExpr("item_id as id")
    found = fx.table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").selectExpr("doc_id as id", "lang as answer")
    return reports.with_predictions(gold, found)


_HEADINGS = r"^\d+(\.\d+)*\.?\s+[A-Z]"


@query(rf"""WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line FROM a UNION ALL SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(ls[1], '[^A-Za-z ]', '', 'g'), ' ')[1:6], lambda w: upper(w[1]) || lower(w[2:])), ' ') FROM a), f AS (SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g')) AS flat FROM l), w AS (SELECT *, string_split(flat, ' ') AS words FROM f),
b AS (SELECT *, flat <> '' AND (regexp_matches(flat, '(?i){"|".join(f"(?:{p})" for p in fixed.BOILERPLATE)}') OR (contains(flat, ' | by ') AND length(flat) > 90)) AS boiler FROM w)
SELECT doc_id, flat AS heading FROM b WHERE flat <> '' AND length(flat) <= 120 AND NOT boiler AND (regexp_matches(flat, '{_HEADINGS}') OR (len(words) <= 12 AND NOT flat LIKE '%.' AND len(list_filter(words, lambda x: regexp_matches(x, '^[A-Z0-9]'))) >= greatest(1.0, len(words) / 2.0)))""")
def heading_lines(spark, sf_dir):
    """Headings among the lines of documents and the first words of each, written as a title."""
    own = fx.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.split("text", "\n").alias("ls"))
    made = F.array_join(F.transform(F.slice(F.split(F.regexp_replace(F.col("ls")[0], "[^A-Za-z ]", ""), " "), 1, 6), F.initcap), " ")
    lines = own.select("doc_id", F.explode("ls").alias("line")).unionAll(own.select("doc_id", made))
    return lines.filter(text.is_heading(F.col("line"))).select("doc_id", text.squeeze(F.col("line")).alias("heading"))


@query(f"WITH {_TURNS} SELECT session_id, turn_id, {_has('lower(content)', fixed.LEAK_MARKERS)} AS verifier_leak, {_has('lower(content)', fixed.ANSWER_LEAK_MARKERS)} AS answer_leak FROM turns")
def leak_variants(spark, sf_dir):
    low = F.lower("content")
    return fx.turns(spark, sf_dir).select("session_id", "turn_id", text.any_of(low, fixed.LEAK_MARKERS).alias("verifier_leak"), text.any_of(low, fixed.ANSWER_LEAK_MARKERS).alias("answer_leak"))


@query(_EVIDENCE + ", k AS (SELECT query_id, rank, chunk_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS tk FROM items), f AS (SELECT *, first_value(tk) OVER (PARTITION BY query_id ORDER BY rank) AS ft FROM k) SELECT query_id, rank, chunk_id FROM f WHERE ft = '' OR tk = ft")
def single_source(spark, sf_dir):
    return answering.single_source(_evidence(spark, sf_dir)).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id")


@query(_EVIDENCE + ", parts AS (SELECT query_id, chunk_id, rank, 0 AS segment FROM items WHERE rank <= 3 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM items WHERE rank % 4 = 0 UNION ALL SELECT query_id, chunk_id, rank, 2 FROM items), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY segment, rank) AS n FROM parts) WHERE n = 1) SELECT query_id, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY segment, rank) AS place FROM once) WHERE place <= 8")
def evidence_union(spark, sf_dir):
    """The first three items, then the chosen ones, then all, each once, eight in all."""
    items = _evidence(spark, sf_dir).select("query_id", "chunk_id", "rank")
    union = retrieval.ordered_union([items.filter("rank <= 3"), items.filter("rank % 4 = 0"), items], ["query_id", "chunk_id"], "rank")
    top = retrieval.ranked(union, ["query_id"], [F.col("segment"), F.col("rank")], 8, "place")
    return top.select("query_id", "chunk_id", F.col("place").cast("long").alias("place"))


# Reports


@query("SELECT event_type, max_by(event_id, (value, event_id)) AS event_id, max(value) AS value FROM events GROUP BY event_type")
def slowest_samples(spark, sf_dir):
    return reports.slowest(_events(spark, sf_dir), ["event_type"], "value", "event_id")


@query("SELECT CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS path, count(*) AS samples FROM events GROUP BY 1")
def path_counts(spark, sf_dir):
    return reports.path_counts(_events(spark, sf_dir).selectExpr("nullif(event_type, 'error') as path"))


@query("SELECT count(*) AS documents, count(*) FILTER (WHERE o_orderstatus = 'F') AS missing_count, count(*) FILTER (WHERE o_orderstatus = 'O') AS undercovered_count, count(*) FILTER (WHERE o_orderstatus = 'P') AS minimum_count, 0 AS target_count, sum(o_orderkey % 3)::BIGINT AS needed, sum(o_orderkey % 4)::BIGINT AS items FROM orders")
def coverage_summary(spark, sf_dir):
    status = "case o_orderstatus when 'F' then 'missing' when 'O' then 'undercovered' when 'P' then 'minimum' end as status"
    return reports.coverage_summary(fx.table(spark, sf_dir, "orders").selectExpr(status, "o_orderkey % 3 as needed", "o_orderkey % 4 as items"))


@query("SELECT event_type AS suite, printf('%.2f', avg(event_id % 11))::DOUBLE AS average, count(*) FILTER (WHERE event_id % 11 >= 8) AS pass_count, count(*) AS total_count FROM events GROUP BY event_type")
def report_rollup(spark, sf_dir):
    return reports.rollup(_events(spark, sf_dir).selectExpr("event_type as suite", "event_id % 11 as score"), ["suite"])


@query("SELECT event_id, printf('%.2f', value / 3)::DOUBLE AS rounded FROM events")
def round_two_places(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", reports.rounded(F.col("value") / 3).alias("rounded"))


@query("SELECT o_orderpriority AS category, count(*) AS failures, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS items FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def taxonomy_items(spark, sf_dir):
    return reports.taxonomy_items(fx.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").selectExpr("o_orderpriority as category", "o_orderkey as id"))


@query("""WITH r AS (SELECT event_type AS phase, avg(value) FILTER (WHERE event_id % 3 = 0) AS cold_ms, avg(value) FILTER (WHERE event_id % 3 <> 0) AS warm_ms, quantile_cont(CASE WHEN event_id % 3 <> 0 THEN value END, 0.95) AS p95_ms FROM events GROUP BY event_type)
SELECT phase, round(cold_ms, 6) AS cold_ms, round(warm_ms, 6) AS warm_ms, round(p95_ms, 6) AS p95_ms, round(cold_ms - warm_ms, 6) AS saved_ms, CASE WHEN warm_ms <= cold_ms * 0.5 THEN 'keep_cache' ELSE 'check_cache' END || CASE WHEN p95_ms > 1000 THEN ',slow' ELSE '' END AS advice FROM r""")
def profile_recommendations(spark, sf_dir):
    runs = _events(spark, sf_dir).selectExpr("event_type as phase", "event_id % 3 <> 0 as warm", "value as ms")
    return _six(reports.profile_recommendations(runs), "cold_ms", "warm_ms", "p95_ms", "saved_ms")


@query(f"WITH {_TURNS}, g AS (SELECT session_id, turn_id, list_filter([list_filter([trim(regexp_replace(role || '  x', '\\s+', ' ', 'g')), ''], lambda x: x <> ''), list_filter(['', ' '], lambda x: trim(x) <> ''), list_filter([trim(substr(regexp_extract(content, '^\\S+'), 1, 9))], lambda x: x <> '')], lambda l: len(l) > 0) AS kept FROM turns) SELECT session_id, turn_id, len(kept) AS n, array_to_string(flatten(kept), '|') AS cleaned FROM g")
def requirement_cleaning(spark, sf_dir):
    first = F.substring(F.regexp_extract("content", r"^\S+", 0), 1, 9)
    raw = F.array(F.array(F.concat("role", F.lit("  x")), F.lit("")), F.array(F.lit(""), F.lit(" ")), F.array(first))
    rows = fx.turns(spark, sf_dir).select("session_id", "turn_id", reports.cleaned_requirements(raw).alias("kept"))
    return rows.select("session_id", "turn_id", F.size("kept").cast("long").alias("n"), F.array_join(F.flatten("kept"), "|").alias("cleaned"))


@query("SELECT event_id AS id, event_type AS question, CASE WHEN event_id % 5 = 0 THEN 'promoted' WHEN event_id % 2 = 0 THEN 'reviewed' ELSE 'draft' END AS status FROM events")
def candidate_states(spark, sf_dir):
    rows = _events(spark, sf_dir).selectExpr("event_id as id", "event_type as question", "if(event_id % 2 = 0, 'yes', ' ') as expected_answer", "'draft' as status")
    gold = _events(spark, sf_dir).filter("event_id % 5 = 0").selectExpr("event_id as id")
    return reports.one_candidate(rows, gold).select("id", "question", "status")


# Text functions


@query(rf"WITH {_ASKED}, w AS (SELECT query_id, list_filter(regexp_extract_all(query, '[A-Za-z][A-Za-z0-9_-]{{3,}}'), lambda x: (regexp_matches(x, '[A-Z]') OR length(x) >= 8)) AS ws FROM asked) SELECT query_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(ws, lambda x: lower(x)), lambda x: NOT list_contains([{', '.join(f"'{x}'" for x in fixed.FOCUS_GENERIC)}], x)))), ',') AS terms FROM w")
def focus_terms(spark, sf_dir):
    return fx.questions(spark, sf_dir).select("query_id", F.array_join(text.focus_terms(F.col("query")), ",").alias("terms"))


@query(rf"WITH {_ASKED}, p AS (SELECT query_id, string_split(query, ' ') AS qw FROM asked), r AS (SELECT query_id, lower(qw[3]) AS a, lower(qw[4]) AS b, regexp_full_match(qw[3], '[A-Z][A-Za-z0-9_]*') AND regexp_full_match(qw[4], '[A-Z][A-Za-z0-9_]*') AND NOT list_contains([{_GENERIC}], lower(qw[3])) AND NOT list_contains([{_GENERIC}], lower(qw[4])) AS named FROM p) SELECT query_id, CASE WHEN NOT named THEN '' WHEN b LIKE '%s' AND length(b) > 4 THEN a || ' ' || left(b, length(b) - 1) || ',' || a || ' ' || b ELSE a || ' ' || b END AS phrases FROM r")
def focus_phrases(spark, sf_dir):
    return fx.questions(spark, sf_dir).select("query_id", F.array_join(text.focus_phrases(F.col("query")), ",").alias("phrases"))


@query(rf"WITH {_TURNS}, c AS (SELECT session_id, turn_id, regexp_replace(trim(regexp_replace(CASE WHEN turn_id % 2 = 0 THEN 'Please  ' ELSE ' - ' END || content, '\s+', ' ', 'g'), ' -'), '^(?i)(please|kindly)\s+', '') AS t FROM turns) SELECT session_id, turn_id, CASE WHEN len(string_split(t, ' ')) > 80 THEN '' ELSE rtrim(substr(t, 1, 500)) END AS cleaned FROM c")
def memory_text_clean(spark, sf_dir):
    raw = F.concat(F.when(F.col("turn_id") % 2 == 0, "Please  ").otherwise(" - "), "content")
    return fx.turns(spark, sf_dir).select("session_id", "turn_id", text.memory_text(raw).alias("cleaned"))


@query("SELECT event_id, CASE (event_id % 101)::INT " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in tools.WEATHER.items()) + " ELSE 'Weather code ' || (event_id % 101)::VARCHAR END AS label FROM events")
def weather_labels(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", tools.weather_label(F.col("event_id") % 101).alias("label"))


@query()
def sentence_predicates(spark, sf_dir):
    """Predicates of every sentence of the conversations."""
    rows = fx.turns(spark, sf_dir).select("session_id", "turn_id", F.posexplode(st.split(F.col("content"))).alias("at", "s"))
    s = F.col("s")
    flags = {"structured": st.is_structured(s), "high_signal": st.is_high_signal(s), "example": st.is_example(s, F.array(F.lit("the"))), "code": st.is_code(s), "low_value": st.is_low_value(s), "keeps_code": st.keeps_code(F.lit("how to run the code"), s)}
    return rows.select("session_id", "turn_id", "at", *(c.alias(n) for n, c in flags.items()))


@query()
def cleaned_answers(spark, sf_dir):
    return cleaning.cleaned(fx.turns(spark, sf_dir).select("session_id", "turn_id", F.concat("content", F.lit(" [1, 2] [9]")).alias("answer")), "answer", F.lit(3))


@query()
def unrepeated_documents(spark, sf_dir):
    """Whole texts, doubled word runs added, without runs that stand again at once."""
    twice = F.concat_ws(" ", "text", F.substring("text", 1, 400), F.substring("text", 1, 400), F.lit("end"))
    rows = fx.dealt_documents(spark, sf_dir).select("doc_id", text.squeeze(twice).alias("body"))
    return rows.select("doc_id", F.length("body").alias("n_before"), cleaning.unrepeated_runs(F.col("body")).alias("body")).select("doc_id", "n_before", F.length("body").alias("n_after"), F.md5(F.col("body").cast("binary")).alias("mark"))


# Retrieval


@query(_EVIDENCE + r""", w AS (SELECT query_id, rank, chunk_id, list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS q, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM items),
s AS (SELECT query_id, rank, chunk_id, len(list_intersect(q, t))::DOUBLE / greatest(len(q), 1) AS score FROM w)
SELECT query_id, chunk_id, round(score, 6) AS reranker_score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM s) WHERE place <= 8""")
def rerank_overlap(spark, sf_dir):
    top = backends.rerank_by_overlap(_evidence(spark, sf_dir), 8)
    return _six(top.select("query_id", "chunk_id", "reranker_score", F.col("place").cast("long").alias("place")), "reranker_score")


@query()
def rerank_backend(spark, sf_dir):
    return backends.reranked(_evidence(spark, sf_dir), 8).select("query_id", "chunk_id", "reranker_score", "place")


@query()
def embed_chunks(spark, sf_dir):
    """Chunks with their vectors: each distinct text is embedded once and stored."""
    store_path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    return backends.embedded_once(fx.chunks(spark, sf_dir).select("chunk_id", "text"), store_path).select("chunk_id", "embedding")


@query(r"""WITH flat AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS p FROM flat WHERE t <> '')
SELECT doc_id, unnest(range(0, len(p)))::INTEGER AS at_, unnest(p) AS sentence FROM parts""")
def sentence_table(spark, sf_dir):
    """Sentences of whole documents by a table function in SQL."""
    backends.register(spark)
    fx.documents(spark, sf_dir).select("doc_no", "text").createOrReplaceTempView("brookfern_documents")
    return spark.sql("SELECT d.doc_no AS doc_id, s.at AS at_, s.sentence FROM brookfern_documents d, LATERAL brookfern_sentences(d.text) s")


_SECTION_STOPS = ", ".join(f"'{w}'" for w in fixed.SECTION_STOPS)
_MEANING_STOPS = ", ".join(f"'{w}'" for w in fixed.MEANINGFUL_STOPS)
_TOKENS = r"regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')"
_EXPANDED = f"""WITH {_CHUNKS}, {_ASKED}, {_ANCHORS},
qt AS (SELECT query_id, list_distinct(list_filter({_TOKENS}, lambda t: length(t) >= 4 AND NOT list_contains([{_SECTION_STOPS}], t))) AS terms, list_distinct(list_filter({_TOKENS}, lambda t: length(t) >= 4 AND NOT list_contains([{_MEANING_STOPS}], t))) AS meant FROM asked),
near AS (SELECT a.query_id, a.rank, CASE WHEN c.chunk_index = a.chunk_index THEN 0 WHEN c.chunk_index < a.chunk_index THEN 1 ELSE 2 END AS role, c.* FROM anchors a JOIN chunks c ON c.doc_id = a.doc_id AND c.chunk_index BETWEEN a.chunk_index - 2 AND a.chunk_index + 2),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, role) AS n FROM near) WHERE n = 1),
base AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, role, chunk_index) AS place FROM once),
turns_of AS (SELECT query_id, doc_id, section_title, place AS after, row_number() OVER (PARTITION BY query_id, doc_id, section_title ORDER BY place) AS turn FROM base WHERE coalesce(section_title, '') <> ''),
pool AS (SELECT s.query_id, c.chunk_id, c.doc_id, c.section_title, c.chunk_index, c.title, c.page_number, len(list_filter(terms, lambda t: contains(lower(c.section_title || ' ' || c.text), t))) AS overlap FROM (SELECT DISTINCT query_id, doc_id, section_title FROM turns_of) s JOIN qt USING (query_id) JOIN chunks c ON c.doc_id = s.doc_id AND c.section_title = s.section_title WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.query_id = s.query_id AND b.chunk_id = c.chunk_id)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, section_title ORDER BY overlap DESC, title, page_number, chunk_index) AS n FROM pool WHERE overlap > 0),
extra AS (SELECT p.query_id, p.chunk_id, t.after, p.n FROM numbered p JOIN turns_of t ON t.query_id = p.query_id AND t.doc_id = p.doc_id AND t.section_title = p.section_title AND t.turn = (p.n + 1) // 2),
dp AS (SELECT query_id, doc_id, min(place) AS doc_place FROM base GROUP BY ALL),
tit AS (SELECT d.query_id, c.chunk_id, d.doc_place, c.title, c.page_number, c.chunk_index, len(list_filter(meant, lambda t: contains(lower(c.section_title), t))) AS th, len(list_filter(meant, lambda t: contains(lower(c.text), t))) AS xh FROM dp d JOIN qt USING (query_id) JOIN chunks c USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.query_id = d.query_id AND b.chunk_id = c.chunk_id) AND NOT EXISTS (SELECT 1 FROM extra e WHERE e.query_id = d.query_id AND e.chunk_id = c.chunk_id)),
titled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY th * 5 + xh DESC, doc_place, title, page_number, chunk_index) AS n FROM tit WHERE th > 0) WHERE n <= 6),
every AS (SELECT query_id, chunk_id, CASE WHEN role = 0 THEN 'hit' ELSE 'neighbor' END AS source, 0 AS part, place AS b0, 0 AS b1 FROM base UNION ALL SELECT query_id, chunk_id, 'section_context', 1, after, n FROM extra UNION ALL SELECT query_id, chunk_id, 'section_title_match', 2, n, 0 FROM titled)"""


@query(_EXPANDED + " SELECT query_id, place, chunk_id, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, b0, b1) AS place FROM every) WHERE place <= 24")
def context_expansion(spark, sf_dir):
    asked, chunks = fx.questions(spark, sf_dir), fx.chunks(spark, sf_dir)
    found = retrieval.expanded(_anchors(asked, chunks), chunks, asked)
    return found.select("query_id", F.col("place").cast("long").alias("place"), "chunk_id", "source")


@query()
def context_parents(spark, sf_dir):
    asked, chunks = fx.questions(spark, sf_dir), fx.chunks(spark, sf_dir)
    return retrieval.with_context(_anchors(asked, chunks), chunks, asked)


@query(_EVIDENCE + """, b AS (SELECT query_id, rank, chunk_id, title, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240) AS t FROM items WHERE rank <= 5) SELECT query_id, count(*) AS n, string_agg(rank::VARCHAR || ':' || t, '|' ORDER BY rank) AS brief, arg_min(title, rank) AS title FROM b GROUP BY query_id""")
def evidence_brief(spark, sf_dir):
    """The JSON of each query's first items, read again."""
    found = reports.evidence_summary(_evidence(spark, sf_dir).withColumn("page_number", F.lit(1)))
    again = F.from_json("evidence_json", "array<struct<rank: int, title: string, page_number: int, text: string>>")
    return found.withColumn("f", again).select("query_id", F.size("f").cast("long").alias("n"), F.array_join(F.transform("f", lambda x: F.concat(x["rank"].cast("string"), F.lit(":"), x["text"])), "|").alias("brief"), "title")


# Answers


@query()
def fact_list(spark, sf_dir):
    return answering.fact_list(_evidence(spark, sf_dir))


def _candidates(spark, sf_dir) -> DataFrame:
    return answering.candidates(answering.fact_list(_evidence(spark, sf_dir))).withColumn("results", F.lit(20))


@query()
def answer_candidates(spark, sf_dir):
    found = _candidates(spark, sf_dir)
    return found.withColumn("reason", answering.rejection(F.col("query"), F.col("candidate"), F.col("results")))


@query()
def accepted_answers(spark, sf_dir):
    """A question on every document, of all kinds in turn, whose pages hold cues of them."""
    items = materialized(fx.cued_items(spark, sf_dir, every=False)).withColumn("section_title", F.lit(""))
    most = items.groupBy("query_id").agg(F.max("rank").alias("results"))
    return answering.first_accepted(answering.candidates(answering.fact_list(items)).join(most, "query_id"))


@query()
def verified_answers(spark, sf_dir):
    """Turns as answers to the turn before, with that as evidence."""
    t = fx.turns(spark, sf_dir).select("session_id", "turn_id", "content")
    before = t.select("session_id", (F.col("turn_id") + 1).alias("turn_id"), F.col("content").alias("before"))
    rows = t.join(before, ["session_id", "turn_id"]).select("session_id", "turn_id", F.concat(F.lit("What does "), F.substring_index("before", " ", 2), F.lit(" say?")).alias("query"), F.concat("content", F.lit(" [1]")).alias("answer"), F.lit(1).alias("retrieved_count"), F.array("before").alias("evidence"))
    return answering.verified(rows).select("session_id", "turn_id", "leak", "drift", "low_overlap", "status")


@query()
def model_answers(spark, sf_dir):
    """Prompts from facts, answered by the stand-in."""
    return backends.generated(answering.prompts(answering.fact_list(_evidence(spark, sf_dir)))).select("query_id", "answer")


# Sources and tools


@query()
def file_discovery(spark, sf_dir):
    """Parquet files of the fixtures, as a listing reads them."""
    return files.discovered(spark, sf_dir, ".parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length").orderBy("name")


@query()
def page_sections(spark, sf_dir):
    """All documents as pages of eight lines, with their section titles filled forward; those without a page that can be searched with the reason for it."""
    lines = fx.documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("page_number", F.floor(F.col("at") / 8).cast("int") + 1)
    pages = lines.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "\n").alias("text"))
    return files.with_sections(pages, refuse=False).select("doc_id", "page_number", "section_title", "refused")


@query("SELECT 'documents' AS table_name, count(*) AS row_count FROM documents UNION ALL SELECT 'events', count(*) FROM events")
def tool_list_tables(spark, sf_dir):
    found = {"documents": fx.table(spark, sf_dir, "documents"), "events": _events(spark, sf_dir)}
    return tools.table_tools(spark, found, fx.traces(spark, sf_dir), store.folded_feedback(fx.feedback_log(spark, sf_dir))).call("list_tables")


@query("SELECT event_id AS trace_id, event_type AS query FROM events ORDER BY event_id DESC LIMIT 50")
def tool_recent_traces(spark, sf_dir):
    found = tools.table_tools(spark, {}, fx.traces(spark, sf_dir), store.folded_feedback(fx.feedback_log(spark, sf_dir))).call("recent_traces", limit=500)
    return found.select("trace_id", "query")
