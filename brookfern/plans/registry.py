"""Queries by name over the fixture tables, each with the equivalent DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import analytics, answer, answering, evaluate, ingest, postings, retrieval, store
from ..sources import fixtures as fx
from ..session import written
from ..streaming import events as streaming
from . import lifecycle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Common table expressions of the oracles: the derived tables of sources.fixtures.
_DOCS = """docs AS (SELECT doc_id AS doc_no, doc_id::VARCHAR AS doc_id, source || '/' || lang || '-' || doc_id::VARCHAR || '.pdf' AS source_path, source || ' ' || lang AS title, source,
  CASE WHEN doc_id % 3 = 0 THEN 'global' ELSE 'user' || (doc_id % 3)::VARCHAR END AS owner_id, CASE WHEN doc_id % 3 = 0 THEN 'global' ELSE 'user' END AS visibility, md5(text) AS checksum, doc_id AS indexed_at, text FROM documents)"""
_CHUNKS = (
    _DOCS
    + """, pieces AS (SELECT doc_id, doc_no, title, source, source_path, string_split(text, chr(10)) AS lines, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS chunk_index FROM docs),
chunks AS (SELECT doc_id, doc_no, title, source, source_path, chunk_index::INTEGER AS chunk_index, (chunk_index // 8 + 1)::INTEGER AS page_number, substr(lines[(chunk_index // 8) * 8 + 1], 1, 40) AS section_title, text,
  doc_id || '-p' || (chunk_index // 8 + 1)::VARCHAR || '-c' || chunk_index::VARCHAR AS chunk_id FROM pieces WHERE text <> '')"""
)
_WORDS5 = [f"lower(coalesce(w[{i}], ''))" for i in range(1, 6)]
_NAME = "translate(substr({0}, 1, 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || substr({0}, 2)"
_ASKED = rf"""asked_words AS (SELECT item_id AS query_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS w FROM benchmark),
asked AS (SELECT query_id, 'What does ' || {_NAME.format(_WORDS5[0])} || ' ' || {_NAME.format(_WORDS5[1])} || ' say about ' || {_WORDS5[2]} || ' ' || {_WORDS5[3]} || ' ' || {_WORDS5[4]} || '?' AS query FROM asked_words)"""
# Runs of two capitalised words are all that a question has for phrases.
_GENERIC = ", ".join(f"'{w}'" for w in fixed.PHRASE_GENERIC)
_PHRASES = rf"""pair AS (SELECT query_id, string_split(query, ' ') AS qw FROM asked), runs AS (SELECT query_id, lower(qw[3]) AS a, lower(qw[4]) AS b, regexp_full_match(qw[3], '[A-Z][A-Za-z0-9_]*') AND regexp_full_match(qw[4], '[A-Z][A-Za-z0-9_]*') AND NOT list_contains([{_GENERIC}], lower(qw[3])) AND NOT list_contains([{_GENERIC}], lower(qw[4])) AS named FROM pair),
phrases AS (SELECT query_id, CASE WHEN NOT named THEN [] WHEN b LIKE '%s' AND length(b) > 4 THEN [a || ' ' || b, a || ' ' || left(b, length(b) - 1)] ELSE [a || ' ' || b] END AS phrases FROM runs)"""
_TERMS = r"terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS term FROM asked) GROUP BY ALL)"


def _bm25_sql(items: str, key: str, body: str, scope: str | None = None) -> str:
    """CTEs up to lexical(query_id, key, score)."""
    bag = rf"""bag AS (SELECT {key}, unnest(regexp_extract_all(lower({body}), '[\p{{L}}\p{{N}}_]+')) AS term FROM {items}),
lens AS (SELECT {key}, len(regexp_extract_all(lower({body}), '[\p{{L}}\p{{N}}_]+')) AS length FROM {items}),
posts AS (SELECT {key}, term, count(*) AS tf FROM bag GROUP BY ALL), """
    if scope is None:
        return bag + f"""stat AS (SELECT count(*) AS n, avg(length) AS mean_length FROM lens),
df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts, stat GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
lexical AS (SELECT query_id, {key}, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) AS score FROM terms JOIN idf USING (term) JOIN posts USING (term) JOIN lens USING ({key}), stat GROUP BY query_id, {key})"""
    return bag + f"""stat AS (SELECT query_id, count(*) AS n, avg(length) AS mean_length FROM lens JOIN {scope} USING ({key}) GROUP BY query_id),
sposts AS (SELECT s.query_id, p.* FROM posts p JOIN {scope} s USING ({key})),
df AS (SELECT query_id, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM sposts JOIN stat USING (query_id) GROUP BY query_id, term, n),
flo AS (SELECT query_id, 0.25 * avg(raw) AS floor FROM df GROUP BY query_id),
idf AS (SELECT query_id, term, CASE WHEN raw < 0 THEN floor ELSE raw END AS idf FROM df JOIN flo USING (query_id)),
lexical AS (SELECT t.query_id, {key}, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) AS score FROM terms t JOIN idf USING (query_id, term) JOIN sposts USING (query_id, term) JOIN lens USING ({key}) JOIN stat ON stat.query_id = t.query_id GROUP BY t.query_id, {key})"""


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Tokens and ranking


@query(r"SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY doc_id")
def tokenize_terms(spark, sf_dir):
    words = fx.table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return words.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_terms"))


@query(r"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY term")
def term_df(spark, sf_dir):
    words = fx.table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {_DOCS}, {_ASKED}, {_TERMS}, {_bm25_sql('docs', 'doc_id', 'text')} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM lexical) WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    asked = fx.questions(spark, sf_dir)
    index = postings.stored(fx.documents(spark, sf_dir), "doc_id", F.col("text"), "documents")
    top = postings.topk(index, "doc_id", retrieval.query_terms(asked), 5)
    return _six(top, "score").withColumn("rank", F.col("rank").cast("long"))


def _chunk_index(chunks: DataFrame) -> postings.Index:
    return postings.stored(chunks, "chunk_id", F.col("text"), "chunks", "doc_id")


_SCOPE = "scope AS (SELECT query_id, chunk_id FROM asked JOIN chunks ON source = 'src' || (query_id % 20)::VARCHAR)"


def _scope(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """Each query may see the documents of one source."""
    own = asked.select("query_id", F.concat(F.lit("src"), F.col("query_id") % 20).alias("source"))
    return docs.select("doc_id", "source").join(own, "source").select("query_id", "doc_id")


@query(f"WITH {_CHUNKS}, {_ASKED}, {_TERMS}, {_SCOPE}, {_bm25_sql('chunks', 'chunk_id', 'text', 'scope')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM lexical) WHERE rank <= 5")
def bm25_scoped_topk(spark, sf_dir):
    asked, chunks = fx.questions(spark, sf_dir), fx.chunks(spark, sf_dir)
    found = retrieval.bm25_scoped(chunks, retrieval.query_terms(asked), *retrieval.numbered_scopes(_scope(asked, fx.documents(spark, sf_dir))), _chunk_index(chunks))
    top = retrieval.ranked(found, ["query_id"], [F.desc(F.round("score", 9)), F.col("chunk_id")], 5)
    return _six(top, "score").withColumn("rank", F.col("rank").cast("long"))


_SPARSE = rf"""WITH {_CHUNKS}, {_ASKED}, {_TERMS}, {_SCOPE}, {_bm25_sql("chunks", "chunk_id", "text", "scope")},
{_PHRASES},
named_boosts AS (SELECT s.query_id, c.chunk_id, list_sum(list_transform(phrases, lambda p: CASE WHEN contains(lower(coalesce(section_title, '')), p) THEN 8.0 WHEN contains(lower(coalesce(section_title, '') || ' ' || title || ' ' || text), p) THEN 5.0 ELSE 0.0 END)) AS named
  FROM scope s JOIN chunks c USING (chunk_id) JOIN phrases f ON f.query_id = s.query_id),
boosts AS (SELECT s.query_id, c.chunk_id, sum(CASE WHEN contains(lower(coalesce(section_title, '')), term) THEN 1.25 WHEN contains(lower(coalesce(section_title, '') || ' ' || title || ' ' || text), term) THEN 0.25 ELSE 0 END) AS boost
  FROM scope s JOIN chunks c USING (chunk_id) JOIN terms t ON t.query_id = s.query_id GROUP BY s.query_id, c.chunk_id),
scored AS (SELECT b.query_id, b.chunk_id, coalesce(l.score, 0) + b.boost + coalesce(n.named, 0)::DOUBLE AS score FROM boosts b JOIN named_boosts n USING (query_id, chunk_id) LEFT JOIN lexical l USING (query_id, chunk_id)),
sparse AS (SELECT s.query_id, s.chunk_id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.score, 9) DESC, c.title, c.page_number, c.chunk_index, c.chunk_id) AS rank FROM scored s JOIN chunks c USING (chunk_id))"""


@query(_SPARSE + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM sparse WHERE rank <= 8")
def sparse_boosted_topk(spark, sf_dir):
    asked, chunks = fx.questions(spark, sf_dir), fx.chunks(spark, sf_dir)
    top = retrieval.sparse_topk(chunks, asked, _scope(asked, fx.documents(spark, sf_dir)), 8, _chunk_index(chunks))
    return _six(top.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank")), "score")


_COSINE = """WITH unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings),
scores AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_dot_product(q.u, v.u) AS score FROM unit q, unit v WHERE q.vec_id % 50 = 0)"""


def _cosine(spark, sf_dir, group: str | None = None, keep: int | None = None):
    vectors = fx.table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.cosine_scores(vectors.withColumnRenamed("embedding", "vector"), asked, "vec_id", group, keep)


@query(_COSINE + " SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM scores) WHERE rank <= 5")
def cosine_topk(spark, sf_dir):
    top = retrieval.ranked(_cosine(spark, sf_dir, keep=5), ["query_id"], [F.desc(F.round("score", 9)), F.col("vec_id")], 5)
    return _six(top.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank")), "score")


@query(_COSINE + """, inner_top AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY round(score, 9) DESC, vec_id) AS gr FROM scores)
SELECT query_id, label, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM inner_top WHERE gr <= 4) WHERE rank <= 10""")
def cosine_per_doc_topk(spark, sf_dir):
    top = retrieval.topk_per_group(_cosine(spark, sf_dir, "label", 4), "label", "vec_id", 10, 4)
    return _six(top.select("query_id", "label", "vec_id", "score", F.col("rank").cast("long").alias("rank")), "score")


_LENGTH_RANK = "dense AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, chunk_id) AS rank FROM scope JOIN chunks USING (chunk_id))"


def _dense_stand_in(scope: DataFrame, chunks: DataFrame) -> DataFrame:
    """A second ranking to fuse: longest chunks of the scope first."""
    rows = scope.join(chunks.select("doc_id", "chunk_id", F.length("text").alias("size")), "doc_id")
    return retrieval.ranked(rows, ["query_id"], [F.desc("size"), F.col("chunk_id")], 25)


@query(_SPARSE + f", {_LENGTH_RANK}" + """, fused AS (SELECT query_id, chunk_id, d.rank AS dense_rank, s.rank AS sparse_rank, coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS score
  FROM (SELECT * FROM dense WHERE rank <= 25) d FULL JOIN (SELECT * FROM sparse WHERE rank <= 25) s USING (query_id, chunk_id))
SELECT query_id, chunk_id, dense_rank, sparse_rank, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, chunk_id) AS rank FROM fused) WHERE rank <= 8""")
def rrf_fuse(spark, sf_dir):
    asked, chunks = fx.questions(spark, sf_dir), fx.chunks(spark, sf_dir)
    scope = _scope(asked, fx.documents(spark, sf_dir))
    fused = retrieval.rrf(_dense_stand_in(scope, chunks), retrieval.sparse_topk(chunks, asked, scope, 25, _chunk_index(chunks)), 8)
    return _six(fused.select("query_id", "chunk_id", *(F.col(c).cast("long").alias(c) for c in ("dense_rank", "sparse_rank")), "score", F.col("rank").cast("long").alias("rank")), "score")


# Access, search, scope


@query(f"WITH {_DOCS} SELECT doc_id, owner_id, visibility FROM docs WHERE visibility = 'global' OR owner_id = 'user1'")
def access_filter(spark, sf_dir):
    return store.accessible(fx.documents(spark, sf_dir), "user1").select("doc_id", "owner_id", "visibility")


@query(f"WITH {_DOCS} SELECT doc_id FROM docs WHERE doc_no % 7 = 0 AND (visibility = 'global' OR owner_id = 'user2')")
def scope_intersect(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    return retrieval.scope_intersect(docs.filter("doc_no % 7 = 0").select("doc_id"), store.accessible(docs, "user2"))


@query(f"WITH {_DOCS} SELECT doc_id, title, source_path, indexed_at FROM docs WHERE title ILIKE '%SRC1%' OR source_path ILIKE '%SRC1%' OR doc_id ILIKE '%SRC1%' ORDER BY indexed_at DESC, doc_id LIMIT 50 OFFSET 10")
def doc_search_ilike(spark, sf_dir):
    return store.search_documents(fx.documents(spark, sf_dir), "SRC1", 50, 10).select("doc_id", "title", "source_path", "indexed_at")


@query(f"WITH {_DOCS} SELECT owner_id, visibility, count(*) AS n FROM docs WHERE source IN ('src1', 'src2') GROUP BY ALL")
def documents_in_list(spark, sf_dir):
    kept = store.restricted(fx.documents(spark, sf_dir), "source", ["src1", "src2", "src1"])
    return kept.groupBy("owner_id", "visibility").agg(F.count("*").alias("n"))


# Context expansion

_HITS = f"{_TERMS}, {_bm25_sql('chunks', 'chunk_id', 'text')}, hits AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM lexical)"
_ANCHORS = f"{_HITS}, anchors AS (SELECT query_id, doc_id, chunk_index, chunk_id, section_title, rank FROM hits JOIN chunks USING (chunk_id) WHERE rank <= 3)"


def _hits(asked: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """The best chunks of each question by BM25, with the columns of chunks."""
    # Few rows a question, as a table whose size is known: the texts of all chunks stay where they are.
    best = written(postings.topk(_chunk_index(chunks), "chunk_id", retrieval.query_terms(asked), limit))
    return best.drop("score").join(chunks, "chunk_id")


def _anchors(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Three chunks a question, kept: many steps read them."""
    return written(_hits(asked, chunks, 3).select("query_id", "doc_id", "chunk_index", "chunk_id", "section_title", "rank"))


@query(f"WITH {_CHUNKS}, {_ASKED}, {_ANCHORS} SELECT a.query_id, a.chunk_index AS anchor_index, c.chunk_id FROM anchors a JOIN chunks c ON c.doc_id = a.doc_id AND c.chunk_index BETWEEN greatest(0, a.chunk_index - 2) AND a.chunk_index + 2")
def neighbor_window(spark, sf_dir):
    asked, chunks = fx.questions(spark, sf_dir), fx.chunks(spark, sf_dir)
    return retrieval.neighbours(_anchors(asked, chunks), chunks).select("query_id", "anchor_index", "chunk_id")


_STOPS_SQL = ", ".join(f"'{w}'" for w in fixed.MEANINGFUL_STOPS)
_MEANT = rf"meant AS (SELECT query_id, list_distinct(list_filter(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 4 AND NOT list_contains([{_STOPS_SQL}], t))) AS mterms FROM asked)"


@query(f"""WITH {_CHUNKS}, {_ASKED}, {_ANCHORS}, {_MEANT}, found AS (SELECT a.query_id, a.chunk_id AS anchor_id, c.chunk_id, c.chunk_index, len(list_filter(mterms, lambda t: contains(lower(c.text), t))) AS overlap
  FROM anchors a JOIN meant USING (query_id) JOIN chunks c ON c.doc_id = a.doc_id AND c.section_title = a.section_title WHERE coalesce(a.section_title, '') <> '' AND NOT EXISTS (SELECT 1 FROM anchors x WHERE x.query_id = a.query_id AND x.chunk_id = c.chunk_id))
SELECT query_id, anchor_id, chunk_id, overlap, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, anchor_id ORDER BY overlap DESC, chunk_index, chunk_id) AS rank FROM found WHERE overlap > 0) WHERE rank <= 2""")
def section_context_topk(spark, sf_dir):
    asked, chunks = fx.questions(spark, sf_dir), fx.chunks(spark, sf_dir)
    found = retrieval.section_context(_anchors(asked, chunks), chunks.drop("title", "source"), asked)
    return found.select("query_id", "anchor_id", "chunk_id", F.col("overlap").cast("long").alias("overlap"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_CHUNKS}, {_ASKED}, {_ANCHORS}, {_MEANT}, found AS (SELECT a.query_id, c.doc_id, c.chunk_id, c.chunk_index, len(list_filter(mterms, lambda t: contains(lower(c.section_title), t))) AS in_title, len(list_filter(mterms, lambda t: contains(lower(c.text), t))) AS in_text
  FROM (SELECT DISTINCT query_id, doc_id FROM anchors) a JOIN meant USING (query_id) JOIN chunks c USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM anchors x WHERE x.query_id = a.query_id AND x.chunk_id = c.chunk_id))
SELECT query_id, chunk_id, in_title * 5 + in_text AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY in_title * 5 + in_text DESC, doc_id, chunk_index) AS rank FROM found WHERE in_title > 0) WHERE rank <= 6""")
def title_match_topk(spark, sf_dir):
    asked, chunks = fx.questions(spark, sf_dir), fx.chunks(spark, sf_dir)
    found = retrieval.title_sections(_anchors(asked, chunks), chunks, asked)
    return found.select("query_id", "chunk_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_CHUNKS}, {_ASKED}, {_ANCHORS}, near AS (SELECT a.query_id, a.doc_id, a.chunk_index AS anchor_index, c.chunk_index, c.text, 4200 - coalesce(sum(length(c.text) + 1) OVER (PARTITION BY a.query_id, a.doc_id, a.chunk_index ORDER BY c.chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM anchors a JOIN chunks c ON c.doc_id = a.doc_id AND c.chunk_index BETWEEN greatest(0, a.chunk_index - 3) AND a.chunk_index + 3)
SELECT query_id, doc_id, anchor_index, string_agg(substr(text, 1, room::INTEGER), chr(10) ORDER BY chunk_index) AS text, min(chunk_index) AS first_index, max(chunk_index) AS last_index FROM near WHERE room >= length(text) OR room > 300 GROUP BY query_id, doc_id, anchor_index""")
def parent_context(spark, sf_dir):
    asked, chunks = fx.questions(spark, sf_dir), fx.chunks(spark, sf_dir)
    return retrieval.parent_windows(_anchors(asked, chunks), chunks)


@query(f"WITH {_CHUNKS}, {_ASKED}, {_ANCHORS}, parts AS (SELECT query_id, chunk_id, chunk_index, 0 AS segment FROM anchors UNION ALL SELECT a.query_id, c.chunk_id, c.chunk_index, 1 FROM anchors a JOIN chunks c ON c.doc_id = a.doc_id AND c.chunk_index BETWEEN greatest(0, a.chunk_index - 2) AND a.chunk_index + 2) SELECT query_id, chunk_id, segment FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY segment, chunk_index) AS n FROM parts) WHERE n = 1")
def ordered_union_dedupe(spark, sf_dir):
    asked, chunks = fx.questions(spark, sf_dir), fx.chunks(spark, sf_dir)
    anchors = _anchors(asked, chunks)
    parts = [anchors.select("query_id", "chunk_id", "chunk_index"), retrieval.neighbours(anchors, chunks).select("query_id", "chunk_id", "chunk_index")]
    return retrieval.ordered_union(parts, ["query_id", "chunk_id"], "chunk_index").select("query_id", "chunk_id", "segment")


# Routing


@query(f"WITH {_CHUNKS} SELECT count(DISTINCT d.doc_id) AS documents, count(c.chunk_id) AS chunks, sum(length(c.text))::BIGINT AS characters, sum(greatest(1, length(c.text) // 4))::BIGINT AS tokens, max(d.indexed_at) AS latest, max(d.checksum) AS checksum FROM docs d LEFT JOIN chunks c USING (doc_id)")
def routing_signature(spark, sf_dir):
    docs, chunks = fx.documents(spark, sf_dir).select("doc_id", "indexed_at", "checksum"), fx.chunks(spark, sf_dir).select("doc_id", "chunk_id", "text")
    joined = docs.join(chunks, "doc_id", "left")
    return joined.agg(F.countDistinct("doc_id").alias("documents"), F.count("chunk_id").alias("chunks"), F.sum(F.length("text")).alias("characters"), F.sum(F.when(F.col("text").isNotNull(), text.token_estimate(F.col("text")))).alias("tokens"), F.max("indexed_at").alias("latest"), F.max("checksum").alias("checksum"))


@query(f"WITH {_CHUNKS} SELECT doc_id, string_agg(DISTINCT section_title, ',' ORDER BY section_title) AS section_titles FROM chunks GROUP BY doc_id")
def section_titles_listagg(spark, sf_dir):
    return fx.chunks(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("section_title")), ",").alias("section_titles"))


@query(f"WITH {_CHUNKS}, used AS (SELECT doc_id, chunk_index, text, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM chunks) SELECT doc_id, count(*) AS chunks, sum(least(length(text), 50000 - u))::BIGINT AS characters, max(md5(substr(text, 1, (50000 - u)::INTEGER))) AS mark FROM used WHERE u < 50000 GROUP BY doc_id")
def routing_text_budget(spark, sf_dir):
    kept = ingest.within_budget(fx.chunks(spark, sf_dir).select("doc_id", "chunk_index", "text"), "doc_id", "chunk_index", "text", 50_000)
    return kept.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"), F.max(F.md5(F.col("text").cast("binary"))).alias("mark"))


def _routing_index(docs: DataFrame) -> postings.Index:
    return postings.stored(docs, "doc_id", retrieval.routing_body(), "routing")


def _routed(spark, sf_dir, top_n: int = 3) -> DataFrame:
    docs = fx.routing_documents(spark, sf_dir)
    return retrieval.route_documents(docs, fx.questions(spark, sf_dir), top_n, _routing_index(docs))


_ROUTE_STOPS = ", ".join(f"'{w}'" for w in fixed.ROUTING_STOPS)
_RP_STOPS = ", ".join(f"'{w}'" for w in fixed.ROUTE_PHRASE_STOPS)
_DT_STOPS = ", ".join(f"'{w}'" for w in fixed.DISTINCTIVE_STOPS)
_FORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_ROUTED = rf"""WITH {_CHUNKS}, {_ASKED},
sections AS (SELECT doc_id, string_agg(DISTINCT section_title, ',' ORDER BY section_title) AS section_titles FROM chunks GROUP BY doc_id),
rdocs AS (SELECT d.doc_id, d.title, d.source_path, d.text, coalesce(s.section_titles, '') AS section_titles FROM docs d LEFT JOIN sections s USING (doc_id)),
content_words AS (SELECT query_id, list_distinct(list_filter(list_transform(regexp_extract_all(query, '[a-zA-Z0-9][a-zA-Z0-9_-]*'), lambda t: lower(t)), lambda t: length(t) >= 2 AND NOT list_contains([{_ROUTE_STOPS}], t))) AS cw, regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+') AS aw FROM asked),
words AS (SELECT query_id, CASE WHEN len(cw) > 0 THEN cw ELSE aw END AS w FROM content_words),
terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(w) AS term FROM words) GROUP BY ALL),
bodies AS (SELECT doc_id, title, source_path, text, title || ' ' || regexp_extract(source_path, '([^/]*)$', 1) || ' ' || section_titles || ' ' || text AS body FROM rdocs),
{_bm25_sql("bodies", "doc_id", "body")},
spots AS (SELECT doc_id, term, sum(t) AS in_title, sum(p) AS in_path, sum(c) AS in_content, sum(s) AS in_sections FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+')) AS term, 1 AS t, 0 AS p, 0 AS c, 0 AS s FROM rdocs UNION ALL
  SELECT doc_id, unnest(regexp_extract_all(lower(source_path), '[\p{{L}}\p{{N}}_]+')), 0, 1, 0, 0 FROM rdocs UNION ALL
  SELECT doc_id, unnest(regexp_extract_all(lower(section_titles), '[\p{{L}}\p{{N}}_]+')), 0, 0, 0, 1 FROM rdocs UNION ALL
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')), 0, 0, 1, 0 FROM rdocs) GROUP BY ALL),
boosts AS (SELECT query_id, doc_id, sum(times * (CASE WHEN in_title > 0 THEN 8 ELSE 0 END + CASE WHEN in_sections > 0 THEN 4 ELSE 0 END + CASE WHEN in_path > 0 THEN 2 ELSE 0 END + CASE WHEN in_content > 0 THEN 0.75 + least(2.5, ln(1 + in_content)) + CASE WHEN length(term) >= 6 THEN 1.25 ELSE 0 END ELSE 0 END)) AS boost,
  sum(times * (CASE WHEN in_title > 0 THEN 1 ELSE 0 END + CASE WHEN in_sections > 0 THEN 1 ELSE 0 END)) AS titled, sum(CASE WHEN in_content > 0 THEN 1 ELSE 0 END) AS matched FROM terms JOIN spots USING (term) GROUP BY query_id, doc_id),
pw AS (SELECT query_id, query, list_filter(string_split(replace(lower(query), '?', ''), ' '), lambda t: regexp_full_match(t, '[a-z0-9][a-z0-9]+') AND NOT list_contains([{_RP_STOPS}], t)) AS ws, list_filter(string_split(replace(query, '?', ''), ' '), lambda t: regexp_full_match(t, '[A-Za-z][A-Za-z0-9_]+') AND length(t) >= 4 AND regexp_matches(t, '[A-Z0-9_]') AND NOT list_contains([{_DT_STOPS}], lower(t))) AS ds FROM asked),
pats AS (SELECT query_id, 'whole' AS kind, lower(query) AS pattern FROM pw UNION ALL
  SELECT DISTINCT query_id, 'phrase', p FROM (SELECT query_id, unnest(list_concat(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) ELSE [] END, CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) ELSE [] END, CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE [] END)) AS p FROM pw) WHERE length(p) >= 7 UNION ALL
  SELECT DISTINCT query_id, 'term', {_FORM.format("d")} FROM (SELECT query_id, unnest(ds) AS d FROM pw)),
forms AS (SELECT doc_id, lower(title) AS lt, lower(text) AS lc, ' ' || {_FORM.format("title")} || ' ' AS ft, ' ' || {_FORM.format("section_titles")} || ' ' AS fs, ' ' || {_FORM.format("source_path")} || ' ' AS fp, ' ' || {_FORM.format("title || ' ' || source_path || ' ' || section_titles || ' ' || text")} || ' ' AS fa FROM rdocs),
points AS (SELECT query_id, doc_id, sum(CASE kind WHEN 'whole' THEN CASE WHEN contains(lt, pattern) THEN 2 ELSE 0 END + CASE WHEN contains(lc, pattern) THEN 4 ELSE 0 END
  WHEN 'phrase' THEN CASE WHEN contains(ft, pattern) THEN 10 WHEN contains(fs, pattern) THEN 8 WHEN contains(fa, pattern) THEN 12 ELSE 0 END
  ELSE CASE WHEN contains(ft, ' ' || pattern || ' ') THEN 40 WHEN contains(fs, ' ' || pattern || ' ') THEN 30 WHEN contains(fp, ' ' || pattern || ' ') THEN 24 WHEN contains(fa, ' ' || pattern || ' ') THEN 36 ELSE 0 END END) AS points FROM forms, pats WHERE pattern <> '' GROUP BY query_id, doc_id HAVING points > 0),
routed AS (SELECT query_id, doc_id, coalesce(l.score, 0) + coalesce(boost, 0) + coalesce(matched, 0)::DOUBLE / greatest(len(list_distinct(w)), 1) * 14 + least(10, coalesce(titled, 0) * 2.5) + coalesce(points, 0) AS routing_score FROM boosts b FULL JOIN points p USING (query_id, doc_id) JOIN words USING (query_id) LEFT JOIN lexical l USING (query_id, doc_id)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(routing_score, 9) DESC, doc_id) AS rank FROM routed) WHERE rank <= 3)"""


@query(_ROUTED + " SELECT query_id, doc_id, round(routing_score, 6) AS routing_score, rank FROM top")
def routing_scores(spark, sf_dir):
    return _six(_routed(spark, sf_dir), "routing_score").withColumn("rank", F.col("rank").cast("long"))


@query(_ROUTED + ", pair AS (SELECT query_id, max(routing_score) FILTER (WHERE rank = 1) AS s1, max(routing_score) FILTER (WHERE rank = 2) AS s2 FROM top GROUP BY query_id) SELECT query_id, doc_id, rank FROM top JOIN pair USING (query_id) WHERE rank = 1 OR NOT (s2 IS NULL OR s1 >= s2 * 1.05 OR s1 - s2 >= 3)")
def candidate_scope(spark, sf_dir):
    return retrieval.candidate_scope(_routed(spark, sf_dir)).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


# Ingestion


@query(f"WITH {_CHUNKS}, marked AS (SELECT doc_id, chunk_index, CASE WHEN length(text) < 40 THEN text END AS heading FROM chunks) SELECT doc_id, chunk_index, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM marked")
def forward_fill_section(spark, sf_dir):
    marked = fx.chunks(spark, sf_dir).select("doc_id", "chunk_index", F.when(F.length("text") < 40, F.col("text")).alias("heading"))
    return ingest.forward_filled(marked, "doc_id", "chunk_index", "heading")


@query(f"WITH {_CHUNKS}, marked AS (SELECT doc_id, chunk_index, coalesce(max((length(text) < 25)::INTEGER) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM chunks) SELECT doc_id, chunk_index FROM marked WHERE ended = 0")
def stop_after_terminal(spark, sf_dir):
    marked = fx.chunks(spark, sf_dir).select("doc_id", "chunk_index", (F.length("text") < 25).alias("terminal"))
    return ingest.until_terminal(marked, "doc_id", "chunk_index", "terminal").select("doc_id", "chunk_index")


def _re(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"WITH {_CHUNKS}, flat AS (SELECT chunk_id, {_FLAT} AS f FROM chunks) SELECT chunk_id, f <> '' AND (regexp_matches(f, '(?i){_re(fixed.BOILERPLATE)}') OR (contains(f, ' | by ') AND length(f) > 90)) AS boilerplate, regexp_matches(f, '(?i){_re(fixed.TERMINAL)}') AS terminal FROM flat")
def boilerplate_lines(spark, sf_dir):
    return fx.chunks(spark, sf_dir).select("chunk_id", text.is_boilerplate(F.col("text")).alias("boilerplate"), text.is_terminal(F.col("text")).alias("terminal"))


@query(f"WITH {_CHUNKS}, flat AS (SELECT chunk_id, {_FLAT} AS f FROM chunks) SELECT chunk_id FROM flat WHERE length(f) < 80 AND NOT regexp_matches(f, '[.!?]') AND NOT regexp_matches(f, '[=(){{}}\\[\\]#<>]')")
def low_value_chunks(spark, sf_dir):
    return fx.chunks(spark, sf_dir).filter(text.is_low_value(F.col("text"))).select("chunk_id")


@query(f"WITH {_CHUNKS} SELECT chunk_id, ('0x' || substr(md5(chunk_id), 1, 12))::BIGINT AS point_id, greatest(1, length(text) // 4)::BIGINT AS token_estimate, sha256(text) AS checksum FROM chunks")
def chunk_ids_hash(spark, sf_dir):
    return fx.chunks(spark, sf_dir).select("chunk_id", text.point_id(F.col("chunk_id")).alias("point_id"), text.token_estimate(F.col("text")).alias("token_estimate"), F.sha2("text", 256).alias("checksum"))


_STATES = "(SELECT source_path, CASE WHEN doc_no % 5 = 0 THEN 'old' ELSE checksum END AS checksum, 1 AS v, doc_no % 4 AS chunk_count, CASE WHEN doc_no % 6 = 0 THEN 'failed' ELSE 'indexed' END AS st FROM docs WHERE doc_no % 7 <> 0)"


@query(f"WITH {_DOCS}, have AS {_STATES} SELECT d.doc_id, CASE WHEN h.st IS NULL THEN 'new' WHEN h.chunk_count > 0 AND h.st = 'indexed' AND h.checksum = d.checksum THEN 'current' ELSE 'changed' END AS state FROM docs d LEFT JOIN have h USING (source_path)")
def ingest_currency(spark, sf_dir):
    same = {"parser_version": F.lit(ingest.PARSER_VERSION), "chunking_version": F.lit(ingest.CHUNKING_VERSION), "embedding_model": F.lit("hash"), "chunk_size": F.lit(900), "chunk_overlap": F.lit(120)}
    docs = fx.documents(spark, sf_dir).withColumns(same)
    have = docs.filter("doc_no % 7 <> 0").selectExpr("source_path", "if(doc_no % 5 = 0, 'old', checksum) as checksum", *same, "doc_no % 4 as chunk_count", "if(doc_no % 6 = 0, 'failed', 'indexed') as ingestion_status")
    return ingest.classify_incoming(docs.select("doc_id", "source_path", "checksum", *same), have).select("doc_id", "state")


@query()
def chunk_documents(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("at", "text"))
    pages = lines.select("doc_id", (F.col("at") + 1).alias("page_number"), "text", F.substring("text", 1, 40).alias("section_title"))
    return ingest.chunk_pages(pages)


# State and summaries


@query("SELECT count(*) AS total_count, count(*) FILTER (WHERE s = 'running') AS running_count, count(*) FILTER (WHERE s = 'indexed') AS indexed_count, count(*) FILTER (WHERE s = 'skipped') AS skipped_count, count(*) FILTER (WHERE s = 'failed') AS failed_count FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'indexed' WHEN 'O' THEN 'running' ELSE 'failed' END AS s FROM orders)")
def ingestion_summary(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "indexed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return store.ingestion_summary(fx.table(spark, sf_dir, "orders").select(status.alias("status")))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def latest_state(spark, sf_dir):
    log = fx.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return store.latest(log, ["user_id"], [F.col("event_id")])


_FEEDBACK = """WITH log AS (SELECT user_id AS trace_id, event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN 'like' ELSE 'dislike' END AS rating, CASE WHEN event_type = 'error' THEN 'issue' || (event_id % 3)::VARCHAR END AS issue_type FROM events),
state AS (SELECT trace_id, arg_max(rating, seq) AS last_rating, max(seq) AS last_seq, max(seq) FILTER (WHERE rating = 'like') AS liked FROM log GROUP BY trace_id),
issue AS (SELECT l.trace_id, arg_max(issue_type, seq) AS issue FROM log l JOIN state s USING (trace_id) WHERE issue_type IS NOT NULL AND rating = 'dislike' AND (liked IS NULL OR seq > liked) GROUP BY l.trace_id),
feedback AS (SELECT trace_id, last_rating AS rating, CASE WHEN last_rating = 'like' THEN '' ELSE coalesce(issue, '') END AS issue_type, last_seq AS seq FROM state LEFT JOIN issue USING (trace_id))"""


@query(_FEEDBACK + " SELECT * FROM feedback")
def feedback_state(spark, sf_dir):
    return store.folded_feedback(fx.feedback_log(spark, sf_dir))


@query(_FEEDBACK + " SELECT count(*) AS total_count, count(*) FILTER (WHERE rating = 'like') AS like_count, count(*) FILTER (WHERE rating = 'dislike') AS dislike_count, max(seq) AS latest_seq, round(count(*) FILTER (WHERE rating = 'dislike')::DOUBLE / count(*), 6) AS dislike_rate FROM feedback")
def feedback_summary(spark, sf_dir):
    return _six(store.feedback_summary(store.folded_feedback(fx.feedback_log(spark, sf_dir))), "dislike_rate")


@query(_FEEDBACK + " SELECT issue_type, count(*) AS issue_count FROM feedback WHERE rating = 'dislike' AND issue_type <> '' GROUP BY issue_type")
def feedback_issues(spark, sf_dir):
    return store.feedback_issues(store.folded_feedback(fx.feedback_log(spark, sf_dir)))


@query(_FEEDBACK + " SELECT e.event_id AS trace_id, f.rating, f.issue_type, e.event_type AS query FROM events e JOIN feedback f ON f.seq = e.event_id WHERE f.rating = 'dislike'")
def feedback_join_traces(spark, sf_dir):
    feedback = store.folded_feedback(fx.feedback_log(spark, sf_dir)).filter("rating = 'dislike'")
    traces = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("query"))
    return traces.join(feedback, "seq").select(F.col("seq").alias("trace_id"), "rating", "issue_type", "query")


_TURNS = "turns AS (SELECT 's' || conv_id::VARCHAR AS session_id, conv_id, turn AS turn_id, role, text AS content FROM conversations)"


@query(f"WITH {_TURNS} SELECT session_id, turn_id, role, row_number() OVER (PARTITION BY session_id ORDER BY turn_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) AS back FROM turns) WHERE back <= 6")
def recent_turns(spark, sf_dir):
    return store.recent_turns(fx.turns(spark, sf_dir)).select("session_id", "turn_id", "role", F.col("place").cast("long").alias("place"))


@query("SELECT 'global' AS scope, 's' || (user_id % 5)::VARCHAR AS session_id, 'known_issue' AS kind, event_type AS content, max(value) AS importance, arg_max('u' || user_id::VARCHAR, event_id) AS source, max(event_id) AS updated_seq FROM events GROUP BY ALL")
def memory_upsert(spark, sf_dir):
    log = fx.table(spark, sf_dir, "events").selectExpr("'global' as scope", "concat('s', user_id % 5) as session_id", "'known_issue' as kind", "event_type as content", "value as importance", "concat('u', user_id) as source", "event_id as seq")
    return store.upserted_memory(log)


@query(f"WITH {_TURNS} SELECT conv_id, turn_id, " + "regexp_replace(" * 5 + "content" + "".join(", '" + p.replace("'", "''") + "', '" + r.replace("$1", "\\1") + "', 'g')" for p, r in fixed.REDACTIONS) + " AS redacted FROM turns")
def redact_pii(spark, sf_dir):
    return fx.turns(spark, sf_dir).select("conv_id", "turn_id", text.redact(F.col("content")).alias("redacted"))


_SENS = " OR ".join([f"contains(lower(text), '{w}')" for w in fixed.SENSITIVE_WORDS] + [f"regexp_matches(text, '{p}')" for p in fixed.SENSITIVE])


@query(f"SELECT doc_id, ({_SENS}) AS sensitive FROM documents")
def sensitive_flag(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.is_sensitive(F.col("text")).alias("sensitive"))


def _has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, w.replace("'", "''")) for w in words) + ")"


@query(f"""WITH {_TURNS}, low AS (SELECT conv_id, turn_id, lower(content) AS t FROM turns) SELECT conv_id, turn_id, {_has("t", fixed.MEMORY_SIGNALS)} AS signal,
 CASE WHEN {_has("t", ["eval", "benchmark", "score", "pass", "failed"])} THEN 'evaluation_result' WHEN {_has("t", ["next step", "todo", "remaining", "completed", "done"])} THEN 'task_status' WHEN {_has("t", ["issue", "bug", "problem", "regression"])} THEN 'known_issue' WHEN {_has("t", ["i prefer", "i want", "my preference"])} THEN 'user_preference' ELSE 'project_decision' END AS kind,
 least(3.0, 1.0 + CASE WHEN {_has("t", ["do not", "don't", "dont", "never", "always", "keep in mind"])} THEN 1.0 ELSE 0 END + CASE WHEN {_has("t", ["target", "goal", "eval", "benchmark", "quality", "general purpose"])} THEN 0.5 ELSE 0 END)::DOUBLE AS importance FROM low""")
def memory_signals(spark, sf_dir):
    c = F.col("content")
    return fx.turns(spark, sf_dir).select("conv_id", "turn_id", text.has_memory_signal(c).alias("signal"), text.memory_kind(c).alias("kind"), text.memory_importance(c).alias("importance"))


_MSTOPS = ", ".join(f"'{w}'" for w in fixed.MEMORY_STOPS)


def _mterms(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z][a-z0-9_-]{{2,}}'), lambda t: NOT list_contains([{_MSTOPS}], t)))"


@query(f"""WITH q AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS query_id, conv_id AS session_id, {_mterms("text")} AS qt FROM conversations WHERE role = 'user'),
m AS (SELECT conv_id AS session_id, turn AS memory_id, 'task_status' AS kind, 1.0::DOUBLE AS importance, {_mterms("text")} AS mt FROM conversations WHERE role = 'assistant'),
s AS (SELECT query_id, memory_id, importance, kind, len(list_intersect(qt, mt)) * 2.0 AS score FROM q JOIN m USING (session_id) WHERE len(qt) > 0 AND len(mt) > 0)
SELECT query_id, memory_id, score::DOUBLE AS score FROM s WHERE score > 0""")
def memory_term_overlap(spark, sf_dir):
    t = fx.turns(spark, sf_dir)
    q = t.filter("role = 'user'").select(F.concat("conv_id", F.lit("-"), "turn_id").alias("query_id"), F.col("conv_id").alias("session_id"), text.memory_terms(F.col("content")).alias("qt"))
    m = t.filter("role = 'assistant'").select(F.col("conv_id").alias("session_id"), F.col("turn_id").alias("memory_id"), text.memory_terms(F.col("content")).alias("mt"))
    scored = q.join(m, "session_id").withColumn("score", F.size(F.array_intersect("qt", "mt")) * 2.0)
    return scored.filter("score > 0").select("query_id", "memory_id", "score")


@query()
def memory_rank(spark, sf_dir):
    t = fx.turns(spark, sf_dir)
    items = t.filter("role = 'assistant'").select(F.col("conv_id").alias("session_id"), F.col("turn_id").alias("memory_id"), "content", text.memory_kind(F.col("content")).alias("kind"), text.memory_importance(F.col("content")).alias("importance"))
    asked = t.filter("role = 'user'").select(F.concat("conv_id", F.lit("-"), "turn_id").alias("query_id"), F.col("conv_id").alias("session_id"), F.col("content").alias("query"))
    return store.ranked_memory(items, asked)


@query("SELECT * FROM (SELECT 'customer' AS table_name, count(*) AS row_count FROM customer UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders)")
def table_catalog(spark, sf_dir):
    return store.table_catalog(spark, {n: fx.table(spark, sf_dir, n) for n in ("events", "documents", "orders", "customer")})


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS text, lang FROM documents ORDER BY doc_id LIMIT 20")
def table_preview(spark, sf_dir):
    return store.preview(fx.table(spark, sf_dir, "documents").select("doc_id", "text", "lang").orderBy("doc_id"), 20)


# Audit and latency

_TOOL = "list_extract(['list_documents', 'mcp.files.read_file', 'delete_rows', 'get_weather', 'write_note'], (event_id % 5 + 1)::INTEGER)"
_AUDIT = f"""WITH base AS (SELECT event_id AS trace_id, 's' || user_id::VARCHAR AS session_id, event_id, {_TOOL} AS tool_name, CASE WHEN event_type = 'error' THEN 'deny' WHEN event_id % 7 = 0 THEN 'needs_approval' ELSE 'allow' END AS status FROM events),
named AS (SELECT *, status = 'allow' AS executed, CASE WHEN status = 'allow' AND event_id % 3 = 0 THEN 'mcp' ELSE CASE tool_name WHEN 'mcp.files.read_file' THEN 'mcp' WHEN 'get_weather' THEN 'web' ELSE 'local' END END AS tool_source,
  CASE WHEN contains(tool_name, 'delete') THEN 'delete_file' WHEN contains(tool_name, 'write') THEN 'write_file' WHEN contains(tool_name, 'weather') THEN 'web_read' WHEN tool_name = 'list_documents' THEN 'read_db' WHEN contains(tool_name, 'file') THEN 'read_file' END AS tool_category, event_id % 7 = 0 AS requires_approval FROM base),
audit AS (SELECT trace_id, session_id, tool_name, tool_source, tool_category, status, requires_approval, false AS approved, executed, CASE WHEN event_id % 6 = 0 THEN true WHEN executed THEN event_id % 4 <> 0 END AS success,
  CASE WHEN tool_category IN ('write_file', 'delete_file') OR status = 'deny' THEN 'high' WHEN status = 'needs_approval' OR requires_approval THEN 'medium' ELSE 'low' END AS risk_level, status IN ('deny', 'needs_approval') AND NOT executed AS blocked FROM named)"""


@query(_AUDIT + " SELECT trace_id, session_id, tool_name, tool_source, tool_category, status, requires_approval, approved, executed, success, risk_level, blocked FROM audit")
def tool_audit_events(spark, sf_dir):
    return analytics.tool_audit(fx.traces(spark, sf_dir), fx.tools(spark)).drop("at")


@query(_AUDIT + """ SELECT count(*) AS total_count, count(*) FILTER (WHERE status = 'allow') AS allow_count, count(*) FILTER (WHERE status = 'deny') AS deny_count, count(*) FILTER (WHERE status = 'needs_approval') AS needs_approval_count, count(*) FILTER (WHERE approved) AS approved_count, count(*) FILTER (WHERE executed) AS executed_count, count(*) FILTER (WHERE blocked) AS blocked_count,
 count(*) FILTER (WHERE risk_level = 'high') AS high_risk_count, count(*) FILTER (WHERE risk_level = 'medium') AS medium_risk_count, count(*) FILTER (WHERE risk_level = 'low') AS low_risk_count, count(*) FILTER (WHERE tool_category IN ('write_file', 'delete_file')) AS write_delete_count FROM audit""")
def tool_audit_summary(spark, sf_dir):
    return analytics.audit_summary(analytics.tool_audit(fx.traces(spark, sf_dir), fx.tools(spark)))


@query(_AUDIT + " SELECT tool_category, risk_level, count(*) AS events FROM audit GROUP BY ALL")
def risk_levels(spark, sf_dir):
    return analytics.tool_audit(fx.traces(spark, sf_dir), fx.tools(spark)).groupBy("tool_category", "risk_level").agg(F.count("*").alias("events"))


@query(_AUDIT + " SELECT 'guardrail' AS step_type, count(*) AS steps, count(DISTINCT tool_name) AS tools FROM audit UNION ALL SELECT 'tool_call', count(*) FILTER (WHERE executed), count(DISTINCT CASE WHEN executed THEN tool_name END) FROM audit")
def step_type_counts(spark, sf_dir):
    return analytics.step_counts(fx.traces(spark, sf_dir))


@query("SELECT event_type AS query, count(*) AS samples, round(avg(value), 6) AS mean_ms, min(value) AS min_ms, max(value) AS max_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return _six(analytics.latency(fx.traces(spark, sf_dir), ["query"], "latency_ms"), "mean_ms", "p50_ms", "p95_ms")


@query("WITH r AS (SELECT event_id % 3 AS run_id, count(*) AS samples, avg(value) AS m, quantile_cont(value, 0.95) AS p FROM events GROUP BY 1) SELECT count(*) AS runs, sum(samples)::BIGINT AS samples, round(max(m) - min(m), 6) AS mean_spread, round(max(p) - min(p), 6) AS p95_spread FROM r")
def latency_stability(spark, sf_dir):
    return _six(analytics.stability(fx.traces(spark, sf_dir), "run_id", "latency_ms"), "mean_spread", "p95_spread")


# Evaluation


@query("WITH d AS (SELECT DISTINCT source AS label FROM documents), g AS (SELECT l.doc_id AS item_id, 'src' || (l.doc_id % 23)::VARCHAR AS label FROM labels l), c AS (SELECT label, count(*) AS items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids FROM g GROUP BY label) SELECT label, coalesce(items, 0) AS items, coalesce(item_ids, '') AS item_ids, CASE WHEN coalesce(items, 0) = 0 THEN 'missing' WHEN items < 2 THEN 'undercovered' WHEN items < 3 THEN 'minimum' ELSE 'target' END AS status, greatest(0, 2 - coalesce(items, 0))::BIGINT AS needed FROM d LEFT JOIN c USING (label)")
def gold_coverage(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(F.col("source").alias("label")).distinct()
    gold = fx.table(spark, sf_dir, "labels").selectExpr("doc_id as item_id", "concat('src', doc_id % 23) as label")
    return analytics.coverage(docs, gold)


@query("SELECT l.doc_id AS item_id, 'src' || (l.doc_id % 23)::VARCHAR AS label FROM labels l WHERE 'src' || (l.doc_id % 23)::VARCHAR NOT IN (SELECT DISTINCT source FROM documents)")
def unmatched_gold(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(F.col("source").alias("label"))
    return analytics.unmatched(fx.table(spark, sf_dir, "labels").selectExpr("doc_id as item_id", "concat('src', doc_id % 23) as label"), docs).select("item_id", "label")


def _graded(spark, sf_dir) -> DataFrame:
    """Documents as answers, judged against words of benchmark items."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("answer"), "lang", "source")
    gold = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("gold_id"), F.slice(text.tokens(F.col("text")), 1, 6).alias("w"))
    n = gold.agg(F.count("*").alias("n")).select("n").scalar()
    joined = docs.withColumn("gold_id", F.col("doc_id") % n).join(gold, "gold_id")
    one = lambda i: F.array(F.get("w", F.lit(i)))
    return joined.select(F.col("doc_id").alias("id"), "answer", F.array(F.array(F.get("w", F.lit(0)), F.get("w", F.lit(1))), one(2), one(3)).alias("must"), F.array(one(4)).alias("should"), F.array(one(5)).alias("must_not"), (F.col("doc_id") % 2).alias("citations"), F.col("lang").alias("expected_title"), F.array(F.concat("source", F.lit(" "), "lang")).alias("titles"), (F.col("doc_id") % 4 != 0).alias("verified"), F.lit(220).alias("max_words"))


_GRADED = r"""WITH n AS (SELECT count(*) AS n FROM benchmark), gold AS (SELECT item_id AS gold_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')[1:6] AS w FROM benchmark),
items AS (SELECT doc_id AS id, text AS answer, w, doc_id % 2 AS citations, doc_id % 4 <> 0 AS verified FROM documents, n JOIN gold ON gold_id = doc_id % n),
flat AS (SELECT *, trim(regexp_replace(lower(answer), '\s+', ' ', 'g')) AS f, ' ' || regexp_replace(trim(regexp_replace(lower(answer), '\s+', ' ', 'g')), '[^\p{L}\p{N}_-]+', ' ', 'g') || ' ' AS b, regexp_replace(lower(answer), '[^a-z0-9]+', '', 'g') AS c,
  len(list_filter(string_split(regexp_replace(answer, '\s+', ' ', 'g'), ' '), lambda x: x <> '')) AS nw, len(list_distinct(regexp_extract_all(answer, '\[(\d+)\]', 1))) AS cites FROM items),
hits AS (SELECT *, list_transform(w, lambda p: p <> '' AND CASE WHEN regexp_full_match(p, '[a-z0-9][a-z0-9-]{1,12}') THEN contains(b, ' ' || p || ' ') ELSE contains(f, p) OR contains(c, regexp_replace(p, '[^a-z0-9]+', '', 'g')) END) AS h FROM flat),
parts AS (SELECT *, (CASE WHEN h[1] OR h[2] THEN 1 ELSE 0 END + CASE WHEN h[3] THEN 1 ELSE 0 END + CASE WHEN h[4] THEN 1 ELSE 0 END) / 3.0::DOUBLE AS must, CASE WHEN h[5] THEN 1.0::DOUBLE ELSE 0 END AS should, h[6] AS bad FROM hits)"""


@query(_GRADED + " SELECT id, round(5 * must, 6) AS fact_score, round(5 * must + should + CASE WHEN cites > 0 AND citations > 0 THEN 1 ELSE 0 END + 1 + CASE WHEN verified THEN 1 ELSE 0 END + CASE WHEN contains(f, 'does not contain enough information') THEN 0 ELSE greatest(0, 1 - CASE WHEN bad THEN 0.75 ELSE 0 END - CASE WHEN nw > 220 THEN 0.25 ELSE 0 END) END, 6) AS score FROM parts")
def rubric_rag(spark, sf_dir):
    return _six(evaluate.rag_rubric(_graded(spark, sf_dir)), "fact_score", "score").select("id", "fact_score", "score")


@query(_GRADED + " SELECT id, round(5.5 * must + should + CASE WHEN cites > 0 AND citations > 0 THEN 1.5 ELSE 0 END + CASE WHEN contains(f, 'does not contain enough information') THEN 0 ELSE 2 - CASE WHEN bad THEN 1.5 ELSE 0 END - CASE WHEN nw > 180 THEN 0.5 ELSE 0 END END, 6) AS score FROM parts")
def rubric_answer(spark, sf_dir):
    return _six(evaluate.answer_rubric(_graded(spark, sf_dir)), "score").select("id", "score")


@query(_GRADED + " SELECT id, round(len(list_intersect([id % 3, id % 5], [1, 2]))::DOUBLE / 2 * 4 + len(list_filter(w, lambda p: contains(f, p) OR contains(c, regexp_replace(p, '[^a-z0-9]+', '', 'g'))))::DOUBLE / greatest(len(w), 1) * 6, 6) AS score FROM parts WHERE id % 3 <> id % 5")
def retrieval_recall(spark, sf_dir):
    items = _graded(spark, sf_dir).filter("id % 3 <> id % 5")
    words = F.flatten(F.concat("must", "should", "must_not"))
    rows = items.select("id", F.array(F.col("id") % 3, F.col("id") % 5).alias("expected_pages"), F.array(F.lit(1), F.lit(2)).cast("array<long>").alias("found_pages"), words.alias("keywords"), F.col("answer").alias("retrieved"))
    return _six(evaluate.retrieval_recall(rows), "score").select("id", "score")


@query(_GRADED + f""", scored AS (SELECT id, verified, CASE WHEN cites > 0 AND citations > 0 THEN 1 ELSE 0 END AS cited, {_has("lower(answer)", fixed.LEAK_MARKERS)} AS leak, bad, must < 0.99 AS missing, contains(f, 'does not contain enough information') AS abst, nw,
  5 * must + should + CASE WHEN cites > 0 AND citations > 0 THEN 1 ELSE 0 END + 1 + CASE WHEN verified THEN 1 ELSE 0 END + CASE WHEN contains(f, 'does not contain enough information') THEN 0 ELSE greatest(0, 1 - CASE WHEN bad THEN 0.75 ELSE 0 END - CASE WHEN nw > 220 THEN 0.25 ELSE 0 END) END AS score FROM parts),
failing AS (SELECT *, list_filter([CASE WHEN cited <= 0 THEN 'citation' END, CASE WHEN NOT verified THEN 'verification' END, CASE WHEN leak THEN 'raw_context_leak' END, CASE WHEN bad THEN 'focus_or_drift' END, CASE WHEN missing THEN 'missing_required_facts' END, CASE WHEN abst THEN 'abstention' END, CASE WHEN nw > 180 THEN 'too_verbose' END], lambda x: x IS NOT NULL) AS cats FROM scored WHERE score < 8 OR NOT verified)
SELECT category, count(*) AS failures, min(id) AS first_id FROM (SELECT id, unnest(CASE WHEN len(cats) = 0 THEN ['low_score_uncategorized'] ELSE cats END) AS category FROM failing) GROUP BY category""")
def failure_taxonomy(spark, sf_dir):
    scored = evaluate.rag_rubric(_graded(spark, sf_dir))
    items = scored.select("id", "score", "routing_score", "citation_score", "verified", "answer", F.when(F.col("fact_score") < 4.95, 1).otherwise(0).alias("missing"), evaluate.met(F.col("answer"), F.col("must_not")).alias("triggered"))
    return analytics.failure_taxonomy(items)


_ANSWERS = "ans AS (SELECT d.doc_id, d.text || CASE WHEN d.doc_id % 3 = 0 THEN ' [1] [4]' WHEN d.doc_id % 3 = 1 THEN ' [2]' ELSE '' END AS answer, CASE WHEN d.doc_id % 2 = 0 THEN 'Why is the model input used?' ELSE 'What is the architecture?' END AS query FROM documents d)"


def _answers(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 3 == 0, " [1] [4]").when(F.col("doc_id") % 3 == 1, " [2]").otherwise("")).alias("answer"), F.when(F.col("doc_id") % 2 == 0, "Why is the model input used?").otherwise("What is the architecture?").alias("query"), F.lit(3).alias("retrieved_count"))


@query(f"""WITH {_ANSWERS}, x AS (SELECT doc_id, answer, lower(answer) AS a, lower(query) AS q, list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda n: n::BIGINT) AS cited, len(list_filter(string_split(regexp_replace(answer, '\\s+', ' ', 'g'), ' '), lambda w: w <> '')) AS nw FROM ans),
f AS (SELECT doc_id, NOT contains(answer, '[') AS uncited, {_has("a", fixed.LEAK_MARKERS)} AS leak, len(list_filter(cited, lambda n: n < 1 OR n > 3)) > 0 AS bad_citation,
  {_has("a", fixed.BROAD_MARKERS)} OR regexp_matches(a, '(^|[^a-z0-9_])applications?:') OR (q LIKE 'what is%' AND nw > 120) AS unfocused,
  CASE WHEN contains(q, 'architecture') THEN NOT {_has("a", ["architecture", "framework", "component", "part", "module", "model"])} WHEN contains(q, 'model input') THEN NOT {_has("a", ["representation", "represent", "latent", "token", "patch", "compress"])} ELSE false END AS wrong_shape FROM x)
SELECT *, NOT (uncited OR leak OR bad_citation) AS grounded, CASE WHEN NOT (uncited OR leak OR bad_citation OR unfocused OR wrong_shape) THEN 'verified' ELSE 'needs_more_info' END AS status FROM f""")
def verifier_flags(spark, sf_dir):
    return evaluate.verifier_flags(_answers(spark, sf_dir)).select("doc_id", "uncited", "leak", "bad_citation", "unfocused", "wrong_shape", "grounded", "status")


_PLANS = ["hi", "What is the weather in Berlin?", "list tables", "show the feedback summary", "show recent traces", "preview table chunks", "list files in docs", "show file info for docs/a.md", "open the file notes.txt", "temperature today", "how does it work"]


@query("WITH p AS (SELECT event_id, list_extract([" + ", ".join("'" + p + "'" for p in _PLANS) + f"], (event_id % {len(_PLANS)} + 1)::INTEGER) AS query FROM events) SELECT event_id, query, list_extract(['direct_answer', 'tool_only', 'tool_only', 'tool_only', 'tool_only', 'tool_only', 'tool_only', 'tool_only', 'tool_only', 'tool_only', 'retrieve_only'], (event_id % {len(_PLANS)} + 1)::INTEGER) AS mode, list_extract(['', 'get_current_weather', 'mcp.sqlite.list_tables', 'mcp.sqlite.feedback_summary', 'mcp.sqlite.recent_traces', 'mcp.sqlite.preview_table', 'mcp.local_files.list_directory', 'mcp.local_files.file_info', 'mcp.local_files.read_text_file', 'get_current_weather', ''], (event_id % {len(_PLANS)} + 1)::INTEGER) AS tool_name FROM p")
def plan_classify(spark, sf_dir):
    asked = fx.table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, _PLANS)), (F.col("event_id") % len(_PLANS) + 1).cast("int")).alias("query"))
    return evaluate.planned(asked)


_PATHS = ["docs/a.md", "docs/.env", "etc/passwd", "data/x.csv", "docs/../k"]


@query("WITH c AS (SELECT event_id AS call_id, " + _TOOL + " AS tool_name, list_extract([" + ", ".join(f"'{p}'" for p in _PATHS) + """], (event_id // 5 % 5 + 1)::INTEGER) AS path, event_id % 3 = 0 AS approved FROM events)
SELECT call_id, tool_name, CASE tool_name WHEN 'delete_rows' THEN 'delete_file' WHEN 'write_note' THEN 'write_file' ELSE 'local_read' END AS category,
 CASE WHEN tool_name = 'mcp.files.read_file' AND path <> 'docs/a.md' THEN 'deny' WHEN tool_name IN ('delete_rows', 'write_note') AND path <> 'data/x.csv' THEN 'deny' WHEN tool_name = 'delete_rows' THEN 'deny' WHEN tool_name = 'write_note' AND NOT approved THEN 'needs_approval' ELSE 'allow' END AS status FROM c""")
def guardrail_decide(spark, sf_dir):
    tool = F.expr("element_at(array('list_documents', 'mcp.files.read_file', 'delete_rows', 'get_weather', 'write_note'), cast(event_id % 5 + 1 as int))")
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.floor(F.col("event_id") / 5) % 5 + 1).cast("int"))
    calls = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), tool.alias("tool_name"), path.alias("path"), (F.col("event_id") % 3 == 0).alias("approved"))
    return evaluate.guarded(calls, fx.tools(spark))


@query(f"WITH {_CHUNKS}, k AS (SELECT doc_id, chunk_index, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS line_key FROM chunks), b AS (SELECT *, lag(line_key) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS before FROM k) SELECT doc_id, chunk_index FROM b WHERE before IS NULL OR before <> line_key")
def consecutive_duplicates(spark, sf_dir):
    keyed = fx.chunks(spark, sf_dir).select("doc_id", "chunk_index", text.normalize(F.col("text")).alias("line_key"))
    return analytics.consecutive_distinct(keyed, "doc_id", "chunk_index", "line_key").select("doc_id", "chunk_index")


# Evidence and answers


def _evidence(spark, sf_dir) -> DataFrame:
    """The twenty best chunks of each question, as retrieved items; two kinds of questions."""
    asked = fx.questions(spark, sf_dir)
    worded = asked.select("query_id", F.concat(F.when(F.col("query_id") % 2 == 0, "what is ").otherwise("limitations of "), "query").alias("query"))
    found = _hits(asked, fx.chunks(spark, sf_dir), 20).join(worded, "query_id")
    return found.select("query_id", "query", "rank", "chunk_id", "title", "section_title", "text", (1.0 / (F.col("rank") + 60)).alias("hybrid_score"))


def _intents_sql(q: str) -> str:
    def group(words, terms):
        named = _has(q, words) + (f" OR (contains({q}, 'challenge') AND NOT regexp_matches({q}, '{fixed.PRACTICE_CHALLENGE}'))" if "limitation" in words else "")
        return f"CASE WHEN {named} THEN [" + ", ".join(f"'{t}'" for t in terms) + "] ELSE [] END"

    groups = [group(*pair) for pair in fixed.EVIDENCE_INTENTS]
    return f"list_distinct(flatten([{', '.join(groups)}]))"


_ESTOPS = ", ".join(f"'{w}'" for w in answer.EVIDENCE_STOPS)
_EVIDENCE = rf"""WITH {_CHUNKS}, {_ASKED}, {_HITS}, items AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'what is ' ELSE 'limitations of ' END || query AS query, rank, chunk_id, title, section_title, text FROM asked JOIN hits USING (query_id) JOIN chunks USING (chunk_id) WHERE rank <= 20),
prep AS (SELECT *, lower(section_title || ' ' || title || ' ' || text) AS ev, lower(section_title || ' ' || title) AS sec, list_distinct(list_filter(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 4 AND NOT list_contains([{_ESTOPS}], t))) AS eterms,
  list_filter(string_split(replace(lower(query), '?', ''), ' '), lambda t: length(t) >= 4 AND regexp_full_match(t, '[a-z][a-z0-9]+') AND NOT list_contains([{_ESTOPS}], t)) AS ws,
  list_filter([{", ".join(f"CASE WHEN contains(lower(query), '{m}') THEN rtrim(substr(lower(query), instr(lower(query), '{m}') + {len(m)}), '?') END" for m in (" about ", " say about ", " does ", " do "))}], lambda t: t IS NOT NULL AND contains(t, ' ')) AS tails, {_intents_sql("lower(query)")} AS its FROM items),
pairs AS (SELECT *, list_distinct(list_concat(tails, CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE [] END)) AS ps FROM prep),
rel AS (SELECT *, len(list_filter(eterms, lambda t: contains(ev, t))) AS overlap, len(list_filter(its, lambda t: contains(ev, t))) AS ihits,
  6 * len(list_filter(ps, lambda p: contains(sec, p))) + 3 * len(list_filter(ps, lambda p: contains(ev, p))) + 5 * len(list_filter(its, lambda t: contains(sec, t))) + 2 * len(list_filter(its, lambda t: contains(ev, t))) AS pp FROM pairs)"""


@query(_EVIDENCE + " SELECT query_id, chunk_id, overlap, overlap * 2 + pp + CASE WHEN len(eterms) > 0 AND overlap = len(eterms) THEN 4 ELSE 0 END AS relevance FROM rel")
def evidence_relevance(spark, sf_dir):
    out = answer.with_relevance(_evidence(spark, sf_dir))
    return out.select("query_id", "chunk_id", F.col("overlap").cast("long").alias("overlap"), F.col("relevance").cast("long").alias("relevance"))


#: Markers of the fixtures' invented prose.
_MARKERS = {"definition": [" the ", " of ", " and ", " is "], "limitation": ["the ", "and ", "in ", " of "]}


def _count(column: str, words: list[str]) -> str:
    return "(" + " + ".join("contains({}, '{}')::INTEGER".format(column, w.replace("'", "''")) for w in words) + ")"


_NUMBERED = r"least(4, len(regexp_extract_all(ev, '\b\d{1,2}\.\s+')))"


@query(_EVIDENCE + rf""", sc AS (SELECT *, CASE WHEN query LIKE 'what is%' THEN 'definition' ELSE 'limitation' END AS shape, CASE WHEN query LIKE 'what is%' THEN 14.0 ELSE 13.0 END AS threshold, CASE WHEN query LIKE 'what is%' THEN {_count("ev", _MARKERS["definition"])} ELSE {_count("ev", _MARKERS["limitation"])} END AS direct FROM rel),
s2 AS (SELECT *, overlap * 2 + pp + CASE WHEN len(eterms) > 0 AND overlap = len(eterms) THEN 4 ELSE 0 END AS relevance FROM sc),
s3 AS (SELECT *, relevance + direct * 3 + ihits * 2 + overlap * 2 + least(6, 20.0::DOUBLE / (rank + 60)) - CASE WHEN {_has("ev", answer.SPECULATIVE)} THEN 4 ELSE 0 END AS score FROM s2 WHERE (direct > 0 OR ihits >= 2) AND (len(eterms) = 0 OR overlap > 0 OR ihits >= 2)),
s4 AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM s3 WHERE score >= threshold),
s5 AS (SELECT * FROM s4 WHERE (score >= greatest(threshold, best * 0.45) OR place <= 3) AND place <= 8),
ok AS (SELECT query_id FROM s5 GROUP BY query_id, shape HAVING CASE WHEN shape = 'definition' THEN max(direct) >= 2 ELSE count(*) >= 2 OR max(direct) FILTER (WHERE place = 1) >= 3 END)
SELECT query_id, chunk_id, place, round(score, 6) AS score, CASE WHEN shape = 'definition' AND direct >= 6 THEN 'DEFINITIVE' WHEN direct >= 4 OR relevance >= 8 THEN 'MAIN_ANSWER' ELSE 'SUPPORTING_DETAIL' END AS label, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, place) AS "order" FROM s5 WHERE query_id IN (SELECT query_id FROM ok)""")
def evidence_fastpath(spark, sf_dir):
    out = answer.fast_path(_evidence(spark, sf_dir), markers=_MARKERS)
    return _six(out.select("query_id", "chunk_id", F.col("place").cast("long").alias("place"), "score", "label", F.col("order").cast("long").alias("order")), "score")


@query(_EVIDENCE + rf""", s2 AS (SELECT *, overlap * 2 + pp + CASE WHEN len(eterms) > 0 AND overlap = len(eterms) THEN 4 ELSE 0 END AS relevance FROM rel),
pre AS (SELECT *, len(eterms) > 0 AND (overlap >= least(2, len(eterms)) OR ihits >= 1) AS meets, count(*) OVER (PARTITION BY query_id) AS n FROM s2),
pf AS (SELECT *, relevance + 20.0::DOUBLE / (rank + 60) + CASE WHEN meets THEN 3 ELSE 0 END + CASE WHEN {_has("ev", fixed.PREFILTER_MARKERS)} THEN 1 ELSE 0 END AS prefilter FROM pre),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 10 OR rank <= 3 THEN 0 ELSE 1 END, CASE WHEN n <= 10 OR rank <= 3 THEN rank ELSE -prefilter END, rank) AS candidate FROM pf)
SELECT query_id, chunk_id, candidate, round(prefilter, 6) AS prefilter FROM c WHERE candidate <= 10""")
def evidence_prefilter(spark, sf_dir):
    out = answer.prefiltered(_evidence(spark, sf_dir))
    return _six(out.select("query_id", "chunk_id", F.col("candidate").cast("long").alias("candidate"), "prefilter"), "prefilter")


@query(_EVIDENCE + rf""", s2 AS (SELECT *, overlap * 2 + pp + CASE WHEN len(eterms) > 0 AND overlap = len(eterms) THEN 4 ELSE 0 END AS relevance FROM rel),
pre AS (SELECT *, len(eterms) > 0 AND (overlap >= least(2, len(eterms)) OR ihits >= 1) AS meets, count(*) OVER (PARTITION BY query_id) AS n FROM s2),
pf AS (SELECT *, relevance + 20.0::DOUBLE / (rank + 60) + CASE WHEN meets THEN 3 ELSE 0 END + CASE WHEN {_has("ev", fixed.PREFILTER_MARKERS)} THEN 1 ELSE 0 END AS prefilter FROM pre),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 10 OR rank <= 3 THEN 0 ELSE 1 END, CASE WHEN n <= 10 OR rank <= 3 THEN rank ELSE -prefilter END, rank) AS candidate FROM pf),
judged AS (SELECT *, CASE WHEN overlap >= 2 THEN 'MAIN_ANSWER' WHEN overlap = 1 THEN 'BACKGROUND' ELSE 'IRRELEVANT' END AS label FROM c WHERE candidate <= 10),
kept AS (SELECT *, CASE WHEN label = 'MAIN_ANSWER' THEN 0 ELSE 2 END AS stage FROM judged WHERE label = 'MAIN_ANSWER' OR (label = 'BACKGROUND' AND meets)),
chosen AS (SELECT query_id, chunk_id, label, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, stage, candidate) AS o FROM kept),
rest AS (SELECT query_id, chunk_id, NULL AS label, row_number() OVER (PARTITION BY query_id ORDER BY prefilter DESC, rank) AS o FROM pf WHERE prefilter > 0 AND query_id NOT IN (SELECT query_id FROM chosen))
SELECT query_id, chunk_id, o AS "order", label FROM (SELECT * FROM chosen UNION ALL SELECT * FROM rest) WHERE o <= 8""")
def evidence_merge(spark, sf_dir):
    """Judgements of a model that failed for every candidate."""
    items = _evidence(spark, sf_dir)
    judged = answer.prefiltered(items).withColumn("label", F.lit(None).cast("string"))
    return answer.merged_judgements(judged, answer.with_prefilter_score(items)).withColumn("order", F.col("order").cast("long"))


@query(_EVIDENCE + rf""", top AS (SELECT query_id, query, lower(string_agg(text, ' ' ORDER BY rank)) AS body FROM items WHERE rank <= 3 GROUP BY query_id, query),
t AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 3 AND NOT list_contains([{_ESTOPS}], t))) AS ts FROM top),
m AS (SELECT *, len(list_filter(ts, lambda t: contains(body, t))) AS matched FROM t)
SELECT query_id, query, matched, round(matched::DOUBLE / greatest(len(ts), 1), 6) AS overlap_ratio, round(least(1.0, matched::DOUBLE / greatest(len(ts), 1) + CASE WHEN contains(body, lower(query)) THEN 0.2 ELSE 0 END), 6) AS quality,
 len(ts) = 0 OR contains(body, lower(query)) OR matched::DOUBLE / greatest(len(ts), 1) >= CASE WHEN regexp_matches(query, 'types|categories|list|kinds') THEN 0.25 WHEN regexp_matches(query, 'safety|risk|concern|trustworthiness') THEN 0.45 WHEN regexp_matches(query, 'instruction|follow') THEN 0.35 ELSE 0.45 END AS sufficient FROM m""")
def evidence_sufficiency(spark, sf_dir):
    out = answer.sufficiency(_evidence(spark, sf_dir))
    return _six(out.withColumn("matched", F.col("matched").cast("long")), "overlap_ratio", "quality")


@query()
def evidence_facts(spark, sf_dir):
    return answering.fact_list(_evidence(spark, sf_dir))


@query()
def extractive_answers(spark, sf_dir):
    return answer.extractive(answering.fact_list(_evidence(spark, sf_dir)))


@query()
def full_pipeline(spark, sf_dir):
    docs, chunks = fx.routing_documents(spark, sf_dir), fx.chunks(spark, sf_dir)
    return lifecycle.ask(fx.questions(spark, sf_dir), docs, chunks, doc_index=_routing_index(docs), chunk_index=_chunk_index(chunks))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, sum(value::DECIMAL(18, 2))::DOUBLE AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    return streaming.windowed(events.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
