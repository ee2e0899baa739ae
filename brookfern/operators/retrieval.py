"""Batch retrieval: many queries against many chunks as equi-joins on terms and documents.

Conventions: queries (query_id, query), chunks (chunk_id, doc_id, title, page_number,
chunk_index, section_title, text), scopes (query_id, doc_id), rankings (query_id, chunk_id, score, rank).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed, sentences, text
from ..session import share_package, written
from . import postings


def ranked(df: DataFrame, keys: list[str], order: list[Column], limit: int | None = None, name: str = "rank") -> DataFrame:
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if limit is None else out.filter(F.col(name) <= limit)


def query_terms(queries: DataFrame, terms: Column | None = None) -> DataFrame:
    """(query_id, term, times)"""
    words = text.tokens(F.col("query")) if terms is None else terms
    return queries.select("query_id", F.explode(words).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def bm25(items: DataFrame, key: str, body: Column, terms: DataFrame, index: postings.Index | None = None) -> DataFrame:
    """(query_id, key, score) of every item that shares a term with the query.

    items: one row per ``key``; terms: (query_id, term, times).  Items are split once into an index, unless one is given."""
    return postings.scores(index or postings.build(items, key, body), key, terms)


def numbered_scopes(scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, scope_id) and (scope_id, doc_id): queries with the same documents share a scope.

    A scope is known by count, sum and xor of hashes of its documents, so no list of documents is gathered."""
    mark = F.xxhash64("doc_id")
    signed = scope.distinct().groupBy("query_id").agg(F.count("*").alias("n"), F.sum(mark.cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "doc_id")).alias("x"))
    asked = signed.select("query_id", F.xxhash64("n", "s", "x").alias("scope_id"))
    first = asked.groupBy("scope_id").agg(F.min("query_id").alias("query_id"))
    return asked, scope.distinct().join(first, "query_id").select("scope_id", "doc_id")


def _weighed(hit: DataFrame, keys: list[str], mean: Column) -> DataFrame:
    norm = F.col("tf") + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * F.col("length") / mean)
    part = F.col("times") * F.col("idf") * F.col("tf") * (fixed.BM25_K1 + 1) / norm
    return hit.groupBy(*keys).agg(F.sum(part).alias("score"))


def bm25_scoped(chunks: DataFrame, terms: DataFrame, asked: DataFrame, members: DataFrame, index: postings.Index | None = None) -> DataFrame:
    """(query_id, chunk_id, score) with the statistics of each query's own scope, made once for each scope.

    Term counts are made inside the rows of chunks, or read from an index of them that carries doc_id."""
    counts = postings.counted(chunks, F.col("text"), "chunk_id", "doc_id") if index is None else index.forward
    # Term counts are dealt out by document once, and counted by scope once; several steps read both.
    inside = written(counts.join(members, "doc_id").select("chunk_id", "scope_id", "length", "counts"))
    found = inside.select("chunk_id", "scope_id", "length", F.explode("counts").alias("c")).select("chunk_id", "scope_id", "length", "c.term", "c.tf")
    size = inside.groupBy("scope_id").agg(F.count("*").alias("n"))
    frequency = written(found.groupBy("scope_id", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("times")))
    idf = frequency.join(size, "scope_id").withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floors = idf.groupBy("scope_id").agg((F.avg("idf") * fixed.BM25_EPSILON).alias("floor"), (F.sum("times") / F.first("n")).alias("mean_length"))
    wanted = terms.join(asked, "query_id")
    # Only rows of asked terms are met: the weights are a few rows a query, and a table whose size is known.
    idf = idf.select("scope_id", "term", "idf").join(floors, "scope_id").select("scope_id", "term", "mean_length", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"))
    hit = found.join(written(wanted.join(idf, ["scope_id", "term"])), ["scope_id", "term"])
    return _weighed(hit, ["query_id", "chunk_id"], F.col("mean_length"))


def sparse_scores(chunks: DataFrame, queries: DataFrame, scope: DataFrame, index: postings.Index | None = None) -> DataFrame:
    """BM25 within each query's scope plus substring boosts; every chunk of the scope keeps a row, without its texts.

    scope: (query_id, doc_id).  A chunk is lower-cased once, not once for each query."""
    # Both are small next to the chunks; as tables their size is known where joins with chunks are planned.
    asked, members = map(written, numbered_scopes(scope))
    lexical = bm25_scoped(chunks, query_terms(queries), asked, members, index)
    section = F.lower(F.coalesce("section_title", F.lit("")))
    whole = F.lower(F.concat_ws(" ", F.coalesce("section_title", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    lowered = chunks.join(members, "doc_id").select("scope_id", "chunk_id", "title", "page_number", "chunk_index", section.alias("low_section"), whole.alias("low_whole"))
    wanted = queries.join(asked, "query_id").select("scope_id", "query_id", F.array_distinct(text.tokens(F.col("query"))).alias("terms"), text.focus_phrases(F.col("query")).alias("phrases"))
    rows = _boosted(lowered, wanted)
    return rows.join(lexical, ["query_id", "chunk_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)) + F.col("boost")).drop("boost")


def _boosted(lowered: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row for each query of a chunk's scope: 8 a phrase in its section title, else 5 in its whole text; 1.25 and 0.25 a term.

    The queries, a stated set, go to every task; what the queries of a scope look for is looked for once in a chunk."""
    share_package(lowered.sparkSession)
    shipped = lowered.sparkSession.sparkContext.broadcast([tuple(r) for r in wanted.collect()])
    kept = [c for c in lowered.columns if c not in ("scope_id", "low_section", "low_whole")]
    asked_by = to_arrow_type(wanted.schema["query_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scopes: dict = {}
        for scope, query, terms, phrases in shipped.value:
            scopes.setdefault(scope, []).append((query, terms or [], phrases or []))
        sought = {}
        for scope, own in scopes.items():
            units = list(dict.fromkeys(u for _, terms, phrases in own for u in (*terms, *phrases)))
            at = {u: i for i, u in enumerate(units)}
            titled, elsewhere = np.zeros((2, len(units), len(own)))
            for q, (_, terms, phrases) in enumerate(own):
                for found, a, b in ((phrases, 8.0, 5.0), (terms, 1.25, 0.25)):
                    for u in found:
                        titled[at[u], q] += a
                        elsewhere[at[u], q] += b
            sought[scope] = pa.array([query for query, *_ in own], asked_by), units, titled, elsewhere
        for batch in batches:
            of: dict = {}
            for i, scope in enumerate(batch.column("scope_id").to_pylist()):
                of.setdefault(scope, []).append(i)
            sections, wholes = batch.column("low_section").to_pylist(), batch.column("low_whole").to_pylist()
            for scope, places in of.items():
                if scope not in sought:
                    continue
                ids, units, titled, elsewhere = sought[scope]
                level = np.array([[2 if u in sections[i] else 1 if u in wholes[i] else 0 for u in units] for i in places], np.int8).reshape(len(places), len(units))
                boost = (level == 2).astype(float) @ titled + (level == 1).astype(float) @ elsewhere
                row, q = pa.array(np.repeat(places, len(ids))), pa.array(np.tile(np.arange(len(ids)), len(places)))
                yield pa.RecordBatch.from_arrays([ids.take(q), *(batch.column(c).take(row) for c in kept), pa.array(boost.ravel())], ["query_id", *kept, "boost"])

    kinds = [wanted.schema["query_id"], *(lowered.schema[c] for c in kept)]
    return lowered.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", boost double")


def sparse_topk(chunks: DataFrame, queries: DataFrame, scope: DataFrame, limit: int, index: postings.Index | None = None) -> DataFrame:
    """The best chunks of each query, with the columns of ``chunks``."""
    order = [F.desc(F.round("score", 9)), F.col("title"), F.col("page_number"), F.col("chunk_index"), F.col("chunk_id")]
    best = ranked(sparse_scores(chunks, queries, scope, index), ["query_id"], order, limit).select("query_id", "chunk_id", "score", "rank")
    return written(best).join(chunks, "chunk_id")


def unit(vector: Column) -> Column:
    doubled = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(doubled, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(doubled, lambda x: x / norm)).otherwise(doubled)


#: Queries that meet a row of vectors at once; queries and rows of one tile of products.
QUERY_BLOCK, TILE_QUERIES, TILE_ROWS = 64, 4096, 1024


def _plain(vector: Column) -> Column:
    """A vector of finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def cosine_scores(vectors: DataFrame, asked: DataFrame, key: str, group: str | None = None, keep: int | None = None) -> DataFrame:
    """(query_id, key, score): cosine of each query vector with every vector.

    ``asked`` (query_id, vector) is a stated query set; blocks of queries are dealt to the vectors by their number, so neither
    side is broadcast by force.  keep: only the best so many of each query (and group) are wanted, ties to the smaller key;
    then plain vectors of one length meet as matrices, and a tile keeps the best of each query before anything is dealt out."""
    more = [group] if group else []
    if keep is None:
        return _cosine_pairs(vectors, asked, key, more)
    order = [F.desc(F.round("score", 9)), F.col(key)]
    sizes = asked.filter(_plain(F.col("vector"))).agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if sizes.low is None or sizes.low != sizes.high:
        return ranked(_cosine_pairs(vectors, asked, key, more), ["query_id", *more], order, keep, "kept").drop("kept")
    plain = _plain(F.col("vector")) & (F.size("vector") == sizes.low)
    best = _cosine_tiles(vectors.filter(plain), asked.filter(plain), key, more, keep)
    # Vectors that are null, of another length or hold anything but numbers: pair by pair, each pair once.
    odd = _cosine_pairs(vectors.filter(~plain), asked, key, more).unionByName(_cosine_pairs(vectors.filter(plain), asked.filter(~plain), key, more))
    return ranked(best.unionByName(odd), ["query_id", *more], order, keep, "kept").drop("kept")


def _cosine_tiles(vectors: DataFrame, asked: DataFrame, key: str, more: list[str], keep: int) -> DataFrame:
    """The best ``keep`` of each query (and group) in each tile of rows and queries."""
    share_package(vectors.sparkSession)
    blocks = max(1, -(-asked.count() // TILE_QUERIES))
    tiles = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() // (16 * TILE_ROWS)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select(key, *more, unit(F.col("vector")).alias("unit"), F.pmod(F.xxhash64(key), F.lit(tiles)).cast("int").alias("tile"), spread(blocks).alias("block"))
    own = asked.select("query_id", unit(F.col("vector")).alias("unit"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), spread(tiles).alias("tile"))
    names = ["query_id", key, *more, "score"]
    kinds = {"query_id": own.schema["query_id"].dataType, **{c: rows.schema[c].dataType for c in (key, *more)}, "score": T.DoubleType()}
    arrow = [to_arrow_type(kinds[c]) for c in names]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in arrow], names)
        matrix = lambda t: t.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        right = right.combine_chunks()
        # Rows in the order of their key: of equal scores the first ones stay.
        left = left.sort_by([(key, "ascending")]).combine_chunks()
        labels = left.column(more[0]).to_pylist() if more else [None] * left.num_rows
        of: dict = {}
        for i, label in enumerate(labels):
            of.setdefault(label, []).append(i)
        u, v, found = matrix(left), matrix(right), []
        for members in map(np.array, of.values()):
            for a in range(0, len(v), TILE_ROWS):
                score = v[a : a + TILE_ROWS] @ u[members].T
                first = np.argsort(-np.rint(score * 1e9), axis=1, kind="stable")[:, :keep]
                q = np.repeat(np.arange(len(score)), first.shape[1])
                found.append((q + a, members[first.ravel()], score[q, first.ravel()]))
        q, i, score = (np.concatenate(x) for x in zip(*found, strict=True))
        held = [right.column("query_id").take(pa.array(q)), *(left.column(c).take(pa.array(i)) for c in (key, *more)), pa.chunked_array([pa.array(score)])]
        return pa.table([c.cast(t) for c, t in zip(held, arrow, strict=True)], names)

    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in names)
    return rows.groupBy("block", "tile").cogroup(own.groupBy("block", "tile")).applyInArrow(run, schema)


def _cosine_pairs(vectors: DataFrame, asked: DataFrame, key: str, more: list[str]) -> DataFrame:
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    dealt = asked.select(block.alias("block"), F.struct("query_id", unit(F.col("vector")).alias("unit")).alias("q")).groupBy("block").agg(F.collect_list("q").alias("qs"))
    own = vectors.select(key, *more, unit(F.col("vector")).alias("unit"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = own.join(dealt, "block").select(key, *more, F.explode(F.transform("qs", lambda q: F.struct(q["query_id"].alias("query_id"), dot(F.col("unit"), q["unit"]).alias("score")))).alias("s"))
    return pairs.select("s.query_id", key, *more, "s.score")


def topk_per_group(scores: DataFrame, group: str, key: str, limit: int, per_group: int) -> DataFrame:
    """Best ``per_group`` of each group first, then the best ``limit`` of those."""
    order = [F.desc(F.round("score", 9)), F.col(key)]
    inner = ranked(scores, ["query_id", group], order, per_group, "group_rank").drop("group_rank")
    return ranked(inner, ["query_id"], order, limit)


def rrf(dense: DataFrame, sparse: DataFrame, limit: int, k: int = fixed.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, chunk_id, rank); ties keep first-seen order."""
    both = (
        dense.filter("chunk_id is not null").select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
        .join(sparse.filter("chunk_id is not null").select("query_id", "chunk_id", F.col("rank").alias("sparse_rank")), ["query_id", "chunk_id"], "full")
    )
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", part("dense_rank") + part("sparse_rank"))
    order = [F.desc("score"), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), F.col("chunk_id")]
    return ranked(scored, ["query_id"], order, limit)


def _tagged(values: Column, name: str, tag: str | int, tag_name: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(tag).alias(tag_name), v.alias(name)))


def query_patterns(queries: DataFrame) -> DataFrame:
    """(query_id, kind, pattern): the whole query, its phrases of two to four words, and its distinctive terms."""
    # Words stand in columns of their own: what is read many times is worked out once, and code stays small.
    words = text.without(text.ascii_words(F.lower("query"), "a-z0-9", "a-z0-9-"), fixed.ROUTE_PHRASE_STOPS)
    distinct = F.filter(text.ascii_words(F.col("query"), "A-Za-z", "A-Za-z0-9_-"), lambda w: (F.length(w) >= 4) & w.rlike("[A-Z0-9_-]") & ~F.lower(w).isin(fixed.DISTINCTIVE_STOPS))
    asked = queries.select("query_id", F.lower("query").alias("q"), words.alias("words"), F.transform(distinct, text.phrase_form).alias("named"))
    asked = asked.withColumns({f"of{n}": text.ngrams(F.col("words"), n) for n in (2, 3, 4)})
    phrases = F.filter(F.array_distinct(F.transform(F.concat("of4", "of3", "of2"), text.phrase_form)), lambda p: F.length(p) >= 7)
    terms = F.filter(F.array_distinct("named"), lambda t: t != "")
    kinds = {"whole": F.array("q"), "phrase": phrases, "term": terms}
    marked = F.concat(*(_tagged(ps, "pattern", kind, "kind") for kind, ps in kinds.items()))
    return asked.select("query_id", F.explode(marked).alias("m")).select("query_id", "m.kind", "m.pattern").filter("pattern <> ''")


#: Patterns searched in one pass over the documents; more take further passes.
MOST_PATTERNS = 200_000


def pattern_points(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(query_id, doc_id, points): what the patterns of each query add to a document.

    A batch of questions is a stated query set, so its distinct patterns go to every task, and one pass over each
    document finds all of them at once.  The whole query: 2 in the title, 4 in the content; a phrase: 10 in
    the title, else 8 in the section titles, else 12 anywhere; a term (as words): 40, 30, 24 in the path, 36 anywhere."""
    spark = docs.sparkSession
    wanted = sorted((r.kind, r.pattern) for r in patterns.select("kind", "pattern").distinct().collect())
    fields = docs.select("doc_id", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "source_path", "section_titles", "content")))
    kind_of = docs.schema["doc_id"].dataType.simpleString()

    def search(chosen: list[tuple[str, str]]):
        shipped = spark.sparkContext.broadcast(chosen)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shipped.value
            raw = _matcher({p: [i] for i, (kind, p) in enumerate(own) if kind == "whole"})
            plain: dict[str, list[int]] = {}
            for i, (kind, p) in enumerate(own):
                if kind != "whole":
                    plain.setdefault(p if kind == "phrase" else f" {p} ", []).append(i)
            form = _matcher(plain)
            tidy = lambda t: f" {re.sub(r'[^a-z0-9]+', ' ', t.lower()).strip()} "
            for batch in batches:
                ids, which, points = [], [], []
                for d, title, path, sections, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found: dict[int, float] = {}
                    for body, worth in ((title, 2.0), (content, 4.0)):
                        for i in raw(body.lower()):
                            found[i] = found.get(i, 0.0) + worth
                    low = [x.lower() for x in (title, path, sections, content)]
                    for body, phrase, term in ((title, 10.0, 40.0), (sections, 8.0, 30.0), (path, None, 24.0), (" ".join(low), 12.0, 36.0)):
                        for i in form(tidy(body)):
                            worth = phrase if own[i][0] == "phrase" else term
                            if worth is not None:
                                found.setdefault(i, worth)
                    ids += [d] * len(found)
                    which += found.keys()
                    points += found.values()
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array([own[i][0] for i in which], pa.string()), pa.array([own[i][1] for i in which], pa.string()), pa.array(points, pa.float64())], ["doc_id", "kind", "pattern", "points"])

        return fields.mapInArrow(run, f"doc_id {kind_of}, kind string, pattern string, points double")

    found = search(wanted[:MOST_PATTERNS])
    for at in range(MOST_PATTERNS, len(wanted), MOST_PATTERNS):
        found = found.unionAll(search(wanted[at : at + MOST_PATTERNS]))
    return found.join(patterns, ["kind", "pattern"]).groupBy("query_id", "doc_id").agg(F.sum("points").alias("points"))


def _matcher(patterns: dict[str, list[int]]):
    """A function from a text to the numbers of the patterns that are substrings of it."""
    if not patterns:
        return lambda body: set()
    try:
        import ahocorasick
    except ImportError:
        return lambda body: {i for p, numbers in patterns.items() if p in body for i in numbers}
    automaton = ahocorasick.Automaton()
    for p, numbers in patterns.items():
        automaton.add_word(p, numbers)
    automaton.make_automaton()
    return lambda body: {i for _, numbers in automaton.iter(body) for i in numbers}


def routing_body() -> Column:
    """What BM25 reads of a document that is routed to."""
    base = F.regexp_extract("source_path", r"([^/]*)$", 1)
    return F.concat_ws(" ", "title", base, F.coalesce("section_titles", F.lit("")), "content")


def route_documents(docs: DataFrame, queries: DataFrame, top_n: int = 3, index: postings.Index | None = None) -> DataFrame:
    """Top documents of each query: BM25 plus title, section, path, content and coverage boosts and those of ``pattern_points``.

    docs: doc_id, title, source_path, section_titles, content (one row a document).  Documents that share nothing
    with a query are not ranked."""
    own = queries.select("query_id", "query", text.content_tokens(F.col("query")).alias("content"))
    asked = own.select("query_id", F.when(F.size("content") > 0, F.col("content")).otherwise(text.tokens(F.col("query"))).alias("words"))
    terms = asked.select("query_id", F.explode("words").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    lexical = bm25(docs, "doc_id", routing_body(), terms, index)
    # Where each asked term stands in a document: all fields of a document are split in one pass.
    places = {"in_title": "title", "in_sections": "section_titles", "in_path": "source_path", "in_content": "content"}
    tagged = F.concat(*(_tagged(text.tokens(F.coalesce(F.col(c), F.lit(""))), "term", i, "field") for i, c in enumerate(places.values())))
    spots = docs.select("doc_id", F.explode(tagged).alias("t")).select("doc_id", "t.term", "t.field").join(terms.select("term").distinct(), "term", "left_semi")
    spots = spots.groupBy("doc_id", "term").agg(*(F.count_if(F.col("field") == i).alias(name) for i, name in enumerate(places)))
    hit = terms.join(spots, "term")
    has = lambda c, worth: F.when(F.col(c) > 0, worth).otherwise(0.0)
    frequent = 0.75 + F.least(F.lit(2.5), F.log1p("in_content")) + F.when(F.length("term") >= 6, 1.25).otherwise(0.0)
    value = has("in_title", 8.0) + has("in_sections", 4.0) + has("in_path", 2.0) + has("in_content", frequent)
    titled = has("in_title", 1) + has("in_sections", 1)
    boosts = hit.groupBy("query_id", "doc_id").agg(F.sum(value * F.col("times")).alias("boost"), F.sum(titled * F.col("times")).alias("titled"), F.sum(has("in_content", 1)).alias("matched"))
    size = asked.select("query_id", F.size(F.array_distinct("words")).alias("asked"))
    extra = pattern_points(docs, query_patterns(queries))
    scored = boosts.join(lexical, ["query_id", "doc_id"], "left").join(extra, ["query_id", "doc_id"], "full").join(size, "query_id")
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = number("score") + number("boost") + number("matched") / F.greatest("asked", F.lit(1)) * 14.0 + F.least(F.lit(10.0), number("titled") * 2.5) + number("points")
    return ranked(scored.select("query_id", "doc_id", score.alias("routing_score")), ["query_id"], [F.desc(F.round("routing_score", 9)), F.col("doc_id")], top_n)


def candidate_scope(routed: DataFrame) -> DataFrame:
    """Only the first document if it leads by 5 % or by 3 points; else all routed ones."""
    w = Window.partitionBy("query_id")
    first = F.max(F.when(F.col("rank") == 1, F.col("routing_score"))).over(w)
    second = F.max(F.when(F.col("rank") == 2, F.col("routing_score"))).over(w)
    alone = second.isNull() | (first >= second * 1.05) | (first - second >= 3.0)
    return routed.withColumn("alone", alone).filter(~F.col("alone") | (F.col("rank") == 1)).drop("alone")


def scope_intersect(selected: DataFrame, accessible: DataFrame) -> DataFrame:
    return selected.join(accessible.select("doc_id").distinct(), "doc_id", "left_semi")


def neighbours(anchors: DataFrame, chunks: DataFrame, window: int = 2) -> DataFrame:
    """Chunks up to ``window`` places around each anchor (query_id, doc_id, chunk_index): offsets exploded to an equi-join."""
    spots = anchors.select("query_id", "doc_id", F.col("chunk_index").alias("anchor_index"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - window), F.col("chunk_index") + window)).alias("chunk_index"))
    return spots.join(chunks, ["doc_id", "chunk_index"])


def overlap(terms: Column, body: Column) -> Column:
    lower = F.lower(F.coalesce(body, F.lit("")))
    return F.size(F.filter(terms, lambda t: lower.contains(t)))


def section_context(anchors: DataFrame, chunks: DataFrame, queries: DataFrame, per_anchor: int = 2) -> DataFrame:
    """Best chunks of each anchor's section by query terms in the text, anchors themselves left out."""
    terms = queries.select("query_id", text.meaningful_terms(F.col("query")).alias("terms"))
    named = anchors.filter("coalesce(section_title, '') <> ''").select("query_id", F.col("chunk_id").alias("anchor_id"), "doc_id", "section_title").join(terms, "query_id")
    named = written(named)  # a few rows a query: their size is known where the chunks are joined
    found = named.join(chunks, ["doc_id", "section_title"]).join(anchors.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    scored = found.withColumn("overlap", overlap(F.col("terms"), F.col("text"))).filter("overlap > 0")
    return ranked(scored, ["query_id", "anchor_id"], [F.desc("overlap"), F.col("chunk_index"), F.col("chunk_id")], per_anchor)


def title_sections(anchors: DataFrame, chunks: DataFrame, queries: DataFrame, limit: int = 6) -> DataFrame:
    """Chunks of the anchors' documents whose section title holds a query term: 5 points a term there, 1 in the text."""
    terms = queries.select("query_id", text.meaningful_terms(F.col("query")).alias("terms"))
    docs = written(anchors.select("query_id", "doc_id").distinct().join(terms, "query_id"))
    found = docs.join(chunks, "doc_id").withColumn("in_title", overlap(F.col("terms"), F.col("section_title"))).filter("in_title > 0")
    found = found.join(anchors.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    scored = found.withColumn("score", F.col("in_title") * 5 + overlap(F.col("terms"), F.col("text")))
    return ranked(scored, ["query_id"], [F.desc("score"), F.col("doc_id"), F.col("chunk_index")], limit)


def parent_windows(anchors: DataFrame, chunks: DataFrame, radius: int = 3, budget: int = 4200) -> DataFrame:
    """One text per anchor window: chunks in order, cut at the character budget."""
    near = neighbours(anchors, chunks, radius)
    before = Window.partitionBy("query_id", "doc_id", "anchor_index").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    cut = near.withColumn("left", left).filter((F.col("left") >= F.length("text")) | (F.col("left") > 300)).withColumn("piece", F.expr("substring(text, 1, cast(left as int))"))
    return cut.groupBy("query_id", "doc_id", "anchor_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "piece"))), lambda s: s["piece"]), "\n").alias("text"),
        F.min("chunk_index").alias("first_index"),
        F.max("chunk_index").alias("last_index"),
    )


#: Characters of a parent text, and of one chunk around what the query is about.
PARENT_BUDGET, EXCERPT = 4200, 2200


def surrounded(hits: DataFrame, chunks: DataFrame, window: int = 2) -> DataFrame:
    """Each hit (query_id, doc_id, chunk_index, rank) with its neighbours, those before it first, each chunk once; ``place`` numbers them."""
    own = hits.select("query_id", "doc_id", F.col("chunk_index").alias("anchor_index"), "rank", F.explode(F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - window), F.col("chunk_index") + window)).alias("chunk_index"))
    role = F.when(F.col("chunk_index") == F.col("anchor_index"), 0).when(F.col("chunk_index") < F.col("anchor_index"), 1).otherwise(2)
    near = own.withColumn("role", role).join(chunks, ["doc_id", "chunk_index"])
    first = ranked(near, ["query_id", "chunk_id"], [F.col("rank"), F.col("role")], 1, "copy").drop("copy")
    base = ranked(first, ["query_id"], [F.col("rank"), F.col("role"), F.col("chunk_index")], name="place")
    return base


def expanded(hits: DataFrame, chunks: DataFrame, queries: DataFrame, limit: int = 24, window: int = 2) -> DataFrame:
    """(query_id, place, chunk_id, doc_id, chunk_index, source) of the hits with their context, each chunk once.

    Each hit with its neighbours, those before it first; then, for every one of these, the two best chunks of its section that
    are not there yet; then the six best chunks whose section title holds a query term.  Chunks of one section are ranked
    once: its first item takes the first two, the next one the next two."""
    listing = ["title", "page_number", "chunk_index"]
    base = surrounded(hits, chunks, window)
    base = base.withColumn("source", F.when(F.col("role") == 0, "hit").otherwise("neighbor"))
    seen = base.select("query_id", "chunk_id")
    terms = queries.select("query_id", F.array_distinct(text.without(text.tokens(F.col("query")), fixed.SECTION_STOPS, 4)).alias("terms"), text.meaningful_terms(F.col("query")).alias("meant"))

    named = base.filter("coalesce(section_title, '') <> ''")
    order = ranked(named, ["query_id", "doc_id", "section_title"], [F.col("place")], name="turn").select("query_id", "doc_id", "section_title", "turn", F.col("place").alias("after"))
    sections = order.select("query_id", "doc_id", "section_title").distinct().join(terms, "query_id")
    pool = sections.join(chunks, ["doc_id", "section_title"]).join(seen, ["query_id", "chunk_id"], "left_anti")
    pool = pool.withColumn("overlap", overlap(F.col("terms"), F.concat_ws(" ", "section_title", "text"))).filter("overlap > 0")
    pool = ranked(pool, ["query_id", "doc_id", "section_title"], [F.desc("overlap"), *map(F.col, listing)], name="n").withColumn("turn", F.ceil(F.col("n") / 2).cast("int"))
    extra = pool.join(order, ["query_id", "doc_id", "section_title", "turn"]).withColumn("source", F.lit("section_context"))

    taken = seen.unionByName(extra.select("query_id", "chunk_id"))
    docs = base.groupBy("query_id", "doc_id").agg(F.min("place").alias("doc_place")).join(terms, "query_id")
    titled = docs.join(chunks, "doc_id").withColumn("in_title", overlap(F.col("meant"), F.col("section_title"))).filter("in_title > 0").join(taken, ["query_id", "chunk_id"], "left_anti")
    titled = titled.withColumn("points", F.col("in_title") * 5 + overlap(F.col("meant"), F.col("text")))
    titled = ranked(titled, ["query_id"], [F.desc("points"), F.col("doc_place"), *map(F.col, listing)], 6, "n").withColumn("source", F.lit("section_title_match"))

    part = lambda df, number, *by: df.select("query_id", "chunk_id", "doc_id", "chunk_index", "source", F.lit(number).alias("part"), *(c.alias(f"by{i}") for i, c in enumerate(by)))
    nought = F.lit(0)
    every = part(base, 0, F.col("place"), nought).unionByName(part(extra, 1, F.col("after"), F.col("n"))).unionByName(part(titled, 2, F.col("n"), nought))
    return ranked(every, ["query_id"], [F.col("part"), F.col("by0"), F.col("by1")], limit, "place").select("query_id", "place", "chunk_id", "doc_id", "chunk_index", "source")


def parents(items: DataFrame, chunks: DataFrame, queries: DataFrame, limit: int = 24, radius: int = 3) -> DataFrame:
    """(query_id, place, doc_id, first_index, last_index, text): one text for each window around the items, in their order.

    Chunks carry a header.  If the query names a focus, a chunk gives the excerpt around it, its neighbours their start, and a
    window without it goes.  Blocks fill the budget in order; the first that doesn't fit is cut if more than 300 characters are left."""
    units = queries.select("query_id", F.when(F.size(text.focus_phrases(F.col("query"))) > 0, text.focus_phrases(F.col("query"))).otherwise(text.focus_terms(F.col("query"))).alias("units"))
    low, high = F.greatest(F.lit(0), F.col("chunk_index") - radius), F.col("chunk_index") + radius
    keyed = items.select("query_id", "doc_id", low.alias("low"), high.alias("high"), "place")
    once = keyed.groupBy("query_id", "doc_id", "low", "high").agg(F.min("place").alias("place"))
    rows = once.withColumn("chunk_index", F.explode(F.sequence("low", "high"))).join(chunks.select("doc_id", "chunk_index", "page_number", "section_title", F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n")).alias("text")), ["doc_id", "chunk_index"]).join(units, "query_id")
    w = Window.partitionBy("query_id", "doc_id", "low", "high").orderBy("chunk_index")
    body = F.lower("text")
    hit = F.exists("units", lambda u: body.contains(u))
    rows = rows.withColumn("hit", hit).withColumn("beside", F.coalesce(F.lag("hit").over(w), F.lit(False)) | F.coalesce(F.lead("hit").over(w), F.lit(False)))
    focused = F.size("units") > 0
    piece = F.when(~focused, F.col("text")).when(F.col("hit"), sentences.excerpt(F.col("text"), F.col("units"), EXCERPT)).when(F.col("beside"), F.btrim(F.substring("text", 1, EXCERPT), F.lit(" \t\r\n")))
    header = F.format_string("[child chunk %d | page %d | section %s]\n", F.col("chunk_index"), F.col("page_number"), F.when(F.coalesce("section_title", F.lit("")) == "", "Unknown").otherwise(F.col("section_title")))
    kept = rows.withColumn("piece", piece).filter("piece <> ''").withColumn("block", F.concat(header, "piece"))
    kept = kept.withColumn("used", F.coalesce(F.sum(F.length("block")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    room = F.lit(PARENT_BUDGET) - F.col("used")
    fits = F.col("used") + F.length("block") <= PARENT_BUDGET
    cut = F.concat(F.rtrim(F.substring(F.col("block"), F.lit(1), room.cast("int"))), F.lit("..."))
    shown = kept.withColumn("shown", F.when(fits, F.col("block")).when(room > 300, cut)).filter("shown is not null")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "shown"))), lambda s: s["shown"]), "\n\n")
    out = shown.groupBy("query_id", "doc_id", "low", "high").agg(F.min("place").alias("at"), texts.alias("text"), F.max(F.col("hit") | (F.size("units") == 0)).alias("met")).filter("met")
    return ranked(out, ["query_id"], [F.col("at"), F.col("doc_id"), F.col("low")], limit, "place").select("query_id", "place", "doc_id", F.col("low").alias("first_index"), F.col("high").alias("last_index"), "text")


def with_context(hits: DataFrame, chunks: DataFrame, queries: DataFrame, limit: int = 24) -> DataFrame:
    """(query_id, place, doc_id, source, text): the parent texts of a query, or its expanded chunks if it has none."""
    items = expanded(hits, chunks, queries, limit=1 << 30)
    whole = parents(items, chunks, queries, limit)
    left = items.filter(F.col("place") <= limit).join(whole.select("query_id").distinct(), "query_id", "left_anti")
    plain = left.join(chunks.select("chunk_id", "text"), "chunk_id").select("query_id", "place", "doc_id", "source", "text")
    return whole.select("query_id", "place", "doc_id", F.lit("parent_context").alias("source"), "text").unionByName(plain)


def ordered_union(parts: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """UNION that keeps the first of each key, parts in turn, each by its own ``order``."""
    tagged = [p.withColumn("segment", F.lit(i)) for i, p in enumerate(parts)]
    union = tagged[0]
    for p in tagged[1:]:
        union = union.unionByName(p)
    return ranked(union, keys, [F.col("segment"), F.col(order)], 1, "copy").drop("copy")
