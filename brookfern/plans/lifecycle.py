"""The question-answering lifecycle as one plan over a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answer, answering, evaluate, postings, retrieval
from ..session import written


def ask(queries: DataFrame, docs: DataFrame, chunks: DataFrame, top_k: int = 8, doc_index: postings.Index | None = None, chunk_index: postings.Index | None = None) -> DataFrame:
    """plan -> route -> scope -> sparse search -> neighbours -> facts -> answer -> verify -> retry.

    docs: doc_id, title, source_path, section_titles, content; chunks: as in operators.retrieval; doc_index, chunk_index:
    stored indexes of them, made here if there are none.
    Queries whose answer does not verify get a second pass over all routed documents
    with a larger evidence limit; a hit brings the chunks beside it; the second answer counts only if it verifies.
    """
    # One row a query; kept, or its rules would be pushed into every step that filters on them.  What is kept here is a few rows a
    # query, and a table whose size is known: chunks are not dealt out to meet it.
    plan = written(evaluate.planned(queries))
    asked = plan.filter("mode = 'retrieve_only'").select("query_id", "query")
    routed = written(retrieval.route_documents(docs, asked, index=doc_index))  # at most three rows a query
    first = written(_attempt(asked, retrieval.candidate_scope(routed), chunks, top_k, chunk_index))
    retry = asked.join(first.filter("status <> 'verified'").select("query_id"), "query_id", "left_semi")
    second = written(_attempt(retry, routed, chunks, top_k + 2, chunk_index).filter("status = 'verified'")).withColumn("attempt", F.lit(2))
    best = second.unionByName(first.join(second.select("query_id"), "query_id", "left_anti").withColumn("attempt", F.lit(1)))
    return plan.join(best.drop("query"), "query_id", "left").select("query_id", "query", "mode", "tool_name", F.coalesce("answer", F.when(F.col("mode") == "retrieve_only", answer.ABSTAIN)).alias("answer"), "status", "facts", "attempt")


def _attempt(asked: DataFrame, scope_docs: DataFrame, chunks: DataFrame, top_k: int, index: postings.Index | None) -> DataFrame:
    hits = written(retrieval.sparse_topk(chunks, asked, scope_docs.select("query_id", "doc_id"), top_k, index))
    # A hit's neighbours stand with it: after all hits, and within their number, none would ever be read.
    near = retrieval.surrounded(hits.select("query_id", "doc_id", "chunk_index", "rank"), chunks, 1)
    ranked = written(near.select("query_id", "chunk_id", "doc_id", "title", "section_title", "text", "chunk_index", F.col("place").alias("rank")).join(asked, "query_id"))
    answers = answer.extractive(answering.fact_list(ranked))
    counted = answers.join(ranked.groupBy("query_id").agg(F.count("*").alias("retrieved_count")), "query_id")
    return evaluate.verifier_flags(counted).select("query_id", "query", "answer", "status", "facts")
