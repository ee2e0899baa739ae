"""Semantics that the fixtures do not reach."""

from pyspark.sql import functions as F

from brookfern.functions import text
from brookfern.operators import ingest, retrieval, store


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first()[0]


def test_empty_in_list_keeps_nothing(spark):
    df = spark.range(3)
    assert store.restricted(df, "id", []).count() == 0
    assert store.restricted(df, "id", None).count() == 3


def test_redaction_is_idempotent_and_ordered(spark):
    raw = "mail a.b@c.org token: abcdef phone 123 456 789 01 key sk_ABCDEFGH12345678"
    once = one(spark, text.redact(F.col("v")), raw)
    assert "@" not in once and "abcdef" not in once and "sk_" not in once
    assert once == one(spark, text.redact(F.col("v")), once)


def test_focus_phrases(spark):
    assert one(spark, text.focus_phrases(F.col("v")), "What do Conditional Random Fields do") == ["conditional random field", "conditional random fields"]


def test_feedback_fold(spark):
    log = spark.createDataFrame([(1, "dislike", "a", 1), (1, "dislike", None, 2), (2, "dislike", "b", 1), (2, "like", None, 2), (2, "dislike", None, 3)], "trace_id int, rating string, issue_type string, seq int")
    got = {r.trace_id: (r.rating, r.issue_type) for r in store.folded_feedback(log).collect()}
    assert got == {1: ("dislike", "a"), 2: ("dislike", "")}


def test_upsert_on_two_keys(spark):
    old = spark.createDataFrame([("a", "p1", 1), ("b", "p2", 1), ("c", "p3", 1)], "doc_id string, source_path string, v int")
    new = spark.createDataFrame([("a", "p9", 2), ("z", "p2", 2)], "doc_id string, source_path string, v int")
    assert sorted(map(tuple, store.merged(old, new, ["doc_id", "source_path"]).collect())) == [("a", "p9", 2), ("c", "p3", 1), ("z", "p2", 2)]


def test_rrf_ties_and_permutation(spark):
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, rank int")
    s = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "query_id int, chunk_id string, rank int")
    first = [r.chunk_id for r in retrieval.rrf(d, s, 5).orderBy("rank").collect()]
    assert first == ["a", "b"]
    assert first == [r.chunk_id for r in retrieval.rrf(d.orderBy(F.desc("rank")), s, 5).orderBy("rank").collect()]


def test_windows_cover_the_text():
    body = " ".join(f"word{i}." if i % 7 == 0 else f"word{i}" for i in range(400))
    pieces = ingest.windows(body, 300, 60)
    assert all(len(p) <= 380 for p in pieces)
    at = 0
    for p in pieces:
        found = body.find(p)
        assert 0 <= found <= at + 1
        at = found + len(p)
    assert at == len(body)


def test_split_text_packs_paragraphs():
    assert ingest.split_text("aa\n\nbb\n\n" + "c" * 20, 10, 2)[:1] == ["aa\n\nbb"]
    assert ingest.split_text("short", 10, 2) == ["short"]


def test_terminal_page_ends_document(spark):
    rows = [("d", 1, "A long enough sentence to be kept as a chunk.", "s"), ("d", 2, "Another sentence that is kept, too.\nNo responses yet\nnot seen.", "s"), ("d", 3, "This page is never read at all.", "s")]
    pages = spark.createDataFrame(rows, "doc_id string, page_number int, text string, section_title string")
    got = ingest.chunk_pages(pages).orderBy("chunk_index").collect()
    assert [r.page_number for r in got] == [1, 2] and got[1].chunk_id == "d-p2-c1"


def test_upsert_stream(spark, tmp_path):
    from brookfern.streaming import events

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], "k int, seq int, v string").write.parquet(src)
    stream = spark.readStream.schema("k int, seq int, v string").parquet(src)
    events.upsert_stream(stream, ["k"], "seq", str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.k, r.v) for r in events.current(spark, str(tmp_path / "t")).collect()) == [(1, "c"), (2, "b")]


def test_clean_citations(spark):
    got = one(spark, text.clean_citations(F.col("v"), F.lit(3)), "Facts [1, 2] and [9] more [3].")
    assert got == "Facts [1] [2] and  more [3]."
    assert one(spark, text.clean_citations(F.col("v"), F.lit(3)), "It holds.\nThe provided context does not contain enough information.") == "It holds."


def test_safe_ids(spark):
    assert one(spark, text.namespaced_session(F.col("v"), F.lit(None).cast("string")), " a b/c ") == "a-b-c:default"
