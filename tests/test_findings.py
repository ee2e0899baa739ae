"""Cases that findings of reviews named."""

import duckdb
from pyspark.sql import functions as F

from brookfern.functions import fixed, text
from brookfern.llm import near, simhash
from brookfern.operators import answer, answering, cleaning, curation, postings, relations, retrieval, runs, windows
from brookfern.plans import extended, lifecycle, more, registry  # noqa: F401  (extended and more add to the registry)
from brookfern.sources import fixtures as fx


def test_memory_rubric_takes_phrases_as_written(spark, tmp_path):
    rows = [(1, 1, "user", "here the of. and there"), (2, 1, "user", "here the of and there"), (3, 1, "user", "zzz zzz"), (4, 1, "system", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = dict(con.execute(registry.ORACLES["memory_rubric"]).fetchall())
    assert {r.conv_id: r.score for r in registry.QUERIES["memory_rubric"](spark, str(tmp_path)).collect()} == want


def test_windows_of_all_kinds_are_cut_in_one_pass(spark, sf):
    items = fx.cued_items(spark, sf)
    plan = windows.windows(items)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("documents.parquet") + plan.count("Relation") <= 2  # the items, and the questions


def test_index_deals_out_no_occurrences_and_topk_no_pairs(spark):
    items = spark.createDataFrame([(i, "a b c" + " a" * (i % 3)) for i in range(50)] + [(50, None)], "id long, body string")
    index = postings.build(items, "id", F.col("body"))
    terms = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "z", 1), (3, "c", 1)], "query_id int, term string, times int").withColumn("times", F.col("times").cast("long"))
    every = postings.scores(index, "id", terms).collect()
    want = {}
    for q in {r.query_id for r in every}:
        order = sorted((-round(r.score, 9), r.id, r.score) for r in every if r.query_id == q)
        want |= {(q, i + 1): x[1] for i, x in enumerate(order[:4])}
    top = postings.topk(index, "id", terms, 4)
    assert {(r.query_id, r["rank"]): r.id for r in top.collect()} == want and len(want) == 8
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan


def test_cosine_tiles_equal_pairs(spark):
    rows = [(i, "ab"[i % 2], [float(i % 5), 1.0, float(i % 3)]) for i in range(30)] + [(30, "a", None), (31, "b", [1.0]), (32, "a", [0.0, 0.0, 0.0]), (33, "a", [1.0, None, 2.0])]
    vectors = spark.createDataFrame(rows, "id long, label string, vector array<float>")
    asked = vectors.filter("id in (0, 7, 30, 32)").select(F.col("id").cast("int").alias("query_id"), "vector")
    order = [F.desc(F.round("score", 9)), F.col("id")]
    for group in (None, "label"):
        keys = ["query_id", group] if group else ["query_id"]
        want = retrieval.ranked(retrieval.cosine_scores(vectors, asked, "id", group), keys, order, 3)
        got = retrieval.cosine_scores(vectors, asked, "id", group, 3)
        pick = lambda df: sorted(((r.query_id, r.id, None if r.score is None else round(r.score, 9)) for r in df.collect()), key=str)
        assert pick(got) == pick(want)
        assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_growing_joins_of_near_copies_are_not_broadcast(spark):
    prints = spark.range(200).selectExpr("xxhash64(id) as fp").localCheckpoint()
    plan = simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "BroadcastHashJoin" not in plan
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7, 30))) for i in range(40)], "doc_id long, text string")
    plan = near.classes(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_window_answers_clean_items_once_and_known_questions_spare_a_pass(spark, tmp_path):
    row = (1, "What is holding people back?", 1, "doc", 1, 0, "It is the fear of failing. People stop trying to walk there, because of risk.")
    names = "query_id long, query string, rank int, title string, page_number int, chunk_index int, text string"
    spark.createDataFrame([row], names).write.parquet(f"{tmp_path}/items")
    found = windows.answers(spark.read.parquet(f"{tmp_path}/items"))
    assert "Relation" not in found._jdf.queryExecution().optimizedPlan().toString()  # all kinds read what was kept
    unread = spark.read.parquet(f"{tmp_path}/items").withColumn("query", F.raise_error(F.lit("read")).cast("string"))
    windows.evidence(unread, fx.window_questions(spark))


def test_few_rows_a_question_meet_chunks_where_these_are(spark, sf):
    asked, chunks = fx.questions(spark, sf), fx.chunks(spark, sf)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "64KB")
    try:
        anchors = registry._anchors(asked, chunks)
        plans = [registry._hits(asked, chunks, 3), retrieval.section_context(anchors, chunks.drop("title", "source"), asked), retrieval.title_sections(anchors, chunks, asked), retrieval.neighbours(anchors, chunks)]
        for df in plans:
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(limit)


def test_section_titles_are_gathered_in_the_row_of_a_document(spark, tmp_path):
    page = "\n".join(f"line {i}" for i in range(8))
    texts = [None, "", "\n\n", "one", f"{page}\nb\nc", f"b\n\n\n\n\n\n\n\n\nx\n\n\n\n\n\n\nb{'z' * 60}", "\n" * 8 + "a", f"{page}\n{page}"]
    rows = [(i, t, "en", "src1", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = fx.routing_documents(spark, str(tmp_path))
    want = {}
    for c in fx.chunks(spark, str(tmp_path)).collect():
        want.setdefault(c.doc_id, set()).add(c.section_title)
    assert {r.doc_id: r.section_titles for r in docs.collect()} == {str(i): ",".join(sorted(want.get(str(i), ()))) for i in range(len(texts))}
    assert "Exchange" not in docs._jdf.queryExecution().executedPlan().toString()


def test_boosts_of_all_queries_of_a_scope_in_one_pass(spark):
    chunks = [("c1", "d1", "Alpha Tools", 1, 0, "Great Alpha", "the alpha tool"), ("c2", "d1", None, 1, 1, None, None), ("c3", "d2", "x", 1, 0, "", "say Great Alpha here")]
    chunks = spark.createDataFrame(chunks, "chunk_id string, doc_id string, title string, page_number int, chunk_index int, section_title string, text string")
    asked = spark.createDataFrame([(1, "What of Great Alpha?"), (2, "tool tool"), (3, "alpha")], "query_id int, query string")
    scope = spark.createDataFrame([(1, "d1"), (1, "d2"), (2, "d1"), (2, "d2"), (3, "d2")], "query_id int, doc_id string")
    found = retrieval.sparse_scores(chunks, asked, scope)
    got = {(r.query_id, r.chunk_id) for r in found.collect()}
    assert got == {(q, c) for q in (1, 2) for c in ("c1", "c2", "c3")} | {(3, "c3")}
    lowered = chunks.selectExpr("1 as scope_id", "chunk_id", "lower(coalesce(section_title, '')) as low_section", "lower(concat_ws(' ', coalesce(section_title, ''), coalesce(title, ''), coalesce(text, ''))) as low_whole")
    wanted = spark.createDataFrame([(1, 1, ["what", "of", "great", "alpha"], ["great alpha"]), (1, 2, ["tool"], [])], "scope_id int, query_id int, terms array<string>, phrases array<string>")
    boosts = {(r.query_id, r.chunk_id): r.boost for r in retrieval._boosted(lowered, wanted).collect()}
    assert boosts == {(1, "c1"): 10.5, (2, "c1"): 0.25, (1, "c2"): 0.0, (2, "c2"): 0.0, (1, "c3"): 5.5, (2, "c3"): 0.0}
    assert "aggregate(" not in found._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_a_batch_at_a_time(spark):
    rows = [(1, "b a b Ä_1 b"), (2, None), (3, "..."), (4, "A a"), (5, "é z é")]
    found = postings.counted(spark.createDataFrame(rows, "id int, body string"), F.col("body"), "id")
    got = {r.id: (r.length, [tuple(c) for c in r.counts]) for r in found.collect()}
    assert got == {1: (5, [("a", 1), ("b", 3), ("ä_1", 1)]), 2: (0, []), 3: (0, []), 4: (2, [("a", 2)]), 5: (3, [("z", 1), ("é", 2)])}
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_one_title_are_dealt_out_packed(spark, monkeypatch):
    monkeypatch.setattr(curation, "BLOCK", 8)
    monkeypatch.setattr(curation, "TILE", 4)
    gold = spark.createDataFrame([(i, "src1 EN") for i in range(40)] + [(None, "src1 EN"), (99, None), (98, "other")], "item_id int, label string").coalesce(1)
    docs = spark.createDataFrame([(i, "src1 en") for i in range(40)] + [(7, "src1 en"), (50, None)], "doc_id int, title string").coalesce(1)
    found = curation.fuzzy_documents(gold, docs)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(((r.item_id is None, r.item_id or 0, r.doc_id) for r in rows)) == sorted((i is None, i or 0, d) for i in [*range(40), None] for d in [*range(40), 7])
    assert len({r.task for r in rows}) > 1


def test_answers_read_a_file_of_one_group_in_many_tasks_and_clean_texts_once(spark, tmp_path, monkeypatch):
    texts = ["ther ther thou\nthha that that that thes", "aâ€™s Â° gener- ation ther", "", None]
    rows = [(i, texts[i % 4]) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items = fx.cued_items(spark, str(tmp_path), every=False)
    assert items.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    body = F.concat(F.lit(" "), F.regexp_replace("text", r"\n", " \n "), F.lit(" "))
    for word, cue in fx.CUED_WORDS.items():
        body = F.replace(body, F.lit(f" {word} "), F.lit(f" {cue} "))
    docs = spark.createDataFrame(rows, "doc_id long, text string").filter("text is not null")
    want = {r.doc_id: r.b.replace("\n", " ") for r in docs.select("doc_id", body.alias("b")).collect()}
    assert {r.title: r.text for r in items.collect()} == {f"doc {i}": b for i, b in want.items()}
    # A cleaned text that items bring is not cleaned again.
    ready = items.withColumns({"section_title": F.lit(""), "body": F.lit("For example, the reasons include a limitation because it is a challenge.")})
    monkeypatch.setattr(answering.st, "evidence_clean", lambda body: F.raise_error(F.lit("cleaned again")))
    assert answering.fact_list(ready).count() > 0


def test_words_and_replacements_are_as_written_one_by_one(spark):
    words = ["is a", "is", "(1)", "[x]", "^b", "a-b", "key : value", "don’t", "&&", "import ", "10**"]
    bodies = ["this", "i s", "(1", "(1)", "x]", "[x]", "^b", "ab", "a-b", "key : valu", "don’t", "&", "&&", "import", "import x", "10*", "10**", "", None, "â€™ ÂÂ simu- late", "â simu-late"]
    rows = spark.createDataFrame([(b,) for b in bodies], "b string")
    got = rows.select("b", text.any_of(F.col("b"), words).alias("held"), text.replaced(F.col("b"), fixed.MOJIBAKE + fixed.BROKEN_WORDS).alias("told")).collect()
    for r in got:
        told = r.b
        for wrong, right in fixed.MOJIBAKE + fixed.BROKEN_WORDS:
            told = told if told is None else told.replace(wrong, right)
        assert r.told == told and r.held == (None if r.b is None else any(w in r.b for w in words))


def test_policy_stages_take_cleaned_texts_as_they_are(spark, monkeypatch):
    def refused(body):
        raise AssertionError("cleaned again")

    monkeypatch.setattr(windows.st, "evidence_clean", refused)
    items = spark.createDataFrame([(1, "What is the main pipeline?", 1, "t", "b")], "query_id int, query string, rank int, text string, body string")
    assert {"query_id", "answer"} == set(runs.pipeline_answers(items).columns) == set(relations.definition_answers(items).columns) == set(runs.challenge_answers(items).columns)


def test_facts_take_titles_structure_and_eight_of_broad_questions(spark):
    body = " ".join(f"Sentence number {n} of this text tells a little more on the limitations of engines." for n in ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine"))
    rows = [
        (1, "what types of engines are there?", 1, "c1", "Motors", "2.1 Diesel kinds", "[child chunk 3 | page 2 | section Steam kinds] import os; engines = build(os, (1)) and more of the same code here."),
        (2, "limitations of engines", 1, "c1", "Motors", "", body),
        (3, "how do engines scale?", 1, "c1", "Motors", "", "It is held in memory at a cost that few would like to pay today. Nothing of that sort was said by them in the morning."),
    ]
    items = spark.createDataFrame(rows, "query_id int, query string, rank int, chunk_id string, title string, section_title string, text string")
    got = {}
    for r in answering.fact_list(items).orderBy("query_id", "fact_no").collect():
        got.setdefault(r.query_id, []).append((r.sentence, r.score))
    lead = "The retrieved document section identifies this relevant item/category: "
    assert [s for s, _ in got[1]] == [lead + "Diesel kinds.", lead + "Steam kinds."]  # titles first, and no code
    assert len(got[2]) == 8
    # Two words that "scale" implies.
    assert got[3] == [("It is held in memory at a cost that few would like to pay today.", 4)]


def test_evidence_facts_are_the_whole_fact_list(spark, sf):
    rows = lambda name: sorted(map(tuple, registry.QUERIES[name](spark, sf).collect()))
    assert rows("evidence_facts") == rows("fact_list") and not hasattr(answer, "facts")


def test_lifecycle_reads_the_neighbours_of_its_hits(spark):
    said = "The Brook Fern engine is a small pump that moves water up the hill to the old mill every day."
    beside = "Its main limitation is a physical cause and effect: a valve that was never made to close in cold nights."
    texts = [f"Brook Fern engine limitations are told of in part {i} of this text on limitations." if i % 2 == 0 else beside if i == 9 else said.replace("small", f"small{i}") for i in range(24)]
    texts = [t if i % 2 == 0 or i == 9 else "Nothing else is there." for i, t in enumerate(texts)]
    chunks = spark.createDataFrame([("d", f"c{i:02}", i, 1, "", t, "t") for i, t in enumerate(texts)], "doc_id string, chunk_id string, chunk_index int, page_number int, section_title string, text string, title string")
    asked = spark.createDataFrame([(1, "What limitations does Brook Fern have?")], "query_id int, query string")
    hits = retrieval.sparse_topk(chunks, asked, spark.createDataFrame([(1, "d")], "query_id int, doc_id string"), 8).select("query_id", "doc_id", "chunk_index", "rank", "chunk_id")
    near = retrieval.surrounded(hits.drop("chunk_id"), chunks, 1).orderBy("place").collect()
    assert {r.chunk_index % 2 for r in hits.collect()} == {0} and "c09" in {r.chunk_id for r in near}
    assert [r.place for r in near] == list(range(1, len(near) + 1)) and len({r.chunk_id for r in near}) == len(near)
    docs = spark.createDataFrame([("d", "t", "d.pdf", "", " ".join(texts))], "doc_id string, title string, source_path string, section_titles string, content string")
    (got,) = lifecycle.ask(asked, docs, chunks).collect()
    assert "a valve that was never made to close" in got.answer


def test_repeated_runs_are_looked_for_only_where_words_come_again(monkeypatch):
    looked = []
    monkeypatch.setattr(cleaning, "_left", lambda word, mark, whole=cleaning._left: looked.append(len(word)) or whole(word, mark))
    plain = "One two three four five six seven eight nine, " * 50
    again = "So a b c d A b c D a b c d\te f. "
    assert cleaning.without_repeats(plain + again + plain) == plain + "So a b c d\te f. " + plain and looked == [24]  # up to the next comma


def test_documents_are_dealt_out_before_runs_are_looked_for(spark, sf):
    assert registry.QUERIES["unrepeated_documents"](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_each_distinct_window_of_a_text_is_cut_once(spark):
    body = "Why this works. " + "The reason is that because it helps. " * 6 + "And no more of it"
    rows = spark.createDataFrame([(1, body)], "id int, body string")
    ats = [i for i in range(len(body)) if body.startswith("because", i)]
    cues = F.array(*(F.struct(F.lit("reason").alias("kind"), F.lit(0).alias("part"), F.lit(at).alias("at")) for at in ats))
    rows = rows.withColumn("cues", cues)
    start, stop = windows.around(F.col("body"), F.col("c.at"), 90, 760)
    want = {}
    for r in rows.select(F.explode("cues").alias("c"), "body").select("c.at", start.alias("start"), stop.alias("stop")).collect():
        want[r.start, r.stop] = min(r["at"], want.get((r.start, r.stop), r["at"]))
    got = [(c.start, c.stop, c["at"]) for (found,) in windows.with_reaches(rows, windows.ANCHORED).select("reaches").collect() for c in found]
    assert len(got) == len(want) < len(ats) and {(a, b): at for a, b, at in got} == want
