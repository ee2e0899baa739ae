"""Functions that SQL can't express, against plain Python or known cases."""

from __future__ import annotations

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from brookfern.functions import fixed, text
from brookfern.functions import sentences as st
from brookfern.operators import answering, backends, cleaning, curation, reports, retrieval, state, tools
from brookfern.sources import files


def values(spark, rows, column, schema="v string"):
    df = spark.createDataFrame([(i, r) if not isinstance(r, tuple) else (i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def excerpt_reference(body, units, radius):
    low = body.lower()
    spots = [low.find(u) for u in units if u in low]
    if not spots:
        return ""
    anchor = min(spots)
    begin, end = max(0, anchor - radius // 3), min(len(body), anchor + radius)
    back = max(body.rfind(". ", 0, begin), body.rfind("\n", 0, begin))
    begin = back + 1 if back >= 0 else begin
    ahead = [at for at in (body.find(". ", end), body.find("\n", end)) if at >= 0]
    return body[begin : min(ahead) + 1 if ahead else end].strip(" \t\r\n")


def test_excerpt(spark):
    rng = random.Random(3)
    words = ["alpha", "beta.", "gamma", "Delta\n", "eps.", "zeta"]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for units in (["gamma"], ["delta", "zeta"], ["nowhere"]):
        got = values(spark, rows, st.excerpt(F.col("v"), F.array(*map(F.lit, units)), 60))
        assert got == [excerpt_reference(r, units, 60) for r in rows]


def test_answer_cleaning(spark):
    cases = {
        "Based on the provided context, it works [1, 2] [9].": "it works [1] [2].",
        "[child chunk 3 | page 1 | section x] Text stays.": "Text stays.",
        "the quick brown fox the quick brown fox jumps": "the quick brown fox jumps",
        "Same thing here. Same thing here [1]. Other.": "Same thing here. Other.",
        "Title: a\nReal answer. Follow publication now for more": "Real answer.",
        "Points: - One thing - Two things": "Points:\n- One thing\n- Two things",
        "It signif- icantly helps , see [3] .": "It significantly helps, see [3].",
        "Itâ€™s fine": "It's fine",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, answer string")
    assert [r.answer for r in cleaning.cleaned(df, "answer", F.lit(3)).orderBy("i").collect()] == list(cases.values())


def test_sentence_predicates(spark):
    rows = ["import numpy as np", "First do this, then that.", "A plain sentence of words.", "x = f(a, (b))", "The DoclingDocument holds it", "3.1 Some Heading", "Follow publication for more", "such as the cat", "University Research by Ann Lee and Bob Ray, Cy Dee and Eli Fox"]
    flags = {name: values(spark, rows, c) for name, c in {"code": st.is_code(F.col("v")), "structured": st.is_structured(F.col("v")), "low": st.is_low_value(F.col("v")), "example": st.is_example(F.col("v"), F.array(F.lit("cat"))), "id": st.has_identifier(F.col("v"))}.items()}
    assert flags["code"] == [True, False, False, True, False, False, False, False, True]
    assert flags["structured"] == [False, True, False, False, True, True, False, False, True]
    assert flags["low"] == [False, False, False, False, False, True, True, False, False]
    assert flags["example"] == [False] * 7 + [True, False]
    assert flags["id"] == [False, False, False, False, True, True, False, False, True]


def test_fact_sentences(spark):
    row = "- a listed item of words. Run pip install brookfern now. Short one. This is a sentence that has more than forty characters in it. no code here"
    got = st.with_fact_sentences(spark.createDataFrame([(row,)], "v string"), F.col("v")).first().sentences
    assert got[0] == "a listed item of words." and "Short one." not in got and got[-1] == "no code here"
    assert len(got) == len({x.lower() for x in got})


def test_definition_entity(spark):
    cases = {"What is a Docker image?": "a Docker image", "What is the main feature of it?": "", "define entropy": "entropy", "What does overfit mean?": "overfit", "What is it?": "", "How does it work?": "", "What are Random Forests": "Random Forests", "what is the article's message": ""}
    assert values(spark, list(cases), st.definition_entity(F.col("v"))) == list(cases.values())


def test_drift_and_overlap(spark):
    both = [
        ("What does Brook Fern offer?", "Brook Fern offers search [1]."),
        ("What does Brook Fern offer?", "Kafka offers streams and more [1]."),
        ("what is it", "Anything at all."),
        ("What is Alpha?", "Alpha and Beta differ. " + "word " * 190 + "Beta is faster. Beta wins."),
        ("What is Alpha?", "Alpha is fine. " + "word " * 190 + "Gamma once."),
    ]
    assert values(spark, both, answering.drifts(F.col("q"), F.col("a")), "q string, a string") == [False, True, False, True, False]
    evidence = "The reactor core temperature rises quickly when coolant pumps stop working during maintenance windows every spring."
    rows = [("How does the reactor react?", "Completely unrelated musings concerning gardening.", [evidence]), ("How does the reactor react?", "Its temperature rises when coolant pumps stop.", [evidence]), ("How does the reactor react?", "Anything.", [])]
    assert values(spark, rows, answering.low_overlap(F.col("q"), F.col("a"), F.col("e")), "q string, a string, e array<string>") == [True, False, False]


def test_rejections(spark):
    cases = [
        ("What is Docker?", "", "empty_candidate"),
        ("What is Docker?", "The provided context does not contain enough information.", "insufficient_candidate"),
        ("What is Docker?", "Docker is a tool. Score: 3 [1]", "raw_context_leak"),
        ("What is Docker?", "Docker is a platform that runs containers on any machine.", "missing_citation"),
        ("What is Docker?", "Docker is a platform that runs containers on any machine [9].", "invalid_citation"),
        ("What is Docker?", "Docker runs [1].", "definition_coverage_missing"),
        ("What is Docker?", "Docker is small [1].", "definition_length_out_of_bounds"),
        ("What is Docker?", "Docker is a platform that runs containers on any machine you like [1].", ""),
        ("Which limitations are mentioned?", "The limitations: cost [1].", "list_answer_too_short"),
        ("Why does caching work?", "Caching helps [1].", "explanation_answer_too_short"),
        ("Tell me of caching", "Caching helps [1].", "answer_too_short"),
        ("Tell me of caching", "Something else entirely is said in this one here [1].", "distinctive_query_terms_missing"),
    ]
    got = values(spark, [c[:2] for c in cases], answering.rejection(F.col("q"), F.col("a"), F.lit(3)), "q string, a string")
    assert got == [c[2] for c in cases]


def test_answers_by_kind(spark):
    body = "The physical motion of objects is a known limitation of the model in many scenes. Spatial placement left and right gets confused, which is a challenge for users. The release is not public because of safety, another limitation of usage."
    rows = [(1, "What limitations does the model have?", 1, "c1", "Models", "Limits", body, 0.1), (2, "What is the model?", 1, "c1", "Models", "Limits", body, 0.1)]
    items = spark.createDataFrame(rows, "query_id int, query string, rank int, chunk_id string, title string, section_title string, text string, hybrid_score double")
    facts = answering.fact_list(items)
    assert facts.filter("query_id = 1").count() == 3
    found = {(r.query_id, r.source): r.candidate for r in answering.candidates(facts).collect()}
    limits = found[1, "limitation"]
    assert limits.startswith("The highlighted limitations are: - ") and limits.count("[1]") == 3 and "Physical/cause-and-effect limitation: " in limits and "Usage/access" not in limits
    kept = answering.first_accepted(answering.candidates(facts).withColumn("results", F.lit(1))).collect()
    assert [(r.query_id, r.source) for r in kept if r.query_id == 1] == [(1, "limitation")]
    assert answering.prompts(facts).filter("prompt like '%Facts:%- The physical%[1]%'").count() >= 1


def test_parents_and_context(spark):
    chunks = spark.createDataFrame([("d", f"c{i}", i, 1, "S" if i < 5 else "T", f"Text {i} about Brook Fern. " + "x" * 700, "t") for i in range(12)], "doc_id string, chunk_id string, chunk_index int, page_number int, section_title string, text string, title string")
    hits = spark.createDataFrame([(1, "d", "c6", 6, 1), (2, "d", "c6", 6, 1)], "query_id int, doc_id string, chunk_id string, chunk_index int, rank int")
    asked = spark.createDataFrame([(1, "What does Brook Fern do?"), (2, "What does Lone Pine do?")], "query_id int, query string")
    got = retrieval.with_context(hits, chunks, asked).orderBy("query_id", "place").collect()
    first = [r for r in got if r.query_id == 1]
    assert {r.source for r in first} == {"parent_context"} and first[0].text.startswith("[child chunk 3 | page 1 | section S]\nText 3")
    assert all(len(r.text) <= retrieval.PARENT_BUDGET + 20 for r in first) and first[0].text.endswith("...")
    assert [r.source for r in got if r.query_id == 2][0] == "hit"


def test_pattern_matcher_without_the_library(monkeypatch):
    import builtins

    patterns = {"ab": [1], " cat ": [2, 3], "b c": [4]}
    fast = retrieval._matcher(patterns)
    real = builtins.__import__
    monkeypatch.setattr(builtins, "__import__", lambda name, *a, **k: (_ for _ in ()).throw(ImportError()) if name == "ahocorasick" else real(name, *a, **k))
    slow = retrieval._matcher(patterns)
    for body in ("ab cat ab", "a cat sat", "b c", ""):
        assert fast(body) == slow(body) == {i for p, ns in patterns.items() if p in body for i in ns}


def places_reference(location):
    words = location.split()
    out = [location, *(" ".join(words[:k]) for k in range(len(words) - 1, 0, -1))]
    if len(words[-1]) >= 5:
        out.append(" ".join([*words[:-1], words[-1][:-1]]))
    for i, w in enumerate(words):
        if len(w) >= 5:
            for k in range(len(w) - 1):
                if w[k].lower() != w[k + 1].lower():
                    turned = w[:k] + w[k + 1] + w[k] + w[k + 2 :]
                    out.append(" ".join([*words[:i], turned, *words[i + 1 :]]))
                    if len(words) > 1 and i == 0:
                        out.append(turned)
    return list(dict.fromkeys(out))[: tools.MOST_PLACES]


def test_places(spark):
    rows = ["Berlin", "New York", "Bielefeldd Germany", "Ulm", "San Francisco Bay"]
    assert values(spark, rows, tools.place_candidates(F.col("v"))) == [places_reference(r) for r in rows]
    pairs = spark.createDataFrame([("Berlni", "Berlni", "Berlin", "Berlin, Germany"), ("Paris", "Paris", "Rome", "Rome, Italy"), ("x", "x", None, None), ("New York", "New", "New York", "New York, US")], "asked string, candidate string, place string, label string")
    assert [r.same for r in tools.same_place(pairs).collect()] == [True, False, True, True]


def test_rounding_is_half_even_of_the_binary_value(spark):
    rows = [2.675, 0.125, 0.375, 1.005, -2.5, None]
    assert values(spark, rows, reports.rounded(F.col("v")), "v double") == [None if r is None else round(r, 2) for r in rows]


def test_offline_rubric(spark):
    rows = [("The cat sat [1]", "the cat sat", ["cat", "dog"], ["bird"]), ("bird", "the cat sat", [], ["bird"]), ("w " * 130, "short", ["zzz"], [])]

    def want(answer, expected, must, bad):
        flat, exp = " ".join(answer.lower().split()), " ".join(expected.lower().split())
        missing = [m for m in must if m not in flat]
        keys = 4.0 * (len(must) - len(missing)) / len(must) if must else 4.0
        focus = 2.0 - any(b in flat for b in bad) - 0.5 * (len(flat.split()) > max(120, 2 * len(exp.split()))) - 0.5 * (len(missing) >= max(1, len(must) // 2))
        return round(keys + round(3 * difflib.SequenceMatcher(None, exp, flat).ratio(), 2) + max(0, focus) + bool(re.search(r"\[\d+\]", answer)), 2)

    df = spark.createDataFrame(rows, "answer string, expected string, must array<string>, must_not array<string>")
    assert [r.score for r in reports.offline_rubric(df).collect()] == [want(*r) for r in rows]


def test_similarity_equals_difflib(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("abc ") for _ in range(rng.randint(0, 80))), "".join(rng.choice("abc ") for _ in range(rng.randint(0, 80)))) for _ in range(30)]
    got = curation.similarity(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()
    assert [r.similarity for r in got] == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in rows]


def test_rewriting(spark):
    q = "What are limitations of the Brook Fern?"
    got = values(spark, [q], curation.rewritten(F.col("v")))[0]
    assert got.startswith(q + " limitations brook fern limitations challenges constraints") is False or "failure" in got
    assert got.split("  ")[0].startswith(q) and "limitations" in got and "Brook Fern" in got and "safety" in got
    assert values(spark, ["a 30 day challenge"], F.array_contains(curation.expansion(F.col("v")), "safety")) == [False]
    none = F.array().cast("array<string>")
    assert values(spark, ["of it"], curation.rewritten_for_retry(F.col("v"), F.lit("before"), none, none)) == ["before"]
    assert values(spark, ["of it"], curation.rewritten_for_retry(F.col("v"), F.lit("before"), F.array(F.lit("more")), none)) == ["of it more"]
    assert len(values(spark, ["Alpha Beta Gamma Delta Eps Zeta Eta Theta Iota Kappa"], curation.keyphrases(F.col("v")))[0]) == 16


def test_fuzzy_titles_equal_brute_force(spark):
    rng = random.Random(9)
    make = lambda: "".join(rng.choice("ab-A ") for _ in range(rng.randint(1, 7)))
    gold, docs = [(i, make()) for i in range(40)], [(i, make()) for i in range(40)]
    tight = lambda t: re.sub("[^a-z0-9]+", "", t.lower())
    want = {(i, j) for i, a in gold for j, b in docs if tight(a) and tight(b) and (tight(a) in tight(b) or tight(b) in tight(a))}
    got = curation.fuzzy_documents(spark.createDataFrame(gold, "item_id int, label string"), spark.createDataFrame(docs, "doc_id int, title string"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_backends(spark):
    class Broken(backends.StandIn):  # in here, so that workers get it by value
        def rerank(self, queries, texts):
            raise RuntimeError("no model")

        def generate(self, prompts):
            raise RuntimeError("no model")

    hits = spark.createDataFrame([(1, "red cat", "a dog", 1), (1, "red cat", "the red cat", 2), (1, "red cat", "a cat", 3)], "query_id int, query string, text string, rank int")
    assert [r.text for r in backends.reranked(hits, 2).orderBy("place").collect()] == ["the red cat", "a cat"]
    assert [r.text for r in backends.rerank_by_overlap(hits, 2).orderBy("place").collect()] == ["the red cat", "a cat"]
    assert [r.text for r in backends.reranked(hits, 2, Broken).orderBy("place").collect()] == ["a dog", "the red cat"]
    vectors = [r.embedding for r in backends.embedded(hits.select("text")).collect()]
    assert len(vectors[0]) == 64 and abs(sum(x * x for x in vectors[1]) - 1) < 1e-5
    asked = spark.createDataFrame([("Facts:\n- one [1]\n- two",), (None,)], "prompt string")
    assert [r.answer for r in backends.generated(asked).collect()] == ["one [1]", ""]
    assert [r.answer for r in backends.generated(asked, factory=Broken).collect()] == ["", ""]
    backends.register(spark)
    assert spark.sql("select brookfern_tokens('A b-C'), brookfern_weather(95)").first()[:] == (["a", "b", "c"], "Thunderstorm")


def test_tool_registry(spark):
    tables = {"t": spark.range(100)}
    traces = spark.range(60).selectExpr("id as trace_id")
    feedback = spark.createDataFrame([("like", 1)], "rating string, seq int")
    found = tools.table_tools(spark, tables, traces, feedback)
    assert [r.tool_name for r in found.specs(spark).collect()] == ["feedback_summary", "list_tables", "preview_table", "recent_traces"]
    assert found.call("preview_table", table="t", limit=500).count() == 50 and found.call("recent_traces").count() == 10
    with pytest.raises(KeyError):
        found.call("preview_table", table="secret")
    with pytest.raises(KeyError):
        found.call("drop_table")
    with pytest.raises(ValueError):
        found.register(tools.Tool("list_tables", "", lambda: None))


def test_files(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"caf\xff" + b"x" * 2000)
    (root / ".hidden").write_text("no")
    (root / "sub" / "b.pdf").write_bytes(b"one|" + b"Some Heading\nText of the first page, long enough to be searched." + b"|")
    (root / "c.pdf").write_bytes(b"|" + b"Words without any heading that go on until the end of it." + b"|2")
    at = str(root)
    assert [r.name for r in files.listed(spark, at).collect()] == ["sub", "a.txt", "c.pdf"]
    row = files.read_text(spark, at, "a.txt", 10).first()
    assert (row.size_bytes, row.returned_bytes, row.truncated) == (2004, 1000, True) and row.content.startswith("caf�x")
    assert files.file_info(spark, at, "a.txt").first().size_bytes == 2004
    for bad in ("../x", "sub/../../x", ".env", "id_rsa", "key.pem"):
        with pytest.raises(PermissionError):
            files.read_text(spark, at, bad)
    found = files.discovered(spark, at)
    assert sorted(r.path.rsplit("/", 1)[-1] for r in found.select("path").collect()) == ["b.pdf", "c.pdf"]
    assert files.discovered(spark, f"{at}/c.pdf").count() == 1
    with pytest.raises(ValueError):
        files.discovered(spark, f"{at}/a.txt")

    def reader(content):
        title, *pages = content.decode().split("|")
        return title, pages

    pages = files.with_sections(files.parsed(found, reader, ocr=lambda content, page: f"scanned page {page}")).orderBy("title", "page_number").collect()
    assert [(r.title, r.page_number, r.section_title) for r in pages] == [("c", 1, None), ("c", 2, None), ("one", 1, "Some Heading"), ("one", 2, "Some Heading")]
    assert pages[1].text == "scanned page 2" and pages[0].doc_id == pages[0].checksum[:16] and pages[0].page_count == 2
    empty = spark.createDataFrame([("d", 1, " short ")], "doc_id string, page_number int, text string")
    with pytest.raises(Exception, match="no text that can be searched"):
        files.with_sections(empty).collect()


def test_json_and_backups(spark, tmp_path):
    at = str(tmp_path / "gold.json")
    assert files.read_json(spark, at, "id long, must array<string>").count() == 0
    for n in (3, 2):
        files.write_json(spark.range(n).selectExpr("id", "array('a') as must"), at)
        assert files.read_json(spark, at, "id long, must array<string>").count() == n
    assert len(list(tmp_path.iterdir())) == 1
    home = str(tmp_path / "backups")
    made = [files.backed_up(spark, {"t": spark.range(n), "u": spark.range(1)}, home, f"2026-01-0{n}T00:00:00") for n in (1, 2, 3)]
    assert [r.created_at[:10] for r in files.backups(spark, home).collect()] == ["2026-01-03", "2026-01-02", "2026-01-01"]
    assert files.restored(spark, made[1])["t"].count() == 2
    assert files.prune_backups(spark, home, 2) == [made[0]] and files.backups(spark, home).count() == 2


def test_vector_collection(spark, tmp_path):
    at = str(tmp_path / "vectors")
    points = state.collection(spark, at)
    row = lambda *v: spark.createDataFrame([(1, "d", "c", list(v))], state.VECTORS)
    assert points.count() == 0 and state.upserted_points(points, row(1.0, 2.0)).count() == 1
    with pytest.raises(Exception, match="another width"):
        state.upserted_points(row(1.0, 2.0), row(1.0)).collect()
    with pytest.raises(Exception, match="unknown visibility"):
        values(spark, ["secret"], state.visibility(F.col("v")))


def test_memory_without_sessions(spark):
    from brookfern.operators import store

    items = spark.createDataFrame([(i, "known_issue", f"the reactor item {i}", 1.0) for i in range(300)], "memory_id int, kind string, content string, importance double")
    asked = spark.createDataFrame([(1, "reactor item"), (2, "nothing shared")], "query_id int, query string")
    got = store.ranked_memory(items, asked).collect()
    assert [r.memory_id for r in sorted(got, key=lambda r: r["rank"])] == [299, 298, 297, 296, 295, 294] and {r.query_id for r in got} == {1}


def test_lists_are_whole(spark):
    assert values(spark, ["what does the [Child Chunk hold"], text.any_of(F.lower("v"), fixed.LEAK_MARKERS)) == [True]
    assert values(spark, ["a+b", "aab"], text.any_of(F.col("v"), ["a+b"])) == [True, False]


def test_ingestion(spark):
    from brookfern.operators import ingest

    plan = spark.createDataFrame([("a", "pa", "new", None), ("b", "pb", "replace", "old"), ("c", "pc", "skip", None), ("d", "pd", "refuse", None)], "doc_id string, source_path string, action string, old_doc_id string")
    body = "A page of text that is long enough to be kept as a chunk, and that ends here. " * 3
    pages = spark.createDataFrame([(d, 1, "S", body) for d in "abcd"], "doc_id string, page_number int, section_title string, text string")
    chunks = spark.createDataFrame([("old-p1-c0", "old", 0), ("b-p1-c9", "b", 9), ("c-p1-c0", "c", 0)], "chunk_id string, doc_id string, chunk_index int")
    points = spark.createDataFrame([(1, "old", "old-p1-c0", [1.0]), (2, "c", "c-p1-c0", [1.0])], state.VECTORS)
    after, vectors = ingest.ingested(plan, pages, chunks, points)
    assert sorted({r.doc_id for r in after.collect()}) == ["a", "b", "c"] and after.filter("chunk_id = 'b-p1-c9'").count() == 0
    assert sorted({r.doc_id for r in vectors.collect()}) == ["a", "b", "c"]
    failures = spark.createDataFrame([("pb", "broken   file")], "source_path string, error string")
    log = ingest.ingestion_events(plan, failures, 5).withColumn("at", F.col("seq"))
    got = {r.source_path: (r.status, r.error) for r in state.ingestion_state(log).collect()}
    assert got == {"pa": ("indexed", ""), "pb": ("failed", "broken file"), "pc": ("skipped", ""), "pd": ("failed", "the path is indexed for another owner")}
