"""Staged routing: every stage answers some rows, and the trace says why the others passed them on."""

import json

from pyspark.sql import functions as F

from brookfern.functions import fixed
from brookfern.operators import backends, policy

ITEMS = "query_id int, query string, rank int, title string, page_number int, chunk_index int, text string, section_title string, hybrid_score double"


def backend(reply, error=None):
    class Own(backends.StandIn):  # made here, so that workers get it by value
        def generate(self, prompts):
            if error:
                raise error
            return [reply for _ in prompts]

    return Own


Broken = backend("", TimeoutError("no model"))
Plain = backend("Gardens grow slowly in old towns, as the author says of them [1].")


def items(spark, *rows):
    return spark.createDataFrame([(q, query, rank, "T", 1, rank, body, "", 0.01) for q, query, rank, body in rows], ITEMS)


def test_chain_keeps_state_and_trace(spark):
    asked = spark.createDataFrame([(i,) for i in range(5)], "query_id int")
    none = F.lit(None).cast("string")
    seen = []

    def even(open_):
        return open_.filter("query_id % 2 = 0").select("query_id", F.lit("even").alias("answer"), none.alias("source"), none.alias("reason"))

    def judge(open_):
        seen.append(sorted(r.query_id for r in open_.collect()))
        return open_.select("query_id", F.when(F.col("query_id") == 1, "one").alias("answer"), F.lit("own name").alias("source"), F.when(F.col("query_id") == 3, "too large").alias("reason"))

    got = {r.query_id: (r.answer, r.source, [(t.stage, t.reason) for t in r.trace]) for r in policy.chain(asked, [("first", even), ("second", judge)]).collect()}
    assert seen == [[1, 3]]
    assert got[0] == got[2] == got[4] == ("even", "first", [("first", "answered")])
    assert got[1] == ("one", "own name", [("first", "not_applicable"), ("second", "answered")])
    assert got[3] == (None, None, [("first", "not_applicable"), ("second", "too large")])


ROWS = [
    (1, "What reason does the author give?", 1, "It works well because people remember the question that brain science triggers in them every single day of the week."),
    (2, "What does the author say of gardens?", 1, "Old gardens grow slowly. Nothing else is told of them here at all."),
    (3, "What colour is it?", 1, "zzz"),
]


def test_model_fails(spark):
    broken = {r.query_id: r for r in policy.answered(items(spark, *ROWS), Broken).collect()}
    assert set(broken) == {1, 2, 3} and all(r.answer for r in broken.values())
    assert "gardens" in broken[2].answer and broken[3].source == "generic_extractive_fallback"
    assert ("repair", "llm_generation_exception:TimeoutError") in [tuple(t) for t in broken[3].trace]


def test_model_answers_are_judged(spark):
    got = {r.query_id: r for r in policy.answered(items(spark, *ROWS), Plain).collect()}
    assert set(got) == {1, 2, 3}
    assert all(r.trace[0].stage == "fast_path" for r in got.values())
    assert got[1].answer.startswith("The reasons are:") and got[1].answer.endswith("[1]")


def test_repairs_cite_and_leak_nothing(spark):
    rows = [
        (1, "q", {"source_window": "chunk_id 3 leaks [1].", "definition": "It is a thing of some use [1].", "list": "later [1]."}, 2),
        (2, "q", {"definition": "No citation here.", "list": "A list of two things [2]."}, 2),
        (3, "q", {"list": "The context does not contain enough information [1]."}, 2),
        (4, "q", {}, 2),
    ]
    df = spark.createDataFrame(rows, "query_id int, query string, by_kind map<string,string>, results int")
    assert {r.query_id: (r.source, r.answer) for r in policy.repairs(df).collect()} == {1: ("definition", "It is a thing of some use [1]."), 2: ("list", "A list of two things [2].")}


def test_direct(spark):
    df = spark.createDataFrame([(1, " Hello "), (2, "tell me"), (3, ""), (4, None)], "query_id int, query string")
    got = {r.query_id: (r.answer, r.source) for r in policy.direct(df).collect()}
    assert got == {1: (fixed.GREETINGS["hello"], "greeting"), 2: ("tell me", "model"), 3: (fixed.DIRECT_FALLBACK, "fallback"), 4: (fixed.DIRECT_FALLBACK, "fallback")}
    assert {r.answer for r in policy.direct(df.filter("query_id > 1"), Broken).collect()} == {fixed.DIRECT_FALLBACK}


def test_tool_results_in_words(spark):
    mcp = lambda **result: json.dumps({"source": "mcp", "result": result})
    cases = [
        (json.dumps({"tool": "get_current_weather", "location": "Bonn", "temperature": "3 C", "time": "noon", "timezone": "CET"}), "The current temperature in Bonn is 3 C. Reported at noon (CET)."),
        (json.dumps({"tool": "get_current_weather"}), "The weather tool did not return a current temperature."),
        (mcp(tool="list_tables", tables=[]), "No SQLite tables were found."),
        (mcp(tool="preview_table", table="t", columns=["a", "b"], rows=[]), "Table t has no rows. Columns: a, b."),
        (mcp(tool="recent_traces", traces=[{"trace_id": 4, "verification_json": '{"status":"verified"}', "query": "x"}]), "Recent SQLite traces:\n- Trace 4: verified - x"),
        (mcp(tool="list_directory", path="/d", entries=[{"name": "f", "type": "file"}], truncated=True), "Files in /d:\n- f (file)\nThe list was truncated."),
        (mcp(tool="read_text_file", path="p", content="body", truncated=False), "Here is the content of p:\n\nbody"),
        (mcp(tool="file_info", path="p", is_dir=True), "p is a directory."),
        (mcp(tool="other"), None),
        (mcp(success=False), "The MCP tool could not complete the request: The tool could not complete the request."),
        ("[1]", None), ("", None), (None, None), ("{broken", None),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, payload string")
    got = [r.said for r in policy.tool_texts(df).orderBy("i").collect()]
    assert got == [said for _, said in cases]
