"""Ordered runs, steps of challenges and stages of pipelines, worked out by hand."""

from pyspark.sql import functions as F

from brookfern.operators import runs

ITEMS = "query_id int, query string, rank int, title string, page_number int, chunk_index int, text string"


def test_runs_are_islands_of_counting_markers(spark):
    rows = [(1, "1. one 2. two 3) three 7. odd 1. again 2. more"), (2, "First, wake. Second, walk. then fifth"), (3, None), (4, ""), (5, "no markers"), (6, "1. alone"), (7, "2. b 1. a"), (8, "x1. no 3.5 no")]
    df = spark.createDataFrame(rows, "id int, body string")
    got = sorted((r.id, r.kind, r.run, r.step, r.steps, r.number, r.item) for r in runs.runs(df, "body", "id").collect())
    assert got == [
        (1, "numbered", 1, 1, 3, 1, "one"), (1, "numbered", 1, 2, 3, 2, "two"), (1, "numbered", 1, 3, 3, 3, "three"), (1, "numbered", 3, 1, 2, 1, "again"), (1, "numbered", 3, 2, 2, 2, "more"),
        (2, "ordinal", 1, 1, 2, 1, "wake"), (2, "ordinal", 1, 2, 2, 2, "walk. then"),
    ]
    assert {(r.id, r.run, r.steps) for r in runs.longest(runs.runs(df, "body", "id"), "id").collect()} == {(1, 1, 3), (2, 1, 2)}
    at = {r.number: r.at for r in runs.markers(df.filter("id = 1"), "body", "id").filter("kind = 'numbered' and at < 20").collect()}
    assert at == {1: 0, 2: 7, 3: 14}
    assert runs.runs(df.limit(0), "body", "id").count() == 0


def test_long_texts(spark):
    body = " ".join(f"{i % 9 + 1}. item" for i in range(9000))
    df = spark.createDataFrame([(1, body)], "id int, body string")
    assert runs.runs(df, "body", "id").agg(F.count("*"), F.max("steps"), F.max("run")).first() == (9000, 9, 1000)


def test_challenge_steps_keep_their_order(spark):
    rows = [
        (1, "What are the steps of the 7-day challenge?", 1, "t", 1, 1, "Nothing here."),
        (1, "What are the steps of the 7-day challenge?", 2, "t", 1, 2, "The challenge: 1. Day 1: write a hook. 2. Day 2: tell a friend. 3. Days 3-4: practice it aloud. Why This Works: x"),
        (2, "Which challenge steps are there?", 1, "t", 1, 1, "A challenge: 1. Open the door 2. Go on in now 3. no"),
        (3, "What are the steps?", 1, "t", 1, 1, "The challenge: 1. Day 1: write a hook. 2. Day 2: tell a friend."),
        (4, "Which challenge steps?", 1, "t", 1, 1, None),
    ]
    got = {r.query_id: r.answer for r in runs.challenge_answers(spark.createDataFrame(rows, ITEMS)).collect()}
    assert got == {
        1: "The 7-day challenge steps are:\n- Day 1: write a hook. [2]\n- Day 2: tell a friend. [2]\n- Days 3-4: practice it aloud. [2]",
        2: "The challenge steps are:\n- Open the door. [1]\n- Go on in now. [1]",
    }


def test_pipeline_stages(spark):
    q = "What is the main pipeline of Docling Tool?"
    rows = [
        (1, q, 1, "t", 1, 1, "Load a PDF from a file or URL. Process the image with the model."),
        (1, q, 2, "t", 2, 1, "It will generate DocTags for output. Then a DoclingDocument() can export Markdown and HTML. A Gradio preview follows."),
        (2, q, 1, "t", 1, 1, "Nothing of the kind."),
        (3, "What is the pipeline?", 1, "t", 1, 1, "input data\n# load the raw rows here\n# process every row\n# export them to disk\noutput document process"),
        (4, "Who wrote it?", 1, "t", 1, 1, "Load file model output process"),
    ]
    got = {r.query_id: r.answer for r in runs.pipeline_answers(spark.createDataFrame(rows, ITEMS)).collect()}
    assert set(got) == {1, 3}
    lines = got[1].split("\n")
    assert lines[0] == "The main pipeline is:" and lines[1] == "- Load PDFs or images from a local file/upload or a URL. [1]" and lines[2].endswith("model. [1]")
    assert "- Generate DocTags for each page or image. [2]" in lines and "- Create DoclingDocument from the generated output. [2]" in lines and any(x.startswith("- Export the result as ") for x in lines) and lines[-1].endswith("in the Gradio UI. [2]")
    assert got[3].index("Load the raw rows") < got[3].index("Process every row") < got[3].index("Export them")


def test_series(spark):
    rows = [(1, 2, 1, 0, "1. first thing 2. second thing 3. third thing"), (1, 1, 2, 0, "1. short 2. run"), (2, 1, 1, 0, "none")]
    got = runs.series(spark.createDataFrame(rows, "query_id int, rank int, page_number int, chunk_index int, body string")).collect()
    assert [(r.query_id, r.answer) for r in got] == [(1, "The steps are: - first thing. [2] - second thing. [2] - third thing. [2]")]
