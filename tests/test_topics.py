"""Competing topics: other names that a text turns to, where the question asks about one."""

from pyspark.sql import functions as F

from brookfern.functions import sentences as st


def test_competing_topics(spark):
    q = "What are the key features of Random Forest?"
    cases = [
        (q, "Random Forest: many trees vote on each row.", False),
        (q, "Support Vector Machines are fast and small.", True),
        (q, "It votes. Support Vector Machines: draw a line.", True),
        (q, "It works well on rows and once met Support Vector Machines somewhere.", False),
        (q, "RandomForest is a kind of it.", False),
        (q, "It is like XGBoost in this.", True),
        (q, "Key Features: many trees.", False),
        (q, "It votes. Boosting: trees in a row.", True),
        ("What is Random Forest?", "Support Vector Machines are fast.", False),
        ("what are the features of it?", "Support Vector Machines are fast.", False),
        (q, "", False),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, q string, b string")
    got = [r.x for r in df.select("i", st.competing(F.col("q"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert got == [x for *_, x in cases]


def test_sentences_keep_their_numbers(spark):
    body = "0 apples fell. 1 apple stays 1. 2 pears 2"
    row = spark.createDataFrame([(body,)], "b string").select(st.split(F.col("b")).alias("x")).first()
    assert row.x == ["0 apples fell.", "1 apple stays 1.", "2 pears 2"]
