"""Vectors by content: a text is embedded once, and not again in a second run; table functions in SQL."""

import numpy as np

from brookfern.operators import backends


def test_each_text_is_embedded_once(spark, tmp_path):
    store = str(tmp_path / "vectors")
    rows = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "c" * 100_000)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.embedding for r in backends.embedded_once(df, store).collect()}
    plain = {r.id: r.embedding for r in backends.embedded(df).collect()}
    assert got == plain and spark.read.parquet(store).count() == 3
    more = df.unionAll(spark.createDataFrame([(6, "new"), (7, "new")], df.schema))

    class Counting(backends.StandIn):  # refuses what is stored
        def embed(self, texts):
            assert texts == ["new"]
            return np.asarray(super().embed(texts))

    assert backends.embedded_once(more, store, factory=Counting).count() == 7 and spark.read.parquet(store).count() == 4
    again = backends.embedded_once(more, store, factory=Counting)
    assert again.count() == 7 and spark.read.parquet(store).count() == 4
    assert backends.embedded_once(df.limit(0), store).count() == 0


def test_sentences_in_sql(spark):
    backends.register(spark)
    spark.createDataFrame([(1, "One. Two!  Three"), (2, ""), (3, None), (4, "  \n ")], "id int, body string").createOrReplaceTempView("bodies")
    got = sorted((r.id, r.at, r.sentence) for r in spark.sql("SELECT b.id, s.at, s.sentence FROM bodies b, LATERAL brookfern_sentences(b.body) s").collect())
    assert got == [(1, 0, "One."), (1, 1, "Two!"), (1, 2, "Three")]
