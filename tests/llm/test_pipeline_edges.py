"""Every stage on nulls, empty and long texts, ties, repeated rows, clashing names and empty tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from brookfern.llm import common

STAGES = dict(corpus_pipeline.STAGES)
EN, DE = "the cat and the dog were there with them ", "der hund und die katze waren dort mit ihnen "
ROWS = [
    *((i, (EN if i % 2 else DE) * (2 + i) + f"number{i}", "en" if i % 2 else "de", f"s{i}", "row") for i in range(24)),
    (100, None, "en", "s1", "null text"),
    (101, "", "en", None, "empty"),
    (102, " \n ", None, "s1", "blank"),
    (103, "12 34 !", "de", "s2", "no letters"),
    (104, EN * 30_000, None, "s3", "long"),
    (105, EN + "same text twice", "en", "s4", "twin"),
    (105, EN + "same text twice", "en", "s4", "twin"),
    (None, EN + "without an id", "en", "s5", "no id"),
    (106, None, None, None, None),
]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines long, cut_at long, mix_words long, node long, lang_pred string, key string, size long"


@pytest.fixture(scope="module")
def rows(spark):
    full = [(d, t, lang, s, None if t is None else len(t), note, 1, 2, 3, 4, "mine", "k", 5) for d, t, lang, s, note in ROWS]
    return common.cut(spark.createDataFrame(full, CLASH), "edges")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage(spark, rows, name):
    out = STAGES[name](spark, rows, "")
    assert out.columns == rows.columns
    got = out.collect()
    assert all((r.n_lines, r.cut_at, r.mix_words, r.node, r.lang_pred, r.key, r["size"]) == (1, 2, 3, 4, "mine", "k", 5) for r in got)
    notes = sorted(str(r.score) for r in got)
    everyone = sorted(str(note) for *_, note in ROWS)
    if name == "language ID":
        assert notes == sorted([*["row"] * 24, "long", "twin", "twin", "no id"])
    elif name == "line dedup":
        assert notes == everyone
        assert {(r.doc_id, r.text) for r in got} == {(d, t) for d, t, *_ in ROWS}
    elif name == "SimHash near-dedup":
        # Repeats of one sentence share all shingles, the long one among them; what has no words is one class.
        assert notes.count("twin") == 1 and notes.count("no id") == 1 and notes.count("long") <= 1
        assert [r.doc_id for r in got if not (r.text or "").strip()] == [100]
    else:
        assert {r.score for r in got} <= {"row", "no letters", "long", "twin", "no id"}
        assert all(r.n_chars == len(r.text) for r in got if r.text)
    assert STAGES[name](spark, rows.limit(0), "").count() == 0


def test_encoding(spark, rows):
    got = corpus_pipeline.encode(spark, rows, "").collect()
    assert len(got) == len(ROWS) and sum(r.n_tokens == 0 for r in got) == 3
    assert corpus_pipeline.encode(spark, rows.limit(0), "").count() == 0
