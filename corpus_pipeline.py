"""Corpus pipeline: language ID, line dedup, near-dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents.  All stages but the last keep the columns of
``documents``; empty inputs pass through every stage.  Further columns, whatever their names, pass through
all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookfern.llm import bpe, common, language, lines, mixing, near

#: A text is rejected if it has no letters or if its language is less sure than this.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language; learn from the labelled documents of the stage's own input.

    Null texts, empty ones and texts without letters go; rows of null lang are judged, but not learnt from;
    a null doc_id is judged by its text; if nothing can be learnt, all go; ties between languages go to
    the first by code point; repeated rows share their fate; long texts are judged whole.
    """
    common.share_package(spark)
    model = language.fit(docs.filter(~language.held_out()))
    lang, score = common.free("stage_lang", docs), common.free("stage_score", docs)
    own = {"lang_pred": lang, "score": score}
    found = language.identify(docs.withColumnsRenamed(own), model, with_spans=False)
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({new: old for old, new in own.items()}).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove cross-site boilerplate lines from the texts; no row goes.

    Null and empty texts stay as they are; a null source is a site of its own; rows without doc_id lose
    boilerplate lines, but never are the ones that keep them; of a line's documents the least doc_id keeps it; repeated rows
    are cut alike; long texts are read whole; n_chars follows the text.
    """
    return lines.cleaned(docs, counts=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies (shingles of five words, similarity 0.8 or more).

    Null, empty and word-less texts are one class; rows without doc_id stay; a class keeps its least doc_id, of
    several texts of that id the one of the least hash, and of repeated rows one; long texts are compared whole.
    """
    common.share_package(spark)
    return near.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the words that the mix takes; rows of which it takes none go.

    Null and word-less texts have no words and go; a null source is one source, the last; a null doc_id is a
    row like others; repeated rows each have their own words; long texts span many blocks; n_chars follows the text.
    """
    common.share_package(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text and of its decoding, a row for each row.

    A null text counts as empty; a null doc_id stays null; repeated rows are encoded alike; long texts
    are encoded whole; other columns are left out.
    """
    common.share_package(spark)
    return bpe.digests(docs, bpe.default_vocabulary())


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mix),
    ("BPE encoding", encode),
]

#: Viterbi labels, fingerprint classes, random permutations and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
