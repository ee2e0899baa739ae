"""Removal of lines that stand on many sites, with DataFrame operations only.

A HyperLogLog sketch of the sites of every line hash is built on the map side and merged by
the aggregation, so a line that is everywhere costs one sketch per task.  Lines whose estimate
is clear of the threshold are decided by it (with the boilerplate table broadcast while its size allows; beyond that a very
common line is a hot join key with one row on the other side, which adaptive execution splits); those near the threshold get an exact
count of distinct sites.  A line on ``min_sites`` sites or more is boilerplate: it stays in the
document with the least doc_id and goes from all others.

Defined results: null text stays null, with no lines; blank lines are no lines and always stay; lines are
compared without white space at their ends; a null source is a site of its own; a line that only
rows without doc_id hold stays; rows of one doc_id are one document; repeated rows are cut alike; an
empty table gives an empty result; very long texts and lines are read whole; other columns, whatever their names,
pass through, but for n_lines and n_removed where they are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_SITES = 10
#: log2 of the registers of a sketch: a standard error of 1.6 %.
SKETCH_BITS = 12
#: Estimates within this share of the threshold are counted exactly.
NEAR = 0.15
_BLANKS = " \t\r\x0b\x0c"


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _lines(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("site"), _row_key().alias("row_key"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = F.btrim("line", F.lit(_BLANKS))
    return rows.filter(line != "").select("doc_id", "site", "row_key", "at", F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, keeper): hashes of the lines of ``min_sites`` sites or more and the least doc_id that has each."""
    lines = _lines(docs)
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites"), F.min("doc_id").alias("keeper"))
    low, high = min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR) + 1
    found = common.cut(sketched.filter(F.col("sites") >= low), "line-spread")
    clear = found.filter(F.col("sites") > high).select("h1", "h2", "keeper")
    near = found.filter(F.col("sites") <= high)
    pairs = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    exact = pairs.groupBy("h1", "h2").count().filter(F.col("count") >= min_sites)
    return clear.unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "keeper"))


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES, counts: bool = True) -> DataFrame:
    """``docs`` without boilerplate lines; n_chars follows if it is there.  counts: add (or replace) n_lines and n_removed."""
    repeated = _lines(docs).join(boilerplate(docs, min_sites), ["h1", "h2"]).filter("keeper is not null and not (doc_id <=> keeper)")
    row, cut, key, own = (common.free(name, docs) for name in ("cut_row", "cut_at", "cut_key", "cut_id"))
    dropped = repeated.groupBy(F.col("row_key").alias(key), F.col("doc_id").alias(own)).agg(F.collect_set("at").alias(cut))
    keyed = docs.withColumn(row, _row_key())
    joined = keyed.join(dropped, (keyed[row] == dropped[key]) & keyed["doc_id"].eqNullSafe(dropped[own]), "left")
    pieces = F.split("text", "\n")
    kept = F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains(cut, i)), "\n")
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(kept)
    added = {
        "n_lines": F.coalesce(F.size(F.filter(pieces, lambda x: F.btrim(x, F.lit(_BLANKS)) != "")), F.lit(0)).cast("long"),
        "n_removed": F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut)).cast("long"),
    }
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": text} | (added if counts else {})
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(c.alias(name) for name, c in out.items()))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return cleaned(docs).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH pieces AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, unnest(string_split(text, chr(10))) AS piece, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents
), lines AS (
  SELECT *, trim(piece, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM pieces
), spread AS (
  SELECT line, min(doc_id) AS keeper FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}
), judged AS (
  SELECT l.*, (s.line IS NOT NULL AND l.doc_id <> s.keeper) AS gone FROM lines l LEFT JOIN spread s ON l.line = s.line
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(piece, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       (CASE WHEN d.text IS NULL THEN NULL ELSE length(k.text) END)::BIGINT AS kept_chars, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
