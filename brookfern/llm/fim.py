"""Fill-in-middle transformation over run-length encoded character classes.

A text is units: a maximal run of ASCII letters is one unit, every other code point is one.  Instead of a
list of units, a text is kept as its maximal runs of one class (letters or others) with the number of units
and of code points before each run.  A cut after k units is found by binary search among the cumulative unit
counts: a run of letters is only cut before or after it, and in any other run the offset is the run's own plus
the units that are left.  The runs of a batch lie in flat arrays; nothing is kept per unit.

Cuts are found in Python over Arrow buffers; texts are put together, taken apart again and digested by Spark.

Defined results: a null text counts as empty; empty texts and texts that hold a marker stay as they are (form
``plain``); a null doc_id draws like the empty string in its place; repeated rows are transformed alike; texts are
read whole, in pieces of whole rows of about ``PIECE_BYTES``; an empty table gives an empty result; other columns, whatever
their names, pass through ``transformed``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text whose runs are held at a time (a longer text is one piece).
PIECE_BYTES = 4 << 20


@dataclass(frozen=True)
class Rates:
    """Which texts are left plain, and which of the others put their suffix first (percent)."""

    plain: int = 10
    suffix_first: int = 20
    seed: str = "1"


class Runs:
    """Maximal class runs of the rows of a string array."""

    def __init__(self, texts: pa.StringArray):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        letter = ((raw | 0x20) - np.uint8(97)) < 26
        turn = np.empty(len(raw) + 1, bool)
        turn[:-1][1:] = letter[1:] != letter[:-1]
        turn[offsets] = True  # no run goes over the end of a row
        at = np.flatnonzero(turn[:-1])
        lead = (raw & 0xC0) != 0x80
        chars = np.add.reduceat(lead, at, dtype=np.int64) if len(at) else np.empty(0, np.int64)
        units = np.where(letter[at], 1, chars)
        #: Runs of row i are first[i] to first[i + 1]; units and code points of the batch before each run, and in all.
        self.first = np.searchsorted(at, offsets)
        self.units = np.r_[0, np.cumsum(units)]
        self.chars = np.r_[0, np.cumsum(chars)]

    def totals(self) -> np.ndarray:
        """Units of each row."""
        return self.units[self.first[1:]] - self.units[self.first[:-1]]

    def offsets(self, after: np.ndarray) -> np.ndarray:
        """Code points of each row before its cut ``after`` so many units."""
        goal = self.units[self.first[:-1]] + after
        run = np.searchsorted(self.units, goal, "right") - 1
        return self.chars[run] + (goal - self.units[run]) - self.chars[self.first[:-1]]


def _pieces(texts: pa.StringArray):
    sizes = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]), dtype=np.int64)
    a = 0
    while a < len(texts):
        done = sizes[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(sizes, done + PIECE_BYTES, "right")))
        yield a, b
        a = b


def _draw(group: int, key: Column) -> Column:
    """One of the 32-bit numbers that belong to a key."""
    return F.conv(F.substring(F.sha2(key, 256), 8 * group - 7, 8), 16, 10).cast("long")


def cuts(text: Column, first: Column, second: Column) -> Column:
    """struct(n, prefix_chars, middle_chars): units, and code points before and between the cuts ``first % (n + 1)`` and ``second % (n + 1)``, in order."""

    @F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "prefix_chars", "middle_chars")]))
    def run(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        texts = texts.cast(pa.string())
        one, two = (x.to_numpy(zero_copy_only=False) for x in (one, two))
        found = [np.empty((0, 3), np.int64)]
        for a, b in _pieces(texts):
            runs = Runs(texts.slice(a, b - a))
            n = runs.totals()
            x, y = one[a:b] % (n + 1), two[a:b] % (n + 1)
            low, high = runs.offsets(np.minimum(x, y)), runs.offsets(np.maximum(x, y))
            found.append(np.column_stack([n, low, high - low]))
        common.trim()
        rows = np.concatenate(found)
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["n", "prefix_chars", "middle_chars"])

    return run(text, first, second)


def transformed(df: DataFrame, text: str = "text", key: str = "doc_id", rates: Rates = Rates()) -> DataFrame:
    """``df`` with n, form (plain, psm or spm), prefix_chars, middle_chars and the transformed text in ``output``.

    The draws depend on ``rates.seed`` and the key alone, so a rerun, or a lost executor, changes nothing.
    Columns of these names are replaced."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    drawn = F.concat(F.lit(rates.seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    whole, spot = common.free("fim_text", df), common.free("fim_cut", df)
    held = df.withColumn(whole, body).withColumn(spot, cuts(F.col(whole), _draw(1, drawn), _draw(2, drawn)))
    low, size = F.col(spot)["prefix_chars"], F.col(spot)["middle_chars"]
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(F.col(whole), F.lit(mark))
    plain = (F.col(whole) == "") | marked | (_draw(3, drawn) % 100 >= 100 - rates.plain)
    form = F.when(plain, "plain").when(_draw(4, drawn) % 100 < rates.suffix_first, "spm").otherwise("psm")
    prefix, middle = F.substring(F.col(whole), F.lit(1), low.cast("int")), F.substring(F.col(whole), (low + 1).cast("int"), size.cast("int"))
    suffix = F.substring(F.col(whole), (low + size + 1).cast("int"), F.lit(2**31 - 1))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    shown = held.withColumn("form", form).withColumn("n", F.col(spot)["n"])
    shown = shown.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col(whole)))
    for name, value in (("prefix_chars", low), ("middle_chars", size)):
        shown = shown.withColumn(name, F.when(F.col("form") != "plain", value))
    return shown.drop(whole, spot)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.  No part holds a marker and markers do not overlap, so they part it exactly."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transformed(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM drawn),
placed AS (
  SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS c1, greatest(h1 % (n + 1), h2 % (n + 1)) AS c2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:c1], '') AS p, array_to_string(u[c1 + 1:c2], '') AS m, array_to_string(u[c2 + 1:], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
