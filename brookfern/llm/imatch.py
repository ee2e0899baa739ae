"""I-Match fingerprints with randomised lexicon subsets, with DataFrame operations only.

The lexicon holds the terms in a band of document frequency (so of inverse document
frequency).  The lower bound makes its size independent of the corpus: terms that
are in at least the share ``LEAST`` of all documents number at most the mean count of distinct
terms of a document divided by ``LEAST``.  That bounded list is a literal of the plan.

A hash deals the lexicon into ``SUBSETS`` random subsets.  For each subset the
distinct terms of a text that it holds are sorted and hashed together; the fingerprint is the list of
these hashes.  The subsets are small on purpose: one that keeps most of the lexicon changes with
every edit, and nothing would be left to compare once a quarter of a text is replaced.  A text with fewer than
``FEW`` lexicon terms is filled up to that number by its other terms, those of the least hash first, so
that texts on either side of the limit still agree in what they share.  The likeness of two fingerprints is the share of subsets with equal hashes among those that either
text has terms in; two texts without words are alike.

The next document is found without a global sort: ranges of doc_id between approximate quantiles are
ordered each on its own, and the first document of a range is sent to the range before it, too.

Defined results: null text counts as empty; the empty text's fingerprint has only empty places; rows without doc_id come
first; rows of one doc_id follow each other by their text; the next of the last is the first,
and of an only document itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Document-frequency band of the lexicon, as shares of all documents.
LEAST, MOST = 0.01, 0.25
SUBSETS = 128
FEW = 12
RANGE_ROWS = 3000
MOST_RANGES = 4096


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), common.WORD_GAP), lambda w: w != "")


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST, most: float = MOST) -> list[int]:
    """Hashes of the terms in the band; at most (mean distinct terms of a document) / least of them."""
    total = docs.count()
    seen = docs.select(F.explode(F.array_distinct(_terms(F.col(text)))).alias("term")).groupBy("term").count()
    band = seen.filter((F.col("count") >= max(2.0, least * total)) & (F.col("count") <= most * total))
    return sorted({r[0] for r in band.select(F.xxhash64("term")).collect()})


def _literal(values: list[int]) -> Column:
    """A constant array, folded once by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>") if values else F.array().cast("array<long>")


def fingerprint(text: str, lexicon: list[int]) -> Column:
    """One hash for each subset of the terms of column ``text``, null where the text has no term of it."""
    # The list of literals becomes one hash set for the whole query.
    known = f"t in ({','.join(f'{x}L' for x in lexicon)})" if lexicon else "false"
    gap = common.WORD_GAP.replace("\\", "\\\\")
    own = f"array_distinct(transform(filter(split(lower(`{text}`), '{gap}'), w -> w <> ''), w -> xxhash64(w)))"
    filled = f"if(size(x.known) >= {FEW}, x.known, concat(x.known, slice(sort_array(array_except(x.own, x.known)), 1, {FEW} - size(x.known))))"
    # Arrays of one element hold what is used more than once, so that it is computed once.
    chosen = f"transform(transform(array({own}), own -> struct(own, filter(own, t -> {known}) as known)), x -> sort_array({filled}))"
    place = f"transform(array(filter(terms, t -> pmod(t, {SUBSETS}) = k)), own -> if(size(own) > 0, xxhash64(own), null))[0]"
    return F.expr(f"flatten(transform({chosen}, terms -> transform(sequence(0, {SUBSETS - 1}), k -> {place})))")


def likeness(a: Column, b: Column) -> Column:
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda z: z))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda z: z))
    return F.when(either > 0, equal / either).otherwise(1.0)


def as_text(prints: Column) -> Column:
    """All digits of all hashes: equal texts have equal strings, and unequal fingerprints unequal ones."""
    return F.lower(F.array_join(F.transform(prints, lambda x: F.coalesce(F.lpad(F.hex(x), 16, "0"), F.lit("-" * 16))), ""))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``docs`` (doc_id, text and ``carried``) with next_<column> of the next document by doc_id, around the end."""
    n, least = docs.agg(F.count("*"), F.min("doc_id")).first()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    steps = [i / ranges for i in range(1, ranges)]
    picked = docs.agg(F.percentile_approx("doc_id", steps, 20_000)).first()[0] if steps and least is not None else []
    bounds = sorted({b for b in picked or [] if b != least})
    own = F.size(F.filter(_literal(bounds), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    ranged = docs.withColumn("own_range", F.when(F.col("doc_id").isNull(), 0).otherwise(own))
    first = F.col("doc_id").isNull() | F.col("doc_id").isin([b for b in (least, *bounds) if b is not None])
    before = F.when(F.col("own_range") == 0, len(bounds)).otherwise(F.col("own_range") - 1)
    places = F.when(first, F.array(F.struct(F.col("own_range").alias("place"), F.lit(False).alias("ghost")), F.struct(before.alias("place"), F.lit(True).alias("ghost"))))
    sent = ranged.withColumn("spot", F.explode(places.otherwise(F.array(F.struct(F.col("own_range").alias("place"), F.lit(False).alias("ghost"))))))
    order = Window.partitionBy("spot.place").orderBy("spot.ghost", F.col("doc_id").asc_nulls_first(), "text")
    found = sent.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in carried))
    return found.filter("not spot.ghost").drop("spot", "own_range")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n / 4) code points replaced by the first as many of ``following``."""
    gone = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - gone), F.substring(following, F.lit(1), gone))


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = lexicon(docs)
    marked = docs.withColumn("prints", fingerprint("text", words))
    pairs = with_next(marked, ["text", "prints"]).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    both = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "prints", "next_prints", fingerprint("edited", words).alias("edited_prints"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("prints")).alias("fingerprint"),
        as_text(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )
