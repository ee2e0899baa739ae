"""SimHash near-duplicate classes with one-wildcard segment variants.

A 64-bit fingerprint is cut into two 32-bit segments.  Of two fingerprints that differ in
at most two bits, one segment differs in at most one bit, so the pair meets under the exact
value of that segment or under one of its variants with one bit wildcarded.  Variants are
equality-joined and every candidate is verified on all 64 bits.

A variant shared by more than ``HOT`` fingerprints isn't paired.  Its fingerprints are keyed
again by the other segment: under a wildcarded variant the rest may differ in one bit, so
one wildcard of the other segment is added; under an exact one the rest may differ in two,
so the values one flip away from the other segment are the keys (two values differ in at
most two bits exactly if they share such a value).  All fingerprints under such a key are
within two bits of each other and link to the least; a key has at most 33 of them.  No link
is lost and no bucket grows with the data.

Defined results: null or word-less text has fingerprint zero and links like any other; equal
texts share a class; rows with one doc_id get a class each by their own text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE_WORDS = 3
SEED = 42
#: A variant with more fingerprints is split by the other segment instead of being paired.
HOT = 32
_LOW = (1 << 32) - 1


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one text."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest, data = xxhash.xxh64_intdigest, b" ".join(words)
    n = max(1, len(words) - words_per_shingle + 1)
    ends = list(accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    stops = ends[len(words) - n :]
    hashes = np.array([digest(data[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(0, dtype=np.int64) * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of every text as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def links(prints: DataFrame) -> DataFrame:
    """(u, v), u < v: verified links between distinct fingerprints, enough of them to connect every class."""
    low, high = F.col("fp").bitwiseAND(_LOW), F.shiftrightunsigned("fp", 32)
    # A fingerprint becomes 66 rows: small inputs are spread first, or few tasks would make all of them.
    segments = prints.repartition(common.shuffle_width(prints.sparkSession), F.hash("fp")).select(
        "fp",
        F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), own.alias("own"), other.alias("other")) for s, (own, other) in enumerate(((low, high), (high, low)))))).alias("x"),
    ).select("fp", "x.*")
    spots = segments.select("fp", "own", "other", "seg", F.explode(F.expr("sequence(0, 32)")).alias("bit"))
    variants = spots.select(
        "fp",
        "other",
        (F.col("seg") * 33 + F.col("bit")).alias("slot"),
        F.expr("if(bit = 32, own, own & ~shiftleft(1L, bit))").alias("key"),
        F.expr("if(bit = 32, 0, cast(shiftright(own, bit) & 1 as int))").alias("side"),
    )
    # A wildcarded variant pairs fingerprints that do differ in its bit; those that do not meet under the exact one.
    counts = variants.groupBy("slot", "key").agg(F.count("*").alias("n"), F.sum("side").alias("ones"))
    useful = counts.filter("n > 1 and (slot % 33 = 32 or (ones > 0 and ones < n))").select("slot", "key", "n")
    met = common.cut(variants.join(common.dealt(useful), ["slot", "key"]), "simhash-variants")
    cool = met.filter(F.col("n") <= HOT)
    a, b = (cool.select("slot", "key", F.col("fp").alias(f), F.col("side").alias(s)) for f, s in (("u", "su"), ("v", "sv")))
    paired = a.join(common.dealt(b), ["slot", "key"]).filter("if(slot % 33 = 32, u < v, su < sv) and bit_count(u ^ v) <= 2").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    hot = met.filter(F.col("n") > HOT).select("fp", "slot", "key", "other", F.explode(F.expr("sequence(0, 32)")).alias("flip"))
    split = hot.select(
        "fp",
        "slot",
        "key",
        F.expr("if(slot % 33 = 32, -1, flip)").alias("wild"),
        F.expr("if(flip = 32, other, if(slot % 33 = 32, other ^ shiftleft(1L, flip), other & ~shiftleft(1L, flip)))").alias("rest"),
    )
    least = split.groupBy("slot", "key", "wild", "rest").agg(F.min("fp").alias("u"), F.count("*").alias("k")).filter("k > 1").drop("k")
    starred = split.join(common.dealt(least), ["slot", "key", "wild", "rest"]).filter("u <> fp").select("u", F.col("fp").alias("v"))
    return paired.unionAll(starred).distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the class of every document is named by its least doc_id."""
    prints = common.cut(fingerprints(docs, doc_id, text), "simhash-prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_doc"))
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = nodes.join(common.dealt(roots), "fp", "left").select("fp", "least_doc", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    named = common.cut(rooted.join(common.dealt(names), "root").select("fp", "component_id"), "simhash-names")
    return prints.join(common.dealt(named), "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
