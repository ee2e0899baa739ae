"""Mixing sources to target weights from fixed-length blocks of tokens.

The words of a source are one stream: its documents in a fixed pseudorandom order, cut into
blocks of ``BLOCK`` words.  Output shards draw their source counts: the slots of a source (its target in
blocks, rounded) fall on the shards multinomially, drawn from a seed by halving: of the slots in a range of
shards, a binomial draw goes to its first half.  So a shard's counts vary like a multinomial sample, the totals
stay at the targets, and a task draws the counts of its own shard without those of the
others.  The slots of a source, counted over all shards, go
through pseudorandom permutations of its block numbers (a Feistel network with cycle
walking), one permutation for each pass over the source.  Joining slots and blocks by
source and number says how often each block, and so each word, is taken.

Targets: sources in code-point order, null last, weigh 1, 2, 3, repeating; they share the
size of all sources; a target stops at three times its source's size and the excess is
shared again by weight.  No source has more slots than three passes, so no document is taken more than three times.

Defined results: null text has size 0 and is never taken; a null source is one source, the
last; repeated rows each have their own words, and a repeated doc_id counts by row; an empty table
gives an empty result; very long documents span many blocks; reruns agree, whatever the
partitioning.  One row per source is gathered on the driver and shipped to the tasks, nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 64
SHARD_SLOTS = 8192
LIMIT = 3
SEED = 20_240_101
CHUNK_ROWS = 5000
_ROUNDS = 4


def targets(sizes: list[tuple[str | None, int]], limit: float = LIMIT) -> list[float]:
    """Targets of sources (name, size), in the order given."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i][0] is None, sizes[i][0] or ""))
    weight = [0] * len(sizes)
    for rank, i in enumerate(order):
        weight[i] = 1 + rank % 3
    out = [0.0] * len(sizes)
    left, open_ = float(sum(n for _, n in sizes)), set(range(len(sizes)))
    while open_:
        share = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if share * weight[i] > limit * sizes[i][1]}
        for i in full or open_:
            out[i] = float(limit * sizes[i][1]) if full else share * weight[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def slot_counts(wanted: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Slots of each source: whole numbers near ``wanted`` with its sum (by largest remainder) as far as there is room."""
    out = np.minimum(np.floor(wanted).astype(np.int64), room)
    left = int(np.floor(wanted.sum() + 0.5)) - int(out.sum())
    for i in np.argsort(-(wanted - out), kind="stable"):
        if left <= 0:
            break
        more = min(int(room[i] - out[i]), max(1, int(wanted[i] - out[i])), left)
        out[i] += more
        left -= more
    return out


def shard_counts(slots: np.ndarray, shards: int, shard: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in one output shard, and in the shards before it."""
    low, high = 0, shards
    own, before = slots.copy(), np.zeros_like(slots)
    while high - low > 1:
        middle = (low + high) // 2
        draw = np.random.Generator(np.random.PCG64([seed, low, high]))
        first = draw.binomial(own, (middle - low) / (high - low))
        if shard < middle:
            own, high = first, middle
        else:
            own, before, low = own - first, before + first, middle
    return own, before


def _mix64(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1 for each key, at the given indexes."""
    index, size, key = (np.asarray(x, np.uint64) for x in (index, size, key))
    half = np.ones(len(size), np.uint64)
    while ((np.uint64(1) << (np.uint64(2) * half)) < size).any():
        half = np.where((np.uint64(1) << (np.uint64(2) * half)) < size, half + np.uint64(1), half)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        x, h, m, k = out[todo], half[todo], low[todo], key[todo]
        a, b = x >> h, x & m
        for r in range(_ROUNDS):
            a, b = b, a ^ (_mix64(b * np.uint64(0x9E3779B97F4A7C15) + k + np.uint64(r + 1)) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _placed(docs: DataFrame) -> DataFrame:
    """docs with size, source and start: the place of its words in the source's stream."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("size"), "mix_row")
    # Chunks by a hash of the row, so that no chunk grows with its source.
    chunks = F.lit(max(1, rows.count() // CHUNK_ROWS))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", F.lit(SEED)), chunks))
    inside = Window.partitionBy("source", "chunk").orderBy("doc_id", "size", "mix_row").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("chunk_size").over(before), F.lit(0))).drop("chunk_size")
    return (
        rows.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .alias("r")
        .join(totals.alias("t"), F.expr("r.source <=> t.source and r.chunk = t.chunk"))
        .select("r.doc_id", "r.source", "r.size", "r.mix_row", (F.col("base") + F.col("offset")).alias("start"))
    )


def takes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, mix_row, size, source_size, target, taken, pieces) of every row.

    ``docs`` needs doc_id, source, size (words) and mix_row (tells equal rows apart, may be 0).
    pieces: the row's runs of words (start, length) with the times each is taken.
    """
    spark = docs.sparkSession
    placed = common.cut(_placed(docs), "mix-placed")
    sources = [(r[0], int(r[1])) for r in placed.groupBy("source").agg(F.sum("size")).collect()]
    sources.sort(key=lambda s: (s[0] is None, s[0] or ""))
    goal = targets(sources)
    kind = lambda c: docs.schema[c].dataType.simpleString()
    if not sources:
        return spark.createDataFrame([], f"doc_id {kind('doc_id')}, mix_row {kind('mix_row')}, size long, source_size long, target double, taken long, pieces array<struct<start: long, length: long, times: long>>")
    names = spark.createDataFrame([(s, i, n, t) for i, ((s, n), t) in enumerate(zip(sources, goal, strict=True))], "source string, sid int, source_size long, target double")
    blocks = np.array([-(-n // BLOCK) for _, n in sources], np.int64)
    # A last block may be part full: expected slots follow its mean length.
    mean = np.array([n / b if b else 1.0 for (_, n), b in zip(sources, blocks.tolist(), strict=True)])
    slots = slot_counts(np.array(goal) / np.maximum(mean, 1e-9) * (blocks > 0), LIMIT * blocks)
    shards = -(-int(slots.sum()) // SHARD_SLOTS)

    def drawn_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                counts, before = shard_counts(slots, shards, s, seed)
                sid = np.repeat(np.arange(len(counts)), counts)
                j = before[sid] + np.arange(len(sid)) - np.repeat(np.cumsum(counts) - counts, counts)
                size = blocks[sid]
                number = permuted(j % size, size, (j // size) * 1_000_003 + sid * 7919 + seed)
                yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int32()), pa.array(number, pa.int64())], ["sid", "number"])

    drawn = spark.range(shards, numPartitions=max(1, min(shards, 4 * common.shuffle_width(spark)))).mapInArrow(drawn_slots, "sid int, number long").groupBy("sid", "number").agg(F.count("*").alias("times"))
    named = placed.join(names, placed["source"].eqNullSafe(names["source"])).drop("source")
    spread = named.filter("size > 0").select(
        "doc_id",
        "mix_row",
        "sid",
        "start",
        "size",
        F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))).alias("number"),
    )
    low = F.greatest("start", F.col("number") * BLOCK)
    high = F.least(F.col("start") + F.col("size"), (F.col("number") + 1) * BLOCK)
    # Sizes behind Python and range() are guessed far too low: without the hints these would be broadcast.
    pieces = spread.join(drawn.hint("merge"), ["sid", "number"]).select("doc_id", "mix_row", "sid", "size", F.struct((low - F.col("start")).alias("start"), (high - low).alias("length"), F.col("times")).alias("piece"), "start")
    taken = pieces.groupBy("sid", "start", "size").agg(F.sum(F.col("piece.length") * F.col("piece.times")).alias("taken"), F.sort_array(F.collect_list("piece")).alias("pieces"))
    return named.join(taken.hint("merge"), ["sid", "start", "size"], "left").select("doc_id", "mix_row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "pieces")


def sized(docs: DataFrame) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.withColumn("size", words).withColumn("mix_row", F.lit(0).cast("long"))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with the words that the mix takes: pieces in place, further passes after a line break; n_chars follows.

    Equal rows are numbered, and each has its own words.  Other columns, whatever their names, pass through."""
    key, number, size, times, pieces_of, words_of = (common.free(c, docs) for c in ("mix_key", "mix_number", "mix_size", "mix_taken", "mix_pieces", "mix_words"))
    row = F.xxhash64("doc_id", F.col("source").cast("string"), F.col("text").cast("string"))
    # Which of several equal rows has which number does not matter.
    numbered = lambda df: df.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    rows = numbered(sized(docs.select("doc_id", "source", "text", row.alias(key))).drop("text", "mix_row"))
    found = takes(rows.select("doc_id", "source", "size", F.struct(F.col(key).alias("key"), F.col(number).alias("number")).alias("mix_row"))).filter("taken > 0")
    mark, copy = common.free("mix_mark", docs), common.free("mix_copy", docs)
    found = found.select(F.col("mix_row.key").alias(mark), F.col("mix_row.number").alias(copy), F.col("size").alias(size), F.col("taken").alias(times), F.col("pieces").alias(pieces_of))
    # The number is compared beside the join, whose key then is the one that the texts are dealt out by already.
    kept = numbered(docs.withColumn(key, row)).join(found.hint("merge"), (F.col(key) == F.col(mark)) & (F.col(number) - F.col(copy) == 0))
    words = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    whole = F.expr(f"forall({pieces_of}, p -> p.times = 1) and {times} = {size}")
    # The words stand in an array of their own so that the text is split once and not for each piece.
    passes = F.expr(f"transform(array({words_of}), ws -> transform(filter(sequence(1, 3), t -> exists({pieces_of}, p -> p.times >= t)), t -> array_join(flatten(transform(filter({pieces_of}, p -> p.times >= t), p -> slice(ws, cast(p.start + 1 as int), cast(p.length as int)))), ' ')))[0]")
    text = F.when(whole, F.col("text")).otherwise(F.array_join(passes, "\n"))
    out = kept.withColumn(words_of, words).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return takes(sized(docs).drop("text")).select("doc_id", "size", "source_size", "target", "taken")
