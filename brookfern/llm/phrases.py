"""Phrase collocations by pivot partitioning.

Every n-gram belongs to the partition of its rarest word, its pivot.  Words are ranked by frequency in their language
(rarer is higher, ties by the word), and the rank is the word's number.

1. Blocks of documents count their words; one aggregation gives every word's frequency, and words under the support ``LEAST`` drop
   out, since no phrase with them can reach it.  Each block gets the ranks of its own words back, so no task sees the whole vocabulary.
2. A block rewrites its texts for the pivots: around each place of a word it keeps the words up to three to the left
   that are more frequent and three to the right that are no rarer, as far as they adjoin.  Equal fragments of a block
   are sent once with a count, packed, to the partition of the pivot; a fragment of one word is not sent.
3. A partition mines its fragments: n-grams that hold the pivot, taken at its first place in them, so each occurrence
   counts once.  Longer n-grams are only tried where the pairs at the pivot are frequent.  A pivot of over ``SALT``
   occurrences is dealt to several partitions by block, and their counts are summed.
4. Cuts, scores, containment and ranks are joins and aggregations over the mined phrases.

Frequent words are pivots of few distinct fragments (all other words in them are more frequent still), so no partition
grows with a frequent word.  Cross-block messages are never more than the fragments.

Defined results: a null text is empty, a null lang is ``und``; doc_id is not used, so rows without one and repeated rows
count like others; a piece never crosses a text; very long texts are read whole; ties are broken by a, then by the
phrase; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .suffix import _cuts, _mix, _pack, _unpack

#: Occurrences that a phrase needs, the longest phrase, and how many phrases of a language are reported.
LEAST, LONGEST, REPORTED = 30, 4, 2000
#: A phrase goes if a longer one that holds it has this share of its occurrences (percent).
ABSORBED = 80
#: Occurrences of a pivot that one partition takes.
SALT = 1 << 22
BLOCK_BYTES = 4 << 20
REACH = LONGEST - 1
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_SEPARATORS + b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"." * len(_SEPARATORS) + b" abcdefghijklmnopqrstuvwxyz")
_U = np.uint64


class _Words(dict):
    """Numbers of the words of one language; all languages of a block share ``names``."""

    def __init__(self, lang: str, names: list[tuple[str, bytes]]):
        super().__init__({b".": -1})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append((self.lang, word))
        return n


def _tokens(table: pa.Table) -> tuple[np.ndarray, list[tuple[str, bytes]]]:
    """Word numbers of all texts of a block, with -1 between pieces, and the words."""
    names: list[tuple[str, bytes]] = []
    numbers: dict[str, _Words] = {}
    rows = []
    for text, lang in zip(table.column("text").to_pylist(), table.column("lang").to_pylist(), strict=True):
        if (own := numbers.get(lang)) is None:
            own = numbers[lang] = _Words(lang, names)
        # A full stop parts pieces, so no word is one.
        words = text.encode().translate(_PLAIN).replace(b".", b" . ").split()
        rows.append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
        rows.append(np.full(1, -1, np.int32))
    return np.concatenate([np.empty(0, np.int32), *rows]), names


def _word_rows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    common.trim()
    tokens, names = _tokens(table)
    counts = np.bincount(tokens[tokens >= 0], minlength=len(names))
    return pa.table({
        "block": pa.array([key[0].as_py()] * len(names), pa.int32()),
        "lang": pa.array([lang for lang, _ in names], pa.string()),
        "word": pa.array([w.decode() for _, w in names], pa.string()),
        "times": pa.array(counts, pa.int64()),
    })


def _dense(a: np.ndarray) -> np.ndarray:
    return np.unique(a, return_inverse=True)[1]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair of numbers; equal pairs only have equal ones."""
    if not len(a):
        return a.astype(np.int64)
    if (int(a.max()) + 1) * (int(b.max()) + 1) >= 1 << 62:
        a, b = _dense(a), _dense(b)
    return a.astype(np.int64) * (int(b.max()) + 1) + b


def _fragments(ids: np.ndarray, out: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fragments (number of each word or -1, the pivot in the middle column) and their counts.

    ids: words as numbers that rise with rarity; ``out`` is none of a word that can be in a phrase and above all that are."""
    padded = np.concatenate([np.full(REACH, out, ids.dtype), ids, np.full(REACH, out, ids.dtype)])
    at = np.flatnonzero(padded < out)
    pivot = padded[at]
    columns: list[np.ndarray] = [pivot]
    for step, side in ((-1, "left"), (1, "right")):
        goes = np.ones(len(at), bool)
        for d in range(1, REACH + 1):
            word = padded[at + step * d]
            goes = goes & (word < pivot if side == "left" else word <= pivot)
            column = np.where(goes, word, -1)
            columns = [column, *columns] if side == "left" else [*columns, column]
    some = (columns[REACH - 1] >= 0) | (columns[REACH + 1] >= 0)
    columns = [c[some] for c in columns]
    key = columns[0] + 1
    for c in columns[1:]:
        key = _pair(key, c + 1)
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    return np.column_stack([c[first] for c in columns]), times


def _fragment_rows(parts: int, salt: int):
    """A block's fragments by partition of their pivot; those of a salted pivot go to partitions of their own kind, ``parts`` and above."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, known: pa.Table) -> pa.Table:
        common.trim()
        tokens, names = _tokens(table)
        number = {pair: i for i, pair in enumerate(names)}
        where = np.fromiter((number[lang, w.encode()] for lang, w in zip(known.column("lang").to_pylist(), known.column("word").to_pylist(), strict=True)), np.int64, known.num_rows)
        del number
        rank, often = (known.column(c).to_numpy() for c in ("word_rank", "f"))
        order = np.argsort(rank)
        rank, often, out = rank[order], often[order], len(order)
        local = np.full(len(names) + 1, out, np.int64)  # the last one is for -1
        local[where[order]] = np.arange(out)
        found, times = _fragments(local[tokens], out)
        pivot = found[:, REACH]
        salts = 1 + often[pivot] // salt
        spot = _mix(_mix(rank[pivot].view(_U)) + (key[0].as_py() % salts).astype(_U)) >> _U(33)
        part = (spot % _U(parts)).astype(np.int64) + np.where(salts > 1, parts, 0)
        order = np.argsort(part, kind="stable")
        part, found, times = part[order], found[order], times[order]
        spans = list(pairwise([*_cuts(part).tolist(), len(part)]))
        ranks = np.where(found >= 0, np.r_[rank, 0][found], -1)
        return pa.table({
            "part": pa.array([int(part[a]) for a, _ in spans], pa.int32()),
            "n": pa.array([b - a for a, b in spans], pa.int32()),
            # Column by column, so that equal bytes lie together.
            "words": pa.array([_pack((ranks[a:b] + 1).T) for a, b in spans], pa.binary()),
            "times": pa.array([_pack(times[a:b]) for a, b in spans], pa.binary()),
        })

    return run


def _summed(columns: list[np.ndarray], times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each row's n-gram, a row of each n-gram, and its occurrences."""
    key = columns[0]
    for c in columns[1:]:
        key = _pair(key, c)
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    total = np.zeros(len(first), np.int64)
    np.add.at(total, inverse, times)
    return inverse, first, total


def _mined(parts: int):
    """Frequent n-grams of the pivots of a partition; of salted pivots all, as their counts are parts of the whole."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        common.trim()
        sizes = table.column("n").to_pylist()
        width = 2 * REACH + 1
        blobs = table.column("words").to_pylist()
        each = [_unpack([b], [n], np.int64, width).reshape(width, -1).T - 1 for b, n in zip(blobs, sizes, strict=True)]
        words = np.concatenate([np.empty((0, width), np.int64), *each])
        times = _unpack(table.column("times").to_pylist(), sizes, np.int64)
        del blobs, each
        least = LEAST if key[0].as_py() < parts else 1
        rank, dense = np.unique(words, return_inverse=True)
        dense = dense.reshape(words.shape)
        present = words >= 0
        del words
        grams, counts = [], []
        frequent = {}
        for side, a, b in (("left", 1, 0), ("right", 0, 1)):
            there = np.flatnonzero(present[:, REACH - 1 if a else REACH + 1])
            held = np.zeros(len(dense), bool)
            if len(there):
                # A pair may be met on either side, but the counts of one pair come from one side alone: left words are strictly more frequent.
                inverse, first, total = _summed([dense[there, REACH - a], dense[there, REACH + b]], times[there])
                held[there] = total[inverse] >= least
                keep = total >= least
                grams.append(np.column_stack([dense[there[first[keep]], REACH - a], dense[there[first[keep]], REACH + b]]))
                counts.append(total[keep])
            frequent[side] = held
        rows = [(rank[g], c) for g, c in zip(grams, counts, strict=True)]
        for n in range(3, LONGEST + 1):
            picked, weight = [], []
            for a in range(n):
                b = n - 1 - a
                fits = present[:, REACH - a] & present[:, REACH + b]
                if a:
                    fits = fits & frequent["left"]
                if b:
                    fits = fits & frequent["right"]
                there = np.flatnonzero(fits)
                picked.append(dense[there, REACH - a : REACH + b + 1])
                weight.append(times[there])
            gram, weight = np.concatenate(picked), np.concatenate(weight)
            if len(gram):
                _, first, total = _summed(list(gram.T), weight)
                keep = total >= least
                rows.append((rank[gram[first[keep]]], total[keep]))
        common.trim()
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1, dtype=np.int32) * g.shape[1]), pa.array(g.ravel())) for g, _ in rows]
        return pa.table({"words": pa.chunked_array(lists, pa.list_(pa.int64())), "a": pa.chunked_array([pa.array(c, pa.int64()) for _, c in rows], pa.int64())})

    return run


def _numbered(words: DataFrame) -> DataFrame:
    """``words`` with word_rank: 0, 1, ... from the most frequent on, over range partitions."""
    width = common.shuffle_width(words.sparkSession)
    order = [F.desc("f"), F.col("lang"), F.col("word")]
    lined = words.repartitionByRange(width, *order).sortWithinPartitions(*order)
    seen = common.cut(lined.withColumn("line", F.monotonically_increasing_id()), "phrases-words")
    # One row for each of the partitions, whatever the vocabulary.
    share = F.shiftright("line", 33).alias("share")
    sizes = seen.groupBy(share).agg(F.count("*").alias("size")).orderBy("share").collect()
    before = np.cumsum([0, *(r["size"] for r in sizes)]).tolist()
    starts = words.sparkSession.createDataFrame([(r["share"], b) for r, b in zip(sizes, before)], "share long, before long")
    return seen.withColumn("share", share).join(F.broadcast(starts), "share").select("lang", "word", "f", (F.col("before") + F.col("line").bitwiseAND((1 << 33) - 1)).alias("word_rank"))


def mine(docs: DataFrame, block_bytes: int = BLOCK_BYTES, salt: int = SALT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, f, word_rank) that are frequent, sizes (lang, n), and phrases (words, a) of ranks."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).filter("text <> ''")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("text", F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    by_block = rows.withColumn("block", block).repartition(max(blocks, 2), "block").groupBy("block")
    counts = common.cut(by_block.applyInArrow(_word_rows, "block int, lang string, word string, times long"), "phrases-counts")
    totals = counts.groupBy("lang", "word").agg(F.sum("times").alias("f"))
    words = common.cut(_numbered(totals.filter(F.col("f") >= LEAST)), "phrases-ranks")
    sizes = counts.groupBy("lang").agg(F.sum("times").alias("n"))
    known = counts.join(words, ["lang", "word"]).select("block", "lang", "word", "f", "word_rank")
    sent = by_block.cogroup(known.groupBy("block")).applyInArrow(_fragment_rows(blocks, salt), "part int, n int, words binary, times binary")
    # Equal phrases of salted pivots come from several partitions; others are whole already.
    found = common.cut(sent.repartition(max(blocks, 2), "part").groupBy("part").applyInArrow(_mined(blocks), "words array<long>, a long"), "phrases-mined")
    return words, sizes, found.groupBy("words").agg(F.sum("a").alias("a")).filter(F.col("a") >= LEAST)


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """(words, a, l, r, score) of phrases that no longer one absorbs, by their lowest-scoring cut."""
    counts = phrases.unionAll(words.select(F.array("word_rank"), "f")).select(F.col("words").alias("piece"), F.col("a").alias("f"))
    k = F.expr("explode(sequence(1, size(words) - 1)) as k")
    cuts = phrases.select("words", "a", k)
    ends = F.array(F.struct(F.lit(0).alias("side"), F.expr("slice(words, 1, k)").alias("piece")), F.struct(F.lit(1).alias("side"), F.expr("slice(words, k + 1, size(words) - k)").alias("piece")))
    halves = cuts.select("words", "a", "k", F.explode(ends).alias("half")).select("words", "a", "k", "half.side", "half.piece").join(counts, "piece")
    # All cuts of a phrase are gathered in its own row: at most three.
    sides = F.collect_list(F.struct("k", "side", "f")).alias("sides")
    gathered = halves.groupBy("words", "a").agg(sides)
    part = lambda s, side, k: F.filter(s, lambda x: (x["k"] == k) & (x["side"] == side))[0]["f"]
    of_k = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(k.alias("k"), part(F.col("sides"), 0, k).alias("l"), part(F.col("sides"), 1, k).alias("r")))
    listed = gathered.select("words", "a", of_k.alias("cut"))
    worth = F.transform("cut", lambda c: F.struct(F.call_function("div", _wide(F.lit(2_000_000)) * _wide(F.col("a")), _wide(c["l"]) + _wide(c["r"])).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    best = listed.select("words", "a", F.array_min(worth).alias("best")).select("words", "a", "best.l", "best.r", "best.score")
    inner = "flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> slice(words, i, n))))"
    held = phrases.filter(F.size("words") > 2).select(F.explode(F.expr(inner)).alias("words"), F.col("a").alias("longer")).groupBy("words").agg(F.max("longer").alias("longer"))
    return best.join(held, "words", "left").filter(F.col("longer").isNull() | (100 * _wide(F.col("longer")) < ABSORBED * _wide(F.col("a")))).drop("longer")


def _best(df: DataFrame, groups: list[str], order: list[Column], ties: bool = False) -> DataFrame:
    place = (F.rank() if ties else F.row_number()).over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("rank", place).filter(F.col("rank") <= REPORTED)


def collocations(docs: DataFrame, block_bytes: int = BLOCK_BYTES, salt: int = SALT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    words, sizes, phrases = mine(docs, block_bytes, salt)
    phrases = common.cut(phrases, "phrases-frequent")
    names = words.select(F.col("word_rank").alias("first"), "lang", "word")
    found = scored(words, phrases).withColumn("first", F.col("words")[0]).join(names.drop("word"), "first").drop("first")
    # The best of a bucket are few, whatever the language holds; ties stay until phrases have their words.
    bucketed = found.withColumn("bucket", F.pmod(F.hash("words"), F.lit(common.shuffle_width(docs.sparkSession))))
    worth = [F.desc("score"), F.desc("a")]
    near = common.cut(_best(bucketed, ["lang", "bucket"], worth, ties=True), "phrases-best")
    spelt = near.select("words", F.posexplode("words").alias("place", "first")).join(names.drop("lang"), "first").groupBy("words").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("line"))
    phrase = F.array_join(F.transform("line", lambda x: x["word"]), " ").alias("phrase")
    shown = near.drop("rank").join(spelt.select("words", phrase), "words")
    order = [*worth, F.col("phrase")]
    top = _best(_best(shown, ["lang", "bucket"], order), ["lang"], order)
    return top.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
lists AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w, row_number() OVER () AS id FROM pieces),
placed AS (SELECT lang, id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM lists),
joined AS (
  SELECT lang, x AS g1, x || ' ' || lead(x, 1) OVER p AS g2, x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p AS g3,
    x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p || ' ' || lead(x, 3) OVER p AS g4 FROM placed WINDOW p AS (PARTITION BY id ORDER BY i)),
grams AS (SELECT lang, 1 AS k, g1 AS g FROM joined UNION ALL SELECT lang, 2, g2 FROM joined UNION ALL SELECT lang, 3, g3 FROM joined UNION ALL SELECT lang, 4, g4 FROM joined),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS c FROM grams WHERE g IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
sizes AS (SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, g, c AS a, str_split(g, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.*, i FROM cand c, (VALUES (1), (2), (3)) AS v(i) WHERE i < k),
worth AS (
  SELECT x.lang, x.k, x.g, x.a, i, p.c AS l, q.c AS r, CAST((2000000::HUGEINT * x.a) // (p.c::HUGEINT + q.c) AS BIGINT) AS score FROM cuts x
  JOIN f p ON p.lang = x.lang AND p.g = array_to_string(w[1:i], ' ') JOIN f q ON q.lang = x.lang AND q.g = array_to_string(w[i + 1:], ' ')),
best AS (SELECT * FROM worth QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1),
inner_of AS (SELECT c.lang, array_to_string(w[s:s + m - 1], ' ') AS g, c.a AS longer FROM cand c, (VALUES (2), (3)) AS v(m), (VALUES (1), (2), (3)) AS u(s) WHERE m < k AND s + m - 1 <= k),
held AS (SELECT lang, g, max(longer) AS longer FROM inner_of GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.g = b.g WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT t.lang, rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept) t JOIN sizes z ON z.lang = t.lang WHERE rank <= 2000
"""
