"""Near-duplicate classes: SimHash signatures and rare shared shingles find pairs, whole sets verify them.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8
or more.  Equal sets are one node.  At that similarity 64-bit fingerprints differ in ten bits or so,
and segments short enough to differ in one bit at most hold nine bits: deletion variants of
them would pair a share of all documents.  So the variants of ``simhash.links`` give the
pairs within two bits, and prefix filtering gives the rest, without loss:

1. Blocks of documents send their shingle hashes, packed, by hash range; a range counts them over the whole
   corpus and tells each block which of its own are shared, and how frequent they are.
2. Of two similar sets the rarest fifth (and one more) share a hash, whatever order ranks the
   hashes.  So a node is keyed by those of its rarest fifth that are shared; a text with enough words of its
   own is never keyed by a passage that many texts hold.
3. Nodes of one key are pairs if sizes and parity bitmaps allow a similarity of 0.8 (the bits in which two
   bitmaps differ are at most the hashes that only one set has).  A key of more than ``HOT`` nodes is not
   paired: its nodes are compared with one of them, its centre.
4. These pairs are verified.  Nodes of a hot key that are still in several classes are then compared by their
   bitmaps, in tiles of ``TILE`` nodes, and possible pairs of two classes are verified, too.

Only shared hashes are needed to verify: others are in one set only.  No pair that could add a link between
classes is left out.

Defined results: null and word-less texts are equal; a text of fewer than five words is one shingle; words are
split and lower-cased as in ``simhash``; rows without doc_id have no class and always stay; rows of one doc_id are
classed each by its own text; of equal rows one stays; an empty table gives an empty result; very long texts are
read whole; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, simhash
from .components import components
from .suffix import _cuts, _mix, _pack, _short, _unpack

SHINGLE_WORDS = 5
SEED = 42
#: A key with more nodes is not paired at once.
HOT = 32
#: Nodes of a hot key that are compared with each other in one place.
TILE = 2048
BLOCK_BYTES = 2 << 20
_U = np.uint64
_WORDS_OF_BITS = 8  # 512 bits
_BITS = [f"b{i}" for i in range(_WORDS_OF_BITS)]
_MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def shingles(texts: list[str | None], width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of the texts, end to end and with repeats, and their number for each text."""
    import xxhash

    numbers = _Numbers()
    rows = [np.fromiter(map(numbers.__getitem__, (t or "").encode().lower().split()), np.int32) for t in texts]
    hashed = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in numbers), _U, len(numbers))
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    word = np.concatenate([np.empty(0, _U), hashed[np.concatenate([np.empty(0, np.int32), *rows])], np.zeros(width, _U)])
    starts = np.cumsum(lengths) - lengths
    counts = np.maximum(1, lengths - width + 1)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    room = np.repeat(np.minimum(lengths, width).astype(np.int8), counts)
    total = room.astype(_U)
    for i in range(width):
        part = word[at + i]
        part[room <= i] = 0
        part *= _U(_MULTIPLIERS[i % 5] + 2 * (i // 5))
        total += part
    return _mix(_mix(total)), counts


def _hash_rows(ranges: int):
    """Distinct hashes of a block and their counts, by range."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        distinct, counts = np.unique(_short(shingles(table.column("text").to_pylist())[0], ranges), return_counts=True)
        common.trim()
        part = (distinct >> _U(32)).astype(np.int64)
        low, few = distinct.astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
        cut = np.r_[_cuts(part), len(part)].tolist()
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        return pa.table({
            "part": pa.array([int(part[a]) for a, _ in spans], pa.int32()),
            "block": pa.array([key[0].as_py()] * len(spans), pa.int32()),
            "n": pa.array([b - a for a, b in spans], pa.int32()),
            "hashes": pa.array([_pack(low[a:b]) for a, b in spans], pa.binary()),
            "counts": pa.array([_pack(few[a:b]) for a, b in spans], pa.binary()),
        })

    return run


def _shared_rows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each block its hashes of the range that are counted more than once, with their rank of frequency."""
    common.trim()
    n = table.column("n").to_pylist()
    low = _unpack(table.column("hashes").to_pylist(), n, np.uint32)
    counts = _unpack(table.column("counts").to_pylist(), n, np.uint8)
    order = np.argsort(low, kind="stable")
    first = _cuts(low[order])
    total = np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    rank = np.empty(len(low), np.uint8)
    rank[order] = np.repeat(np.minimum(4 * np.log2(np.maximum(total, 1)), 255).astype(np.uint8), np.diff(np.r_[first, len(low)]))
    owner = np.repeat(np.arange(len(n)), n)[rank > 0]
    low, rank = low[rank > 0], rank[rank > 0]
    blocks = table.column("block").to_pylist()
    cut = np.r_[_cuts(owner), len(owner)].tolist()
    spans = list(zip(cut[:-1], cut[1:], strict=True))
    return pa.table({
        "block": pa.array([blocks[owner[a]] for a, _ in spans], pa.int32()),
        "part": pa.array([key[0].as_py()] * len(spans), pa.int32()),
        "n": pa.array([b - a for a, b in spans], pa.int32()),
        "hashes": pa.array([_pack(low[a:b]) for a, b in spans], pa.binary()),
        "ranks": pa.array([_pack(rank[a:b]) for a, b in spans], pa.binary()),
    })


def _fingerprints(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SimHash of each run of values."""
    ends = np.r_[starts[1:], len(values)]
    out, a = np.empty(len(starts), _U), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + 100_000, "right")))
        own = values[starts[a] : ends[b - 1]]
        bits = np.unpackbits(own.view(np.uint8).reshape(len(own), 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts[a:b] - starts[a], axis=0, dtype=np.int32)
        out[a:b] = np.packbits(ones * 2 > (ends[a:b] - starts[a:b])[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        a = b
    return out


def _bitmaps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Parities of the numbers of values in each cell, as words of 64 bits."""
    ends, width = np.r_[starts[1:], len(values)], 64 * _WORDS_OF_BITS
    out = np.empty((len(starts), _WORDS_OF_BITS), np.int64)
    for a in range(0, len(starts), 2000):
        b = min(len(starts), a + 2000)
        owner = np.repeat(np.arange(b - a), ends[a:b] - starts[a:b])
        cell = (values[starts[a] : ends[b - 1]] >> _U(40)).astype(np.int64) & (width - 1)
        odd = np.bincount(owner * width + cell, minlength=(b - a) * width).reshape(b - a, width) & 1
        out[a:b] = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<i8")
    return out


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int64()), pa.array(values.view(np.int64))).cast(pa.list_(pa.int64()))


def _node_rows(ranges: int, id_type: pa.DataType):
    """Every row with its node; the first row of a node in a block also with what pairs are found and verified by."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, hits: pa.Table) -> pa.Table:
        rows = docs.num_rows
        if not rows:
            empty = {"doc_id": id_type, "text_key": pa.int64(), "node": pa.int64(), "n": pa.int64(), "fp": pa.int64(), **dict.fromkeys(_BITS, pa.int64()), "keys": pa.list_(pa.int64()), "shared": pa.list_(pa.int64())}
            return pa.table({c: pa.array([], t) for c, t in empty.items()})
        common.trim()
        value, counts = shingles(docs.column("text").to_pylist())
        owner = np.repeat(np.arange(rows), counts)
        order = np.lexsort((value, owner))
        value = value[order]
        new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
        value, owner = value[new], owner[new]
        size = np.bincount(owner, minlength=rows)
        starts = np.cumsum(size) - size
        node = _mix(np.add.reduceat(_mix(value ^ _U(0xA5A5A5A5A5A5A5A5)), starts) + size.astype(_U))
        leads = np.sort(np.unique(node, return_index=True)[1])
        kept = np.zeros(rows, bool)
        kept[leads] = True
        own = kept[owner]
        value, owner = value[own], (np.cumsum(kept) - 1)[owner[own]]
        size = size[leads]
        starts = np.cumsum(size) - size
        n = hits.column("n").to_pylist()
        known = _unpack(hits.column("hashes").to_pylist(), n, np.uint32).astype(_U) | (np.repeat(np.array(hits.column("part").to_pylist(), _U), n) << _U(32))
        ranks = _unpack(hits.column("ranks").to_pylist(), n, np.uint8)
        by_hash = np.argsort(known)
        known, ranks = known[by_hash], ranks[by_hash]
        short = _short(value, ranges)
        spot = np.minimum(np.searchsorted(known, short), max(len(known) - 1, 0))
        shared = np.flatnonzero(known[spot] == short) if len(known) else np.empty(0, np.int64)
        rank, whose = ranks[spot[shared]] if len(known) else np.empty(0, np.uint8), owner[shared]
        common_size = np.bincount(whose, minlength=len(leads))
        rarest = np.lexsort((value[shared], rank, whose))
        place = np.arange(len(shared)) - np.repeat(np.cumsum(common_size) - common_size, common_size)
        prefix = size + (-4 * size // 5) + 1 - (size - common_size)  # its place among the shared ones
        keyed = place < prefix[whose]
        lead = pa.array(np.where(kept, np.cumsum(kept) - 1, -1), pa.int64(), mask=~kept)
        take = lambda a: a.take(lead)
        bits = _bitmaps(value, starts)
        columns = {"doc_id": docs.column("doc_id").combine_chunks(), "text_key": docs.column("text_key").combine_chunks(), "node": pa.array(node.view(np.int64)), "n": take(pa.array(size, pa.int64())), "fp": take(pa.array(_fingerprints(value, starts).view(np.int64)))}
        columns |= {name: take(pa.array(bits[:, i])) for i, name in enumerate(_BITS)}
        columns["keys"] = take(_lists(value[shared][rarest][keyed], np.bincount(whose[keyed], minlength=len(leads))))
        columns["shared"] = take(_lists(value[shared], common_size))
        out = pa.table(columns)
        del value, owner, order, new, short, spot, rank, whose, rarest, place, keyed, bits, columns, known, ranks
        common.trim()
        return out

    return run


def text_key(text: str = "text") -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.col(text).cast("string"))


def _prints(docs: DataFrame, block_bytes: int) -> DataFrame:
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_key", text_key())
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    # Equal rows of one task stay together, those of others do not.
    block = F.pmod(F.xxhash64("doc_id", "text_key", F.spark_partition_id()), F.lit(blocks)).cast("int")
    by_block = rows.withColumn("block", block).repartition(max(blocks, 2), "block").groupBy("block")
    ranges = max(4, blocks // 4)  # a block sends a row to a range it has hashes of
    hashes = by_block.applyInArrow(_hash_rows(ranges), "part int, block int, n int, hashes binary, counts binary")
    hits = hashes.groupBy("part").applyInArrow(_shared_rows, "block int, part int, n int, hashes binary, ranks binary")
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, text_key long, node long, n long, fp long, {', '.join(f'{b} long' for b in _BITS)}, keys array<long>, shared array<long>"
    from pyspark.sql.pandas.types import to_arrow_type

    return by_block.cogroup(hits.groupBy("block")).applyInArrow(_node_rows(ranges, to_arrow_type(kind)), schema)


_POSSIBLE = f"5 * least(a, b) >= 4 * greatest(a, b) and 9 * ({' + '.join(f'bit_count(u{b} ^ v{b})' for b in _BITS)}) <= a + b"


def _ends(df: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """``df`` as either end of a pair: u with size a, v with size b, and the bits of both."""
    return tuple(df.select(*more, F.col("node").alias(x), F.col("n").alias(size), *(F.col(b).alias(x + b) for b in _BITS), *(F.col(c).alias(c + x) for c in df.columns if c in ("root", "tile"))) for x, size in (("u", "a"), ("v", "b")))


def _verified(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar, by their whole sets."""
    asked = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct()
    sets = common.cut(prints.filter("n is not null").select("node", "n", "shared").join(common.dealt(asked), "node", "left_semi").dropDuplicates(["node"]), "near-sets")
    u, v = (sets.select(F.col("node").alias(x), F.col("n").alias(size), F.col("shared").alias(h)) for x, size, h in (("u", "a", "hu"), ("v", "b", "hv")))
    return common.cut(pairs.join(common.dealt(v), "v").join(common.dealt(u), "u").filter("9 * size(array_intersect(hu, hv)) >= 4 * (a + b)").select("u", "v"), "near-links")


def links(prints: DataFrame) -> DataFrame:
    """(u, v): verified links between nodes, enough of them to connect every class."""
    nodes = common.cut(prints.filter("n is not null").select("node", "n", "fp", *_BITS, "keys").dropDuplicates(["node"]), "near-nodes")
    keyed = nodes.select("node", "n", *_BITS, F.explode("keys").alias("key"))
    often = keyed.groupBy("key").agg(F.count("*").alias("k"), F.min_by(F.struct("node", "n", *_BITS), F.xxhash64("node", "key")).alias("centre")).filter("k > 1")
    met = common.cut(keyed.join(common.dealt(often.select("key", "k")), "key"), "near-keys")
    u, v = _ends(met.filter(F.col("k") <= HOT), "key")
    paired = u.join(common.dealt(v), "key").filter(f"u < v and {_POSSIBLE}").select("u", "v")
    hot = met.filter(F.col("k") > HOT)
    centres = often.filter(F.col("k") > HOT).select("key", F.col("centre.node").alias("u"), F.col("centre.n").alias("a"), *(F.col(f"centre.{b}").alias(f"u{b}") for b in _BITS))
    fans = _ends(hot, "key")[1].join(common.dealt(centres), "key").filter(f"u <> v and {_POSSIBLE}").select("u", "v")
    prints_of = nodes.groupBy("fp").agg(F.min("node").alias("u"))
    same = nodes.select("fp", F.col("node").alias("v")).join(common.dealt(prints_of), "fp").filter("u <> v").select("u", "v")
    near = simhash.links(prints_of.select("fp")).select(F.col("u").alias("fu"), F.col("v").alias("fv"))
    near = near.join(common.dealt(prints_of.select(F.col("fp").alias("fu"), "u")), "fu").join(common.dealt(prints_of.select(F.col("fp").alias("fv"), F.col("u").alias("v"))), "fv").select("u", "v")
    every = paired.unionAll(fans).unionAll(same).unionAll(near)
    pairs = common.cut(every.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-pairs")
    first = _verified(pairs, prints)
    roots = components(first)
    rooted = hot.join(common.dealt(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), (F.min("root") < F.max("root")).alias("several")).filter("several").drop("several")
    numbered = rooted.join(common.dealt(split), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiled = numbered.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"low": F.least("own", "tile"), "high": F.greatest("own", "tile")}).drop("tile").withColumnRenamed("own", "tile")
    u, v = _ends(tiled.select("key", "low", "high", "node", "n", *_BITS, "root", "tile"), "key", "low", "high")
    left = u.join(common.dealt(v), ["key", "low", "high"]).filter(f"u < v and rootu <> rootv and (tileu <> tilev or low = high) and {_POSSIBLE}").select("u", "v")
    rest = common.cut(left.distinct(), "near-rest")
    return first.unionAll(_verified(rest, prints))


def classes(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text_key, component_id) of every row with a doc_id: the class is named by its least doc_id."""
    prints = common.cut(_prints(docs.filter("doc_id is not null"), block_bytes), "near-prints")
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("least_doc"))
    roots = components(links(prints))
    rooted = nodes.join(common.dealt(roots), "node", "left").select("node", "least_doc", F.coalesce("root", "node").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    named = common.cut(rooted.join(common.dealt(names), "root").select("node", "root", "component_id"), "near-names")
    return prints.select("doc_id", "text_key", "node").join(common.dealt(named), "node").select("doc_id", "text_key", "component_id", "root")


def deduplicated(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row of each class: that of the least doc_id, of its several texts the one of the least key, and of equal
    ones the one whose other columns hash least.  Rows without doc_id stay."""
    kept = classes(docs, block_bytes).groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("keeper"))
    kept = kept.select(F.col("keeper.doc_id").alias("near_id"), F.col("keeper.text_key").alias("near_key")).distinct()
    plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("near_row"), F.col("doc_id").alias("near_id"), text_key().alias("near_key"), F.xxhash64(*(F.col(f"`{c}`") for c in plain)).alias("near_rank"))
    chosen = row.filter("near_id is not null").join(kept, ["near_id", "near_key"], "left_semi")
    best = chosen.groupBy("near_id", "near_key").agg(F.min_by("near_row", "near_rank").alias("near_row"))
    return best.select("near_row.*").unionByName(docs.filter("doc_id is null"))
