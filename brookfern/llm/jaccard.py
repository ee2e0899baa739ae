"""N-gram Jaccard join by a count-vector R-tree.

A document's set is its distinct five-word shingles.  Hashing the shingles into ``GROUPS`` groups and counting each group
turns a set into a point, and the summed coordinate minima of two points bound the overlap of their sets from
above; the maxima of a tree node's points bound that of all its sets.  Pairs that survive the bound in
the tree are verified on whole sets.

1. Blocks of documents exchange packed shingle hashes by hash range and learn which of theirs occur elsewhere, and how
   often.  Only those can be shared, so only those are counted in a point, while sizes stay whole: a text with more than
   a fifth of its own shingles can't reach the bound and leaves here.  Equal sets are one point from here on.
2. The directory of the tree addresses points by coordinate: of two similar sets the rarest fifth (and one more) meet
   in a shingle, so a point hangs below each of its rare shared shingles.  Below that, points are packed
   by size and counts into leaves of ``FAN`` and nodes of ``FAN`` children; pairs of nodes descend together while the
   bound, the sizes and the addresses allow.  Tasks hold buckets of addresses, each of ``HOT`` points at most.
3. An address of more points is hot: its points are first held against one of them, its centre.  What is still in several classes is
   packed into pages by size (sizes of similar sets differ by a quarter at most) with their own subtrees; page pairs are joined if the
   bound of their roots allows and they hold several classes.  Sets travel with the points of a page, so pairs are verified in place and only links between
   classes leave it.

No link that could join two classes is lost; classes are found by star contraction.

Defined results: words are split and ASCII-lower-cased; a text of fewer words is one shingle; null, empty and
word-less texts have an empty set and link with nothing, equal ones included; rows of one doc_id are classed each by its own text; rows without doc_id
link like others, but don't name a class (component_id is null if nothing else does); equal rows stay apart rows with one
answer; an empty table gives an empty result; very long texts are read whole; other columns are ignored.
Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, near
from .components import components
from .suffix import _mix, _pack, _short, _unpack

#: Similar: 100 * intersection >= PERCENT * union.
PERCENT = 80
GROUPS = 64
#: Points below a node of the tree.
FAN = 8
#: An address with more points is held against a centre first.
HOT = 32
#: Points, and shingles of all of them, of a page of a hot address.
PAGE_POINTS, PAGE_HASHES = 1024, 1 << 19
#: Points of a bucket of addresses.
BUCKET_POINTS = 1 << 16
BLOCK_BYTES = 2 << 20
#: Node pairs tested at once.
CHUNK = 1 << 14
_U = np.uint64


def _narrow(points: np.ndarray) -> list[bytes]:
    """Each row of counts in the narrowest unsigned type that holds it."""
    top = points.max(1, initial=0)
    return [row.astype(np.uint8 if t < 256 else np.uint16 if t < 65536 else np.uint32).tobytes() for row, t in zip(points, top.tolist(), strict=True)]


def _wide(rows: list[bytes]) -> np.ndarray:
    kinds = {GROUPS: np.uint8, 2 * GROUPS: np.uint16, 4 * GROUPS: np.uint32}
    out = np.empty((len(rows), GROUPS), np.int32)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join([rows[i] for i in at.tolist()]), kinds[size]).reshape(-1, GROUPS)
    return out


class Tree:
    """Packed R-tree over count vectors; points of different addresses never pair."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, address: np.ndarray | None = None):
        address = np.zeros(len(points), np.int64) if address is None else address
        #: Place of each point of the tree in the given arrays.
        self.order = np.lexsort((points[:, 2], points[:, 1], points[:, 0], sizes, address))
        first = address[self.order]
        level = (points[self.order], sizes[self.order], first, first)
        #: From the points up: maxima of the counts, least size, first and last address.
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), FAN)
            level = (np.maximum.reduceat(level[0], at), np.minimum.reduceat(level[1], at), level[2][at], np.maximum.reduceat(level[3], at))
            self.levels.append(level)

    def _passing(self, other: Tree, height: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (top, size, low, high), (top2, size2, low2, high2) = self.levels[min(height, len(self.levels) - 1)], other.levels[min(height, len(other.levels) - 1)]
        kept = np.flatnonzero((low[a] <= high2[b]) & (low2[b] <= high[a]))
        a, b = a[kept], b[kept]
        bound = np.minimum(top[a], top2[b]).sum(1, dtype=np.int64)
        return kept[(100 + PERCENT) * bound >= PERCENT * (size[a] + size2[b])]

    def _below(self, height: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of the nodes one level down, and the place of their parents."""
        if height > len(self.levels) - 1:  # a lower tree waits at its root
            return nodes, np.arange(len(nodes))
        size = len(self.levels[height - 1][0])
        child = nodes[:, None] * FAN + np.arange(FAN)
        there = child < size
        return child[there], np.repeat(np.arange(len(nodes)), there.sum(1))

    def join(self, other: Tree | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j) of points that the bound lets through, in batches; of the tree itself each pair once."""
        own = other is None
        other = self if own else other
        if not len(self.order) or not len(other.order):
            return
        top = max(len(self.levels), len(other.levels)) - 1
        open_pairs = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while open_pairs:
            height, a, b = open_pairs.pop()
            if len(a) > CHUNK:
                open_pairs += [(height, a[CHUNK:], b[CHUNK:])]
                a, b = a[:CHUNK], b[:CHUNK]
            kept = self._passing(other, height, a, b)
            a, b = a[kept], b[kept]
            if not len(a):
                continue
            if height == 0:
                if own:
                    a, b = a[a < b], b[a < b]
                yield self.order[a], other.order[b]
                continue
            # Each pair of parents gives all pairs of their children.
            left, of_left = self._below(height, a)
            right, of_right = other._below(height, b)
            many = np.bincount(of_right, minlength=len(b))
            start = np.cumsum(many) - many
            times = many[of_left]
            x = np.repeat(left, times)
            y = right[np.repeat(start[of_left] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
            if own:
                x, y = x[x <= y], y[x <= y]
            open_pairs.append((height - 1, x, y))


def _point_rows(ranges: int, id_type: pa.DataType):
    """Every row with its point's name and set size; the first row of a point in a block that can link, also with its counts, addresses and shared shingles."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, hits: pa.Table) -> pa.Table:
        lists = pa.list_(pa.int64())
        kinds = {"doc_id": id_type, "node": pa.int64(), "n": pa.int64(), "point": pa.binary(), "keys": lists, "shared": lists}
        if not docs.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        common.trim()
        texts = docs.column("text").to_pylist()
        value, counts = near.shingles(texts)
        rows = len(texts)
        blank = np.zeros(rows, bool)
        for i in np.flatnonzero(counts == 1).tolist():
            blank[i] = not (texts[i] or "").encode().strip()
        del texts
        owner = np.repeat(np.arange(rows), counts)
        order = np.lexsort((value, owner))
        value = value[order]
        new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
        value, owner = value[new], owner[new]
        size = np.bincount(owner, minlength=rows)
        starts = np.cumsum(size) - size
        node = _mix(np.add.reduceat(_mix(value ^ _U(0xA5A5A5A5A5A5A5A5)), starts) + size.astype(_U)).view(np.int64)
        n = np.where(blank, 0, size)
        kept = np.zeros(rows, bool)
        kept[np.unique(node, return_index=True)[1]] = True
        kept &= ~blank
        mine = kept[owner]
        value, owner = value[mine], owner[mine]
        packed = hits.column("n").to_pylist()
        known = _unpack(hits.column("hashes").to_pylist(), packed, np.uint32).astype(_U) | (np.repeat(np.array(hits.column("part").to_pylist(), _U), packed) << _U(32))
        ranks = _unpack(hits.column("ranks").to_pylist(), packed, np.uint8)
        by_hash = np.argsort(known)
        known, ranks = known[by_hash], ranks[by_hash]
        if len(known):
            short = _short(value, ranges)
            spot = np.minimum(np.searchsorted(known, short), len(known) - 1)
            found = known[spot] == short
            value, owner, rank = value[found], owner[found], ranks[spot[found]]
        else:
            value, owner, rank = value[:0], owner[:0], ranks
        shared = np.bincount(owner, minlength=rows)
        addresses = np.maximum(0, shared + (-PERCENT * n // 100) + 1)  # those of the rarest that others may share
        addresses[~kept] = 0
        able = np.flatnonzero(addresses)
        mine = addresses[owner] > 0
        value, rank, owner = value[mine], rank[mine], (np.cumsum(addresses > 0) - 1)[owner[mine]]
        cell = (value >> _U(40)).astype(np.int64) & (GROUPS - 1)
        points = np.bincount(owner * GROUPS + cell, minlength=len(able) * GROUPS).reshape(-1, GROUPS)
        shared = shared[able]
        rarest = np.lexsort((value, rank, owner))
        place = np.arange(len(value)) - np.repeat(np.cumsum(shared) - shared, shared)
        keyed = rarest[place < addresses[able][owner]]
        lead = pa.array(np.where(addresses > 0, np.cumsum(addresses > 0) - 1, -1), pa.int64(), mask=addresses == 0)
        out = pa.table({
            "doc_id": docs.column("doc_id").combine_chunks(),
            "node": pa.array(node),
            "n": pa.array(n, pa.int64()),
            "point": pa.array(_narrow(points), pa.binary()).take(lead),
            "keys": near._lists(value[keyed], addresses[able]).take(lead),
            "shared": near._lists(value, shared).take(lead),
        })
        common.trim()
        return out

    return run


def points(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, node, n, point, keys, shared) of every row; the last three where a row leads a point that can link."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int")
    by_block = rows.withColumn("block", block).repartition(max(blocks, 2), "block").groupBy("block")
    ranges = max(4, blocks // 4)
    hashes = by_block.applyInArrow(near._hash_rows(ranges), "part int, block int, n int, hashes binary, counts binary")
    hits = hashes.groupBy("part").applyInArrow(near._shared_rows, "block int, part int, n int, hashes binary, ranks binary")
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, node long, n long, point binary, keys array<long>, shared array<long>"
    return by_block.cogroup(hits.groupBy("block")).applyInArrow(_point_rows(ranges, to_arrow_type(kind)), schema)


def _bucket_pairs(table: pa.Table) -> pa.Table:
    """Pairs of points of a bucket of addresses that the tree lets through."""
    common.trim()
    node, size, address = (table.column(c).to_numpy() for c in ("node", "n", "key"))
    tree = Tree(_wide(table.column("point").to_pylist()), size, address)
    found = [np.empty((0, 2), np.int64)]
    for i, j in tree.join():
        u, v = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        found.append(np.unique(np.column_stack([u, v])[u < v], axis=0))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})


@F.arrow_udf(T.LongType())
def _minima(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(np.minimum(_wide(a.to_pylist()), _wide(b.to_pylist())).sum(1, dtype=np.int64))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar; only shared shingles can be in both."""
    u, v = (sets.select(F.col("node").alias(x), F.col("n").alias(size), F.col("shared").alias(h)) for x, size, h in (("u", "a", "hu"), ("v", "b", "hv")))
    similar = f"{100 + PERCENT} * size(array_intersect(hu, hv)) >= {PERCENT} * (a + b)"
    return common.cut(pairs.join(v, "v").join(u, "u").filter(similar).select("u", "v"), "jaccard-links")


def _page(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A page as one row: what prunes it, and its points with their sets, packed."""
    points = _wide(table.column("point").to_pylist())
    root, size = table.column("root").to_numpy(), table.column("n").to_numpy()
    lists = table.column("shared").combine_chunks()
    ends = np.cumsum(np.fromiter((len(x) for x in lists), np.int64, len(lists)))
    values = lists.flatten().to_numpy()
    body = {"node": table.column("node").to_numpy(), "n": size, "root": root, "ends": ends, "points": points.ravel(), "values": values}
    return pa.table({
        **{c: pa.array([k.as_py()], k.type) for c, k in zip(("key", "slice", "tile"), key, strict=True)},
        "low": pa.array([int(root.min())]), "high": pa.array([int(root.max())]), "least": pa.array([int(size.min())]),
        "top": pa.array([points.max(0).tolist()], pa.list_(pa.int32())),
        "rows": pa.array([len(root)], pa.int32()), "hashes": pa.array([len(values)], pa.int64()),
        **{c: pa.array([_pack(x)], pa.binary()) for c, x in body.items()},
    })


_PAGE = "key long, slice int, tile int, low long, high long, least long, top array<int>, rows int, hashes long, node binary, n binary, root binary, ends binary, points binary, values binary"


class _Page:
    def __init__(self, row: dict):
        rows = row["rows"]
        self.node, self.n, self.root, self.ends = (_unpack([row[c]], [rows], np.int64) for c in ("node", "n", "root", "ends"))
        self.points = _unpack([row["points"]], [rows], np.int32, GROUPS)
        self.values = _unpack([row["values"]], [row["hashes"]], np.int64)
        self.tree = Tree(self.points, self.n)

    def set(self, i: int) -> np.ndarray:
        return self.values[self.ends[i - 1] if i else 0 : self.ends[i]]


def _page_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links between classes of two pages: at most one fewer than they have classes."""
    for batch in batches:
        for row in batch.to_pylist():
            one, two = (_Page(row[x]) for x in ("a", "b"))
            parent: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            links = []
            for i, j in one.tree.join(two.tree):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if (p := find(int(one.root[x]))) == (q := find(int(two.root[y]))):
                        continue
                    both = len(np.intersect1d(one.set(x), two.set(y), assume_unique=True))
                    if (100 + PERCENT) * both >= PERCENT * (one.n[x] + two.n[y]):
                        parent[p] = q
                        links.append((int(one.node[x]), int(two.node[y])))
            common.trim()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["u", "v"])


def _apart(hot: DataFrame, first: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the points of hot addresses that are still in several classes."""
    rooted = hot.join(components(first), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("key").agg((F.min("root") < F.max("root")).alias("several")).filter("several").select("key")
    # Sizes of similar sets differ by a quarter at most: they are in one slice or in neighbouring ones.
    left = rooted.join(several, "key").withColumn("slice", F.floor(F.log("n") / F.log(F.lit(101 / PERCENT))).cast("int"))
    tiles = left.groupBy("key", "slice").agg(F.ceil(F.greatest(F.count("*") / PAGE_POINTS, F.sum("n") / PAGE_HASHES)).cast("int").alias("tiles"))
    tiled = left.join(tiles, ["key", "slice"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    paged = tiled.select("key", "slice", "tile", "node", "n", "root", "point").join(sets.select("node", "shared"), "node")
    pages = common.cut(paged.groupBy("key", "slice", "tile").applyInArrow(_page, _PAGE), "jaccard-pages")
    a = pages.select("key", F.struct(*pages.columns).alias("a"), F.explode(F.array(F.col("slice"), F.col("slice") + 1)).alias("slice"))
    b = pages.select("key", "slice", F.struct(*pages.columns).alias("b"))
    bound = F.aggregate(F.zip_with("a.top", "b.top", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    met = a.join(b, ["key", "slice"]).filter("(a.slice < b.slice or a.tile <= b.tile) and least(a.low, b.low) < greatest(a.high, b.high)")
    met = met.filter((100 + PERCENT) * bound >= PERCENT * (F.col("a.least") + F.col("b.least")))
    return common.cut(met.select("a", "b").mapInArrow(_page_links, "u long, v long"), "jaccard-apart")


def links(prints: DataFrame) -> DataFrame:
    """(u, v): verified links between points, enough of them to connect every class."""
    able = prints.filter("keys is not null")
    nodes = common.cut(able.select("node", "n", "point", "keys").dropDuplicates(["node"]), "jaccard-nodes")
    keyed = nodes.select("node", "n", "point", F.explode("keys").alias("key"))
    often = keyed.groupBy("key").agg(F.count("*").alias("k"), F.min_by("node", F.xxhash64("node", "key")).alias("centre")).filter("k > 1")
    met = common.cut(keyed.join(often, "key"), "jaccard-addresses")
    buckets = max(common.shuffle_width(prints.sparkSession), -(-met.filter(F.col("k") <= HOT).count() // BUCKET_POINTS))
    cool = met.filter(F.col("k") <= HOT).select("key", "node", "n", "point", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    paired = cool.groupBy("bucket").applyInArrow(_bucket_pairs, "u long, v long")
    hot = met.filter(F.col("k") > HOT)
    centres = hot.filter("node = centre").select("key", F.col("n").alias("a"), F.col("point").alias("other"))
    fans = hot.join(centres, "key").filter("node <> centre").filter((100 + PERCENT) * _minima("point", "other") >= PERCENT * (F.col("n") + F.col("a")))
    every = paired.unionAll(fans.select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v")))
    pairs = common.cut(every.distinct(), "jaccard-pairs")
    asked = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).unionAll(hot.select("node")).distinct()
    sets = common.cut(able.select("node", "n", "shared").join(asked, "node", "left_semi").dropDuplicates(["node"]), "jaccard-sets")
    first = _verified(pairs, sets)
    return first.unionAll(_apart(hot, first, sets))


def classes(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: a class is named by its least doc_id."""
    prints = common.cut(points(docs, block_bytes), "jaccard-points")
    sets = prints.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least_doc"))
    rooted = sets.join(components(links(prints)), "node", "left").select("node", "least_doc", F.coalesce("root", "node").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    named = common.cut(rooted.join(names, "root").select("node", "component_id"), "jaccard-names")
    some = prints.filter("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionAll(prints.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"))


#: Shingle sets, their pairwise overlaps by shared shingles, and reachability.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT u, v FROM met JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 180 * k >= 80 * (x.n + y.n)),
reached AS (SELECT u AS doc_id, u AS other FROM links UNION SELECT r.doc_id, l.v FROM reached r JOIN links l ON l.u = r.other)
SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, coalesce(min(r.other), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reached r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
