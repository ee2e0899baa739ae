"""Removal of repeated byte strings with a distributed, sampled suffix array.

A byte goes if a 50-byte string covers it that also starts in a document with a smaller
doc_id.  Suffixes are taken at *anchors*: the least-hashed 16-byte strings of every 50-byte
window.  Equal windows have equal anchors, so every repeat shows as two anchored suffixes
that agree on the 16 bytes, and at least one anchor lies in each window.

1. ``anchors``: blocks of documents send the short hashes of their anchors, by hash range; a
   range finds those of two documents and tells the blocks that have them.
2. ``suffixes``: for such anchors the blocks send the 50 bytes from the anchor and the 34
   before it.  Copies within a block are decided there: only the suffix of the least
   document is sent.  Sampled splitters deal the suffixes into ranges of their leading
   eight bytes; equal leading bytes never straddle two ranges, which leaves nothing to
   compare across a boundary.
3. ``matches``: each range sorts its suffixes by multikey quicksort on 8-byte keys, to the
   right and to the left of the anchor; the common-prefix lengths of neighbours give, for each of the 35
   windows around an anchor, the classes of equal windows and their least document.
4. ``repeats``: the blocks cover the bytes of the windows that lost.

The documents are shuffled once; the three uses share that exchange.  Nothing is collected
but the number of bytes and the splitters.

Defined results: null or empty text has no bytes and no spans; texts under 50 bytes stay;
a string repeated only within one document, or only in rows of one doc_id, stays; rows
without doc_id are neither cut nor a reason to cut; repeated rows are cut alike; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MATCH = 50
GRAM = 16
LEFT = MATCH - GRAM
SPAN = LEFT + 1  # anchors a window chooses among; also the windows around an anchor
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
_U = np.uint64


def _mix(z: np.ndarray) -> np.ndarray:
    z = z * _U(0x9E3779B97F4A7C15)
    z ^= z >> _U(29)
    z *= _U(0xBF58476D1CE4E5B9)
    z ^= z >> _U(32)
    return z


def _slide(a: np.ndarray, pick, width: int) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        a = pick(a[:-done], a[done:])
        done *= 2
    return pick(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


def _anchors_of(piece: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors in ``piece``; room: bytes left in its document from each position on."""
    n = len(piece)
    if n < MATCH:
        return np.empty(0, np.int64), np.empty(0, _U)
    x = piece.astype(_U)
    for step, shift in ((1, 8), (2, 16), (4, 32)):
        x = x[:-step] | (x[step:] << _U(shift))
    m = n - GRAM + 1
    h = _mix(_mix(x[:m]) ^ (x[8 : 8 + m] * _U(0xD6E8FEB86659FD93))) | _U(1)
    least = _slide(h, np.minimum, SPAN)
    least[room[: len(least)] < MATCH] = 0
    edge = np.zeros(SPAN - 1, _U)
    top = _slide(np.concatenate([edge, least, edge]), np.maximum, SPAN)
    at = np.flatnonzero(top == h)
    return at, h[at]


class _Block:
    """The documents of one block in a fixed order, as one byte array."""

    def __init__(self, table: pa.Table):
        rows = [(d, t.encode() if t else b"") for d, t in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True)]
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.ids = [r[0] for r in rows]
        self.texts = [r[1] for r in rows]
        self.known = sum(d is not None for d in self.ids)
        self.doc_id = np.array(self.ids[: self.known], np.int64)
        self.lengths = np.fromiter(map(len, self.texts), np.int64, len(rows))
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position in the block, number of the document and hash of each anchor of a document with a doc_id."""
        stop = int(self.ends[self.known - 1]) if self.known else 0
        spots, hashes = [], []
        for a in range(0, stop, SLICE_BYTES):  # slices overlap by all but one byte of a window
            b = min(stop, a + SLICE_BYTES + MATCH - 1)
            first, last = np.searchsorted(self.ends, [a, b - 1], "right")
            ends = self.ends[first : last + 1]
            room = np.repeat(ends, np.diff(np.concatenate([[a], np.minimum(ends, b)]))) - np.arange(a, b)
            at, h = _anchors_of(self.data[a:b], room)
            spots.append(at + a)
            hashes.append(h)
        at, h = (np.concatenate([np.empty(0, np.int64), *spots]), np.concatenate([np.empty(0, _U), *hashes]))
        if len(spots) > 1:
            at, keep = np.unique(at, return_index=True)
            h = h[keep]
        return at, np.searchsorted(self.ends, at, "right"), h


def _short(h: np.ndarray, ranges: int) -> np.ndarray:
    """Range number in the upper half, 32 more bits of the hash in the lower."""
    return (((h >> _U(32)) * _U(ranges)) & ~_U(0xFFFFFFFF)) | ((h >> _U(1)) & _U(0xFFFFFFFF))


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _unpack(blobs: list[bytes], sizes: list[int], kind, width: int = 0) -> np.ndarray:
    each = np.dtype(kind).itemsize * max(width, 1)
    parts = [np.frombuffer(pa.decompress(b, n * each, codec="zstd", asbytes=True), kind) for b, n in zip(blobs, sizes, strict=True)]
    out = np.concatenate([np.empty(0, kind), *parts])
    return out.reshape(-1, width) if width else out


def _cuts(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.empty(0, np.int64)


def _anchor_rows(ranges: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, doc, h = (block := _Block(table)).anchors()
        short = _short(h, ranges)
        order = np.lexsort((doc, short))
        short, ids = short[order], block.doc_id[doc[order]]
        first = _cuts(short)
        size = np.diff(np.r_[first, len(short)])
        several = ids[first] != ids[first + size - 1]  # an anchor of two documents of the block is sent twice
        sent = np.repeat(short[first], 1 + several)
        part = (sent >> _U(32)).astype(np.int64)
        cut = np.r_[_cuts(part), len(part)].tolist()
        low = sent.astype(np.uint32)
        rows = [(int(part[a]), b - a, _pack(low[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([key[0].as_py()] * len(rows), pa.int32()), "n": pa.array([r[1] for r in rows], pa.int32()), "hashes": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _shared_rows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    n = table.column("n").to_pylist()
    low = _unpack(table.column("hashes").to_pylist(), n, np.uint32)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.argsort(low, kind="stable")
    first = _cuts(low[order])
    size = np.diff(np.r_[first, len(low)])
    shared = np.zeros(len(low), bool)
    shared[order] = np.repeat(size > 1, size)
    low, owner = low[shared], owner[shared]
    blocks = table.column("block").to_pylist()
    cut = np.r_[_cuts(owner), len(owner)].tolist()
    rows = [(blocks[owner[a]], b - a, _pack(low[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([key[0].as_py()] * len(rows), pa.int32()), "n": pa.array([r[1] for r in rows], pa.int32()), "hashes": pa.array([r[2] for r in rows], pa.binary())})


#: Rows between the steps: suffixes of a block for a bucket, or windows of a block that lost.
_SENT = "bucket int, block int, n int, lost boolean, who binary, at binary, ids binary, room binary, bytes binary"


def _sent(rows: list[tuple]) -> pa.Table:
    kinds = {"bucket": pa.int32(), "block": pa.int32(), "n": pa.int32(), "lost": pa.bool_(), **dict.fromkeys(("who", "at", "ids", "room", "bytes"), pa.binary())}
    return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())})


def _windows(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Bit o of each entry: the window that starts o bytes before the anchor lies in the document."""
    high, low = np.minimum(before, LEFT), np.maximum(MATCH - after, 0)
    full = ((_U(1) << (high + 1).astype(_U)) - _U(1)) & ~((_U(1) << np.minimum(low, 63).astype(_U)) - _U(1))
    return np.where(high >= low, full, _U(0))


def _suffix_rows(ranges: int, splitters: np.ndarray):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, hits: pa.Table) -> pa.Table:
        if not docs.num_rows or not hits.num_rows:
            return _sent([])
        block, number = _Block(docs), key[0].as_py()
        at, doc, h = block.anchors()
        n = hits.column("n").to_pylist()
        known = _unpack(hits.column("hashes").to_pylist(), n, np.uint32).astype(_U) | (np.repeat(np.array(hits.column("part").to_pylist(), _U), n) << _U(32))
        known.sort()
        short = _short(h, ranges)
        found = known[np.minimum(np.searchsorted(known, short), len(known) - 1)] == short
        at, doc, h = at[found], doc[found], h[found]
        del short, known, found
        before = np.minimum(at - block.starts[doc], LEFT).astype(np.uint8)
        after = np.minimum(block.ends[doc] - at, MATCH).astype(np.uint8)
        padded = np.concatenate([np.zeros(LEFT, np.uint8), block.data, np.zeros(MATCH, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, LEFT + MATCH)[at]
        col = np.arange(LEFT + MATCH)
        rows[(col < LEFT - before[:, None].astype(np.int64)) | (col >= LEFT + after[:, None].astype(np.int64))] = 0
        # Copies within the block: equal suffixes, told by a hash and then compared byte by byte.
        wide = np.concatenate([rows, before[:, None], after[:, None], np.zeros((len(rows), 2), np.uint8)], axis=1).view("<u8")
        mark = _mix(h)
        for c in range(wide.shape[1]):
            mark = _mix(mark ^ wide[:, c])
        order = np.argsort(mark, kind="stable")
        first = _cuts(mark[order])
        size = np.diff(np.r_[first, len(order)])
        lead = np.empty(len(order), np.int64)
        lead[order] = np.repeat(order[first], size)
        ids = block.doc_id[doc]
        lost = (ids > ids[lead]) & (wide == wide[lead]).all(1)
        del wide, mark
        place = at - block.starts[doc]
        out = []
        if lost.any():
            out.append((number % (len(splitters) + 1), number, int(lost.sum()), True, _pack(doc[lost].astype(np.uint32)), _pack(place[lost]), None, None, _pack(_windows(before[lost].astype(np.int64), after[lost].astype(np.int64)))))
        sent = np.flatnonzero(~lost)
        words = rows[sent, LEFT : LEFT + 8].copy().view(">u8").ravel().astype(_U)
        bucket = np.searchsorted(splitters, words, "right")
        order = np.lexsort((words, bucket))
        sent, bucket = sent[order], bucket[order]
        cut = np.r_[_cuts(bucket), len(bucket)].tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            s = sent[a:b]
            out.append((int(bucket[a]), number, b - a, False, _pack(doc[s].astype(np.uint32)), _pack(place[s]), _pack(ids[s]), _pack(np.stack([before[s], after[s]], 1)), _pack(rows[s])))
        return _sent(out)

    return run


def _multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of the rows by several integer keys: later keys only sort what the earlier ones leave tied."""
    order = np.argsort(columns[0], kind="stable")
    new = np.r_[True, np.diff(columns[0][order]) != 0]
    for column in columns[1:]:
        tied = ~(new & np.r_[new[1:], True])
        spots = np.flatnonzero(tied)
        if not len(spots):
            break
        group = np.cumsum(new)[spots]
        rows = order[spots]
        rows = rows[np.lexsort((column[rows], group))]
        order[spots] = rows
        differs = np.r_[True, column[rows[1:]] != column[rows[:-1]]]
        new[spots] |= differs
    return order


def _keys(rows: np.ndarray) -> list[np.ndarray]:
    """Bytes of the rows as big-endian 8-byte keys, which sort as the bytes do."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    words = padded.view(">u8")
    return [words[:, i].astype(_U) for i in range(words.shape[1])]


def _neighbours(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common-prefix length of each row with the one before it in the order (0 for the first)."""
    common_length = np.zeros(len(order), np.int16)
    for a in range(1, len(order), 100_000):
        b = min(len(order), a + 100_000)
        same = rows[order[a:b]] == rows[order[a - 1 : b - 1]]
        common_length[a:b] = np.where(same.all(1), rows.shape[1], same.argmin(1))
    return common_length


def _match_rows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    local = table.filter(table.column("lost"))
    out = [(int(key[0].as_py()), b, n, True, w, a, None, None, m) for b, n, w, a, m in zip(*(local.column(c).to_pylist() for c in ("block", "n", "who", "at", "bytes")), strict=True)]
    table = table.filter(pc.invert(table.column("lost")))
    n = table.column("n").to_pylist()
    blob = lambda name, kind, width=0: _unpack(table.column(name).to_pylist(), n, kind, width)
    rows = blob("bytes", np.uint8, LEFT + MATCH)
    if not len(rows):
        return _sent(out)
    who, at, ids, room = blob("who", np.uint32), blob("at", np.int64), blob("ids", np.int64), blob("room", np.uint8, 2)
    owner = np.repeat(np.arange(len(n)), n)
    inside = _windows(room[:, 0].astype(np.int64), room[:, 1].astype(np.int64))
    right, left = rows[:, LEFT:], rows[:, LEFT - 1 :: -1]
    sorted_right = _multikey_order(_keys(right))
    shared_right = _neighbours(right, sorted_right)
    # Suffixes that share fewer than 16 bytes with both neighbours (equal short hashes only) repeat nothing.
    alone = (shared_right < GRAM) & (np.r_[shared_right[1:], 0] < GRAM)
    live = sorted_right[~alone]
    if not len(live):
        return _sent(out)
    rows, who, at, ids, owner, inside = rows[live], who[live], at[live], ids[live], owner[live], inside[live]
    shared_right, left = shared_right[~alone], rows[:, LEFT - 1 :: -1]
    sorted_left = _multikey_order(_keys(left))
    shared_left = _neighbours(left, sorted_left)
    lost = np.zeros(len(live), _U)
    left_class = np.empty(len(live), np.int64)
    for o in range(SPAN):
        at_right = np.cumsum(shared_right < MATCH - o)  # the rows stand in right order
        left_class[sorted_left] = np.cumsum(shared_left < o) if o else 0
        usable = np.flatnonzero((inside >> _U(o)) & _U(1))
        window = at_right[usable] * (len(live) + 1) + left_class[usable]
        order = np.argsort(window, kind="stable")
        first = _cuts(window[order])
        if not len(first):
            continue
        owned = ids[usable[order]]
        least = np.repeat(np.minimum.reduceat(owned, first), np.diff(np.r_[first, len(order)]))
        lost[usable[order[owned > least]]] |= _U(1) << _U(o)
    some = np.flatnonzero(lost)
    some = some[np.argsort(owner[some], kind="stable")]
    cut = np.r_[_cuts(owner[some]), len(some)].tolist()
    blocks = table.column("block").to_pylist()
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        s = some[a:b]
        out.append((int(key[0].as_py()), blocks[owner[s[0]]], b - a, True, _pack(who[s]), _pack(at[s]), None, None, _pack(lost[s])))
    return _sent(out)


def _repeat_rows(key: tuple[pa.Scalar, ...], docs: pa.Table, lost: pa.Table) -> pa.Table:
    block = _Block(docs)
    size = len(block.data)
    begins = np.zeros(size, bool)
    blobs = [lost.column(c).to_pylist() for c in ("n", "who", "at", "bytes")]
    for n, who, at, mask in zip(*blobs, strict=True):
        base = block.starts[_unpack([who], [n], np.uint32)] + _unpack([at], [n], np.int64)
        mask = _unpack([mask], [n], _U)
        for o in range(SPAN):
            begins[base[((mask >> _U(o)) & _U(1)).astype(bool)] - o] = True
    # A window covers the 50 bytes from its start on, all within its document.
    count = np.cumsum(begins, dtype=np.int32)
    covered = count > 0 if size <= MATCH else np.r_[count[:MATCH] > 0, count[MATCH:] > count[:-MATCH]]
    kept, spans = [], []
    for s, e, text in zip(block.starts.tolist(), block.ends.tolist(), block.texts, strict=True):
        own = covered[s:e]
        if not own.any():
            kept.append(text)
            spans.append([])
            continue
        edge = np.flatnonzero(np.diff(np.r_[0, own.view(np.int8), 0]))
        spans.append([{"start": a, "length": b - a} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
        kept.append(block.data[s:e][~own].tobytes())
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    return pa.table({"doc_id": pa.array(block.ids, pa.int64()), "n_bytes": pa.array(block.lengths, pa.int64()), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.large_binary()).cast(pa.binary())})


def repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the removed byte spans of every document and the bytes that stay."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    # One suffix of every document, at a pseudorandom place, is the sample for the splitters.
    spot = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length(raw), F.lit(1))).cast("int") + 1
    token = F.conv(F.rpad(F.hex(F.substring(raw, spot, F.lit(8))), 16, "0"), 16, 10).cast("double")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    ranges = min(1 << 16, max(4, blocks))
    steps = [i / blocks for i in range(1, min(blocks, 1 << 14))]
    picked = docs.filter("length(text) > 0").agg(F.percentile_approx(token, steps, 10_000)).first()[0] if steps else []
    splitters = np.unique(np.array([min(int(x), (1 << 64) - 1) for x in picked or []], _U))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(blocks)).cast("int")).repartition(max(blocks, 2), "block")
    by_block = dealt.groupBy("block")
    hashes = by_block.applyInArrow(_anchor_rows(ranges), "part int, block int, n int, hashes binary")
    hits = hashes.groupBy("part").applyInArrow(_shared_rows, "block int, part int, n int, hashes binary")
    sent = by_block.cogroup(hits.groupBy("block")).applyInArrow(_suffix_rows(ranges, splitters), _SENT)
    lost = sent.groupBy("bucket").applyInArrow(_match_rows, _SENT).select("block", "n", "who", "at", "bytes")
    return by_block.cogroup(lost.groupBy("block")).applyInArrow(_repeat_rows, "doc_id long, n_bytes long, spans array<struct<start: long, length: long>>, kept binary")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(common.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["length"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
