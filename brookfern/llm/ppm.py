"""Language-model scores by prediction by partial matching over a byte-context trie.

The model is learnt from the training documents only.  A text is its lower-cased words, each closed by
a blank, and one more blank for the end token; it is coded byte by byte.  The context of a byte is what
precedes it in the text, over word borders, up to seven bytes (line breaks and a blank stand before the text).  Contexts are
trie nodes: the longest count occurrences, shorter ones count the longer contexts that a byte
was seen in.  An unseen byte escapes to the next shorter context, and bytes that the longer context has
seen are excluded there (symbol exclusion).  Below the empty context all bytes are equally likely.  The
chance of an escape is estimated for nodes of like length, visits and distinct bytes together, by
leaving each visit out in turn: a byte seen once would then have escaped.

Seven bytes serve large corpora and five small ones, so a text is coded by both orders (``ORDERS``; they share the
nodes of four bytes and less), and the code of a token is the mixture of both, each weighed by how it has coded the last ``WINDOW``
tokens of the text.  What is learnt grows with the corpus: every distinct string of eight bytes counts.

1. ``_blocks``: tasks make blocks of documents, and of each block its distinct strings (a context and its byte)
   with their training counts, sorted by reversed context, and its distinct words, by 64-bit hashes.
2. Strings are dealt out by a hash of the last three context bytes, so that a node and all its longer contexts meet.  Contexts
   that hold a 1,024th of the strings or more are dealt out by four or five bytes.  The nodes above these, at most
   1,024 of either length, and those of two bytes and less, at most 2^24 counts whatever the corpus, are
   counted by an aggregation (of ``_group_rows``) and broadcast.
3. ``_code_rows``: each group merges its strings over all blocks and returns code lengths (to 1/256 of a decade) to the blocks.
4. ``_document_rows``: blocks add up the code lengths of their documents.

Defined results: null or empty text is one end token; a row without doc_id is held out; repeated rows
score alike; without training documents every byte costs log10(256); ties do not matter; very long texts are scored whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

ORDER = 7
ORDERS = (7, 5)
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
#: Groups of strings for each block: a group is loaded as a whole.
GROUPS_A_BLOCK = 2
#: Contexts of three or four bytes with this share of all strings are dealt out by one byte more.
SPLIT_SHARE = 1 / 1024
WINDOW = 50
#: Steps of a code length in a decade.
STEPS = 256
_START = b"\n" * (ORDER - 1) + b" "
_U = np.uint64


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys byte plane by byte plane, which packs them to a byte or two each."""
    return _pack(keys.view(np.uint8).reshape(-1, 8).T)


def _unpack_keys(blob: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(_unpack(blob, n * 8, np.uint8).reshape(8, n).T).reshape(-1).view(_U)


def _cuts(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)


def _sorted_set(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[_cuts(a)]


def _mix(z: np.ndarray) -> np.ndarray:
    z = z * _U(0x9E3779B97F4A7C15)
    z ^= z >> _U(29)
    z *= _U(0xBF58476D1CE4E5B9)
    return z ^ (z >> _U(32))


# Strings: the byte before last in the highest place, ..., the byte to predict in the lowest


def stream(text: str | None) -> bytes:
    """The bytes that are coded."""
    words = (text or "").encode().lower().split()
    return b" ".join(words) + (b"  " if words else b" ")


def _tokens(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the blanks that close the tokens of some texts, and a 64-bit hash of each token."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.r_[0, ends[:-1] + 1]
    within = np.arange(len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)]))
    return ends, _mix(np.add.reduceat(_mix((within.astype(_U) << _U(8)) | data), starts))


def _token_counts(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct token hashes and their counts."""
    parts = [np.unique(_tokens(b"".join(streams[a:b]))[1], return_counts=True) for a, b in _slices(streams)]
    return _merge(np.concatenate([np.empty(0, _U), *(h for h, _ in parts)]), np.concatenate([np.empty(0, np.int64), *(c for _, c in parts)]))


def _parts_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Range of the hash, in ascending order."""
    return (((hashes >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)


def _keys(streams: list[bytes]) -> np.ndarray:
    """Per byte to predict, text by text: its context and itself in one integer."""
    data = np.frombuffer(b"".join([p for s in streams for p in (_START, s)]), np.uint8)
    lengths = np.fromiter(map(len, streams), np.int64, len(streams)) + ORDER
    own = np.ones(len(data), bool)
    starts = np.cumsum(lengths) - lengths
    for i in range(ORDER):
        own[starts + i] = False
    key = data.astype(_U)
    wide = key.copy()
    for back in range(1, ORDER + 1):
        key[back:] |= wide[:-back] << _U(8 * (8 - back))
    return key[own]


def _slices(streams: list[bytes]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, s in enumerate(streams):
        size += len(s)
        if size >= SLICE_BYTES or i == len(streams) - 1:
            yield first, i + 1
            first, size = i + 1, 0


def _distinct(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct strings and their counts."""
    parts = [np.unique(_keys(streams[a:b]), return_counts=True) for a, b in _slices(streams)]
    keys = _sorted_set(np.concatenate([np.empty(0, _U), *(k for k, _ in parts)]))
    counts = np.zeros(len(keys), np.int64)
    for k, c in parts:
        counts[np.searchsorted(keys, k)] += c
    return keys, counts


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = _cuts(keys)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _context(keys: np.ndarray, k: int) -> np.ndarray:
    return keys >> _U(64 - 8 * k) if k else np.zeros(len(keys), _U)


def _pair(keys: np.ndarray, k: int) -> np.ndarray:
    return (_context(keys, k) << _U(8)) | (keys & _U(255))


def _shorter(pair: np.ndarray) -> np.ndarray:
    return ((pair >> _U(16)) << _U(8)) | (pair & _U(255))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _group_of(keys: np.ndarray, split: dict[int, np.ndarray], groups: int) -> np.ndarray:
    three, four = _context(keys, 3), _context(keys, 4)
    long = _find(split[3], three)[1]
    longer = long & _find(split[4], four)[1]
    own = np.where(longer, _context(keys, 5) | _U(5 << 60), np.where(long, four | _U(4 << 60), three | _U(3 << 60)))
    return (_mix(own) % _U(groups)).astype(np.int64)


# Step 1: documents to blocks

_BLOCK_SCHEMA = "kind string, block long, part int, n long, doc_id array<{id}>, held_out array<boolean>, lengths array<int>, data binary, size long, counts binary"
_BLOCK_TYPES = [("kind", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("doc_id", None), ("held_out", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("data", pa.binary()), ("size", pa.int64()), ("counts", pa.binary())]


def _zipped(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _blocks(parts: int, block_bytes: int):
    names = [n for n, _ in _BLOCK_TYPES]

    def flush(number: int, rows: list[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        out = []
        for a, b in _slices([s for _, _, s in rows]):  # n: training tokens
            own = rows[a:b]
            tokens = sum(s.count(b" ") for _, held, s in own if not held)
            raw = b"".join([s for _, _, s in own])
            out.append(("doc", number, None, tokens, [d for d, _, _ in own], [held for _, held, _ in own], [len(s) for _, _, s in own], _zipped(raw), len(raw), None))
        words, every = _token_counts([s for _, _, s in rows])
        unseen, times = _token_counts([s for _, held, s in rows if held])
        every[np.searchsorted(words, unseen)] -= times
        part = _parts_of(words, parts)
        cut = np.r_[_cuts(part), len(part)].tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            out.append(("word", number, int(part[a]), b - a, None, None, None, _pack_keys(words[a:b]), None, _pack_keys(every[a:b])))
        del words, part, every
        keys, counts = _distinct([s for _, _, s in rows])
        unseen, times = _distinct([s for _, held, s in rows if held])
        counts[_find(keys, unseen)[0]] -= times
        out.append(("string", number, None, len(keys), None, None, None, _pack_keys(keys), None, _pack_keys(counts)))
        for length in (3, 4):
            context = _context(keys, length)
            first = _cuts(context)
            size = np.diff(np.r_[first, len(keys)])
            for i in np.flatnonzero(size >= SPLIT_SHARE / 4 * len(keys)).tolist():
                out.append(("heavy", number, length, int(size[i]), None, None, None, None, int(context[first[i]]), None))
        kinds = [t or pa.list_(id_type) for _, t in _BLOCK_TYPES]
        at = 0
        while at < len(out):
            upto, size = at, 0
            while upto < len(out) and upto - at < 1000 and size < SLICE_BYTES:
                size += len(out[upto][7] or b"")
                upto += 1
            columns = zip(*out[at:upto], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
            at = upto
        del out, keys, counts
        common.trim()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, used = TaskContext.get().partitionId() << 24, 0
        rows, size, id_type = [], 0, pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for d, text, held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                rows.append((d, held, stream(text.as_py())))
                size += len(rows[-1][2])
                if size >= block_bytes:
                    yield from flush(base + used, rows, id_type)
                    rows, size, used = [], 0, used + 1
        if rows:
            yield from flush(base + used, rows, id_type)

    return run


# Words, for the base score

_COUNT_SCHEMA = "kind string, block long, part int, n long, m long, a binary, b binary"
_COUNT_TYPES = {"kind": pa.string(), "block": pa.int64(), "part": pa.int32(), "n": pa.int64(), "m": pa.int64(), "a": pa.binary(), "b": pa.binary()}


def _table(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(types.items())})


def _word_rows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Training counts over all blocks of each block's words; block -1: how many of the part's words were trained."""
    n, data, counts_of = (table.column(c).to_pylist() for c in ("n", "data", "counts"))
    distinct, total, rows = _merged(data, counts_of, n)
    out = [("word", b, key[0].as_py(), len(r), 0, _pack_keys(total[np.searchsorted(distinct, r)]), None) for b, r in zip(table.column("block").to_pylist(), rows, strict=True)]
    out.append(("types", -1, key[0].as_py(), int((total > 0).sum()), 0, None, None))
    return _table(out, _COUNT_TYPES)


# Step 2: the trie

_GROUP_TYPES = {"grp": pa.int32(), "block": pa.int64(), "n": pa.int64(), "data": pa.binary(), "counts": pa.binary()}


def _grouped(split: dict[int, np.ndarray], groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, counts = _unpack_keys(r["data"], r["n"]), _unpack_keys(r["counts"], r["n"]).view(np.int64)
                group = _group_of(keys, split, groups)
                order = np.argsort(group, kind="stable")
                cut = np.r_[_cuts(group[order]), len(order)].tolist()
                rows = [(int(group[order[a]]), r["block"], b - a, _pack_keys(keys[order[a:b]]), _pack_keys(counts[order[a:b]])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield from _table(rows, _GROUP_TYPES).to_batches()

    return run


def _merged(data: list[bytes], counts_of: list[bytes], n: list[int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct strings of a group, their counts over all blocks, and each block's strings."""
    rows = [_unpack_keys(b, k) for b, k in zip(data, n, strict=True)]
    distinct = _sorted_set(np.concatenate(rows))
    counts = np.zeros(len(distinct), np.int64)
    for keys, blob in zip(rows, counts_of, strict=True):
        counts[np.searchsorted(distinct, keys)] += _unpack_keys(blob, len(keys)).view(np.int64)
    return distinct, counts, rows


Level = tuple[np.ndarray, np.ndarray]


def _levels(keys: np.ndarray, counts: np.ndarray) -> dict[int, Level]:
    """By context length from 7 to 3: sorted (context, byte) pairs and their counts; 8: those of five bytes by occurrences."""
    seen = counts > 0
    keys, counts = keys[seen], counts[seen]
    levels = {ORDER: (keys, counts), 8: _merge(_pair(keys, 5), counts)}
    for k in range(ORDER - 1, 2, -1):
        levels[k] = np.unique(_shorter(levels[k + 1][0]), return_counts=True)
    return levels


def _without(level: Level, contexts: np.ndarray) -> Level:
    own = ~_find(contexts, level[0] >> _U(8))[1]
    return level[0][own], level[1][own]


#: Escape estimates are kept for levels x visits x distinct bytes, both by classes of size.
_STATES = (9, 64, 32)


def _classes(x: np.ndarray, exact: int) -> np.ndarray:
    """Numbers below ``exact`` (a power of two) as they are, larger ones by powers of two."""
    x = np.maximum(x, 0).astype(np.int64)
    power = np.log2(np.maximum(x, 1)).astype(np.int64)
    return np.where(x < exact, x, exact + power - int(np.log2(exact)))


def _states(level: int, n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return (level * _STATES[1] + _classes(n, 1)) * _STATES[2] + _classes(d, 16)


def _node_stats(level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First pair, context, visits, distinct bytes and bytes seen once of each node."""
    pair, count = level
    first = _cuts(pair >> _U(8))
    if not len(first):
        return (first, np.empty(0, _U), *(np.empty(0, np.int64),) * 3)
    return first, (pair >> _U(8))[first], np.add.reduceat(count, first), np.diff(np.r_[first, len(pair)]), np.add.reduceat((count == 1).astype(np.int64), first)


def _left_out(number: int, level: Level) -> np.ndarray:
    """(state, escaped or not) counted over the visits of a level's nodes, each left out in turn."""
    grid = np.zeros((int(np.prod(_STATES)), 2), np.int64)
    _, _, n, d, once = _node_stats(level)
    some = n > 1
    n, d, once = n[some], d[some], once[some]
    np.add.at(grid[:, 1], _states(number, n - 1, d - 1), once)
    np.add.at(grid[:, 0], _states(number, n - 1, d), n - once)
    return grid


def escapes(grid: np.ndarray) -> np.ndarray:
    return (grid[:, 1] + 0.25) / (grid.sum(1) + 0.5)


_STAT_TYPES = {"level": pa.int32(), "key": pa.int64(), "times": pa.int64()}
_GROUP_SCHEMA = "kind string, level int, key long, times long, grp int, block array<long>, n array<long>, data array<binary>, counts array<binary>"
_GROUP_ROW = {"kind": pa.string(), **_STAT_TYPES, "grp": pa.int32(), "block": pa.list_(pa.int64()), "n": pa.list_(pa.int64()), "data": pa.list_(pa.binary()), "counts": pa.list_(pa.binary())}


def _stats(distinct: np.ndarray, counts: np.ndarray, split: dict[int, np.ndarray]) -> list[np.ndarray]:
    """level, key, times: what a group adds to the counts of pairs above it (levels 2 to 4) and to the escapes (level -1)."""
    levels = _levels(distinct, counts)
    above = {4: levels[4], 3: np.unique(_shorter(_without(levels[4], split[4])[0]), return_counts=True)}
    levels[4], levels[3] = _without(levels[4], split[4]), _without(above[3], split[3])
    above[2] = np.unique(_shorter(levels[3][0]), return_counts=True)
    out = []
    for k in (2, 3, 4):
        pair, times = above[k]
        if k > 2:
            own = _find(split[k], pair >> _U(8))[1]
            pair, times = pair[own], times[own]
        out.append((np.full(len(pair), k), pair.view(np.int64), times))
    grid = sum(_left_out(k, level) for k, level in levels.items()).ravel()
    used = np.flatnonzero(grid)
    out.append((np.full(len(used), -1), used, grid[used]))
    return [np.concatenate([o[i] for o in out]) for i in range(3)]


def _group_rows(split: dict[int, np.ndarray]):
    """The statistics of a group, and all it has in one row."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        common.trim()
        block, n, data, counts_of = (table.column(c).to_pylist() for c in ("block", "n", "data", "counts"))
        distinct, counts, _ = _merged(data, counts_of, n)
        found = _stats(distinct, counts, split)
        size = len(found[0])
        stats = {"kind": pa.array(["stat"] * size), **{c: pa.array(v, t) for (c, t), v in zip(_STAT_TYPES.items(), found, strict=True)}}
        whole = {"kind": ["group"], "grp": [key[0].as_py()], "block": [block], "n": [n], "data": [data], "counts": [counts_of]}
        columns = {}
        for c, t in _GROUP_ROW.items():
            columns[c] = pa.concat_arrays([stats[c].cast(t) if c in stats else pa.nulls(size, t), pa.array(whole[c], t) if c in whole else pa.nulls(1, t)])
        return pa.table(columns)

    return run


class Top:
    """The nodes above all groups and the escape estimates."""

    def __init__(self, rows: pa.Table, split: dict[int, np.ndarray]):
        level, key, times = (rows.column(c).to_numpy() for c in _STAT_TYPES)
        given = {}
        for k in (2, 3, 4):
            own = level == k
            given[k] = _merge(key[own].astype(np.int64).view(_U), times[own])
        self.split, self.levels = split, {4: given[4]}
        for k in (3, 2):
            longer = np.unique(_shorter(self.levels[k + 1][0]), return_counts=True)
            self.levels[k] = _merge(np.concatenate([given[k][0], longer[0]]), np.concatenate([given[k][1], longer[1]]))
        for k in (1, 0):
            self.levels[k] = np.unique(_shorter(self.levels[k + 1][0]), return_counts=True)
        grid = np.zeros(2 * int(np.prod(_STATES)), np.int64)
        own = level == -1
        np.add.at(grid, key[own], times[own])
        self.escape = escapes(grid.reshape(-1, 2) + sum(_left_out(k, x) for k, x in self.levels.items()))

    def with_group(self, keys: np.ndarray, counts: np.ndarray) -> dict[int, Level]:
        """All levels that the strings of a group need."""
        levels = _levels(keys, counts)
        levels[3] = np.unique(_shorter(_without(levels[4], self.split[4])[0]), return_counts=True)
        for k in (3, 4):
            local = _without(levels[k], self.split[k])
            levels[k] = _merge(np.concatenate([local[0], self.levels[k][0]]), np.concatenate([local[1], self.levels[k][1]]))
        return levels | {k: self.levels[k] for k in (0, 1, 2)}


def code_lengths(keys: np.ndarray, levels: dict[int, Level], escape: np.ndarray, order: int) -> np.ndarray:
    """log10 probability of each string's byte after its context, from contexts of ``order`` bytes down."""
    score = np.zeros(len(keys))
    # Only strings whose byte no longer context has seen are looked up further.
    left = np.arange(len(keys))
    # Of the longer context, if it was seen: how many bytes it saw and what they count for in the next shorter one.
    less_n, less_d = np.zeros(len(keys)), np.zeros(len(keys))
    for k in range(order, -1, -1):
        number = 8 if k == order != ORDER else k
        level = levels[number]
        first, node, visits, distinct, _ = _node_stats(level)
        if not len(first) or not len(left):
            continue
        own = keys[left]
        context = _context(own, k)
        at, known = _find(node, context)
        spot, there = _find(level[0], (context << _U(8)) | (own & _U(255)))
        n, d = visits[at], distinct[at]
        chance = escape[_states(number, n, d)]
        miss = known & ~there & (d > less_d)
        score[left[there]] += np.log10((1 - chance[there]) * level[1][spot[there]] / (n - less_n)[there])
        score[left[miss]] += np.log10(chance[miss])
        left, at, known = left[~there], at[~there], known[~there]
        less_n, less_d = less_n[~there], less_d[~there]
        if k:
            worth = _worth(level[0], first, distinct, _sorted_set(at[known]), levels[k - 1])
            less_n[known], less_d[known] = worth[at[known]], distinct[at[known]]
    score[left] -= np.log10(max(1, 256 - len(levels[0][0])))
    return score


def _worth(pair: np.ndarray, first: np.ndarray, size: np.ndarray, nodes: np.ndarray, shorter: Level) -> np.ndarray:
    """What the bytes of the asked nodes count for in the next shorter level."""
    out = np.zeros(len(first))
    if len(nodes):
        each = size[nodes]
        begin = np.cumsum(each) - each
        at = np.repeat(first[nodes] - begin, each) + np.arange(int(each.sum()))
        out[nodes] = np.add.reduceat(shorter[1][_find(shorter[0], _shorter(pair[at]))[0]], begin)
    return out


def _short_strings(keys: np.ndarray) -> np.ndarray:
    """Distinct pairs of five context bytes and a byte."""
    return _sorted_set(_pair(keys, ORDERS[1]))


def _stepped(code: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-STEPS * code), 65535).astype(np.uint16)


def _pack_codes(codes: np.ndarray) -> bytes:
    return _pack(np.ascontiguousarray(codes).view(np.uint8).reshape(-1, 2).T)


def _unpack_codes(blob: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(_unpack(blob, 2 * n, np.uint8).reshape(2, n).T).view(np.uint16).reshape(-1)


def _code_rows(top):
    """Code lengths of each block's strings: of seven bytes of context for each string, of five for each shorter one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = top.value
        for batch in batches:
            for r in range(batch.num_rows):
                common.trim()
                grp, block, n, data, counts_of = (batch.column(c)[r].as_py() for c in ("grp", "block", "n", "data", "counts"))
                distinct, counts, rows = _merged(data, counts_of, n)
                levels = own.with_group(distinct, counts)
                long = _stepped(code_lengths(distinct, levels, own.escape, ORDERS[0]))
                pairs = _short_strings(distinct)
                padded = ((pairs >> _U(8)) << _U(64 - 8 * ORDERS[1])) | (pairs & _U(255))
                short = _stepped(code_lengths(padded, levels, own.escape, ORDERS[1]))
                del levels, counts, padded
                out = []
                for b, keys in zip(block, rows, strict=True):
                    asked = _short_strings(keys)
                    out.append(("code", b, grp, len(keys), len(asked), _pack_codes(long[np.searchsorted(distinct, keys)]), _pack_codes(short[np.searchsorted(pairs, asked)])))
                yield from _table(out, _COUNT_TYPES).to_batches()

    return run


# Step 4: scores of documents


def mixed(code: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """log10 probability of each text from that of each token (rows) by each order (columns); texts: the first token of each."""
    total = np.concatenate([np.zeros((1, code.shape[1])), np.cumsum(code, axis=0)])
    at = np.arange(len(code))
    begin = np.repeat(texts, np.diff(np.r_[texts, len(code)]))
    ahead = total[at] - total[np.maximum(at - WINDOW, begin)]
    return np.add.reduceat(_log_sum(ahead + code) - _log_sum(ahead), texts)


def _log_sum(x: np.ndarray) -> np.ndarray:
    """log10 of the sum of the powers of ten in the two columns."""
    return np.maximum(x[:, 0], x[:, 1]) + np.log10(1 + 10.0 ** -np.abs(x[:, 0] - x[:, 1]))


def _document_rows(tokens: int, types: int, split: dict[int, np.ndarray], groups: int, id_type: pa.DataType):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, given: pa.Table) -> pa.Table:
        common.trim()
        got = sorted(zip(*(given.column(c).to_pylist() for c in ("kind", "part", "n", "m", "a", "b")), strict=True), key=lambda r: r[:2])
        # Distinct strings of each slice, and where each of its bytes finds its own.
        slices, words = [], np.empty(0, _U)
        for blob, size, lengths in zip(*(docs.column(c).to_pylist() for c in ("data", "size", "lengths")), strict=True):
            raw = pa.decompress(blob, size, codec="zstd", asbytes=True)
            ends = np.cumsum([0, *lengths]).tolist()
            own, where = np.unique(_keys([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]), return_inverse=True)
            blanks, hashes = _tokens(raw)
            own_words, which = np.unique(hashes, return_inverse=True)
            words = np.concatenate([words, own_words])
            slices.append((ends, own, where.astype(np.int32), blanks.astype(np.int32), own_words, which.astype(np.int32)))
        words = _sorted_set(words)
        keys = _sorted_set(np.concatenate([np.empty(0, _U), *(own for _, own, *_ in slices)]))
        code = np.empty((len(keys), 2), np.uint16)
        order, at = np.argsort(_group_of(keys, split, groups), kind="stable"), 0
        for kind, _, n, m, long, short in got:
            if kind == "code":
                own = order[at : at + n]
                code[own, 0] = _unpack_codes(long, n)
                code[own, 1] = _unpack_codes(short, m)[np.searchsorted(_short_strings(keys[own]), _pair(keys[own], ORDERS[1]))]
                at += n
        counts = np.concatenate([np.empty(0, np.int64), *(_unpack_keys(a, n).view(np.int64) for kind, _, n, _, a, _ in got if kind == "word")])
        del order, got
        plain = np.log10((counts + 0.1) / (tokens + 0.1 * (types + 1)))
        sizes, known, base, scores = [], [], [], []
        for lengths, own, where, ends, own_words, which in slices:
            byte = code[np.searchsorted(keys, own)][where] / -float(STEPS)
            texts = np.searchsorted(ends, lengths[:-1])
            scores.append(mixed(np.add.reduceat(byte, np.r_[0, ends[:-1] + 1], axis=0), texts))
            ids = np.searchsorted(words, own_words)[which]
            sizes.append(np.diff(np.r_[texts, len(ends)]))
            known.append(np.add.reduceat((counts[ids] > 0).astype(np.int64), texts))
            base.append(np.add.reduceat(plain[ids], texts))
        ids = [d for row in docs.column("doc_id").to_pylist() for d in row]
        return pa.table({
            "doc_id": pa.array(ids, id_type),
            "held_out": pa.array([h for row in docs.column("held_out").to_pylist() for h in row], pa.bool_()),
            "n_tokens": pa.array(np.concatenate(sizes), pa.int64()),
            "n_known": pa.array(np.concatenate(known), pa.int64()),
            "train_tokens": pa.array(np.full(len(ids), tokens), pa.int64()),
            "base_score": pa.array(np.concatenate(base), pa.float64()),
            "score": pa.array(np.concatenate(scores), pa.float64()),
        })

    return run


def score(docs: DataFrame, held_out: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score every document with a model of those where ``held_out`` is false."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, width = max(1, -(-size // block_bytes)), common.shuffle_width(spark)
    groups, parts = GROUPS_A_BLOCK * blocks, max(1, blocks // 2)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = _BLOCK_SCHEMA.format(id=kind)
    at = common.write_shared(docs.mapInArrow(_blocks(parts, block_bytes), schema), "ppm-blocks", "kind")
    stored = spark.read.schema(schema).parquet(at)
    words = common.cut(stored.filter("kind = 'word'").select("block", "part", "n", "data", "counts").groupBy("part").applyInArrow(_word_rows, _COUNT_SCHEMA), "ppm-words")
    types = words.filter("kind = 'types'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens = stored.filter("kind = 'doc'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    strings = stored.filter("kind = 'string'")
    share = SPLIT_SHARE * (strings.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 1)
    heavy = stored.filter("kind = 'heavy'").groupBy("part", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= share).collect()  # at most 1,024 of either length
    split = {k: np.array(sorted(r["size"] for r in heavy if r["part"] == k), _U) for k in (3, 4)}
    grouped = strings.select("block", "n", "data", "counts").mapInArrow(_grouped(split, groups), "grp int, block long, n long, data binary, counts binary").repartition(max(width, groups), "grp").groupBy("grp")
    held = common.write_shared(grouped.applyInArrow(_group_rows(split), _GROUP_SCHEMA), "ppm-groups", "kind")
    common.removed(spark, f"{at}/kind=string")  # the groups have them now
    grouped = spark.read.schema(_GROUP_SCHEMA).parquet(held)
    stats = grouped.filter("kind = 'stat'").groupBy("level", "key").agg(F.sum("times").alias("times"))
    top = spark.sparkContext.broadcast(Top(stats.toArrow(), split))
    codes = grouped.filter("kind = 'group'").select("grp", "block", "n", "data", "counts").mapInArrow(_code_rows(top), _COUNT_SCHEMA)
    # As many tasks as blocks, so that none grows with the input.
    dealt = lambda df: df.repartition(max(width, blocks), "block").groupBy("block")
    given = dealt(codes.unionByName(words.filter("kind = 'word'")))
    kept = dealt(stored.filter("kind = 'doc'").select("block", "doc_id", "held_out", "lengths", "data", "size"))
    rows = _document_rows(tokens, types, split, groups, to_arrow_type(docs.schema["doc_id"].dataType))
    return kept.cogroup(given).applyInArrow(rows, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 10 == 0
    return score(common.table(spark, sf_dir, "documents"), held)
