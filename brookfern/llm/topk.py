"""Exact top-k search by distributed histogram selection.

Queries meet all rows in blocks: a block of candidates and a block of queries give one
matrix of integer scores.  For every query a range of scores is known to hold its k-th
score; each round counts the scores of all blocks in the cells of that range and keeps
the cell that the k-th falls in, until the range is one value.  Then each block filters what
reaches it, orders ties by the smaller id and keeps k rows of each query, and a last
ranking keeps k of those.

Blocks are rows (packed arrays), so nothing is paired row by row.  The pairs of blocks form a grid: query
blocks are dealt into groups and candidate blocks by salts, a candidate block is sent once to each group and a query
block once to each salt, and both are equality-joined on (group, salt).  The grid has a few cells for each
shuffle partition, of a shape that moves the fewest bytes; neither side is broadcast.

Defined results: vectors that are null or hold a null or non-finite component take no part; a
shorter vector counts as padded with zeros; a component becomes floor(256 * x); rows that share an id are
never candidates of that id's query; fewer than k candidates are all returned; an empty table gives
an empty result; repeated (equal id) candidates each take a place; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE = 256
CELLS = 1024
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 256
#: Cells of the grid for each shuffle partition.
CELLS_A_PARTITION = 4
_PACKED = "block long, n int, dims int, ids binary, vectors binary"


def _packed(block_rows: int):
    """Vectors of a task in blocks of equal length, as arrays."""

    def pack(base: int, used: list, dims: int, ids: list, vectors: list) -> pa.RecordBatch:
        number = base + used[0]
        used[0] += 1
        values = (pa.array([number], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([dims], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([np.concatenate(vectors).tobytes() if dims else b""]))
        return pa.RecordBatch.from_arrays([*values], ["block", "n", "dims", "ids", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, used = TaskContext.get().partitionId() << 24, [0]
        waiting: dict[int, tuple[list, list]] = {}
        for batch in batches:
            column = batch.column(1)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum([0, *(len(x) for x in column.to_pylist())])
            for row, i in enumerate(batch.column(0).to_pylist()):
                x = np.floor(SCALE * flat[ends[row] : ends[row + 1]])
                ids, vectors = waiting.setdefault(len(x), ([], []))
                ids.append(i)
                vectors.append(x)
                if len(ids) == block_rows:
                    yield pack(base, used, len(x), ids, vectors)
                    del waiting[len(x)]
        for dims, (ids, vectors) in waiting.items():
            yield pack(base, used, dims, ids, vectors)

    return run


def _matrix(n: int, dims: int, blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(n, dims)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles while they are exact, else in Python integers."""
    d = min(queries.shape[1], rows.shape[1])
    a, b = queries[:, :d], rows[:, :d]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(d, 1) < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in a], object) @ np.array([[int(v) for v in r] for r in b], object).T
    return exact.astype(np.int64)  # raises if a score is no long


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of blocks: the histogram of each query's scores within its range."""
    for batch in batches:
        for r in batch.to_pylist():
            queries, rows = _matrix(r["qn"], r["qdims"], r["qvectors"]), _matrix(r["n"], r["dims"], r["vectors"])
            ids, own = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["qids"], np.int64)
            low, width = np.frombuffer(r["low"], np.int64), np.frombuffer(r["width"], np.int64)
            score = _scores(queries, rows)
            cell = (score - low[:, None]) // np.maximum(width, 1)[:, None]
            inside = (width > 0)[:, None] & (cell >= 0) & (cell < CELLS) & (ids[None, :] != own[:, None])
            flat = np.bincount((cell + np.arange(r["qn"])[:, None] * CELLS)[inside], minlength=r["qn"] * CELLS)
            where = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), r["qblock"])), pa.array(where // CELLS, pa.int32()), pa.array(where % CELLS, pa.int32()), pa.array(flat[where], pa.int64())], ["qblock", "slot", "cell", "rows"])


def _filter_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                queries, rows = _matrix(r["qn"], r["qdims"], r["qvectors"]), _matrix(r["n"], r["dims"], r["vectors"])
                ids, own = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["qids"], np.int64)
                score = _scores(queries, rows)
                slot, at = np.nonzero((score >= np.frombuffer(r["low"], np.int64)[:, None]) & (ids[None, :] != own[:, None]))
                value = score[slot, at]
                order = np.lexsort((ids[at], -value, slot))
                slot, at, value = slot[order], at[order], value[order]
                first = np.searchsorted(slot, slot, "left")
                keep = np.arange(len(slot)) - first < k
                yield pa.RecordBatch.from_arrays([pa.array(own[slot[keep]]), pa.array(ids[at[keep]]), pa.array(value[keep])], ["query_id", "vec_id", "score"])

    return run


def search(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query.  Both tables: vec_id, embedding."""
    spark = rows.sparkSession
    usable = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and x = x and abs(x) < double('infinity'))"
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(usable)
    candidates = common.cut(clean(rows).mapInArrow(_packed(CANDIDATE_BLOCK), _PACKED), "topk-rows")
    asked = clean(queries).mapInArrow(_packed(QUERY_BLOCK), _PACKED)
    qblocks = common.cut(asked.select(F.col("block").alias("qblock"), F.col("n").alias("qn"), F.col("dims").alias("qdims"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors")), "topk-queries")

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [float(np.sqrt((_matrix(r["n"], r["dims"], r["vectors"]) ** 2).sum(1)).max(initial=0)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(tops, pa.float64())], ["length"])

    length = candidates.mapInArrow(longest, "length double").agg(F.coalesce(F.max("length"), F.lit(0.0))).first()[0]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                bound = np.ceil(np.sqrt((_matrix(r["qn"], r["qdims"], r["qvectors"]) ** 2).sum(1)) * length * (1 + 1e-9)).astype(np.int64) + 1
                width = np.ones_like(bound)
                while (short := width * CELLS < 2 * bound + 1).any():
                    width[short] *= CELLS  # powers of CELLS, so that cells split evenly
                out.append((r["qblock"], (-bound).tobytes(), width.tobytes(), np.full(r["qn"], k, np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["qblock", "low", "width", "left"])

    state_schema = "qblock long, low binary, width binary, left binary"
    n_queries, n_rows = qblocks.count(), candidates.count()
    cells = CELLS_A_PARTITION * common.shuffle_width(spark)
    groups = max(1, min(n_queries, round((cells * n_queries * QUERY_BLOCK / max(1, n_rows * CANDIDATE_BLOCK)) ** 0.5)))
    salts = max(1, min(n_rows, cells // groups))

    def pairs(state: DataFrame) -> DataFrame:
        """Each candidate block with each query block and its ranges."""
        known = qblocks.join(state, "qblock").withColumns({"group": F.pmod(F.xxhash64("qblock"), F.lit(groups)), "salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))})
        dealt = candidates.withColumns({"salt": F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"), "group": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))})
        return dealt.hint("merge").join(known, ["group", "salt"]).drop("group", "salt")

    def narrow(key: tuple[pa.Scalar, ...], table: pa.Table, counts: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        low, width, left = (np.frombuffer(row[c], np.int64).copy() for c in ("low", "width", "left"))
        grid = np.zeros((len(low), CELLS), np.int64)
        if counts.num_rows:
            np.add.at(grid, (counts.column("slot").to_numpy(), counts.column("cell").to_numpy()), counts.column("rows").to_numpy())
        above = np.cumsum(grid[:, ::-1], axis=1)[:, ::-1]  # scores in this cell or a higher one
        enough = above >= left[:, None]
        cell = np.where(enough.any(1), CELLS - 1 - enough[:, ::-1].argmax(1), 0)
        settled = (width == 0) | ~enough.any(1)  # its k-th score is known, or it has fewer candidates than k: everything stays
        higher = np.where(cell + 1 < CELLS, above[np.arange(len(low)), np.minimum(cell + 1, CELLS - 1)], 0)
        low = np.where(settled, low, low + cell * width)
        left = np.where(settled, left, left - higher)
        width = np.where(settled | (width == 1), 0, width // CELLS)
        coarse = int((width > 0).sum())
        return pa.table({"qblock": pa.array([row["qblock"]], pa.int64()), "low": pa.array([low.tobytes()]), "width": pa.array([width.tobytes()]), "left": pa.array([left.tobytes()]), "coarse": pa.array([coarse], pa.int64())})

    state = qblocks.mapInArrow(start, state_schema)
    coarse = n_queries
    while coarse:  # a width of 0 marks a settled query
        counts = pairs(state).mapInArrow(_count_rows, "qblock long, slot int, cell int, rows long").groupBy("qblock", "slot", "cell").agg(F.sum("rows").alias("rows"))
        state = common.cut(state.groupBy("qblock").cogroup(counts.groupBy("qblock")).applyInArrow(narrow, state_schema + ", coarse long"), "topk-state")
        coarse = state.agg(F.sum("coarse")).first()[0]
        state = state.select("qblock", "low", "width", "left")
    best = pairs(state).mapInArrow(_filter_rows(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    return search(rows.filter("vec_id % 50 = 0"), rows, 5)
