"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by pseudo-rotations (three rounds of random signs and a fast Hadamard transform) and hashed to the
nearest signed axis, of the first AXES ones at most. A table joins two such hashes into cells; each vector lies in one cell
of each table.

A query goes through two rounds. The scout looks into the `scout` cells of the first table that its own coordinates favour,
and so finds a k-th best cosine s. From s and the query's coordinates follows the chance that a vector of that cosine lies
in a cell (see axis_chances); the second round looks into the likeliest cells of the other tables, as many as it takes until
such a vector is missed with a chance of `miss` at most. The nearer the neighbours, the fewer the cells, whatever the number of
rows. Where the scout met fewer than k rows, or the cells wanted amount to a whole table, all cells of one table are looked
into, which is exact: no query gets fewer than k rows if there are as many candidates.

Cells are dealt over tasks in blocks: each table is cut into at least `blocks` runs of neighbouring cells, and into more where a
run would pass rows_per_block rows; a cell with more rows than that makes several parts. A query goes only to the blocks with cells that it looks into, and what it meets there is ranked by exact
cosines, of which the k best of a block go on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.llm.words import tasks
from cairnlake.plans.checkpoints import cut

#: Long vectors are hashed by so many coordinates of their rotated form, so that the cells stay few at any length.
AXES = 64
#: At most so many lots of neighbouring cells of a table are counted for the layout.
LOTS = 1 << 14
_FOUND = "query_id long, qh long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Hadamard transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """The first AXES coordinates after a pseudo-random rotation; rows are padded with zeros to a power of two."""
    size = 1 << (x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], size))
    return x[:, :AXES]


def signed_axes(x: np.ndarray, seed: int) -> np.ndarray:
    """Coordinates along every signed axis after the rotation: the largest names the hash."""
    x = rotate(x, seed)
    return np.concatenate([x, -x], axis=1)


def cells_of(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """The cell of each unit vector in a table."""
    first, second = (signed_axes(x, seed + 2 * table + i) for i in (0, 1))
    return first.argmax(axis=1) * first.shape[1] + second.argmax(axis=1)


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function by a published rational approximation, off by less than 2e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    tail = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return np.sign(x) * (1 - tail * np.exp(-x * x))


def axis_chances(q: np.ndarray, s: np.ndarray, size: int, points: int = 24) -> np.ndarray:
    """For rotated unit vectors q (rows, of `size` coordinates before the cut) and a cosine s of each: how likely each signed axis is the hash of a vector that has
    this cosine with q and is random otherwise. Its coordinates are about normal around s * q; the chance that one of them
    is the largest in size is integrated over its value."""
    s = np.clip(s, 0.0, 0.999)[:, None]
    spread, mean = np.sqrt((1 - s * s) / size), s * q
    low, high = 0.2 * spread, np.abs(mean).max(axis=1, keepdims=True) + 5 * spread
    at = low + (high - low) * (np.arange(points) + 0.5) / points
    width = math.sqrt(2) * spread[:, :, None]
    above, below = (at[:, :, None] - mean[:, None, :]) / width, (-at[:, :, None] - mean[:, None, :]) / width
    inside = np.log(np.maximum((_erf(above) - _erf(below)) / 2, 1e-12))
    others = inside.sum(axis=2, keepdims=True) - inside
    chances = np.concatenate([np.exp(others - above**2).sum(axis=1), np.exp(others - below**2).sum(axis=1)], axis=1)
    return chances / chances.sum(axis=1, keepdims=True)


def scout_cells(x: np.ndarray, n_cells: int, seed: int) -> np.ndarray:
    """A mask of the n_cells cells of table 0 with the largest sums of a query's two coordinates, for each row of x."""
    first, second = (signed_axes(x, seed + i) for i in (0, 1))
    sums = (first[:, :, None] + second[:, None, :]).reshape(len(x), -1)
    hit = np.ones(sums.shape, bool)
    if n_cells < sums.shape[1]:
        hit[:] = False
        np.put_along_axis(hit, np.argpartition(-sums, n_cells - 1, axis=1)[:, :n_cells], True, axis=1)
    return hit


def further_cells(x: np.ndarray, s: np.ndarray, tables: int, miss: float, n_scout: int, seed: int) -> np.ndarray:
    """Masks (queries, tables - 1, cells) of the cells to look into after the scout, given the k-th best cosine s (NaN where
    the scout met too few rows)."""
    chances, size = [], 1 << (x.shape[1] - 1).bit_length()
    for t in range(tables):
        first, second = (axis_chances(rotate(x, seed + 2 * t + i), np.nan_to_num(s), size) for i in (0, 1))
        chances.append((first[:, :, None] * second[:, None, :]).reshape(len(x), -1))
    seen = np.where(scout_cells(x, n_scout, seed), chances[0], 0).sum(axis=1)
    chances = np.stack(chances[1:], axis=1)
    goal = math.log(miss) - np.log(np.maximum(1 - seen, 1e-9))
    low, high = np.full(len(x), math.log(1e-12)), np.zeros(len(x))
    for _ in range(16):  # the highest least chance of a cell that still meets the goal
        middle = (low + high) / 2
        met = np.where(chances >= np.exp(middle)[:, None, None], chances, 0).sum(axis=2)
        enough = np.log(np.maximum(1 - met, 1e-9)).sum(axis=1) <= goal
        low, high = np.where(enough, middle, low), np.where(enough, high, middle)
    hit = (chances >= np.exp(low)[:, None, None]) & (goal < 0)[:, None, None]
    whole = np.isnan(s) | (hit.sum(axis=(1, 2)) >= hit.shape[2])
    hit[whole] = False
    hit[whole, 0] = True
    return hit


class Layout:
    """Blocks of the cells of each table, from the rows counted in each lot of cells."""

    def __init__(self, cells: int, tables: int, counts: list[tuple[int, int, int]], blocks: int, rows_per_block: int):
        self.cells, lots = cells, min(cells, LOTS)
        self.step = -(-cells // lots)
        rows = np.zeros((tables, -(-cells // self.step)), np.int64)
        for table, lot, n in counts:
            rows[table, lot] = n
        rows_per_block = min(rows_per_block, max(64, -(-int(rows[0].sum()) // blocks)))
        self.starts, self.parts = [], []
        for own in rows.tolist():
            starts, parts, filled = [0], [1], 0
            for lot, n in enumerate(own):
                if filled and filled + n > rows_per_block:
                    starts.append(lot * self.step)
                    parts.append(1)
                    filled = 0
                filled += n
                parts[-1] = max(1, -(-filled // rows_per_block))
            self.starts.append(np.array(starts))
            self.parts.append(np.array(parts))

    def block(self, table: int, cell: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts[table], cell, side="right") - 1


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(scores: np.ndarray, ids: np.ndarray, k: int, spare: int) -> np.ndarray:
    """Positions of the k best scores with different ids, ties to the smaller id; spare rows repeat an id."""
    if len(scores) > k + spare:
        least = np.partition(scores, len(scores) - k - spare)[len(scores) - k - spare]
        near = np.flatnonzero(scores >= least - 1e-12)
    else:
        near = np.arange(len(scores))
    near = near[np.lexsort((ids[near], -scores[near]))]
    if spare:
        near = near[np.sort(np.unique(ids[near], return_index=True)[1])]
    return near


def _rank(k: int, chunk: int = 1 << 22):
    """Of a block's rows and the queries that look into it: the k best of each query by exact cosines."""

    def work(key, index: pa.Table, looks: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if index.num_rows and looks.num_rows:
            ids, cell = index.column("id").to_numpy(), index.column("cell").to_numpy()
            unit, q = _unit(_matrix(index.column("v"))), looks.column("q").combine_chunks()
            spare = len(ids) - len(np.unique(ids))
            query, qh = looks.column("query_id").to_numpy(), looks.column("qh").to_numpy()
            masks = looks.column("cells").combine_chunks()
            step = max(1, chunk // len(ids))
            for at in range(0, len(q), step):
                bits = np.stack([np.unpackbits(np.frombuffer(m, np.uint8)) for m in masks.slice(at, step).to_pylist()]).view(bool)
                q_unit = _unit(_matrix(q.slice(at, step)))
                near = np.where(bits[:, cell], q_unit @ unit.T, -np.inf)
                for i, (row, asking) in enumerate(zip(near, q_unit), at):
                    met = np.flatnonzero((row > -np.inf) & (ids != query[i]))
                    if len(met) > 4 * (k + spare):  # rounding differs by far less than the margin
                        rough = row[met]
                        met = met[rough >= np.partition(rough, len(met) - k - spare)[len(met) - k - spare] - 1e-9]
                    if not len(met):
                        continue
                    scores = (unit[met] * asking).sum(axis=1)
                    chosen = _best(scores, ids[met], k, spare)[:k]
                    out[0].append(np.full(len(chosen), query[i]))
                    out[1].append(np.full(len(chosen), qh[i]))
                    out[2].append(ids[met[chosen]])
                    out[3].append(scores[chosen])
        kinds = (np.int64, np.int64, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate(c) if c else np.empty(0, kind)) for c, kind in zip(out, kinds)], ["query_id", "qh", "vec_id", "score"])

    return work


def _sound(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """id, v and two hashes of v, of the rows that take part, and the length of their vectors."""
    v = F.col("v")
    fit = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(v.isNotNull() & F.col("id").isNotNull()).where(fit)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (lengths.n if lengths else 0)).withColumns({"h": F.xxhash64("v"), "h2": F.hash("v")}), lengths.n if lengths else 0


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, tables: int = 4,
    scout: int = 256, miss: float = 0.1, blocks: int = 32, rows_per_block: int = 65_536, seed: int = 11,
) -> DataFrame:
    """query_id, rank int from 1, vec_id (as `vec_id`), score double: the k nearest found of each row whose id is divisible by
    `every`, among all rows of other ids. score is the cosine of the original vectors; ties go to the smaller id. Every
    query gets k rows, or as many as there are candidates.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than
    most. Repeated rows count once. Of rows that share a vector only the k + 1 smallest ids can be answers, and only they
    are indexed (equality is that of 96 bits of hashes). Rows that share an id are candidates, and queries, each with its
    own vector. An empty table gives no rows; other columns are ignored. scout and miss: see above.
    """
    rows, length = _sound(vectors, id_col, vector_col)
    n_cells, axes = (2 * min(AXES, 1 << (max(length, 1) - 1).bit_length())) ** 2, ["h", "h2"]
    kind = vectors.schema[vector_col].dataType.simpleString()

    # the limit inside the window cuts a very common vector down to k + 1 rows in each task before they are shuffled
    ordered = F.dense_rank().over(Window.partitionBy(*axes).orderBy("id"))
    last = cut(rows.select("id", *axes).withColumn("r", ordered).where(F.col("r") <= k + 1).where(F.col("r") == k + 1).groupBy(*axes).agg(F.min("id").alias("last")))
    held = rows.join(last, axes, "left").where(F.col("last").isNull() | (F.col("id") <= F.col("last"))).select("id", "v")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), F.col("h").alias("qh"), F.col("v").alias("q")).dropDuplicates(["query_id", "qh"])

    step = -(-n_cells // min(n_cells, LOTS))

    def tally(batches):
        total = np.zeros((tables, -(-n_cells // step)), np.int64)
        for b in batches:
            if b.num_rows:
                x = _unit(_matrix(b.column(0)))
                for t in range(tables):
                    total[t] += np.bincount(cells_of(x, t, seed) // step, minlength=total.shape[1])
        t, lot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(lot, pa.int32()), pa.array(total[t, lot], pa.int64())], ["t", "lot", "n"])

    # tables * LOTS numbers at most
    counts = held.select("v").mapInArrow(tally, "t int, lot int, n long").groupBy("t", "lot").agg(F.sum("n").alias("n")).collect()
    layout = Layout(n_cells, tables, [tuple(r) for r in counts], blocks, rows_per_block)

    def index(which):
        def work(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                ids, x = b.column(0).to_numpy(), _unit(_matrix(b.column(1)))
                for t in which:
                    cell = cells_of(x, t, seed)
                    block = layout.block(t, cell)
                    part = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % layout.parts[t][block]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((t << 32) + block, pa.int64()), pa.array(part, pa.int32()), pa.array(cell - layout.starts[t][block], pa.int32()), b.column(0), b.column(1)],
                        ["block", "part", "cell", "id", "v"],
                    )

        return held.mapInArrow(work, f"block long, part int, cell int, id long, v {kind}").groupBy("block", "part")

    def looks(questions, masks_of, which):
        """questions: query_id, qh, q and perhaps s; masks_of gives a mask for each query and table of `which`."""

        def work(batches):
            for b in batches:
                for at in range(0, b.num_rows, 32):
                    c = b.slice(at, 32)
                    masks = masks_of(_unit(_matrix(c.column(2))), c)
                    out = [[], [], [], []]
                    for j, t in enumerate(which):
                        bounds = np.append(layout.starts[t], n_cells)
                        wanted = np.add.reduceat(masks[:, j], layout.starts[t], axis=1, dtype=np.int64) > 0
                        for i, block in zip(*np.nonzero(wanted)):
                            bits = np.packbits(masks[i, j, bounds[block] : bounds[block + 1]]).tobytes()
                            for part in range(layout.parts[t][block]):
                                for column, value in zip(out, ((t << 32) + int(block), part, i, bits)):
                                    column.append(value)
                    chosen = pa.array(out[2], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[3], pa.binary()), *[c.column(i).take(chosen) for i in range(3)]],
                        ["block", "part", "cells", "query_id", "qh", "q"],
                    )

        return questions.mapInArrow(work, f"block long, part int, cells binary, query_id long, qh long, q {kind}").groupBy("block", "part")

    first = looks(asked, lambda x, _: scout_cells(x, scout, seed)[:, None, :], [0])
    first = cut(index([0]).cogroup(first).applyInArrow(_rank(k), _FOUND))
    distinct = first.groupBy("query_id", "qh", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id"))
    kth = distinct.withColumn("r", place).where(F.col("r") <= k).where(F.col("r") == k).select("query_id", "qh", F.col("score").alias("s"))
    # a set number of tasks, by another hash than the join's, or Spark would leave the exchange out and keep these few bytes in
    # one task, but each takes much work
    questions = asked.join(kth, ["query_id", "qh"], "left").select("query_id", "qh", "q", "s").repartition(tasks(vectors), F.hash("query_id", "qh"))

    def further(x, batch):
        s = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
        return further_cells(x, s, tables, miss, scout, seed)

    others = list(range(1, tables))
    second = index(others).cogroup(looks(questions, further, others)).applyInArrow(_rank(k), _FOUND)
    found = first.unionByName(second).groupBy("query_id", "qh", "vec_id").agg(F.max("score").alias("score"))
    found = found.withColumn("rank", place).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
