"""Choices that depend on the ones before. What is sequential stays inside one group or among a bounded number of candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.plans.checkpoints import cut


def _breaks(padded: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a run of items, and for each item as the first of a part the next item that opens one (or the length)."""
    ends = np.cumsum(padded)
    return ends, np.searchsorted(ends, ends - padded + cap, side="right")


def _run_table(padded: np.ndarray, cap: int):
    """What a run of items makes of the bytes used in the part at hand: (total, ends, used, opened). The first end above
    cap - used names the item that opens the next part; used and opened are then those after the run. Without one the part
    goes on. Only items before which a part can still be open come first, so a table has at most cap / least item + 1 rows."""
    ends, to = _breaks(padded, cap)
    at = np.arange(min(int(np.searchsorted(ends, cap, side="right")) + 1, len(padded)))
    first, opened = ends[at], np.ones(len(at), np.int64)
    while (going := to[at] < len(padded)).any():
        at = np.where(going, to[at], at)
        opened += going
    return _merged(int(ends[-1]), first, ends[-1] - ends[at] + padded[at], opened)


def _merged(total, ends, used, opened):
    """Neighbouring rows of a table with one outcome become one."""
    last = np.append((used[1:] != used[:-1]) | (opened[1:] != opened[:-1]), True)
    return total, ends[last], used[last], opened[last]


def _after(table, used, cap: int):
    """(used, parts opened) after a run that is entered with `used` bytes."""
    total, ends, out, opened = table
    at = np.searchsorted(ends, cap - used, side="right")
    breaks, at = at < len(ends), np.minimum(at, len(ends) - 1)
    return np.where(breaks, out[at], used + total), np.where(breaks, opened[at], 0)


def _joined(a, b, cap: int):
    """The table of run a with run b after it."""
    used, more = _after(b, a[2], cap)
    columns = a[1], used, a[3] + more
    if a[0] <= cap:
        n = int(np.searchsorted(b[1] + a[0], cap, side="right")) + 1
        columns = [np.concatenate(x) for x in zip(columns, (b[1][:n] + a[0], b[2][:n], b[3][:n]))]
    return _merged(a[0] + b[0], *columns)


def next_fit_parts(df: DataFrame, group: str, order: str, size: str, cap: int, block: int = 512, per_item: int = 512) -> DataFrame:
    """(group, order, padded, part): items in order fill a part until the next padded item would pass cap. A padded item is its
    size rounded up to blocks, plus per_item; one that is larger than cap is an error.

    Items are dealt over tasks by ranges of (group, order), so a large group lies in many tasks, and each reads its stretch
    batch by batch. A first pass says for each task what its stretch makes of a part begun before it; the driver follows
    these, one small row for each task; a second pass numbers the parts from the states found.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(size).cast("long").alias("s"))
    rows = cut(rows.repartitionByRange("g", "o", "s").sortWithinPartitions("g", "o", "s").withColumn("p", F.spark_partition_id()))

    def runs(batch):
        """(start, stop, group, padded sizes) of each group in a batch."""
        if batch.column(2).null_count:
            raise ValueError("an item has no size")
        padded = per_item - (-batch.column(2).to_numpy() // block) * block
        if padded.max() > cap:
            raise ValueError(f"an item of {padded.max()} is larger than a part of {cap}")
        if padded.min() < 0:
            raise ValueError("an item has a negative size")
        codes = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        for i, j in zip(edges, edges[1:]):
            yield i, j, batch.column(0)[i].as_py(), padded[i:j]

    def sum_up(batches):
        n, part, head, tail, table, state = 0, None, None, None, None, (0, 0)
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(3)[0].as_py()
            for _, _, g, padded in runs(b):
                if not n or g != tail:
                    n, tail, state = n + 1, g, (0, 0)
                    head = g if n == 1 else head
                run = _run_table(padded, cap)
                if n == 1:
                    table = run if table is None else _joined(table, run, cap)
                else:
                    used, opened = _after(run, state[0], cap)
                    state = int(used), state[1] + int(opened)
        if n:
            # only a stretch of one group hands on a state from before it
            total, ends, used, opened = table if n == 1 else (0, [], [], [])
            columns = [(part, pa.int32()), (n, pa.int64()), (head, b.schema.field(0).type), (tail, b.schema.field(0).type), (total, pa.int64()), (list(ends), pa.list_(pa.int64())), (list(used), pa.list_(pa.int64())), (list(opened), pa.list_(pa.int64())), (state[0], pa.int64()), (state[1], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in columns], ["p", "n", "head", "tail", "total", "ends", "used", "opened", "last_used", "last_part"])

    longs = "array<bigint>"
    stretches = rows.mapInArrow(sum_up, f"p int, n long, head {kinds[group]}, tail {kinds[group]}, total long, ends {longs}, used {longs}, opened {longs}, last_used long, last_part long").collect()
    entry, state, before = {}, (0, 0), None
    for r in sorted(stretches, key=lambda r: r.p):
        entry[r.p] = state if before is not None and before.tail == r.head else (0, 0)
        if r.n == 1:
            used, opened = _after((r.total, *(np.array(c, np.int64) for c in (r.ends, r.used, r.opened))), entry[r.p][0], cap)
            state = int(used), entry[r.p][1] + int(opened)
        else:
            state = r.last_used, r.last_part
        before = r

    def number(batches):
        tail, state, any_yet = None, None, False
        for b in batches:
            if not b.num_rows:
                continue
            sizes, parts = [], []
            for _, _, g, padded in runs(b):
                if not any_yet:
                    state = entry[b.column(3)[0].as_py()]
                elif g != tail:
                    state = 0, 0
                any_yet, tail = True, g
                ends, to = _breaks(padded, cap)
                opens, at, last = np.zeros(len(padded), np.int64), int(np.searchsorted(ends, cap - state[0], side="right")), None
                while at < len(padded):
                    opens[at], last, at = 1, at, int(to[at])
                part = state[1] + np.cumsum(opens)
                used = state[0] + ends[-1] if last is None else ends[-1] - ends[last] + padded[last]
                state = int(used), int(part[-1])
                sizes.append(padded)
                parts.append(part)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(parts), pa.int64())], [group, order, "padded", "part"])

    return rows.mapInArrow(number, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, padded long, part long")


def multi_metric_pick(df: DataFrame, id_col: str, direction: str, metrics: list[str], pinned, quota: int, k: int) -> DataFrame:
    """Pinned rows, then rounds over the metrics' rankings within each direction until it has its quota, then the overall best
    of the first metric up to k; no row twice. Ids are unique. Candidates are the k best of each metric and direction, which the limit inside
    the window finds in each task before the shuffle, and the k pinned rows with the least ids, as no more can be chosen; only
    these meet in one task."""
    named = df.withColumn("_pin", F.coalesce(pinned, F.lit(False)))
    keep = named.where("_pin").orderBy(id_col).limit(k)
    for m in metrics:
        w = Window.partitionBy(direction).orderBy(F.desc(m), id_col)
        keep = keep.unionByName(named.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r"))
    keep = keep.select(id_col, direction, "_pin", *metrics).distinct()

    def work(pdf):
        import pandas as pd

        chosen = list(pdf[pdf["_pin"]].sort_values(id_col)[id_col])
        have = set(chosen)
        for d, part in sorted(pdf.groupby(direction), key=lambda x: str(x[0])):
            ranked = [list(part.sort_values([m, id_col], ascending=[False, True])[id_col]) for m in metrics]
            n, at = sum(i in have for i in part[id_col]), [0] * len(metrics)
            while n < quota and any(a < len(r) for a, r in zip(at, ranked)):
                for i, r in enumerate(ranked):
                    while at[i] < len(r) and r[at[i]] in have:
                        at[i] += 1
                    if at[i] < len(r) and n < quota:
                        have.add(r[at[i]])
                        chosen.append(r[at[i]])
                        n += 1
        for i in pdf.sort_values([metrics[0], id_col], ascending=[False, True])[id_col]:
            if len(chosen) >= k:
                break
            if i not in have:
                have.add(i)
                chosen.append(i)
        return pd.DataFrame({id_col: chosen[:k], "place": range(len(chosen[:k]))})

    kind = df.schema[id_col].dataType.simpleString()
    return keep.groupBy(F.lit(0).alias("_one")).applyInPandas(work, f"`{id_col}` {kind}, place int")


def union_top(df: DataFrame, subset, a: int, b: int, score: str, id_col: str) -> DataFrame:
    """The a best of a subset, then the b best of all, each row at its first place. Two bounded sorts."""
    first = df.where(subset).orderBy(F.desc(score), id_col).limit(a).withColumn("_o", F.lit(0))
    second = df.orderBy(F.desc(score), id_col).limit(b).withColumn("_o", F.lit(1))
    both = first.unionByName(second)
    # at most a + b rows
    both = both.withColumn("place", F.row_number().over(Window.orderBy("_o", F.desc(score), id_col)))
    one = both.groupBy(id_col).agg(F.min("place").alias("place"), F.first(score).alias(score))
    return one.withColumn("place", F.row_number().over(Window.orderBy("place")))
