"""Running states along an order, for keys of any size.

A window by key sorts each key in one task. Here a key that holds more than one in SHARE of all rows (and more than `most`)
is cut into blocks of consecutive rows, one for each range partition it reaches into. States run inside each block; what a
block hands on to the next is one row (a sum, a maximum, a last value that is not null), and those rows, fewer than the range
partitions and SHARE together, are combined in order and sent to all tasks. All states here are associative, so the result
is that of the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.operators.skew import SHARE
from cairnlake.plans.checkpoints import cut


@dataclass(frozen=True)
class State:
    """kind: sum, max, min, last (value that is not null) or first (value, null or not). before: without the row itself.
    back: from the end of the order to its beginning."""

    kind: str
    column: Column
    before: bool = False
    back: bool = False

    def over(self, window) -> Column:
        return {
            "sum": lambda: F.sum(self.column), "max": lambda: F.max(self.column), "min": lambda: F.min(self.column),
            "last": lambda: F.last(self.column, ignorenulls=True), "first": lambda: F.first(F.struct(self.column.alias("v"))),
        }[self.kind]().over(window)

    def of_block(self, order: list[str]) -> Column:
        at, value = F.struct(*order), F.struct(self.column.alias("v"))
        ends = {False: (F.min_by, F.max_by), True: (F.max_by, F.min_by)}[self.back]
        return {
            "sum": lambda: F.sum(self.column), "max": lambda: F.max(self.column), "min": lambda: F.min(self.column),
            "last": lambda: ends[1](self.column, F.when(self.column.isNotNull(), at)), "first": lambda: ends[0](value, at),
        }[self.kind]()

    def of_blocks(self, column: str, window) -> Column:
        c = F.col(column)
        return {
            "sum": lambda: F.sum(c), "max": lambda: F.max(c), "min": lambda: F.min(c),
            "last": lambda: F.last(c, ignorenulls=True), "first": lambda: F.first(c, ignorenulls=True),
        }[self.kind]().over(window)

    def joined(self, carried: Column, own: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(carried + own, carried, own)
        if self.kind in ("max", "min"):
            return (F.greatest if self.kind == "max" else F.least)(carried, own)
        return F.coalesce(own, carried) if self.kind == "last" else F.coalesce(carried, own)


def total(column: Column | str, **how) -> State:
    return State("sum", F.col(column) if isinstance(column, str) else column, **how)


def highest(column: Column | str, **how) -> State:
    return State("max", F.col(column) if isinstance(column, str) else column, **how)


def lowest(column: Column | str, **how) -> State:
    return State("min", F.col(column) if isinstance(column, str) else column, **how)


def latest(column: Column | str, **how) -> State:
    """The last value so far that is not null."""
    return State("last", F.col(column) if isinstance(column, str) else column, **how)


def earliest(column: Column | str, **how) -> State:
    """The first row's value, null or not."""
    return State("first", F.col(column) if isinstance(column, str) else column, **how)


def previous(*columns: Column | str) -> State:
    """A struct of the row before; null on the first row."""
    return State("last", F.struct(*columns), before=True)


def following(*columns: Column | str) -> State:
    """A struct of the row after; null on the last row."""
    return State("last", F.struct(*columns), before=True, back=True)


class Scan:
    """Rows by key and order, to which running states are added; `rows` gives them back with the states as columns.

    order must tell the rows of a key apart, or equal ones may be taken in either order, as in a window. Null keys are one
    key. Column names beginning with `_scan` are its own.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], most: int = 1_000_000, share: int = SHARE):
        self.keys, self.order = list(keys), list(order)
        counts = df.groupBy(*keys).agg(F.count("*").alias("_scan_n"))
        large = counts.where(F.col("_scan_n") > most)
        heavy = []
        if large.limit(1).count():
            n = counts.agg(F.sum("_scan_n")).first()[0]
            heavy = large.where(F.col("_scan_n") * share > n).select(*[F.col(k) for k in keys]).collect() if keys else [()]
        self.heavy = len(heavy)
        if not heavy:
            self._rows = df.withColumn("_scan_block", F.lit(-1))
            return
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if keys:
            named = df.sparkSession.createDataFrame(heavy, df.select(*keys).schema).toDF(*[f"_scan_{i}" for i in range(len(keys))])
            rows = df.join(F.broadcast(named.withColumn("_scan_hot", F.lit(True))), self._same(df, named, [f"_scan_{i}" for i in range(len(keys))]), "left")
            rows = rows.withColumn("_scan_hot", F.coalesce("_scan_hot", F.lit(False))).drop(*named.columns)
        else:
            rows = df.withColumn("_scan_hot", F.lit(True))
        hot = cut(rows.where("_scan_hot").repartitionByRange(parts, *keys, *order).withColumn("_scan_block", F.spark_partition_id()))
        self._rows = rows.where(~F.col("_scan_hot")).withColumn("_scan_block", F.lit(-1)).unionByName(hot).drop("_scan_hot")

    def _same(self, left: DataFrame, right: DataFrame, names: list[str]) -> Column:
        found = F.lit(True)
        for k, name in zip(self.keys, names):
            found = found & left[k].eqNullSafe(right[name])
        return found

    def add(self, **states: State) -> Scan:
        """The rows with a column for each state. States of one call do not see each other; those of later calls do."""
        window = {back: Window.partitionBy(*self.keys, "_scan_block").orderBy(*[F.desc(c) if back else F.asc(c) for c in self.order]) for back in (False, True)}
        own = {n: s.over(window[s.back].rowsBetween(Window.unboundedPreceding, -1 if s.before else 0)) for n, s in states.items()}
        if not self.heavy:
            found = self._rows.withColumns({n: c["v"] if states[n].kind == "first" else c for n, c in own.items()})
            return self._with(found)
        rows = self._rows.withColumns({f"_scan_own_{n}": c for n, c in own.items()})
        ends = self._rows.where("_scan_block >= 0").groupBy(*self.keys, "_scan_block").agg(*[s.of_block(self.order).alias(f"_scan_end_{n}") for n, s in states.items()])
        blocks = {back: Window.partitionBy(*self.keys).orderBy(F.desc("_scan_block") if back else F.asc("_scan_block")).rowsBetween(Window.unboundedPreceding, -1) for back in (False, True)}
        keys = [f"_scan_k{i}" for i in range(len(self.keys))]
        carried = ends.select(
            *[F.col(k).alias(n) for k, n in zip(self.keys, keys)], F.col("_scan_block").alias("_scan_at"),
            *[s.of_blocks(f"_scan_end_{n}", blocks[s.back]).alias(f"_scan_in_{n}") for n, s in states.items()],
        )
        # fewer rows than range partitions and heavy keys together
        met = rows.join(F.broadcast(carried), self._same(rows, carried, keys) & (rows["_scan_block"] == carried["_scan_at"]), "left")
        found = {n: s.joined(F.col(f"_scan_in_{n}"), F.col(f"_scan_own_{n}")) for n, s in states.items()}
        met = met.withColumns({n: c["v"] if states[n].kind == "first" else c for n, c in found.items()})
        return self._with(met.drop("_scan_at", *keys, *[f"_scan_{w}_{n}" for n in states for w in ("own", "in")]))

    def _with(self, rows: DataFrame) -> Scan:
        new = object.__new__(Scan)
        new.keys, new.order, new.heavy, new._rows = self.keys, self.order, self.heavy, rows
        return new

    @property
    def rows(self) -> DataFrame:
        return self._rows.drop("_scan_block")
