"""Digests of ordered tables, and where two of them differ.

Rows are numbered along an order; a row's digest is a leaf, and each `fan` consecutive nodes of a level make one node of the
next, the SHA-256 of their digests in order. A level has a `fan`-th of the rows of the one below and every node is made of at
most `fan` rows, so no task holds more, whatever the size. Two trees are compared from the top: below equal nodes nothing is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.keys import canonical_json
from cairnlake.operators.ranges import with_ordinal
from cairnlake.operators.scan import Scan, previous, total
from cairnlake.plans.checkpoints import cut


@dataclass(frozen=True)
class Tree:
    """levels[0] has a node for each row, the last one node at most: node (from 0), digest. rows: how many rows there are."""

    levels: list[DataFrame]
    rows: int
    fan: int

    @property
    def digest(self) -> str | None:
        """The digest of the top node; null for a table without rows."""
        top = self.levels[-1].first()
        return top.digest if top else None


def _above(level: DataFrame, fan: int) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("node", "digest")))
    grouped = level.groupBy(F.floor(F.col("node") / fan).alias("node")).agg(children.alias("c"))
    return grouped.select("node", F.sha2(F.array_join(F.transform("c", lambda c: c.digest), ""), 256).alias("digest"))


def tree(df: DataFrame, order: list[str], columns: list[str] | None = None, fan: int = 64) -> Tree:
    """The tree over df's rows in order, of the canonical JSON of the given columns (all) sorted by name.

    order must tell rows apart, or those that it does not must be equal in the columns. How the rows are partitioned does
    not matter; their order, number and values do.
    """
    names = sorted(columns or df.columns)
    leaf = F.sha2(canonical_json(*[F.col(c) for c in names]), 256)
    rows = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], leaf.alias("digest"))
    placed = with_ordinal(rows, [], [f"_o{i}" for i in range(len(order))], "node").select("node", "digest")
    levels, n = [cut(placed)], 0
    n = left = levels[0].count()
    while left > 1:
        levels.append(cut(_above(levels[-1], fan)))
        left = -(-left // fan)
    return Tree(levels, n, fan)


def ordered_digest(df: DataFrame, order: list[str], columns: list[str] | None = None, fan: int = 64) -> DataFrame:
    """One row: digest (null without rows), n, levels above the rows."""
    found = tree(df, order, columns, fan)
    top = df.sparkSession.createDataFrame([(found.rows, len(found.levels) - 1)], "n long, levels int")
    return top.crossJoin(found.levels[-1].agg(F.first("digest").alias("digest")))


def changed_rows(old: Tree, new: Tree) -> DataFrame:
    """(node, old, new): places whose digests differ, from the top of both trees down; null where a table ends before."""
    if old.fan != new.fan:
        raise ValueError("trees of different fans cannot be compared")
    suspects = None
    for level in range(max(len(old.levels), len(new.levels)) - 1, -1, -1):
        sides = []
        for t, name in ((old, "old"), (new, "new")):
            nodes = t.levels[level] if level < len(t.levels) else t.levels[0].limit(0)
            nodes = nodes.select("node", F.col("digest").alias(name))
            if suspects is not None:
                parents = suspects.select(F.col("node").alias("_parent"))
                nodes = nodes.join(parents, F.floor(F.col("node") / old.fan) == F.col("_parent"), "left_semi")
            sides.append(nodes)
        suspects = sides[0].join(sides[1], "node", "full").where(~F.col("old").eqNullSafe(F.col("new")))
        if level:
            suspects = cut(suspects)
    return suspects


def changed_ranges(old: Tree, new: Tree) -> DataFrame:
    """(first, last, n): runs of consecutive places at which the tables differ."""
    rows = Scan(changed_rows(old, new).select("node"), [], ["node"]).add(_b=previous("node"))
    begins = (F.col("_b").isNull() | (F.col("_b.node") != F.col("node") - 1)).cast("long")
    return rows.add(_run=total(begins)).rows.groupBy("_run").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n")).drop("_run")
