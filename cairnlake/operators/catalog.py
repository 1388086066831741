"""Effective tables to places and entrances: resolution, reasons, classification, names and groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.keys import ascii_fold
from cairnlake.operators.components import connected_components
from cairnlake.operators.skew import heavy_keys, join_by_key
from cairnlake.plans.checkpoints import cut


def first_failing_reason(df: DataFrame, rules: list[tuple[str, Column]], passed: str | None = None, out: str = "reason") -> DataFrame:
    """Adds the name of the first rule that is true for a row, or `passed`. A rule that is null is not true."""
    chain = None
    for name, failing in rules:
        chain = F.when(failing, name) if chain is None else chain.when(failing, name)
    return df.withColumn(out, chain.otherwise(F.lit(passed)))


def stage_counts(df: DataFrame, rules: list[str], reason: str = "reason") -> DataFrame:
    """One row per rule: how many rows it dropped and how many passed it (and all before it)."""
    totals = df.groupBy(reason).agg(F.count("*").alias("n"))
    ranks = df.sparkSession.createDataFrame(list(enumerate(rules)), f"ord int, {reason} string")
    rows = ranks.join(totals, reason, "left").withColumn("dropped", F.coalesce("n", F.lit(0)))
    total = df.agg(F.count("*").alias("total"))
    # a handful of rows, one for each rule
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return rows.crossJoin(F.broadcast(total)).withColumn("passed", F.col("total") - F.sum("dropped").over(w)).select("ord", reason, "dropped", "passed")


def fail_on(df: DataFrame, reasons: list[str], reason: str = "reason") -> DataFrame:
    """The rows as they are; a row with one of these reasons stops the job when it is read."""
    bad = F.coalesce(F.col(reason).isin(reasons), F.lit(False))
    return df.withColumn(reason, F.when(bad, F.raise_error(F.concat(F.lit("fatal: "), reason))).otherwise(F.col(reason)))


def within_extent(x: Column, y: Column, x0, y0, x1, y1, closed: bool = True) -> Column:
    if closed:
        return x.between(x0, x1) & y.between(y0, y1)
    return (x >= x0) & (x < x1) & (y >= y0) & (y < y1)


def scope_filter(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    return df.join(allowed.select(key).distinct(), key, "left_semi")


def resolve(df: DataFrame, other: DataFrame, key: str, other_key: str, fold: bool = False) -> DataFrame:
    """df with other's columns and `matched`. With fold, keys are compared ASCII-folded. other has one row per key."""
    left, right = (ascii_fold(key), ascii_fold(other_key)) if fold else (F.col(key), F.col(other_key))
    rows, known = df.withColumn("_k", left), other.withColumn("_k", right).withColumn("_m", F.lit(True))
    return rows.join(known, "_k", "left").withColumn("matched", F.col("_m").isNotNull()).drop("_k", "_m")


def region_for_grid(cells: DataFrame, land: DataFrame, regions: DataFrame, grid: list[str], source: str, region: str) -> DataFrame:
    """cells with their region over two equi-joins, and `problem` where one is missing: no_land or no_region."""
    rows = cells.join(land.select(*grid, source), grid, "left").join(F.broadcast(regions.select(source, region)), source, "left")
    return rows.withColumn("problem", F.when(F.col(source).isNull(), "no_land").when(F.col(region).isNull(), "no_region"))


def conflicting_groups(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Groups that hold more than one value."""
    return df.groupBy(*key).agg(F.count_distinct(value).alias("values")).where("values > 1")


def localize(places: DataFrame, names: DataFrame, key: str, prefix: str, only_if: Column) -> DataFrame:
    """places with their names; `problem` tells what has no partner. A prefix is removed where only_if holds."""
    from cairnlake.functions.keys import strip_prefix

    p, n = places.withColumn("_p", F.lit(True)), names.withColumn("_n", F.lit(True))
    rows = p.join(n, key, "full")
    problem = F.when(F.col("_p").isNull(), "name_without_place").when(F.col("_n").isNull(), "place_without_name")
    return rows.withColumn("problem", problem).withColumn("label", strip_prefix(F.col("name"), prefix, F.coalesce(only_if, F.lit(False)))).drop("_p", "_n")


def fallback_chain(places: DataFrame, names: DataFrame, key: str, locale: str, chain: list[str]) -> DataFrame:
    """For every place the name of the first locale of the chain that has it, and that locale; null if none has."""
    rank = F.coalesce(*[F.when(F.col(locale) == c, F.lit(i)) for i, c in enumerate(chain)])
    best = names.withColumn("_r", rank).where("_r is not null").groupBy(key).agg(F.min_by("name", "_r").alias("name"), F.min_by(locale, "_r").alias("used"))
    return places.select(key).join(best, key, "left")


def incomplete_locales(places: DataFrame, names: DataFrame, key: str, locale: str) -> DataFrame:
    """Locales that lack some place, and how many."""
    total = places.select(key).distinct().agg(F.count("*").alias("total"))
    have = names.join(places.select(key).distinct(), key, "left_semi").groupBy(locale).agg(F.count_distinct(key).alias("have"))
    return have.crossJoin(F.broadcast(total)).select(locale, (F.col("total") - F.col("have")).alias("missing")).where("missing > 0")


def head_keys(name: Column, suffixes: tuple[str, ...]) -> Column:
    """The prefixes under which a name is related: itself, the part before a comma or colon, and without a known last word."""
    folded = ascii_fold(name)
    base = [folded, F.substring_index(folded, ",", 1), F.substring_index(folded, ":", 1)]
    base += [F.when(folded.endswith(" " + s), F.substring(folded, F.lit(1), F.length(folded) - F.lit(len(s) + 1))) for s in suffixes]
    return F.array_distinct(F.array_compact(F.array(*base)))


def related_by_prefix(outer: DataFrame, inner: DataFrame, name: str, region: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (outer_name, inner_name) of one region where the inner name belongs to the outer: equal, `outer, ...`,
    `outer: ...`, or with a known last word. An equi-join on derived keys, never a comparison of all names."""
    a = outer.select(region, F.col(name).alias("outer_name"), ascii_fold(name).alias("_h")).distinct()
    b = inner.select(region, F.col(name).alias("inner_name"), F.explode(head_keys(F.col(name), suffixes)).alias("_h")).distinct()
    return a.join(b, [region, "_h"]).drop("_h").distinct()


def classify_by_rules(df: DataFrame, text: str, rules: list[tuple[str, str]], fallback: str, out: str = "label", rule_out: str = "rule") -> DataFrame:
    """Label and rule number (1-based, 0 for the fallback) of the first pattern found in the folded text."""
    folded = ascii_fold(text)
    label = rule = None
    for i, (pattern, name) in enumerate(rules, 1):
        hit = folded.rlike(pattern)
        label = F.when(hit, name) if label is None else label.when(hit, name)
        rule = F.when(hit, i) if rule is None else rule.when(hit, i)
    return df.withColumn(out, label.otherwise(fallback)).withColumn(rule_out, rule.otherwise(0))


def classify_with_evidence(df: DataFrame, text: str, evidence: str, rules: list[tuple[str, str]], marks: list[tuple[str, str]], fallback: str) -> DataFrame:
    """classify_by_rules; where no rule is found, the first mark that occurs in any element of the evidence array decides."""
    rows = classify_by_rules(df, text, rules, "")
    by_mark = None
    for pattern, name in marks:
        hit = F.exists(evidence, _finder(pattern))
        by_mark = F.when(hit, name) if by_mark is None else by_mark.when(hit, name)
    return rows.withColumn("label", F.when(F.col("rule") > 0, F.col("label")).otherwise(by_mark.otherwise(fallback)))


def _finder(pattern: str):
    return lambda x: ascii_fold(x).rlike(pattern)


def classify_by_neighbors(exteriors: DataFrame, related: DataFrame, key: str, label: str, settled: list[str], fallback: str, half: str) -> DataFrame:
    """A label from what is related to each exterior: settlement if any of the settled labels is there; else the single other
    label, which for `half` must hold at least half of them; else the fallback. related: key, label (one row each)."""
    special = F.when(~F.col(label).isin(fallback, *settled), F.col(label))
    seen = related.groupBy(key).agg(
        F.count_if(F.col(label).isin(settled)).alias("_s"), F.count_distinct(special).alias("_d"), F.min(special).alias("_l"),
        F.count(special).alias("_c"), F.count("*").alias("_n"),
    )
    alone = (F.col("_d") == 1) & ((F.col("_l") != half) | (2 * F.col("_c") >= F.col("_n")))
    rows = exteriors.join(seen, key, "left")
    return rows.withColumn("label", F.when(F.col("_s") > 0, "settlement").when(alone, F.col("_l")).otherwise(fallback)).drop("_s", "_d", "_l", "_c", "_n")


def civic_prefixes(names: DataFrame, name: str, known: DataFrame, known_name: str, words: list[str]) -> DataFrame:
    """Distinct texts before the first comma that are known names and whose rest ends in one of the words."""
    head, rest = F.substring_index(name, ",", 1), F.regexp_replace(F.col(name), "^[^,]*,?", "")
    rows = names.where(ascii_fold(rest).rlike(r"\b(?:" + "|".join(words) + r")$")).select(head.alias("prefix"))
    return rows.join(known.select(F.col(known_name).alias("prefix")).distinct(), "prefix", "left_semi").distinct()


def tier_by_type(label: Column, tiers: dict[str, int], otherwise: int) -> Column:
    chain = None
    for name, tier in tiers.items():
        chain = F.when(label == name, tier) if chain is None else chain.when(label == name, tier)
    return F.lit(otherwise) if chain is None else chain.otherwise(otherwise)


def alias_set(df: DataFrame, key: str, primary: str, alias: str) -> DataFrame:
    """(key, aliases): spaces collapsed, blanks dropped, one spelling (the least) per folded form, never the primary, sorted."""
    clean = F.trim(F.regexp_replace(alias, r"\s+", " "))
    rows = df.select(key, F.col(primary).alias("_p"), clean.alias("_a")).where("_a <> ''").withColumn("_f", ascii_fold("_a"))
    one = rows.where(F.col("_f") != ascii_fold("_p")).groupBy(key, "_f").agg(F.min("_a").alias("_a"))
    return one.groupBy(key).agg(F.array_sort(F.collect_list("_a")).alias("aliases"))


def medoid(df: DataFrame, group: str, x: str, y: str, id_col: str, most: int = 1000, pivots: int = 256, digits: int = 3) -> DataFrame:
    """(group, medoid, total): the member with the least total distance (rounded) to the others of its group, ties by id.

    Groups of up to `most` members are worked out pair by pair. In larger ones some members, the pivots, are summed exactly; a
    member at distance d from a pivot of total T has a total of at least T - n * d and n * d - T, and is out if that is above the
    best total so far. What is left gives the pivots of the next round, twice as many, until all are summed or out.
    """
    members = df.select(F.col(group).alias("g"), F.col(id_col).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    other = members.select("g", F.col("x").alias("u"), F.col("y").alias("v"))
    away = F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v"))
    totals = lambda own, every: own.join(every, "g").groupBy("g", "i").agg(F.round(F.sum(away), digits).alias("total"))
    pick = lambda sums: sums.groupBy("g").agg(F.min(F.struct("total", "i")).alias("b"))
    told = lambda best: best.select(F.col("g").alias(group), F.col("b.i").alias("medoid"), F.col("b.total").alias("total"))
    sizes = members.groupBy("g").agg(F.count("*").alias("n"))
    large = cut(sizes.where(F.col("n") > most))
    if not large.limit(1).count():
        return told(pick(totals(members, other)))
    small = members.join(large.select("g"), "g", "left_anti")
    left = cut(members.join(large, "g"))
    every = left.select("g", F.col("x").alias("u"), F.col("y").alias("v"))
    best, turn = None, 0
    while True:
        open_sizes = left.groupBy("g").agg(F.count("*").alias("open"))
        # a hash of the member decides, so that the choice is the same whenever it is made again
        chosen = F.pmod(F.xxhash64("i", "x", "y", F.lit(turn)), F.col("open")) < pivots
        marked = cut(left.join(open_sizes, "g").withColumn("chosen", (F.col("open") <= 2 * pivots) | chosen).drop("open"))
        own = marked.where("chosen")
        few = own.count()
        sums = totals(F.broadcast(own.select("g", "i", "x", "y")) if few <= 100_000 else own.select("g", "i", "x", "y"), every)
        sums = cut(sums)
        now = pick(sums)
        best = cut(now if best is None else best.unionByName(now).groupBy("g").agg(F.min("b").alias("b")))
        rest = marked.where(~F.col("chosen")).drop("chosen")
        known = own.select("g", "i", F.col("x").alias("u"), F.col("y").alias("v")).join(sums, ["g", "i"]).select("g", "u", "v", F.col("total").alias("t"))
        known = F.broadcast(known) if few <= 100_000 else known
        least = F.max(F.greatest(F.col("t") - F.col("n") * away, F.col("n") * away - F.col("t")))
        bounds = rest.join(known, "g", "left").groupBy("g", "i", "x", "y", "n").agg(least.alias("least")).join(best, "g", "left")
        left = cut(bounds.where(F.col("least").isNull() | F.col("b").isNull() | (F.col("least") <= F.col("b.total") + 2 * 10.0**-digits)).select("g", "i", "x", "y", "n"))
        if left.isEmpty():
            break
        turn, pivots = turn + 1, 2 * pivots
    return told(best.unionByName(pick(totals(small, other))))


def central_member(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """The member nearest the mean position of its group, ties by (x, y)."""
    mean = df.groupBy(*group).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    rows = df.join(mean, group)
    d = F.round(F.pow(F.col(x) - F.col("_mx"), 2) + F.pow(F.col(y) - F.col("_my"), 2), 6)
    best = F.min_by(F.struct(x, y), F.struct(d.alias("d"), F.col(x).alias("a"), F.col(y).alias("b")))
    return rows.groupBy(*group).agg(best.alias("m")).select(*group, F.col(f"m.{x}").alias("central_x"), F.col(f"m.{y}").alias("central_y"))


BLOCK_BITS = 6
#: Blocks lie around the origin, not with a corner at it: cells of a map that is centred there share one.
HALF = 1 << BLOCK_BITS - 1


def _block_labels(batches):
    """Union-find inside blocks of cells: for each cell the least (x, y) of what it is connected to inside its block."""
    side, width = 1 << BLOCK_BITS, (1 << BLOCK_BITS) + 2
    for batch in batches:
        lists = batch.column(batch.schema.names.index("cells"))
        offsets = lists.offsets.to_numpy()
        at = 0
        while at < len(lists):  # a million cells at a time, or one block
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 1_000_000, side="right")) - 1)
            part = batch.slice(at, to - at)
            flat = part.column(part.schema.names.index("cells")).flatten()
            x, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            sizes = np.diff(offsets[at : to + 1])
            # a ring of free places around each block, so that a neighbour's key is the own one plus a constant
            keys = (np.repeat(np.arange(to - at), sizes) * width + (x + HALF & side - 1) + 1) * width + (y + HALF & side - 1) + 1
            order = np.argsort(keys)
            keys, parent = keys[order], np.arange(len(keys))
            edges = []
            for step in (1, width - 1, width, width + 1):
                found = np.minimum(np.searchsorted(keys, keys + step), len(keys) - 1)
                u = np.flatnonzero(keys[found] == keys + step)
                edges.append((u, found[u]))
            u, v = (np.concatenate(c) for c in zip(*edges))
            while len(u):
                low, high = np.minimum(parent[u], parent[v]), np.maximum(parent[u], parent[v])
                apart = low != high
                if not apart.any():
                    break
                u, v = u[apart], v[apart]
                np.minimum.at(parent, high[apart], low[apart])
                while (parent[parent] != parent).any():
                    parent = parent[parent]
            top = np.empty(len(keys), np.int64)
            top[order] = order[parent]
            cells = pa.StructArray.from_arrays([pa.array(c) for c in (x, y, x[top], y[top])], names=["x", "y", "ax", "ay"])
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, cells)], ["bucket", "cells"])
            at = to


def components8(df: DataFrame, bucket: str, x: str, y: str) -> DataFrame:
    """(bucket, x, y, anchor_x, anchor_y): cells of a bucket that touch by side or corner share the anchor, the least (x, y).

    Cells (whole numbers) are gathered in blocks of 64 by 64; union-find inside each gives the components of the block. Only
    cells on the borders of blocks look for neighbours in other blocks, by an equi-join, and only what these connect goes through star
    contraction: a component that lies in one block costs one shuffle of its cells.
    """
    kinds = [df.schema[c].dataType for c in (bucket, x, y)]
    cell = df.select(F.col(bucket).alias("bucket"), F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")).distinct()
    block = lambda c: F.shiftright(F.col(c) + HALF, BLOCK_BITS)
    at = [block(c) for c in ("x", "y")]
    blocks = cell.groupBy("bucket", at[0].alias("bx"), at[1].alias("by")).agg(F.collect_list(F.struct("x", "y")).alias("cells")).select("bucket", "cells")
    kind = kinds[0].simpleString()
    labels = blocks.mapInArrow(_block_labels, f"bucket {kind}, cells array<struct<x: long, y: long, ax: long, ay: long>>")
    cells = cut(labels.select("bucket", F.explode("cells").alias("c")).select("bucket", "c.*"))

    edge = lambda c: (F.col(c) + HALF).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).isin(0, (1 << BLOCK_BITS) - 1)
    rim = cells.where(edge("x") | edge("y"))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, -1), (1, 0), (1, 1), (0, 1))])
    near = rim.withColumn("s", F.explode(steps)).select("bucket", "x", "y", (F.col("x") + F.col("s.dx")).alias("nx"), (F.col("y") + F.col("s.dy")).alias("ny"), F.col("ax").alias("ux"), F.col("ay").alias("uy"))
    outside = near.where((block("x") != block("nx")) | (block("y") != block("ny"))).select("bucket", F.col("nx").alias("x"), F.col("ny").alias("y"), "ux", "uy")
    pairs = cut(outside.join(rim, ["bucket", "x", "y"]).select("bucket", "ux", "uy", F.col("ax").alias("vx"), F.col("ay").alias("vy")).distinct())
    if not pairs.limit(1).count():
        return _anchored(cells.withColumns({"anchor_x": F.col("ax"), "anchor_y": F.col("ay")}), kinds, bucket, x, y)
    ends = pairs.select("bucket", F.col("ux").alias("ax"), F.col("uy").alias("ay")).union(pairs.select("bucket", "vx", "vy")).distinct()
    nodes = cut(ends.withColumn("id", F.monotonically_increasing_id()))
    u = nodes.select("bucket", F.col("ax").alias("ux"), F.col("ay").alias("uy"), F.col("id").alias("u"))
    v = nodes.select("bucket", F.col("ax").alias("vx"), F.col("ay").alias("vy"), F.col("id").alias("v"))
    found = connected_components(pairs.join(u, ["bucket", "ux", "uy"]).join(v, ["bucket", "vx", "vy"]).select("u", "v"), "u", "v")
    joined = cut(nodes.join(found, F.col("id") == F.col("node")).select("bucket", "ax", "ay", "component"))
    anchors = joined.groupBy("component").agg(F.min(F.struct("ax", "ay")).alias("anchor"), F.count("*").alias("n"))
    heavy = heavy_keys(anchors, "component", "n", joined.count())
    names = join_by_key(joined, anchors.drop("n"), "component", heavy).select("bucket", "ax", "ay", F.col("anchor.ax").alias("anchor_x"), F.col("anchor.ay").alias("anchor_y"))
    told = cells.join(names, ["bucket", "ax", "ay"], "left")
    return _anchored(told.withColumns({"anchor_x": F.coalesce("anchor_x", "ax"), "anchor_y": F.coalesce("anchor_y", "ay")}), kinds, bucket, x, y)


def _anchored(cells: DataFrame, kinds: list, bucket: str, x: str, y: str) -> DataFrame:
    whole = {"x": kinds[1], "y": kinds[2], "anchor_x": kinds[1], "anchor_y": kinds[2]}
    return cells.select("bucket", *[F.col(c).cast(k).alias(c) for c, k in whole.items()]).toDF(bucket, x, y, "anchor_x", "anchor_y")
