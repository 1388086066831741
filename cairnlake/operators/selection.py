"""Exact order statistics of groups of any size.

percentile_disc keeps the distinct values of a group in one task. For a group that holds more than one in SHARE of all rows
(and more than `most`), the value at a rank is found by narrowing instead: the values between the bounds that are still possible
are counted in bins, each with its least and largest value, the bin that holds the rank gives the new bounds, and so on until
both are one value. Each round aggregates before its shuffle and hands on one row for each wanted rank; a bin is a monotone
function of the value, so rounding never moves a value past another, and each round parts the least and the largest value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.operators.skew import SHARE


def _bin(value: Column, low: Column, high: Column, bins: int, kind: str) -> Column:
    """0 for the least value, bins + 1 for the largest, else 1 to bins by its place between both. Whole numbers and decimals are
    subtracted as such: large ones may lie nearer together than doubles tell apart."""
    floating = kind in ("double", "float")
    v, a, b = (c.cast("double") / 2 if floating else c if kind.startswith("decimal") else c.cast("decimal(20,0)") for c in (value, low, high))
    place = F.floor(F.try_divide((v - a).cast("double"), (b - a).cast("double")) * bins)
    known = F.when(F.isnan(place.cast("double")) | place.isNull(), F.lit(0)).otherwise(F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)))
    return F.when(value == low, 0).when(value == high, bins + 1).otherwise(known + 1).cast("int")


def _within(rows: DataFrame, kind: str, wanted: list[list]) -> DataFrame:
    """The rows between the bounds of each wanted rank."""
    targets = rows.sparkSession.createDataFrame([(i, *w) for i, w in enumerate(wanted)], f"_t int, _g int, _name string, _rank long, _low {kind}, _high {kind}")
    return rows.join(F.broadcast(targets), "_g").where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))


def _narrowed(rows: DataFrame, kind: str, wanted: list[list], bins: int, few: int) -> list[list]:
    """The value at each wanted rank: wanted has (number of the group, name, rank, low, high). Once no more than `few` rows lie
    between the bounds of a rank they are sorted."""
    done, last = [], []
    while wanted:
        binned = _within(rows, kind, wanted).groupBy("_t", "_rank", _bin(F.col("_v"), F.col("_low"), F.col("_high"), bins, kind).alias("_bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        up_to = F.sum("_n").over(Window.partitionBy("_t").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))  # of bins + 2 rows at most
        hit = binned.withColumn("_to", up_to).where("_to >= _rank and _to - _n < _rank").select("_t", (F.col("_rank") - F.col("_to") + F.col("_n")).alias("_rank"), "_a", "_b", "_n").collect()
        rest = []
        for r in hit:
            g, name = wanted[r._t][:2]
            if r._a == r._b or r._a != r._a:
                done.append([g, name, r._a])
            else:
                (last if r._n <= few else rest).append([g, name, r._rank, r._a, r._b])
        wanted = rest
    if last:
        place = F.row_number().over(Window.partitionBy("_t").orderBy("_v"))
        done += [[*last[r._t][:2], r._v] for r in _within(rows, kind, last).withColumn("_i", place).where("_i = _rank").select("_t", "_v").collect()]
    return done


def nearest_ranks(df: DataFrame, group: list[str], value: str, shares: dict[str, float], most: int = 1_000_000, share: int = SHARE, bins: int = 1024, few: int = 10_000) -> DataFrame:
    """One row per group: for each of shares = {column: share} the value at rank ceil(share * n), at least the first; nulls do not count,
    and a group of nulls only has nulls. The driver holds fewer than SHARE groups' ranks."""
    kind = df.schema[value].dataType.simpleString()
    names = [f"_k{i}" for i in range(len(group))]
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(group, names)], F.col(value).alias("_v"))
    plain = [F.expr(f"percentile_disc({s!r}) WITHIN GROUP (ORDER BY _v)").cast(kind).alias(c) for c, s in shares.items()]
    stats = rows.groupBy(*names).agg(F.count("_v").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    large = stats.where(F.col("_n") > most)
    heavy = []
    if large.limit(1).count():
        heavy = large.where(F.col("_n") * share > stats.agg(F.sum("_n")).first()[0]).collect()
    if not heavy:
        return rows.groupBy(*names).agg(*plain).toDF(*group, *shares)
    schema = ", ".join(["_g int", *[f"_h{i} {df.schema[g].dataType.simpleString()}" for i, g in enumerate(group)]])
    named = df.sparkSession.createDataFrame([(i, *r[: len(names)]) for i, r in enumerate(heavy)], schema)
    same = F.lit(True)
    for i, k in enumerate(names):
        same = same & rows[k].eqNullSafe(named[f"_h{i}"])
    met = rows.join(F.broadcast(named), same, "left").drop(*[f"_h{i}" for i in range(len(group))])
    wanted = [[i, c, max(1, math.ceil(s * r._n)), r._low, r._high] for i, r in enumerate(heavy) for c, s in shares.items()]
    settled = [[g, c, low] for g, c, _, low, high in wanted if low == high]
    open_ranks = [w for w in wanted if w[3] != w[4]]
    found = settled + _narrowed(met.where("_g is not null and _v is not null").select("_g", "_v"), kind, open_ranks, bins, few)
    values = {(g, c): v for g, c, v in found}
    made = [(*r[: len(names)], *[values.get((i, c)) for c in shares]) for i, r in enumerate(heavy)]
    result = ", ".join([*[f"{k} {df.schema[g].dataType.simpleString()}" for k, g in zip(names, group)], *[f"`{c}` {kind}" for c in shares]])
    light = met.where("_g is null").groupBy(*names).agg(*plain)
    light = light if group else light.limit(0)
    return light.unionByName(df.sparkSession.createDataFrame(made, result)).toDF(*group, *shares)
