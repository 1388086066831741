"""Runs, ranges, ordinals and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_length_encode(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Maximal inclusive ranges of consecutive whole numbers; repeats are ignored."""
    w = Window.partitionBy(*group).orderBy(value)
    rows = df.select(*group, value).distinct().withColumn("_g", F.col(value) - F.row_number().over(w))
    return rows.groupBy(*group, "_g").agg(F.min(value).alias("v_min"), F.max(value).alias("v_max")).drop("_g")


def run_length_decode(df: DataFrame, group: list[str], low: str, high: str, out: str) -> DataFrame:
    return df.select(*group, F.explode(F.sequence(F.col(low), F.col(high))).alias(out))


def order_violations(df: DataFrame, group: list[str], low: str, high: str, adjacent_allowed: bool) -> DataFrame:
    """Ranges that are reversed, overlap the one before, or touch it (unless that is allowed)."""
    w = Window.partitionBy(*group).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rule = F.when(F.col(low) > F.col(high), "reversed").when(F.col(low) <= before, "overlap")
    if not adjacent_allowed:
        rule = rule.when(F.col(low) == before + 1, "adjacent")
    return df.withColumn("rule", rule).where("rule is not null")


def declared_counts(df: DataFrame, group: list[str], low: str, high: str, declared: DataFrame, count: str) -> DataFrame:
    """Groups whose ranges do not hold as many values as declared."""
    have = df.groupBy(*group).agg(F.sum(F.col(high) - F.col(low) + 1).alias("have"))
    return have.join(declared, group, "full").where(~F.col("have").eqNullSafe(F.col(count)))


def with_ordinal(df: DataFrame, keys: list[str], order: list[Column | str], out: str = "ordinal") -> DataFrame:
    """Numbers rows from 0. Without keys the whole table is numbered: per range partition, plus the rows before it, so that
    no single task sorts everything."""
    if keys:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    from cairnlake.plans.checkpoints import cut

    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").count()
    # one row for each partition of the table
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(w), F.lit(0))).drop("count")
    rows = placed.join(F.broadcast(before), "_part")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long")
    return rows.withColumn(out, F.col("_before") + own - 1).drop("_part", "_before")


def modulo_shards(df: DataFrame, order: list[str], n: int, out: str = "shard") -> DataFrame:
    return with_ordinal(df, [], order, out).withColumn(out, F.col(out) % n)


def even_sample(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """k rows at ordinals floor(i * n / k); all rows if there are fewer."""
    rows = with_ordinal(df, [], order)
    n = rows.agg(F.count("*").alias("_n"))
    rows = rows.crossJoin(F.broadcast(n))
    i = F.ceil(F.col("ordinal") * k / F.col("_n"))
    hit = (F.col("_n") <= k) | ((i < k) & (F.floor(i * F.col("_n") / k) == F.col("ordinal")))
    return rows.where(hit).drop("_n")


def shards3x3(cells: DataFrame, x: str, y: str, k: int = 3) -> DataFrame:
    """Cells grouped by the centre of their k by k shard, members from the top row down, each row from the left."""
    from cairnlake.functions.grid import shard_center

    rows = cells.select(x, y).distinct().withColumn("shard_x", shard_center(F.col(x), k)).withColumn("shard_y", shard_center(F.col(y), k))
    members = F.array_sort(F.collect_list(F.struct((-F.col(y)).alias("top"), F.col(x).alias("left"))))
    return rows.groupBy("shard_x", "shard_y").agg(members.alias("_m")).select(
        "shard_x", "shard_y", F.size("_m").cast("long").alias("n"), F.transform("_m", lambda m: F.struct(m["left"].alias(x), (-m["top"]).alias(y))).alias("members")
    )


def threshold_floor(df: DataFrame, value: str, thresholds: DataFrame, threshold: str, out: str = "floor", few: int = 1000) -> DataFrame:
    """The largest threshold not above each value, or null. Up to `few` thresholds are looked up in an array that every row
    carries. More are parted by up to `few` of them into bins, and an as-of merge inside each bin finds the floor: a bin
    begins with a threshold, so the floor of what lies in it never lies outside."""
    steps = thresholds.select(F.col(threshold).cast("double").alias("_t")).where(F.col("_t").isNotNull()).distinct()
    found = sorted(r[0] for r in steps.limit(few + 1).collect())
    floors = lambda values, c: F.array_max(F.filter(F.array(*[F.lit(v) for v in values]).cast("array<double>"), lambda t: t <= c))
    if len(found) <= few:
        return df.withColumn(out, floors(found, F.col(value)))
    shares = [i / few for i in range(few)]
    cuts = sorted(set(steps.agg(F.percentile_approx("_t", shares, 100 * few)).first()[0]))
    rows = df.withColumn("_bin", floors(cuts, F.col(value)))
    return as_of(rows, ["_bin"], value, steps.withColumn("_bin", floors(cuts, F.col("_t"))), "_t", "_t", out).drop("_bin")


def as_of(df: DataFrame, keys: list[str], at: str, facts: DataFrame, fact_at: str, fact: str, out: str) -> DataFrame:
    """The last fact of the same keys not later than each row: union and a running window, no join of ranges."""
    left = df.withColumn("_row", F.lit(1)).withColumn("_fact", F.lit(None).cast(facts.schema[fact].dataType)).withColumn("_at", F.col(at))
    right = facts.select(*keys, F.col(fact_at).alias("_at"), F.col(fact).alias("_fact"), F.lit(0).alias("_row"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_fact", ignorenulls=True).over(w)).where("_row = 1").drop("_row", "_fact", "_at")
