"""Gates: named conditions over measured values, each told with its value, its limit and its verdict.

Two populations of pairs of neighbours (inside a shard, across shards) are compared: the pairs across may be worse than those
inside by a margin only, both have absolute caps, and single pairs across must be sound. Flagged pairs are told and decide nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.operators.selection import nearest_ranks


@dataclass(frozen=True)
class SeamLimits:
    """What the gate of seams allows."""

    pair_mean: float = 8.0
    hard_delta: int = 32
    pair_hard_share: float = 0.10
    cross_mean_margin: float = 0.5
    cross_p95_margin: float = 2.0
    population_mean: float = 4.0
    population_p95: float = 8.0
    population_top: float = 32.0
    population_flagged_share: float = 0.01
    cross_p99: float = 8
    cross_top: float = 32
    cross_hard_share: float = 0.01


@dataclass(frozen=True)
class RepeatLimits:
    """How far two renderings of one image may be apart."""

    differing_share: float = 0.03
    alpha_share: float = 0.02
    mean: float = 0.10
    p99: float = 8
    hard_share: float = 0.01
    top_opaque: float = 48
    largest: float = 16


#: A pixel of a repeated rendering that differs by more is hard. Fixed value.
REPEAT_HARD_DELTA = 8


def judged(df: DataFrame, keys: list[str], conditions: dict[str, tuple[Column, Column | float]]) -> DataFrame:
    """(keys, condition, value, limit, passed), one row for each condition and row of df, {name: (value, limit)}: passed where the
    value is at most the limit. A value that is null passes nothing."""
    rows = [F.struct(F.lit(n).alias("condition"), v.cast("double").alias("value"), (limit if isinstance(limit, Column) else F.lit(limit)).cast("double").alias("limit")) for n, (v, limit) in conditions.items()]
    told = df.select(*keys, F.explode(F.array(*rows)).alias("c")).select(*keys, "c.*")
    return told.withColumn("passed", F.coalesce(F.col("value") <= F.col("limit"), F.lit(False)))


def verdict(told: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, passes, failed): whether all conditions passed, and the sorted names of those that did not."""
    failed = F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("condition"))))
    return told.groupBy(*keys).agg(F.min("passed").alias("passes"), failed.alias("failed"))


def populations(metrics: DataFrame, cross: Column, limits: SeamLimits = SeamLimits(), value: str = "excess") -> DataFrame:
    """(population, n, mean, p95, top, flagged, flagged_share) of pairs inside (same) and across shards (cross); both are told, with
    zeros where there is no pair. Pairs of which cross is null belong to neither."""
    rows = metrics.select(F.when(cross, "cross").when(~cross, "same").alias("population"), F.col(value).alias("_v"), F.col("flagged").alias("_f")).where("population is not null")
    sums = rows.groupBy("population").agg(F.count("*").alias("n"), F.round(F.avg("_v"), 9).alias("mean"), F.round(F.max("_v"), 9).alias("top"), F.count_if("_f").alias("flagged"), F.round(F.avg(F.col("_f").cast("double")), 9).alias("flagged_share"))
    both = metrics.sparkSession.createDataFrame([("same",), ("cross",)], "population string")
    found = both.join(sums, "population", "left").join(nearest_ranks(rows, ["population"], "_v", {"p95": 0.95}), "population", "left")
    return found.select("population", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "p95", "top")], F.coalesce("flagged", F.lit(0)).alias("flagged"), F.coalesce("flagged_share", F.lit(0.0)).alias("flagged_share"))


def structural_failures(metrics: DataFrame, cross: Column, limits: SeamLimits = SeamLimits()) -> DataFrame:
    """The pairs across shards that are unsound by themselves, with `reasons`."""
    tests = {"mean": F.col("excess") > limits.pair_mean, "p99": F.col("p99") > limits.cross_p99, "top": F.col("top") > limits.cross_top, "hard": F.col("hard_share") > limits.cross_hard_share}
    reasons = F.array_compact(F.array(*[F.when(bad, name) for name, bad in tests.items()]))
    return metrics.where(cross).withColumn("reasons", reasons).where(F.size("reasons") > 0)


def population_gate(metrics: DataFrame, cross: Column, limits: SeamLimits = SeamLimits()) -> DataFrame:
    """(condition, population, value, limit, passed): the relative margins (population cross), the absolute caps of both
    populations, and no structural failure. metrics: those of raster.seam_metrics."""
    found = populations(metrics, cross, limits)
    caps = judged(found, ["population"], {
        "absolute_mean": (F.col("mean"), limits.population_mean), "absolute_p95": (F.col("p95"), limits.population_p95),
        "absolute_top": (F.col("top"), limits.population_top), "absolute_flagged_share": (F.col("flagged_share"), limits.population_flagged_share),
    })
    of = lambda p, c: F.max(F.when(F.col("population") == p, F.col(c)))
    wide = found.agg(*[of(p, c).alias(f"{p}_{c}") for p in ("same", "cross") for c in ("mean", "p95")]).withColumn("population", F.lit("cross"))
    margins = judged(wide, ["population"], {
        "relative_mean": (F.col("cross_mean"), F.col("same_mean") + limits.cross_mean_margin), "relative_p95": (F.col("cross_p95"), F.col("same_p95") + limits.cross_p95_margin),
    })
    broken = structural_failures(metrics, cross, limits).agg(F.count("*").alias("n")).withColumn("population", F.lit("cross"))
    rows = caps.unionByName(margins).unionByName(judged(broken, ["population"], {"structural_failures": (F.col("n"), 0)}))
    return rows.select("condition", "population", "value", "limit", "passed")


def seam_audit(metrics: DataFrame, cross: Column, id_col: Column, limits: SeamLimits = SeamLimits(), listed: int = 20) -> DataFrame:
    """One row: passes, the conditions that failed, pairs in all, inside and across shards, flagged pairs (diagnostic: they decide
    nothing by themselves), structural failures and the first `listed` of their ids, sorted."""
    told = verdict(population_gate(metrics, cross, limits))
    counts = metrics.agg(F.count("*").alias("pairs"), F.count_if(~cross).alias("same"), F.count_if(cross).alias("cross"), F.count_if("flagged").alias("flagged"))
    broken = structural_failures(metrics, cross, limits).select(id_col.alias("id"))
    first = broken.orderBy("id").limit(listed).agg(F.array_sort(F.collect_list("id")).alias("failure_ids"))
    return told.crossJoin(counts).crossJoin(broken.agg(F.count("*").alias("structural_failures"))).crossJoin(first)


def repeat_gate(differences: DataFrame, keys: list[str], limits: RepeatLimits = RepeatLimits()) -> DataFrame:
    """(keys, condition, value, limit, passed) of two renderings of each image. differences: those of raster.visual_difference."""
    return judged(differences, keys, {f.name: (F.col(f.name), getattr(limits, f.name)) for f in fields(limits)})
