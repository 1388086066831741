"""Exact selection, gates and block components against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import catalog, gates, raster, selection


def at_rank(values, share):
    values = sorted(v for v in values if v is not None)
    return values[max(1, math.ceil(share * len(values))) - 1] if values else None


@pytest.mark.parametrize(("most", "few"), [(10_000_000, 1), (50, 300), (0, 10)])
def test_nearest_ranks(spark, most, few):
    r = random.Random(4)
    draw = [lambda: r.gauss(0, 1), lambda: r.choice([1.5, 2.5]), lambda: r.choice([1e300, -1e300, 3.0, math.inf, -math.inf]), lambda: 10.0 ** r.randrange(-9, 9), lambda: None, lambda: 7.25]
    rows = [(g, draw[g % 6]()) for g in [r.choice([0, 0, 0, 1, 2, 3, 4, 5]) for _ in range(2000)]] + [(None, float(i)) for i in range(200)]
    shares = {"low": 0.0, "half": 0.5, "p95": 0.95, "p99": 0.99, "all": 1.0}
    got = selection.nearest_ranks(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", shares, most=most, bins=64, few=few).collect()
    assert len(got) == 7
    for row in got:
        own = [v for g, v in rows if g == row.g]
        assert [row[c] for c in shares] == [at_rank(own, s) for s in shares.values()]


@pytest.mark.parametrize("kind", ["long", "int", "decimal(20,2)"])
def test_nearest_ranks_of_whole_numbers(spark, kind):
    big = 2**60 if kind == "long" else 1000
    df = spark.range(5000).selectExpr(f"cast({big} + id * 7919 % 5000 as {kind}) v")
    row = selection.nearest_ranks(df, [], "v", {"p25": 0.25, "p75": 0.75}, most=100, bins=16, few=50).first()
    assert (int(row.p25), int(row.p75)) == (big + 1249, big + 3749)
    assert df.select("v").schema["v"].dataType == selection.nearest_ranks(df, [], "v", {"p": 0.5}, most=100).schema["p"].dataType


def pair(x, excess, hard_share=0.0, p99=0, top=0, flagged=False):
    return (x, excess, hard_share, p99, top, flagged)


def audit(spark, same, cross):
    rows = [(i, False, *p[1:]) for i, p in enumerate(same)] + [(100 + i, True, *p[1:]) for i, p in enumerate(cross)]
    df = spark.createDataFrame(rows, "id int, cross boolean, excess double, hard_share double, p99 long, top long, flagged boolean")
    told = {(r.condition, r.population): r.passed for r in gates.population_gate(df, F.col("cross")).collect()}
    return told, gates.seam_audit(df, F.col("cross"), F.col("id")).first()


def test_flagged_pairs_are_diagnostic(spark):
    told, row = audit(spark, [pair(0, 1.0)] * 200 + [pair(0, 1.0, flagged=True)], [pair(0, 1.2)] * 10)
    assert row.passes and row.flagged == 1 and row.failed == [] and all(told.values()) and len(told) == 11
    assert (row.pairs, row.same, row.cross) == (211, 201, 10)


def test_margins_and_caps(spark):
    told, row = audit(spark, [pair(0, 1.0)] * 20, [pair(0, 1.6)] * 20)
    assert not row.passes and row.failed == ["relative_mean"] and not told["relative_mean", "cross"]
    told, row = audit(spark, [pair(0, 1.0)] * 20, [pair(0, 1.0)] * 18 + [pair(0, 3.5)] * 2)
    assert row.failed == ["relative_p95"]
    told, row = audit(spark, [pair(0, 9.0)] * 3, [pair(0, 5.0)] * 3)
    assert row.failed == ["absolute_mean", "absolute_p95"] and told["absolute_p95", "cross"] and not told["absolute_p95", "same"]
    told, row = audit(spark, [pair(0, 0.0)] * 2000 + [pair(0, 33.0)], [pair(0, 0.0)])
    assert row.failed == ["absolute_top"]
    _, row = audit(spark, [pair(0, 1.0, flagged=True)], [])
    assert row.failed == ["absolute_flagged_share"] and row.cross == 0


def test_structural_failures_are_listed(spark):
    bad = [pair(0, 0.0, p99=9), pair(0, 0.0, top=33), pair(0, 0.0, hard_share=0.02)] + [pair(0, 0.0, p99=10)] * 30
    _, row = audit(spark, [pair(0, 0.0)], bad)
    assert row.failed == ["structural_failures"] and row.structural_failures == 33 and row.failure_ids == list(range(100, 120))


def test_a_null_value_passes_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert [r.passed for r in gates.judged(df, [], {"x": (F.col("v"), 1.0)}).collect()] == [False]


def test_visual_difference(spark):
    black = [(0, x, y, 0, 0, 0, 255) for x in range(4) for y in range(4)]
    other = [(0, x, y, 90 if (x, y) in ((0, 0), (1, 1), (3, 3)) else 0, 0, 0, 0 if (x, y) == (3, 0) else 255) for _, x, y, *_ in black]
    a, b = (spark.createDataFrame(rows, "i long, px long, py long, r long, g long, b long, a long") for rows in (black, other))
    row = raster.visual_difference(a, b, ["i"], 4, 32).first()
    assert (row.pixels, row.compared, row.ignored, row.unpaired, row.differing, row.alpha_differing, row.opaque_differing) == (16, 16, 0, 0, 4, 1, 3)
    assert (row.hard, row.components, row.largest, row.top, row.top_opaque, row.p99) == (4, 3, 2, 255, 90, 255)
    assert row["mean"] == round((3 * 90 + 255) / 64, 9) and row.hard_share == 0.25
    row = raster.visual_difference(a, b, ["i"], 4, 32, ("north", "east")).first()
    assert (row.compared, row.ignored, row.differing, row.components, row.largest, row.top) == (9, 7, 1, 1, 1, 90)
    row = raster.visual_difference(a, b.where("px < 2"), ["i"], 4, 32).first()
    assert (row.pixels, row.unpaired) == (8, 8)
    with pytest.raises(ValueError):
        raster.visual_difference(a, b, ["i"], 4, 32, ("up",))


def plain_components(cells):
    left, found = set(cells), {}
    while left:
        stack, own = [left.pop()], []
        while stack:
            b, x, y = stack.pop()
            own.append((b, x, y))
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    if (b, x + dx, y + dy) in left:
                        left.remove((b, x + dx, y + dy))
                        stack.append((b, x + dx, y + dy))
        anchor = min((x, y) for _, x, y in own)
        found |= dict.fromkeys(own, anchor)
    return found


def test_components_over_block_borders(spark):
    r = random.Random(9)
    cells = {("a", r.randrange(-150, 150), r.randrange(-150, 150)) for _ in range(30_000)}
    snake = {("s", x, y) for x in range(-70, 140) for y in range(-70, 140) if x % 4 == 0 or (y == (139 if x // 4 % 2 else -70))}
    cells |= snake | {("b", 63, 63), ("b", 64, 64), ("b", -1, 0), ("b", 0, -1), ("b", 200, 5), ("c", 0, 0), (None, 5, 5), (None, 6, 6)}
    df = spark.createDataFrame([*cells, *list(cells)[:100]], "k string, x int, y int")
    got = {(q.k, q.x, q.y): (q.anchor_x, q.anchor_y) for q in catalog.components8(df, "k", "x", "y").collect()}
    assert got == plain_components(cells)


def test_components_inside_one_block(spark):
    df = spark.createDataFrame([(1, x, y) for x, y in ((0, 0), (1, 1), (3, 3), (60, 60))], "k long, x long, y long")
    found = catalog.components8(df, "k", "x", "y")
    assert {(q.x, q.y): (q.anchor_x, q.anchor_y) for q in found.collect()} == {(0, 0): (0, 0), (1, 1): (0, 0), (3, 3): (3, 3), (60, 60): (60, 60)}
    assert catalog.components8(df.limit(0), "k", "x", "y").count() == 0
