"""The exact medoid of groups of any size."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import catalog


@pytest.mark.parametrize(("most", "pivots"), [(10_000, 4), (50, 8), (1, 64)])
def test_medoid(spark, most, pivots):
    r = random.Random(3)
    rows = [("a", i, r.gauss(0, 1), r.gauss(0, 1)) for i in range(400)] + [("b", i, math.cos(i), math.sin(i)) for i in range(60)]
    rows += [("c", i, 1.0, 2.0) for i in range(70)] + [("d", 1, 0.0, 0.0), ("d", 2, 3.0, 0.0), ("e", 9, 5.0, 5.0)] + [("f", i, float(i), 0.0) for i in range(101)]
    best = {}
    for g, i, x, y in rows:
        total = round(sum(math.hypot(x - u, y - v) for h, _, u, v in rows if h == g), 3)
        best[g] = min(best.get(g, (total, i)), (total, i))
    got = catalog.medoid(spark.createDataFrame(rows, "g string, i long, x double, y double"), "g", "x", "y", "i", most, pivots).collect()
    assert {q.g: (q.total, q.medoid) for q in got} == best


def test_a_large_group_ends(spark):
    df = spark.range(30_000).selectExpr("0 g", "id i", "id * 7919 % 30011 / 30011.0D x", "id * 104729 % 30013 / 30013.0D y")
    row = catalog.medoid(df, "g", "x", "y", "i").first()
    total = df.agg(F.round(F.sum(F.hypot(F.col("x") - df.where(F.col("i") == row.medoid).first().x, F.col("y") - df.where(F.col("i") == row.medoid).first().y)), 3)).first()[0]
    assert row.total == total
    middle = df.orderBy(F.hypot(F.col("x") - 0.5, F.col("y") - 0.5)).limit(300).collect()
    points = [(q.x, q.y) for q in df.collect()]
    import numpy as np

    xs, ys = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    assert row.medoid == min((round(float(np.hypot(xs - q.x, ys - q.y).sum()), 3), q.i) for q in middle)[1]
