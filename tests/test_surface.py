"""Heights and normals between vertices, against plain loops."""

import math
import random

from pyspark.sql import functions as F

from cairnlake.operators import raster


def test_heights_between_vertices_with_gaps_repeats_and_nulls(spark):
    r = random.Random(5)
    cells, n = 10.0, 3
    vertices = [(gx, gy, row, col, r.choice([None, r.uniform(-5, 5)])) for gx in range(-1, 2) for gy in range(2) for row in range(n + 1) for col in range(n + 1) if r.random() < 0.8]
    vertices += vertices[:9]
    points = [(i % 55, r.uniform(-25, 25), r.uniform(-5, 25)) for i in range(60)] + [(None, 3.0, 4.0)]
    expected = {}
    for key, x, y in points:
        gx, gy = math.floor(x / cells), math.floor(y / cells)
        u, v = (x - gx * cells) * n / cells, (y - gy * cells) * n / cells
        c, w = min(math.floor(u), n - 1), min(math.floor(v), n - 1)
        for i in (0, 1):
            for j in (0, 1):
                own = [2.0 if h is None else h for a, b, row, col, h in vertices if (a, b, row, col) == (gx, gy, w + i, c + j)] or [2.0]
                expected[key] = (expected.get(key) or 0.0) + sum(own) * ((v - w) if i else 1 - (v - w)) * ((u - c) if j else 1 - (u - c))
    found = raster.bilinear_sample(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(vertices, "gx long, gy long, row long, col long, value double"), "id", cells, n, 2.0)
    got = {row.id: row.value for row in found.collect()}
    assert got.keys() == expected.keys()
    assert not [(k, got[k], h) for k, h in expected.items() if abs(got[k] - h) > 2e-6]


def test_no_row_is_made_for_a_corner(spark):
    """A point is shuffled once for each of its four samples, not for their sixteen corners."""
    points = spark.range(1000).select("id", (F.col("id") % 20 * 1.0).alias("x"), (F.col("id") % 19 * 1.0).alias("y"))
    vertices = spark.range(256).selectExpr("id div 16 % 2 gx", "id div 128 gy", "id div 4 % 4 row", "id % 4 col", "1.0d * id value")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = raster.surface_normal(points, vertices, "id", 10.0, 1.0, 3)
        assert found.count() == 1000
        plan = found._jdf.queryExecution().optimizedPlan()
        todo, samples = [plan], []
        while todo:
            node = todo.pop()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
            if node.nodeName() == "Generate":
                samples.append(node.generator().toString())
        assert samples and not any("row" in s and "col" in s for s in samples)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
