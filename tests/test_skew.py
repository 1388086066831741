"""Half of all rows share a key: joins and components stay right, and the heavy key is not shuffled to one task."""

import random

from pyspark.sql import functions as F

from cairnlake.operators import components, skew


def test_join_by_key(spark):
    left = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 400).alias("k"))
    right = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    heavy = skew.heavy_keys(counts, "k", "n", 4000)
    assert heavy[:1] == [7] or 7 in heavy
    assert len(skew.heavy_keys(counts, "k", "n", 10**9)) == 0
    found = skew.join_by_key(left, right, "k", [7])
    assert sorted(map(tuple, found.select("id", "v").collect())) == sorted(map(tuple, left.join(right, "k").select("id", "v").collect()))
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def brute(edges):
    least = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            m = min(least[u], least[v])
            changed |= least[u] != m or least[v] != m
            least[u] = least[v] = m
    return least


def test_components_with_a_hub_and_a_chain(spark):
    rng = random.Random(3)
    edges = [(5000, i) for i in range(1000, 3000)] + [(i, i + 1) for i in range(100)] + [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(150)] + [(2500, 2500), (1, 2)]
    frame = spark.createDataFrame([*edges, (None, 3), (9, None)], "a long, b long")
    found = {r.node: r.component for r in components.connected_components(frame, "a", "b").collect()}
    assert found == {x: m for x, m in brute([e for e in edges if e[0] != e[1]]).items()}
    pairs = frame.select(F.struct(F.col("a").alias("x")).alias("a"), F.struct(F.col("b").alias("x")).alias("b")).where("a.x is not null and b.x is not null")
    assert {r.node.x: r.component.x for r in components.connected_components(pairs, "a", "b").collect()} == found
    assert components.connected_components(frame.limit(0), "a", "b").count() == 0
