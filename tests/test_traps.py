"""Semantics that are easy to get wrong, on small frames."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairnlake.functions import grid, keys
from cairnlake.operators import catalog, find, graph, greedy, merge, raster, sets, userdata
from cairnlake.operators.components import connected_components


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def log(spark, data):
    return spark.createDataFrame(data, "k string, n int, v string, deleted boolean")


def test_tombstones_hide_and_later_versions_come_back(spark):
    df = log(spark, [("a", 1, "x", False), ("a", 2, None, True), ("b", 1, "x", True), ("b", 2, "y", False), ("c", 1, "z", False)])
    assert rows(merge.latest_wins(df, ["k"], ["n"], "deleted"), "k", "v") == [("b", "y"), ("c", "z")]
    merged = merge.epoch_merge(log(spark, [("a", 1, "old", False), ("a", 2, None, True), ("a", 3, "", False), ("a", 4, None, False)]), "k", ["n"], "deleted", always=["v"], first=["n"])
    assert rows(merged, "k", "epoch", "v", "n") == [("a", 1, None, 3)]


def test_moved_beats_regular_even_if_earlier(spark):
    df = spark.createDataFrame([("a", 1, 1, "moved"), ("a", 2, 0, "regular")], "k string, n int, tier int, v string")
    assert rows(merge.two_tier_latest(df, ["k"], ["n"], "tier"), "v") == [("moved",)]


def test_override_counters_need_liveness(spark):
    df = log(spark, [("a", 1, "", False), ("a", 2, "", False), ("a", 3, "", True), ("a", 4, "", False), ("b", 1, "", True)])
    assert merge.override_counters(df, "k", ["n"], "deleted").first().asDict() == {"raw": 5, "effective": 1, "overrides": 1, "deletions": 2}


def test_ascii_fold_leaves_other_letters(spark):
    assert spark.range(1).select(keys.ascii_fold(F.lit("ÄDoor"))).first()[0] == "Ädoor"


def test_floors_go_down_and_errors_stop(spark):
    one = spark.range(1).select(F.lit(-0.5).alias("x"), F.lit(float("nan")).alias("bad"))
    assert one.select(grid.world_to_cell(F.col("x"), 8192.0)).first()[0] == -1
    assert [r[0] for r in spark.range(-4, 5).select(grid.shard_center(F.col("id"))).collect()] == [-3, -3, -3, 0, 0, 0, 3, 3, 3]
    with pytest.raises(PySparkException):
        one.select(grid.world_to_cell(F.col("bad"), 8192.0)).collect()
    with pytest.raises(PySparkException):
        catalog.fail_on(spark.createDataFrame([("bad",)], "reason string"), ["bad"]).collect()


def test_monotonic_time_and_ties_of_backups(spark):
    df = spark.createDataFrame([("a", 1, 500), ("a", 2, 500), ("a", 3, 100), ("a", 4, 900)], "k string, n int, ms long")
    assert [r[0] for r in userdata.monotonic_time(df, "k", ["n"], "ms").orderBy("n").select("at").collect()] == [500, 501, 502, 900]
    schema = "k string, at int, gone boolean"
    old = spark.createDataFrame([("a", 5, False), ("b", 5, True), ("c", 5, False), ("d", 5, False)], schema)
    new = spark.createDataFrame([("a", 5, True), ("b", 5, False), ("c", 5, False), ("e", 1, False)], schema)
    assert rows(userdata.import_backup(old, new, ["k"], "at", "gone"), "k", "taken", "gone") == [("a", True, True), ("b", False, True), ("c", False, False), ("d", None, False), ("e", True, False)]


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randint(200, 320), rng.randint(200, 320)) for _ in range(90)] + [(5, 5), (None, 3)]
    rng.shuffle(edges)
    parent = {}

    def find_root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = find_root(u), find_root(v)
            parent[max(a, b)] = min(a, b)
    expected = sorted((x, find_root(x)) for x in parent)
    found = connected_components(spark.createDataFrame(edges, "u long, v long"), "u", "v")
    assert sorted(map(tuple, found.collect())) == expected
    assert connected_components(spark.createDataFrame([], "u long, v long"), "u", "v").count() == 0


def test_cells_that_touch_by_a_corner_are_one(spark):
    cells = spark.createDataFrame([("n", 0, 0), ("n", 1, 1), ("n", 5, 5), ("m", 1, 0)], "b string, x long, y long")
    assert rows(catalog.components8(cells, "b", "x", "y"), "b", "x", "anchor_x") == [("m", 1, 1), ("n", 0, 0), ("n", 1, 0), ("n", 5, 5)]


def test_nearest_match_never_compares_all(spark):
    schema = "{} long, cell string, name string, mode string, x double, y double"
    d = spark.createDataFrame([(1, None, "a", "boat", 0.0, 0.0), (2, "room", "a", "boat", 9e9, 0.0), (3, None, "z", "cart", 0.0, 0.0)], schema.format("dest"))
    p = spark.createDataFrame([(10, None, "b", "boat", 2048.0, 0.0), (11, None, "a", "boat", 2049.0, 0.0), (12, "room", "c", "boat", 0.0, 0.0), (9, None, "q", "cart", 2048.5, 0.0)], schema.format("provider"))
    found = graph.nearest_compatible(d, p, "dest", "provider", 2048.0)
    assert rows(found, "dest", "provider", "match") == [(1, 10, "matched"), (2, 12, "matched"), (3, None, "none")]
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_exit_anchor_takes_the_first_in_breadth_first_order(spark):
    starts = spark.createDataFrame([("s", "r0", 0.0, 0.0, 0.0), ("out", None, 1.0, 1.0, 1.0), ("loop", "l0", 0.0, 0.0, 0.0), ("deep", "c0", 0.0, 0.0, 0.0), ("deeper", "e0", 0.0, 0.0, 0.0)], "id string, room string, x double, y double, z double")
    door = lambda key, room, x, dest: (key, room, float(x), 0.0, 0.0, dest, 0.0, 0.0, 0.0)
    doors = [door("far", "r0", 9, "r1"), door("near", "r0", 1, "r2"), door("exit1", "r1", 1, None), door("exit2", "r2", 5, None), door("l", "l0", 1, "l1"), door("m", "l1", 1, "l0")]
    doors += [door(f"c{i}", f"c{i}", 1, f"c{i + 1}" if i < 7 else None) for i in range(8)] + [door(f"e{i}", f"e{i}", 1, f"e{i + 1}" if i < 8 else None) for i in range(9)]
    frame = spark.createDataFrame(doors, "door string, room string, x double, y double, z double, dest string, dx double, dy double, dz double")
    assert rows(graph.exit_anchor(starts, frame, "id"), "id", "door", "steps") == [("deep", "c7", 8), ("deeper", "e8", 9), ("loop", None, None), ("out", None, 0), ("s", "exit2", 2)]


def test_chains(spark):
    make = lambda pairs: spark.createDataFrame(pairs, "a string, b string")
    assert graph.linear_chain(make([("x", "y"), ("y", "z")]), "a", "b", "z").first().ok
    assert not graph.linear_chain(make([("x", "y"), ("y", "z")]), "a", "b", "y").first().ok
    assert not graph.linear_chain(make([("x", "y"), ("w", "y")]), "a", "b", "y").first().ok
    assert not graph.linear_chain(make([("x", "y"), ("p", "q"), ("q", "p")]), "a", "b", "y").first().ok


def test_seams(spark):
    def tile(tx, colour, alpha=255):
        return [(tx, 0, px, py, colour, colour, colour, alpha) for px in range(8) for py in range(8)]

    schema = "tx long, ty long, px long, py long, r long, g long, b long, a long"
    measure = lambda data: raster.seam_metrics(spark.createDataFrame(data, schema), 8).first()
    assert measure(tile(0, 7) + tile(1, 7)).excess == 0
    assert measure(tile(0, 0) + tile(1, 255)).hard_share == 1
    assert measure(tile(0, 0, 0) + tile(1, 255, 0)).mean == 0
    assert measure(tile(0, 9, 0) + tile(1, 9)).unmatched_alpha == 8


def test_snapshot_of_itself_is_unchanged_and_order_is_nothing(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k int, v string")
    assert rows(sets.diff_summary(df, df.orderBy(F.desc("k")).repartition(7), ["k"], ["v"]), "state", "n") == [("unchanged", 20)]
    from cairnlake.operators.quality import set_digest

    assert set_digest(df).first() == set_digest(df.orderBy(F.desc("k")).repartition(5)).first()


def test_packing_parts_and_search_edges(spark):
    items = spark.createDataFrame([("g", i, 600) for i in range(5)], "grp string, o int, size int")
    assert [r.part for r in greedy.next_fit_parts(items, "grp", "o", "size", 3200).orderBy("o").collect()] == [0, 0, 1, 1, 2]
    with pytest.raises(PySparkException):
        greedy.next_fit_parts(items, "grp", "o", "size", 600).collect()
    names = spark.createDataFrame([(1, "Old Mill"), (2, "Mole Hill")], "id int, name string")
    assert [r.id for r in find.top_k_search(names, " ", {"name": 1.0}, "id", 1).collect()] == [1]
    assert [r.id for r in find.top_k_search(names, "mill", {"name": 1.0}, "id").collect()][0] == 1
    assert find.weighted_fuzzy(names, "m", {"name": 1.0}).count() == 0
