"""Nearest places by squares, and chains by contraction, against plain loops."""

import math
import random

import pytest

from cairnlake.operators import graph, nearest


def plain(points, places):
    found = {}
    for p, g, x, y in points:
        options = [(round(math.hypot(x - u, y - v), 3), q) for q, h, u, v in places if h == g and None not in (x, y, u, v)] if None not in (x, y) else []
        if options:
            found[p] = min(options)
    return found


@pytest.mark.parametrize("leaf", [3, 10_000])
def test_nearest_in_groups(spark, leaf):
    r = random.Random(5)
    # a group with a third of the places, clusters, a line, equal positions, a far point, a null group
    places = [(i, "hot", r.gauss(0, 1) + 100 * (i % 3), r.gauss(0, 1)) for i in range(900)]
    places += [(1000 + i, "line", float(i), 0.0) for i in range(200)] + [(2000 + i, "same", 1.0, 1.0) for i in range(50)] + [(3000 + i, None, r.random(), r.random()) for i in range(40)]
    places += [(4000, "hot", None, 1.0), (4001, "one", 5.0, 5.0)]
    points = [(i, r.choice(["hot", "hot", "line", "same", None, "one", "none"]), r.uniform(-300, 300), r.uniform(-50, 50)) for i in range(400)]
    points += [(500, "hot", 1e9, -1e9), (501, "line", 7.5, 3.0), (502, "same", 1.0, 1.0), (503, "hot", None, 0.0), (504, "line", 50.0, 0.0), (505, "line", 50.0, 0.0)]
    schema = "{} long, g string, x double, y double"
    got = nearest.nearest_in_groups(spark.createDataFrame(points, schema.format("p")), spark.createDataFrame(places, schema.format("q")), ["g"], "p", "q", leaf=leaf)
    assert {row.p: (row.distance, row.q) for row in got.collect()} == plain(points, places)


def test_few_pairs_are_made(spark):
    """Half of all places and points share a group: what is joined grows with the points, not with the product."""
    places = spark.range(20_000).selectExpr("id q", "id % 2 * (id % 50) g", "rand(1) * 1000 x", "rand(2) * 1000 y")
    points = spark.range(2_000).selectExpr("id p", "id % 2 * (id % 50) g", "rand(3) * 1000 x", "rand(4) * 1000 y")
    assert nearest.nearest_in_groups(points, places, ["g"], "p", "q").count() == 2_000


def test_empty_tables(spark):
    none = spark.createDataFrame([], "p long, q long, g string, x double, y double")
    some = spark.createDataFrame([(1, 2, "a", 0.0, 0.0)], none.schema)
    assert nearest.nearest_in_groups(none, some, ["g"], "p", "q").count() == 0
    assert nearest.nearest_in_groups(some, none, ["g"], "p", "q").count() == 0


@pytest.mark.parametrize("few", [1, 40, 10**6])
def test_chain_places(spark, few):
    r = random.Random(1)
    nodes = list(range(500))
    r.shuffle(nodes)
    paths = [nodes[:300], nodes[300:302], nodes[302:400]]
    loop = nodes[400:450]
    edges = [e for p in paths for e in zip(p, p[1:])] + list(zip(loop, loop[1:] + loop[:1])) + [(nodes[450], nodes[450])]
    r.shuffle(edges)
    got = graph.chain_places(spark.createDataFrame(edges, "a long, b long"), "a", "b", few=few if few > 1 else 60)
    assert {row.node: (row["head"], row.n) for row in got.collect()} == {x: (p[0], i) for p in paths for i, x in enumerate(p)}


@pytest.mark.parametrize("few", [10, 10**6])
def test_linear_chain(spark, few):
    chain = [f"n{i}" for i in range(200)]
    good = list(zip(chain, chain[1:]))
    frame = lambda edges: spark.createDataFrame(edges, "a string, b string")
    check = lambda edges, end="n199": tuple(graph.linear_chain(frame(edges), "a", "b", end, few=few).first())
    assert check(good) == (1, 199, False, True, True)
    assert check(good, "n5") == (1, 199, False, False, False)
    assert check([e for e in good if e[0] != "n100"])[0] == 2
    assert check([*good, ("n3", "n150")])[2] is True
    assert check(good[:20] + [("x", "y"), ("y", "x")], "n20") == (1, 20, False, True, False)


def test_three_dimensions(spark):
    r = random.Random(6)
    places = [(i, i % 3, r.random(), r.random(), r.random()) for i in range(500)]
    points = [(i, i % 3, r.random(), r.random(), r.random()) for i in range(100)]
    schema = "{} long, g long, x double, y double, z double"
    got = nearest.nearest_in_groups(spark.createDataFrame(points, schema.format("p")), spark.createDataFrame(places, schema.format("q")), ["g"], "p", "q", ("x", "y", "z"), 6, leaf=4)
    best = {p: min((round(math.dist(at, to), 6), q) for q, h, *to in places if h == g) for p, g, *at in points}
    assert {row.p: (row.distance, row.q) for row in got.collect()} == best


def walked(starts, doors, depth):
    """The walk as a queue works it off."""
    rooms = {}
    for d in doors:
        rooms.setdefault(d[1], []).append(d)
    found = {}
    for start, room, x, y, z in starts:
        queue, seen = [(room, (x, y, z), 0)], {room}
        found[start] = (None, 0) if room is None else (None, None)
        while room is not None and queue:
            here, at, steps = queue.pop(0)
            own = sorted(rooms.get(here, []), key=lambda d: (round(math.dist(at, d[2:5]), 6), d[0]))
            exits = [d for d in own if d[5] is None]
            if exits:
                found[start] = (exits[0][0], steps + 1)
                break
            for d in own:
                if d[5] not in seen and steps + 1 < depth:
                    seen.add(d[5])
                    queue.append((d[5], d[6:9], steps + 1))
    return found


def test_exit_anchor_against_the_queue(spark):
    r = random.Random(12)
    place = lambda: tuple(float(r.randrange(20)) for _ in range(3))
    doors = []
    for room in range(60):
        for _ in range(r.randrange(1, 6)):
            dest = None if r.random() < 0.08 else r.randrange(60)
            doors.append((f"d{len(doors):04}", room, *place(), dest, *(place() if dest is not None else (None, None, None))))
    doors += [(f"h{i:05}", 100, *place(), r.randrange(60), *place()) for i in range(3000)]  # a hub
    doors += [(f"c{i}", 200 + i, *place(), 201 + i if i < 9 else None, *(place() if i < 9 else (None,) * 3)) for i in range(10)]
    starts = [(i, r.choice([None, 100, *range(60)]), *place()) for i in range(300)] + [(1000 + i, 200 + i, *place()) for i in range(10)] + [(2000, 999, *place())]
    kinds = "door string, room long, x double, y double, z double, dest long, dx double, dy double, dz double"
    got = graph.exit_anchor(spark.createDataFrame(starts, "id long, room long, x double, y double, z double"), spark.createDataFrame(doors, kinds), "id")
    assert {row.id: (row.door, row.steps) for row in got.collect()} == walked(starts, doors, 9)


def test_exit_anchor_of_repeated_rows_and_doors_without_a_place(spark):
    """Each row of starts has one row in the result, whatever is repeated; what has no place is no door, as in the reference."""
    kinds = "door string, room long, x double, y double, z double, dest long, dx double, dy double, dz double"
    doors = [(f"d{i}", i, 1.0, 0.0, 0.0, i + 1 if i < 6 else None, *((0.0,) * 3 if i < 6 else (None,) * 3)) for i in range(7)] * 3
    doors += [("nowhere", 2, None, 0.0, 0.0, None, None, None, None), ("blind", 3, 0.0, 0.0, 0.0, 6, None, 0.0, 0.0)]
    starts = [(i, i, 0.0, 0.0, 0.0) for i in range(7)] * 4 + [(7, None, 0.0, 0.0, 0.0), (8, 5, None, 0.0, 0.0)]
    got = graph.exit_anchor(spark.createDataFrame(starts, "id long, room long, x double, y double, z double"), spark.createDataFrame(doors, kinds), "id")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(i, "d6", 7 - i) for i in range(7) for _ in range(4)] + [(7, None, 0), (8, None, None)]


def test_groups_of_few_places_are_not_halved(spark, monkeypatch):
    """Where no group has more than `leaf` places only their numbers are cut: no levels, and no rows of points or places."""
    cuts, cut = [], nearest.cut
    monkeypatch.setattr(nearest, "cut", lambda df: cuts.append(df.columns) or cut(df))
    places = spark.range(3_000).selectExpr("id q", "id % 300 g", "rand(1) * 1000 x", "rand(2) * 1000 y")
    points = spark.range(2_000).selectExpr("id p", "id % 300 g", "rand(3) * 1000 x", "rand(4) * 1000 y")
    assert nearest.nearest_in_groups(points, places, ["g"], "p", "q").count() == 2_000
    assert len(cuts) == 1 and "n" in cuts[0]


@pytest.mark.parametrize("shuffled", [False, True])
def test_more_paths_than_links_in_one_task(spark, shuffled):
    """Paths that are one link each have nothing to take out: the turns end all the same."""
    paths = [[1000 * p + i for i in range(n)] for p, n in enumerate([2, 3, 40, 2, 7, 90, 2, 2, 30])]
    edges = [e for p in paths for e in zip(p, p[1:])] + [(99_001, 99_002), (99_002, 99_001)]
    if shuffled:
        random.Random(2).shuffle(edges)
    got = graph.chain_places(spark.createDataFrame(edges, "a long, b long").repartition(5) if shuffled else spark.createDataFrame(edges, "a long, b long"), "a", "b", few=3)
    assert {row.node: (row["head"], row.n) for row in got.collect()} == {x: (p[0], i) for p in paths for i, x in enumerate(p)}


def test_chain_in_order_takes_few_turns(spark, monkeypatch):
    """Edges in the order of their chain leave a few links a batch, whatever their number."""
    turns, halved = [], graph._halved
    monkeypatch.setattr(graph, "_halved", lambda links, turn: turns.append(turn) or halved(links, turn))
    edges = spark.range(100_000).selectExpr("id a", "id + 1 b")
    assert tuple(graph.linear_chain(edges, "a", "b", 100_000, few=200).first()) == (1, 100_000, False, True, True)
    assert not turns
