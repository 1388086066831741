"""Grid, range, adjacency and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions import grid
from cairnlake.operators import ranges, sets, summaries
from cairnlake.plans.registry import Registry

R = Registry()
P = "p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice - 40000 AS x, l_quantity * 1000 - 25000 AS y FROM lineitem)"
SIZE = 8192.0


def points(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") - 40000).alias("x"), (F.col("l_quantity") * 1000 - 25000).alias("y"))


def cells(t, size):
    return points(t).select(grid.world_to_cell(F.col("x"), size).alias("cx"), grid.world_to_cell(F.col("y"), size).alias("cy")).distinct()


def cells_sql(size):
    return f"{P}, c AS (SELECT DISTINCT floor(x / {size})::BIGINT AS cx, floor(y / {size})::BIGINT AS cy FROM p)"


def xy():
    return F.col("x"), F.col("y")


@R.add("d1_world_to_cell", f"WITH {P} SELECT floor(x / 8192.0)::BIGINT AS cx, floor(y / 8192.0)::BIGINT AS cy, count(*) AS n FROM p GROUP BY ALL")
def d1(t):
    x, y = xy()
    return points(t).groupBy(grid.world_to_cell(x, SIZE).alias("cx"), grid.world_to_cell(y, SIZE).alias("cy")).agg(F.count("*").alias("n"))


@R.add("d2_cell_extent",
    f"WITH {cells_sql(256.0)} SELECT cx, cy, cx * 256.0 - 16.0::DOUBLE AS min_x, (cy * 256.0 - 16.0)::DOUBLE AS min_y, ((cx + "
    "1) * 256.0 + 16.0)::DOUBLE AS max_x, ((cy + 1) * 256.0 + 16.0)::DOUBLE AS max_y FROM c".replace("cx * 256.0 - 16.0::DOUBLE", "(cx * 256.0 - 16.0)::DOUBLE"))
def d2(t):
    box = grid.cell_extent(F.col("cx"), F.col("cy"), 256.0, 16.0)
    return cells(t, 256.0).select("cx", "cy", *[b.alias(n) for b, n in zip(box, ("min_x", "min_y", "max_x", "max_y"))])


@R.add("d3_world_pixel_round_trip",
    f"WITH {P}, q AS (SELECT *, (x + 50000) / 64.0 AS px, (50000 - y) / 64.0 AS py FROM p) SELECT l_orderkey, l_linenumber, "
    "x, y, px::DOUBLE AS px, py::DOUBLE AS py, (px * 64.0 - 50000)::DOUBLE AS bx, (50000 - py * 64.0)::DOUBLE AS by, (50000 "
    "- (py + 0.5) * 64.0)::DOUBLE AS centre_y FROM q")
def d3(t):
    x, y = xy()
    px, py = grid.world_to_pixel(x, y, -50000, 50000, 64.0)
    rows = points(t).withColumn("px", px).withColumn("py", py)
    bx, by = grid.pixel_to_world(F.col("px"), F.col("py"), -50000, 50000, 64.0)
    return rows.select("l_orderkey", "l_linenumber", "x", "y", "px", "py", bx.alias("bx"), by.alias("by"), grid.pixel_to_world(F.col("px"), F.col("py"), -50000, 50000, 64.0, True)[1].alias("centre_y"))


@R.add("d4_cell_pixels",
    f"WITH {P}, q AS (SELECT x, y, floor(x / 8192.0)::BIGINT AS cx, floor(y / 8192.0)::BIGINT AS cy FROM p) SELECT cx, cy, "
    "floor((x - cx * 8192.0) / 16.0)::BIGINT AS px, floor(((cy + 1) * 8192.0 - y) / 16.0)::BIGINT AS py, count(*) AS n FROM "
    "q GROUP BY ALL")
def d4(t):
    x, y = xy()
    rows = points(t).withColumn("cx", grid.world_to_cell(x, SIZE)).withColumn("cy", grid.world_to_cell(y, SIZE))
    scale = SIZE / 512
    return rows.groupBy("cx", "cy", F.floor((x - F.col("cx") * SIZE) / scale).alias("px"), F.floor(((F.col("cy") + 1) * SIZE - y) / scale).alias("py")).agg(F.count("*").alias("n"))


@R.add("d5_tile_sizes",
    "SELECT DISTINCT p_size % 8 AS z, (16.0 * pow(2.0, 7 - p_size % 8))::DOUBLE AS units, (16.0 * pow(2.0, 7 - p_size % 8) * "
    "512)::DOUBLE AS size FROM part")
def d5(t):
    units = grid.units_per_pixel(F.col("z"), 16.0, 7)
    return t.part.select((F.col("p_size") % 8).alias("z")).distinct().select("z", units.alias("units"), (units * 512).alias("size"))


TILES = (
    f"WITH {P}, z AS (SELECT unnest(range(0, 8))::INTEGER AS z), q AS (SELECT z, floor((x + 50000) / (16.0 * pow(2.0, 7 - z) "
    "* 512))::BIGINT AS tx, floor((50000 - y) / (16.0 * pow(2.0, 7 - z) * 512))::BIGINT AS ty FROM p, z)"
)


def tiles(t):
    x, y = xy()
    rows = points(t).select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("z"))
    tx, ty = grid.world_to_tile(x, y, F.col("z"), -50000, 50000, 16.0, 7, 512)
    return rows.select("z", tx.alias("tx"), ty.alias("ty"))


@R.add("d6_world_to_tile", TILES + " SELECT z, tx, ty, count(*) AS n FROM q GROUP BY ALL")
def d6(t):
    return tiles(t).groupBy("z", "tx", "ty").agg(F.count("*").alias("n"))


@R.add("d7_cell_tile_round_trip", f"WITH {cells_sql(256.0)} SELECT cx, cy, cx + 500 AS tx, 300 - cy AS ty, true AS same FROM c")
def d7(t):
    tx, ty = grid.cell_to_tile(F.col("cx"), F.col("cy"), -500, 300)
    rows = cells(t, 256.0).withColumn("tx", tx).withColumn("ty", ty)
    bx, by = grid.tile_to_cell(F.col("tx"), F.col("ty"), -500, 300)
    return rows.withColumn("same", (bx == F.col("cx")) & (by == F.col("cy")) & (grid.aligned(F.col("cx") * 256.0, 256.0) == F.col("cx")))


@R.add("d9_shard_center",
    f"WITH {cells_sql(256.0)} SELECT (3 * floor((cx + 1) / 3.0))::BIGINT AS sx, (3 * floor((cy + 1) / 3.0))::BIGINT AS sy, "
    "count(*) AS n FROM c GROUP BY ALL")
def d9(t):
    return cells(t, 256.0).groupBy(grid.shard_center(F.col("cx")).alias("sx"), grid.shard_center(F.col("cy")).alias("sy")).agg(F.count("*").alias("n"))


@R.add("d11_rounding",
    "SELECT l_orderkey, l_linenumber, floor(l_discount * 1000 - 25.5 + 0.5)::BIGINT AS js, least(greatest(floor(l_quantity * "
    "7.5 - 20 + 0.5), 0), 255)::INTEGER AS byte, (round_even(l_quantity / 2, 0))::DOUBLE AS even FROM lineitem")
def d11(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", grid.round_half_up(F.col("l_discount") * 1000 - 25.5).alias("js"), grid.to_byte(F.col("l_quantity") * 7.5 - 20).alias("byte"), grid.round_half_even(F.col("l_quantity") / 2, 0).alias("even"))


@R.add("d12_distances",
    f"WITH {P} SELECT l_orderkey, l_linenumber, round(sqrt(x * x + y * y), 4) AS d2, round(sqrt(x * x + y * y + l_linenumber "
    "* l_linenumber), 4) AS d3 FROM p")
def d12(t):
    x, y = xy()
    zero = F.lit(0.0)
    return points(t).select("l_orderkey", "l_linenumber", F.round(grid.distance2(x, y, zero, zero), 4).alias("d2"), F.round(grid.distance3(x, y, F.col("l_linenumber").cast("double")), 4).alias("d3"))


@R.add("d13_group_extent",
    f"WITH {P} SELECT l_partkey, greatest(min(x) - 16384, -40000) AS min_x, greatest(min(y) - 16384, -25000) AS min_y, "
    "least(max(x) + 16384, 60000) AS max_x, least(max(y) + 16384, 25000) AS max_y FROM p GROUP BY l_partkey")
def d13(t):
    return summaries.group_extent(points(t), "l_partkey", "x", "y", 2 * SIZE, (-40000, -25000, 60000, 25000))


@R.add("d14_tile_bounds", TILES +
    " SELECT z, ceil(100000 / (16.0 * pow(2.0, 7 - z) * 512))::BIGINT AS columns, count(*) FILTER (tx < 0 OR ty < 0 OR tx >= "
    "ceil(100000 / (16.0 * pow(2.0, 7 - z) * 512)) OR ty >= ceil(60000 / (16.0 * pow(2.0, 7 - z) * 512))) AS outside FROM q "
    "GROUP BY z")
def d14(t):
    size = grid.units_per_pixel(F.col("z"), 16.0, 7) * 512
    columns, rows = F.ceil(F.lit(100000) / size), F.ceil(F.lit(60000) / size)
    inside = (F.col("tx") >= 0) & (F.col("ty") >= 0) & (F.col("tx") < columns) & (F.col("ty") < rows)
    return tiles(t).groupBy("z").agg(F.max(columns).alias("columns"), F.count_if(~inside).alias("outside"))


ADJ = (
    f"WITH {cells_sql(256.0)}, a AS (SELECT c.cx, c.cy, d.cx AS nx, d.cy AS ny, 'east' AS side FROM c JOIN c d ON d.cx = c.cx "
    "+ 1 AND d.cy = c.cy UNION ALL SELECT c.cx, c.cy, d.cx, d.cy, 'north' FROM c JOIN c d ON d.cx = c.cx AND d.cy = c.cy - 1)"
)


@R.add("e7_adjacency", ADJ + " SELECT * FROM a")
def e7(t):
    return sets.adjacency(cells(t, 256.0), "cx", "cy")


@R.add("e8_cross_group_edges", ADJ +
    " SELECT side, count(*) AS n FROM a WHERE floor((cx + 1) / 3.0) <> floor((nx + 1) / 3.0) OR floor((cy + 1) / 3.0) <> "
    "floor((ny + 1) / 3.0) GROUP BY side")
def e8(t):
    edges = sets.adjacency(cells(t, 256.0), "cx", "cy")
    group = lambda a, b: F.struct(grid.shard_center(F.col(a)).alias("a"), grid.shard_center(F.col(b)).alias("b"))
    return sets.cross_group_edges(edges, group("cx", "cy"), group("nx", "ny")).groupBy("side").agg(F.count("*").alias("n"))


@R.add("e9_neighbor_map", ADJ + """, b AS (SELECT cx, cy, side, nx, ny FROM a UNION ALL SELECT nx, ny, CASE side WHEN 'east' THEN 'west' ELSE 'south' END, cx, cy FROM a)
    SELECT cx, cy, max(nx) FILTER (side = 'west') AS west_x, max(nx) FILTER (side = 'east') AS east_x, max(ny) FILTER (side = 'north') AS north_y, max(ny) FILTER (side = 'south') AS south_y FROM b GROUP BY cx, cy""")
def e9(t):
    found = sets.neighbor_map(sets.adjacency(cells(t, 256.0), "cx", "cy"), "cx", "cy")
    return found.select("cx", "cy", F.col("west.x").alias("west_x"), F.col("east.x").alias("east_x"), F.col("north.y").alias("north_y"), F.col("south.y").alias("south_y"))


DAYS = (
    "d AS (SELECT DISTINCT user_id, (epoch_ms(ts) // 86400000)::BIGINT AS day FROM events), g AS (SELECT *, day - "
    "row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM d), r AS (SELECT user_id, min(day) AS v_min, max(day) "
    "AS v_max FROM g GROUP BY user_id, k)"
)


def days(t):
    return t.events.select("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("day"))


@R.add("g4_run_length_encode", f"WITH {DAYS} SELECT * FROM r")
def g4(t):
    return ranges.run_length_encode(days(t), ["user_id"], "day")


@R.add("g5_run_length_decode", f"WITH {DAYS} SELECT * FROM d")
def g5(t):
    return ranges.run_length_decode(ranges.run_length_encode(days(t), ["user_id"], "day"), ["user_id"], "v_min", "v_max", "day")


@R.add("g6_order_violations", """
    WITH q AS (SELECT l_orderkey AS g, l_linenumber * 10 + l_suppkey % 7 AS lo, l_linenumber * 10 + l_suppkey % 7 + l_partkey % 12 - 1 AS hi, l_linenumber AS k, l_suppkey, l_partkey FROM lineitem),
    s AS (SELECT *, max(hi) OVER (PARTITION BY g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM q),
    v AS (SELECT g, lo, hi, CASE WHEN lo > hi THEN 'reversed' WHEN lo <= b THEN 'overlap' WHEN lo = b + 1 THEN 'adjacent' END AS rule FROM s)
    SELECT rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY rule""")
def g6(t):
    lo = F.col("l_linenumber") * 10 + F.col("l_suppkey") % 7
    rows = t.lineitem.select(F.col("l_orderkey").alias("g"), lo.alias("lo"), (lo + F.col("l_partkey") % 12 - 1).alias("hi"))
    return ranges.order_violations(rows, ["g"], "lo", "hi", adjacent_allowed=False).groupBy("rule").agg(F.count("*").alias("n"))


@R.add("g6_declared_counts",
    f"WITH {DAYS}, h AS (SELECT user_id, sum(v_max - v_min + 1)::BIGINT AS have FROM r GROUP BY user_id) SELECT user_id, "
    "have, have + 1 AS declared FROM h WHERE user_id % 3 = 0")
def g6d(t):
    declared = days(t).distinct().groupBy("user_id").agg((F.count("*") + F.max((F.col("user_id") % 3 == 0).cast("long"))).alias("declared"))
    return ranges.declared_counts(ranges.run_length_encode(days(t), ["user_id"], "day"), ["user_id"], "v_min", "v_max", declared, "declared")


@R.add("g7_modulo_shards", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) % 7)::BIGINT AS shard FROM orders")
def g7(t):
    return ranges.modulo_shards(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 7).select("o_orderkey", "shard")


@R.add("g8_even_sample",
    "WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal, count(*) OVER () AS "
    "n FROM orders) SELECT o_orderkey, ordinal FROM n WHERE ordinal IN (SELECT i * (SELECT count(*) FROM orders) // 100 FROM "
    "range(100) r(i))")
def g8(t):
    return ranges.even_sample(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 100).select("o_orderkey", "ordinal")


@R.add("g12_shards3x3",
    f"WITH {cells_sql(256.0)} SELECT (3 * floor((cx + 1) / 3.0))::BIGINT AS shard_x, (3 * floor((cy + 1) / 3.0))::BIGINT AS "
    "shard_y, count(*) AS n, string_agg(cx || ':' || cy, ' ' ORDER BY cy DESC, cx) AS members FROM c GROUP BY 1, 2")
def g12(t):
    found = ranges.shards3x3(cells(t, 256.0), "cx", "cy")
    return found.withColumn("members", F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["cx"], m["cy"])), " "))


@R.add("c4_threshold_floor",
    "SELECT l_orderkey, l_linenumber, (SELECT max(v) FROM (VALUES (1000.0::DOUBLE), (5000.0), (20000.0), (40000.0)) t(v) "
    "WHERE v <= l_extendedprice) AS floor FROM lineitem")
def c4(t):
    thresholds = t.spark.createDataFrame([(1000.0,), (5000.0,), (20000.0,), (40000.0,)], "v double")
    return ranges.threshold_floor(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", thresholds, "v").select("l_orderkey", "l_linenumber", "floor")


@R.add("c4_as_of",
    "SELECT e.event_id, p.value AS bought FROM events e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE "
    "event_type = 'purchase') p ON p.user_id = e.user_id AND p.ts <= e.ts")
def c4b(t):
    bought = t.events.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("v"))
    return ranges.as_of(t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts", bought, "ts", "v", "bought").select("event_id", "bought")


@R.add("e10_covered",
    f"WITH {DAYS}, q AS (SELECT user_id, (epoch_ms(ts) // 86400000)::BIGINT + event_id % 40 AS v FROM events) SELECT EXISTS "
    "(SELECT 1 FROM r WHERE r.user_id = q.user_id AND q.v BETWEEN v_min AND v_max) AS covered, count(*) AS n FROM q GROUP BY "
    "1")
def e10(t):
    runs = ranges.run_length_encode(days(t), ["user_id"], "day")
    asked = t.events.select("user_id", (F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long") + F.col("event_id") % 40).alias("v"))
    return sets.covered(asked, runs, ["user_id"], "v", "v_min", "v_max").groupBy("covered").agg(F.count("*").alias("n"))


@R.add("e11_parent_topology", TILES + """, t AS (SELECT DISTINCT z, tx, ty FROM q WHERE (z * 7 + tx * 3 + ty) % 11 <> 0), w AS (SELECT DISTINCT z - 1 AS z, tx // 2 AS tx, ty // 2 AS ty FROM t WHERE z > (SELECT min(z) FROM t)),
    m AS (SELECT *, 'missing' AS problem FROM (SELECT * FROM w EXCEPT SELECT * FROM t) UNION ALL SELECT *, 'without_child' FROM (SELECT * FROM t WHERE z < (SELECT max(z) FROM t) EXCEPT SELECT * FROM w))
    SELECT z, tx, ty, problem FROM m""")
def e11(t):
    kept = tiles(t).distinct().where("(z * 7 + tx * 3 + ty) % 11 <> 0")
    return sets.parent_topology(kept, "z", "tx", "ty")


@R.add("f19_topology_summary", TILES + """, t AS (SELECT DISTINCT z, tx, ty FROM q)
    SELECT z, count(*) AS tiles, min(tx) AS min_x, max(tx) AS max_x, min(ty) AS min_y, max(ty) AS max_y,
      (SELECT count(*) FROM t a JOIN t b ON a.z = b.z AND b.tx = a.tx + 1 AND b.ty = a.ty WHERE a.z = t.z) AS east,
      (SELECT count(*) FROM t a JOIN t b ON a.z = b.z AND b.tx = a.tx AND b.ty = a.ty - 1 WHERE a.z = t.z) AS north FROM t GROUP BY z""")
def f19(t):
    return summaries.topology_summary(tiles(t), "tx", "ty", "z")


@R.add("f19_land_topology", """
    WITH c AS (SELECT DISTINCT (o_custkey % 90 - 40)::BIGINT AS x, (o_orderkey % 70 - 30)::BIGINT AS y FROM orders WHERE o_orderkey % 3 <> 1), f AS (SELECT count(*) AS cells, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(DISTINCT (floor((x + 1) / 3), floor((y + 1) / 3))) AS shards FROM c),
    z AS (SELECT unnest(range(0, 5))::INTEGER AS z), t AS (SELECT DISTINCT z, (x - x0) // pow(2, 4 - z)::BIGINT AS tx, (y1 - y) // pow(2, 4 - z)::BIGINT AS ty FROM c, f, z),
    e AS (SELECT a.z, count(*) AS n FROM t a JOIN t b ON a.z = b.z AND b.tx = a.tx + 1 AND b.ty = a.ty GROUP BY a.z), n AS (SELECT a.z, count(*) AS n FROM t a JOIN t b ON a.z = b.z AND b.tx = a.tx AND b.ty = a.ty - 1 GROUP BY a.z),
    x AS (SELECT count(*) AS n FROM c a JOIN c b ON b.x = a.x + 1 AND b.y = a.y OR b.x = a.x AND b.y = a.y + 1 WHERE floor((a.x + 1) / 3) <> floor((b.x + 1) / 3) OR floor((a.y + 1) / 3) <> floor((b.y + 1) / 3))
    SELECT t.z, count(*) AS tiles, coalesce(any_value(e.n), 0) AS east, coalesce(any_value(n.n), 0) AS north, any_value(cells) AS cells, any_value(x0 * 8192) AS min_x, any_value(y0 * 8192) AS min_y, any_value((x1 + 1) * 8192) AS max_x, any_value((y1 + 1) * 8192) AS max_y,
           any_value(x0 * 8192) AS origin_x, any_value((y1 + 1) * 8192) AS origin_y, any_value(shards) AS shards, CASE WHEN t.z = 4 THEN any_value(x.n) END AS cross_shard
    FROM t LEFT JOIN e USING (z) LEFT JOIN n ON n.z = t.z, f, x GROUP BY t.z""")
def f19_land(t):
    cells = t.orders.where("o_orderkey % 3 <> 1").select((F.col("o_custkey") % 90 - 40).alias("x"), (F.col("o_orderkey") % 70 - 30).alias("y"))
    return summaries.land_topology(cells, "x", "y", 4, 8192)


AFTER = (
    "a AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS "
    "o_totalprice, CASE WHEN o_orderkey % 10 = 4 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE "
    "o_orderkey % 10 <> 5 UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE "
    "o_orderkey % 10 = 6)"
)


def after(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    edited = o.where("o_orderkey % 10 <> 5").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 4, "X").otherwise(F.col("o_orderstatus")))
    return edited.unionByName(o.where("o_orderkey % 10 = 6").withColumn("o_orderkey", F.col("o_orderkey") + 10000000))


@R.add("e12_full_compare",
    f"WITH {AFTER} SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'missing' "
    "WHEN b.o_orderkey IS NULL THEN 'extra' WHEN a.o_totalprice <> b.o_totalprice OR a.o_orderstatus <> b.o_orderstatus THEN "
    "'mismatched' ELSE 'same' END AS state FROM orders b FULL JOIN a ON a.o_orderkey = b.o_orderkey")
def e12(t):
    return sets.full_compare(t.orders, after(t), ["o_orderkey"], ["o_totalprice", "o_orderstatus"]).select("o_orderkey", "state")


@R.add("s1_diff_summary",
    f"WITH {AFTER} SELECT CASE WHEN a.o_orderkey IS NULL THEN 'removed' WHEN b.o_orderkey IS NULL THEN 'added' WHEN "
    "a.o_totalprice <> b.o_totalprice OR a.o_orderstatus <> b.o_orderstatus THEN 'changed' ELSE 'unchanged' END AS state, "
    "count(*) AS n FROM orders b FULL JOIN a ON a.o_orderkey = b.o_orderkey GROUP BY 1")
def s1(t):
    return sets.diff_summary(t.orders, after(t), ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@R.add("s2_diff_records", f"""WITH {AFTER}, j AS (SELECT coalesce(b.o_orderkey, a.o_orderkey)::VARCHAR AS key, a.o_orderkey IS NULL AS gone, b.o_orderkey IS NULL AS fresh, a.o_custkey AS ac, b.o_custkey AS bc, a.o_orderstatus AS ast, b.o_orderstatus AS bst FROM orders b FULL JOIN a ON a.o_orderkey = b.o_orderkey)
    SELECT key, CASE WHEN gone THEN 'removed' WHEN fresh THEN 'added' ELSE 'changed' END AS state, CASE WHEN gone OR fresh THEN '' ELSE 'o_orderstatus' END AS fields,
      CASE WHEN NOT fresh THEN sha256('{{"o_custkey":' || bc || ',"o_orderstatus":"' || bst || '"}}') END AS before_hash, CASE WHEN NOT gone THEN sha256('{{"o_custkey":' || ac || ',"o_orderstatus":"' || ast || '"}}') END AS after_hash
    FROM j WHERE gone OR fresh OR ast <> bst""")
def s2(t):
    prefixed = lambda df, p: df.withColumn("key", F.concat(F.lit(p), F.col("o_orderkey").cast("string")))
    return sets.diff_records(prefixed(t.orders, ""), prefixed(after(t), "v2."), "key", "v2.", ["o_orderstatus", "o_custkey"]).withColumn("fields", F.array_join("fields", ","))


@R.add("h1_snapshot_pairs", f"""WITH {AFTER}, b AS (SELECT o_orderkey AS i, o_custkey AS p FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey AS i, o_custkey AS p FROM a WHERE o_orderkey % 3 = 0),
    by_id AS (SELECT b.i AS before_id, n.i AS after_id FROM b JOIN n USING (i)), rb AS (SELECT * FROM b WHERE i NOT IN (SELECT i FROM n)), ra AS (SELECT * FROM n WHERE i NOT IN (SELECT i FROM b)),
    by_p AS (SELECT rb.i AS before_id, ra.i AS after_id FROM rb JOIN ra USING (p) WHERE p IN (SELECT p FROM b GROUP BY p HAVING count(*) = 1) AND p IN (SELECT p FROM n GROUP BY p HAVING count(*) = 1))
    SELECT before_id, after_id, 'id' AS how FROM by_id UNION ALL SELECT *, 'product' FROM by_p UNION ALL SELECT i, NULL, 'removed' FROM rb WHERE i NOT IN (SELECT before_id FROM by_p) UNION ALL SELECT NULL, i, 'added' FROM ra WHERE i NOT IN (SELECT after_id FROM by_p)""")
def h1(t):
    return sets.snapshot_pairs(t.orders.where("o_orderkey % 2 = 0"), after(t).where("o_orderkey % 3 = 0"), "o_orderkey", "o_custkey")


@R.add("h2_used_nodes",
    "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 1 UNION "
    "SELECT l_partkey FROM lineitem WHERE l_quantity = 1)")
def h2(t):
    edges = t.lineitem.where("l_quantity = 1").select("l_suppkey", "l_partkey")
    return sets.used_nodes(edges, ["l_suppkey", "l_partkey"], t.supplier.select("s_suppkey", "s_name"), "s_suppkey")


@R.add("h3_unreachable", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT l_suppkey FROM lineitem)")
def h3(t):
    return sets.pending(t.customer.select("c_custkey"), t.lineitem.select(F.col("l_suppkey").alias("c_custkey")), ["c_custkey"])


@R.add("h4_set_equal",
    "SELECT (SELECT count(*) FROM (SELECT l_partkey FROM lineitem EXCEPT ALL SELECT o_custkey FROM orders)) AS only_a, "
    "(SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT l_partkey FROM lineitem)) AS only_b, false AS "
    "equal")
def h4(t):
    return sets.set_difference_counts(t.lineitem.select(F.col("l_partkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")))


@R.add("h5_ordered_distinct", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def h5(t):
    return sets.ordered_distinct(t.events, ["user_id"], "event_type", "event_id")


@R.add("h6_union_keys", "SELECT l_suppkey AS k FROM lineitem UNION SELECT s_suppkey FROM supplier")
def h6(t):
    return summaries.union_keys(t.lineitem.select("l_suppkey"), t.supplier.select("s_suppkey"))


@R.add("e13_referential_check", """
    WITH r AS (SELECT l_orderkey % 5000 AS id, l_suppkey AS a, l_partkey AS b, l_returnflag AS m FROM lineitem), s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 10 <> 0)
    SELECT rule, count(*) AS n FROM (SELECT 'no_start' AS rule FROM r WHERE a NOT IN (SELECT k FROM s) UNION ALL SELECT 'no_end' FROM r WHERE b NOT IN (SELECT k FROM s) UNION ALL SELECT 'loop' FROM r WHERE a = b UNION ALL SELECT 'mode' FROM r WHERE m NOT IN ('A', 'N') UNION ALL SELECT 'repeated' FROM r GROUP BY id HAVING count(*) > 1) GROUP BY rule""")
def e13(t):
    routes = t.lineitem.select((F.col("l_orderkey") % 5000).alias("id"), F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_returnflag").alias("m"))
    return sets.referential_check(routes, t.supplier.where("s_suppkey % 10 <> 0"), "id", "a", "b", "s_suppkey", "m", ["A", "N"]).groupBy("rule").agg(F.count("*").alias("n"))


@R.add("e14_unknown_keys",
    "WITH k AS (SELECT DISTINCT l_suppkey AS d, l_partkey AS p FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 4 = 0) "
    "SELECT l_suppkey AS d, l_partkey AS p, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT d FROM k) AND (l_suppkey, "
    "l_partkey) NOT IN (SELECT d, p FROM k) GROUP BY ALL")
def e14(t):
    pairs = t.lineitem.select(F.col("l_suppkey").alias("d"), F.col("l_partkey").alias("p"), "l_returnflag")
    return sets.unknown_keys(pairs, pairs.where("l_returnflag = 'A' and d % 4 = 0"), "d", "p").groupBy("d", "p").agg(F.count("*").alias("n"))


@R.add("e19_verify_log", """
    WITH g AS (SELECT event_id AS seq, user_id AS k, md5(event_type) AS h FROM events), d AS (SELECT user_id AS k, md5(arg_max(event_type, event_id)) AS h FROM events WHERE user_id % 4 <> 0 GROUP BY 1),
    s AS (SELECT CASE WHEN row_number() OVER (PARTITION BY g.k ORDER BY seq) > 1 THEN 'duplicate' WHEN d.k IS NULL THEN 'missing' WHEN d.h <> g.h THEN 'differs' ELSE 'verified' END AS state FROM g LEFT JOIN d ON d.k = g.k)
    SELECT state, count(*) AS n FROM s GROUP BY state""")
def e19(t):
    entries = t.events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.md5("event_type").alias("h"))
    decoded = t.events.where("user_id % 4 <> 0").groupBy(F.col("user_id").alias("k")).agg(F.md5(F.max_by("event_type", "event_id")).alias("h"))
    return sets.verify_log(entries, decoded, "k", "h").groupBy("state").agg(F.count("*").alias("n"))


@R.add("e20_hop_audit", """
    WITH u AS (SELECT l_suppkey AS slot, l_orderkey * 10 + l_linenumber AS example FROM lineitem), p AS (SELECT s_suppkey AS slot, s_nationkey::BIGINT AS asset FROM supplier WHERE s_suppkey % 6 <> 0), j AS (SELECT u.slot, example, CASE WHEN p.slot IS NULL THEN 'missing_palette' WHEN asset % 5 = 0 THEN 'missing_asset' END AS reason FROM u LEFT JOIN p USING (slot))
    SELECT reason, slot, count(*) AS n, array_to_string(list_sort(list(example))[1:5], ',') AS examples FROM j WHERE reason IS NOT NULL GROUP BY reason, slot""")
def e20(t):
    usage = t.lineitem.select(F.col("l_suppkey").alias("slot"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("example"))
    palette = t.supplier.where("s_suppkey % 6 <> 0").select(F.col("s_suppkey").alias("slot"), F.col("s_nationkey").cast("long").alias("asset"))
    assets = t.nation.where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").cast("long").alias("asset"))
    return sets.hop_audit(usage, palette, assets, "slot", "asset", "example").withColumn("examples", F.array_join(F.transform("examples", lambda e: e.cast("string")), ","))


@R.add("e23_pending",
    "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey "
    "FROM lineitem WHERE l_linestatus = 'F')")
def e23(t):
    return sets.pending(t.lineitem.select("l_partkey", "l_suppkey").distinct(), t.lineitem.where("l_linestatus = 'F'"), ["l_partkey", "l_suppkey"])


@R.add("e24_positional_slices", """
    WITH i AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS o, l_quantity::BIGINT AS b FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) AS i FROM i),
    c AS (SELECT k, count(*) AS n FROM i GROUP BY k), p AS (SELECT k, 1 AS part, n // 3 AS count FROM c UNION ALL SELECT k, 2, n - n // 3 + (k % 5 = 0)::INT FROM c),
    q AS (SELECT p.*, CASE WHEN part = 1 THEN 0 ELSE (SELECT n // 3 FROM c WHERE c.k = p.k) END AS lo FROM p), g AS (SELECT q.k, part, q.count, count(i.i) AS items FROM q LEFT JOIN n i ON i.k = q.k AND i.i > lo AND i.i <= lo + q.count GROUP BY ALL)
    SELECT k, part::INTEGER AS part, items, items = count AS agrees FROM g""")
def e24(t):
    items = t.lineitem.select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.col("l_quantity").cast("long").alias("b"))
    n = items.groupBy("k").agg(F.count("*").alias("n"))
    third = F.floor(F.col("n") / 3)
    parts = n.select("k", F.lit(1).alias("part"), third.alias("count")).unionByName(n.select("k", F.lit(2).alias("part"), (F.col("n") - third + (F.col("k") % 5 == 0).cast("long")).alias("count")))
    found = sets.positional_slices(items, parts.withColumn("bytes", F.lit(0).cast("long")), "k", "o", "b")
    return found.select("k", "part", F.coalesce("items", F.lit(0)).alias("items"), (F.coalesce("items", F.lit(0)) == F.col("count")).alias("agrees"))


@R.add("s3_assemble_snapshot", """
    WITH p AS (SELECT s_nationkey AS d, count(*) AS n FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS d, c_mktsegment AS k, count(*) AS n FROM customer GROUP BY ALL), m AS (SELECT d, sum(n)::BIGINT AS n, count(*) FILTER (n > 1) AS r FROM c GROUP BY d)
    SELECT coalesce(p.d, m.d) AS d, coalesce(p.n, 0) AS places, 0::BIGINT AS places_repeated, coalesce(m.n, 0) AS names, coalesce(m.r, 0) AS names_repeated, coalesce(p.n, 0) AS tiles, 0::BIGINT AS tiles_repeated FROM p FULL JOIN m ON p.d = m.d""")
def s3(t):
    places = t.supplier.select(F.col("s_nationkey").alias("d"), F.col("s_suppkey").alias("key"))
    names = t.customer.select(F.col("c_nationkey").alias("d"), F.col("c_mktsegment").alias("key"))
    return sets.assemble_snapshot(places, names, places, "d")


@R.add("s4_plan_files",
    "SELECT l_partkey, min(l_quantity) AS l_quantity, min(l_shipdate) AS l_shipdate, count(*) AS referenced, count(DISTINCT "
    "l_quantity || ':' || l_shipdate) > 1 AS conflict FROM lineitem GROUP BY l_partkey")
def s4(t):
    return sets.plan_files(t.lineitem, "l_partkey", "l_quantity", "l_shipdate")


@R.add("s5_checkpoint_progress", """
    WITH c AS (SELECT DISTINCT event_id // 2000 AS ord, user_id, user_id % 7 AS h FROM events), s AS (SELECT *, lag(ord) OVER w AS b, lag(h) OVER w AS bh, lead(ord) OVER w AS nx FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ord)),
    have AS (SELECT ord, count(*) AS have, count(*) FILTER (b IS NULL OR b < ord - 1) AS new, count(*) FILTER (b = ord - 1 AND bh <> h) AS changed FROM s GROUP BY ord), gone AS (SELECT ord + 1 AS ord, count(*) AS lost FROM s WHERE ord < (SELECT max(ord) FROM c) AND (nx IS NULL OR nx > ord + 1) GROUP BY 1)
    SELECT ord, have, new, changed, coalesce(lost, 0) AS lost FROM have LEFT JOIN gone USING (ord)""")
def s5(t):
    chain = t.events.select(F.floor(F.col("event_id") / 2000).alias("ord"), "user_id", (F.col("user_id") % 7).alias("h")).distinct()
    return sets.checkpoint_progress(chain, "ord", "user_id", "h")
