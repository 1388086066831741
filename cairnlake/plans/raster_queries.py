"""Raster and terrain queries: pixels are the embeddings laid on a grid, 8 by 8 pixels to a tile of one vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.operators import gates, raster, summaries
from cairnlake.plans.checkpoints import cut
from cairnlake.plans.registry import Registry

R = Registry()
TILE = 8
PIX = """px AS (SELECT vec_id % 20 AS tx, vec_id // 20 AS ty, (i - 1) % 8 AS px, (i - 1) // 8 AS py,
    least(greatest(floor(v * 400 + 128), 0), 255)::BIGINT AS r, least(greatest(floor(v * 300 + 100), 0), 255)::BIGINT AS g, least(greatest(floor(v * -200 + 90), 0), 255)::BIGINT AS b, CASE WHEN v < -0.2 THEN 0 WHEN v < -0.15 THEN 120 ELSE 255 END::BIGINT AS a
    FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(1, 65)) AS i FROM embeddings WHERE vec_id < 400))""".replace("WHERE vec_id < 400", "")
DOWN = (
    "(SELECT {k}gx // 2 AS gx, gy // 2 AS gy, CASE WHEN sum(a) = 0 THEN 0 ELSE (sum(r * a) + sum(a) // 2) // sum(a) "
    "END::BIGINT AS r, CASE WHEN sum(a) = 0 THEN 0 ELSE (sum(g * a) + sum(a) // 2) // sum(a) END::BIGINT AS g, CASE WHEN "
    "sum(a) = 0 THEN 0 ELSE (sum(b * a) + sum(a) // 2) // sum(a) END::BIGINT AS b, ((sum(a) + 2) // 4)::BIGINT AS a FROM {t} "
    "GROUP BY ALL)"
)
BIN = "(SELECT gx, gy, r, g, b, CASE WHEN a <> 0 THEN 255 ELSE 0 END::BIGINT AS a FROM {t})"
GLOBAL = "gp AS (SELECT tx * 8 + px AS gx, ty * 8 + py AS gy, r, g, b, a FROM px)"


def pixels(t):
    v = F.col("v").cast("double")
    byte = lambda k, o: F.least(F.greatest(F.floor(v * k + o), F.lit(0)), F.lit(255)).cast("long")
    rows = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "v"))
    alpha = F.when(v < -0.2, 0).when(v < -0.15, 120).otherwise(255).cast("long")
    return rows.select((F.col("vec_id") % 20).alias("tx"), F.floor(F.col("vec_id") / 20).alias("ty"), (F.col("i") % 8).cast("long").alias("px"), F.floor(F.col("i") / 8).alias("py"), byte(400, 128).alias("r"), byte(300, 100).alias("g"), byte(-200, 90).alias("b"), alpha.alias("a"))


@R.add("r1_downsample2", f"WITH {PIX}, {GLOBAL} SELECT gx AS px, gy AS py, r, g, b, a FROM {DOWN.format(k='', t='gp')}")
def r1(t):
    return raster.downsample2(raster.global_pixels(pixels(t), TILE), [])


PARENT = "SELECT gx // 8 AS tx, gy // 8 AS ty, gx % 8 AS px, gy % 8 AS py, r, g, b, a FROM "


@R.add("r2_compose_parent", f"WITH {PIX}, {GLOBAL} {PARENT} {BIN.format(t=DOWN.format(k='', t='gp'))}")
def r2(t):
    return raster.compose_parent(pixels(t), TILE)


L1, L2 = "l1 AS " + BIN.format(t=DOWN.format(k="", t="gp")), "l2 AS " + BIN.format(t=DOWN.format(k="", t="l1"))
PYRAMID = f"WITH {PIX}, {GLOBAL}, {L1}, {L2}, pyr AS (SELECT 2 AS z, * FROM gp UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 0, * FROM l2)"


@R.add("r3_build_pyramid", PYRAMID +
    " SELECT z::INTEGER AS z, count(*) AS pixels, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(a)::BIGINT AS a, "
    "count(DISTINCT (gx // 8, gy // 8)) AS tiles FROM pyr GROUP BY z")
def r3(t):
    rows = raster.build_pyramid(pixels(t), TILE, 2)
    return rows.groupBy("z").agg(F.count("*").alias("pixels"), F.sum("r").alias("r"), F.sum("g").alias("g"), F.sum("a").alias("a"), F.count_distinct("tx", "ty").alias("tiles"))


@R.add("r4_binary_alpha", f"WITH {PIX} SELECT tx, ty, px, py, CASE WHEN a <> 0 THEN 255 ELSE 0 END::BIGINT AS a FROM px")
def r4(t):
    return raster.binary_alpha(pixels(t)).select("tx", "ty", "px", "py", "a")


PRE = "pm AS (SELECT tx, ty, px, py, (r * a + 127) // 255 AS r, (g * a + 127) // 255 AS g, (b * a + 127) // 255 AS b, a FROM px)"


@R.add("r5_premultiply", f"WITH {PIX}, {PRE} SELECT * FROM pm")
def r5(t):
    return raster.premultiply(pixels(t))


GRADED = "SELECT tx, ty, px, py, " + ", ".join(f"least(greatest(128 + floor((lum + floor(({c} - lum) * 320 / 256) - 128) * 280 / 256) + 5, 0), 255)::BIGINT AS {c}" for c in "rgb") + ", a FROM (SELECT *, floor((r * 54 + g * 183 + b * 19) / 256) AS lum FROM px)"


@R.add("r6_grade", f"WITH {PIX} {GRADED}")
def r6(t):
    return raster.grade(pixels(t), 320, 280, 5)


@R.add("r7_blend",
    f"WITH {PIX}, j AS (SELECT p.*, q.r AS qr, q.g AS qg, q.b AS qb, q.a AS qa FROM px p JOIN px q ON q.tx = p.tx + 1 AND "
    "q.ty = p.ty AND q.px = 7 - p.px AND q.py = p.py) SELECT tx, ty, px, py, CASE WHEN r = qr AND g = qg AND b = qb AND a = "
    "qa THEN r WHEN a * 2 + qa = 0 THEN 0 ELSE (r * a * 2 + qr * qa + (a * 2 + qa) // 2) // (a * 2 + qa) END::BIGINT AS r, "
    "CASE WHEN r = qr AND g = qg AND b = qb AND a = qa THEN a ELSE (a * 2 + qa + 1) // 3 END::BIGINT AS a FROM j")
def r7(t):
    p = pixels(t)
    q = p.select((F.col("tx") - 1).alias("tx"), "ty", (7 - F.col("px")).alias("px"), "py", *[F.col(c).alias(f"q{c}") for c in "rgba"])
    mixed = raster.blend({c: F.col(c) for c in "rgba"}, {c: F.col(f"q{c}") for c in "rgba"})
    return p.join(q, ["tx", "ty", "px", "py"]).select("tx", "ty", "px", "py", mixed["r"].alias("r"), mixed["a"].alias("a"))


def _step(src, out, t, at):
    other = "ty = s.ty AND q.{p} = 7 - s.{p} AND q.{o} = s.{o}".format(p="px" if t == "tx" else "py", o="py" if t == "tx" else "px")
    other = ("q.tx = s.tx + CASE WHEN s.px = 0 THEN -1 ELSE 1 END AND q." + other) if t == "tx" else ("q.tx = s.tx AND q.ty = s.ty + CASE WHEN s.py = 0 THEN -1 ELSE 1 END AND q.py = 7 - s.py AND q.px = s.px")
    same, total = "r = qr AND g = qg AND b = qb AND a = qa", "(a * 2 + qa)"
    mix = ", ".join(
        f"CASE WHEN qa IS NULL OR ({same}) THEN {c} WHEN {total} = 0 THEN 0 ELSE ({c} * a * 2 + q{c} * qa + {total} // 2) // "
        f"{total} END::BIGINT AS {c}" for c in "rgb")
    return (
        f"{out} AS (SELECT tx, ty, px, py, {mix}, CASE WHEN qa IS NULL OR ({same}) THEN a ELSE (a * 2 + qa + 1) // 3 END::BIGINT "
        f"AS a FROM (SELECT s.*, q.r AS qr, q.g AS qg, q.b AS qb, q.a AS qa FROM {src} s LEFT JOIN {src} q ON s.{at} IN (0, 7) "
        f"AND {other} AND floor((s.{t} + 1) / 3) <> floor((q.{t} + 1) / 3)))"
    )


@R.add("r8_stabilize_borders",
    f"WITH {PIX}, {_step('px', 'sx', 'tx', 'px')}, {_step('sx', 'sy', 'ty', 'py')} SELECT tx, ty, px, py, r, g, b, CASE WHEN "
    "a <> 0 THEN 255 ELSE 0 END::BIGINT AS a FROM sy")
def r8(t):
    return raster.stabilize_borders(pixels(t), TILE)


@R.add("r9_edge_rows",
    f"WITH {PIX}, e AS (SELECT *, 'west' AS side, px AS depth FROM px WHERE px IN (0, 1) UNION ALL SELECT *, 'east', 7 - px "
    "FROM px WHERE px IN (7, 6) UNION ALL SELECT *, 'north', py FROM px WHERE py IN (0, 1) UNION ALL SELECT *, 'south', 7 - "
    "py FROM px WHERE py IN (7, 6)) SELECT tx, ty, side, depth::INTEGER AS depth, count(*) AS n, sum(r)::BIGINT AS r FROM e "
    "GROUP BY ALL")
def r9(t):
    return raster.edge_rows(pixels(t), TILE).groupBy("tx", "ty", "side", "depth").agg(F.count("*").alias("n"), F.sum("r").alias("r"))


@R.add("r10_verify_pyramid", PYRAMID +
    " SELECT 1::INTEGER AS z, gx // 8 AS tx, gy // 8 AS ty, count(*) AS differing FROM l1 WHERE (gx + gy) % 50 = 0 GROUP BY "
    "ALL")
def r10(t):
    built = raster.build_pyramid(pixels(t), TILE, 2)
    broken = (F.col("z") == 1) & ((F.col("tx") * 8 + F.col("px") + F.col("ty") * 8 + F.col("py")) % 50 == 0)
    found = raster.verify_pyramid(built.withColumn("r", F.when(broken, F.col("r") + 1000).otherwise(F.col("r"))), TILE)
    return found.where("z = 1")


SEAM = f"""WITH {PIX}, {PRE}, w AS (SELECT a.tx, a.ty, 'east' AS side, a.py AS along, a.r AS ar, a.g AS ag, a.b AS ab, a.a AS aa, i.r AS ir, i.g AS ig, i.b AS ib, i.a AS ia, b.r AS br, b.g AS bg, b.b AS bb, b.a AS ba, j.r AS jr, j.g AS jg, j.b AS jb, j.a AS ja
      FROM pm a JOIN pm i ON i.tx = a.tx AND i.ty = a.ty AND i.px = 6 AND i.py = a.py JOIN pm b ON b.tx = a.tx + 1 AND b.ty = a.ty AND b.px = 0 AND b.py = a.py JOIN pm j ON j.tx = b.tx AND j.ty = b.ty AND j.px = 1 AND j.py = b.py WHERE a.px = 7
    UNION ALL SELECT a.tx, a.ty, 'north', a.px, a.r, a.g, a.b, a.a, i.r, i.g, i.b, i.a, b.r, b.g, b.b, b.a, j.r, j.g, j.b, j.a
      FROM pm a JOIN pm i ON i.tx = a.tx AND i.ty = a.ty AND i.py = 1 AND i.px = a.px JOIN pm b ON b.tx = a.tx AND b.ty = a.ty - 1 AND b.py = 7 AND b.px = a.px JOIN pm j ON j.tx = b.tx AND j.ty = b.ty AND j.py = 6 AND j.px = b.px WHERE a.py = 0),
    d AS (SELECT tx, ty, side, [abs(ar - br), abs(ag - bg), abs(ab - bb), abs(aa - ba)] AS e, [greatest(abs(ar - ir), abs(br - jr)), greatest(abs(ag - ig), abs(bg - jg)), greatest(abs(ab - ib), abs(bb - jb)), greatest(abs(aa - ia), abs(ba - ja))] AS l, (aa = 0) <> (ba = 0) AS u FROM w),
    y AS (SELECT *, [greatest(e[1] - l[1], 0), greatest(e[2] - l[2], 0), greatest(e[3] - l[3], 0), greatest(e[4] - l[4], 0)] AS x FROM d),
    m AS (SELECT tx, ty, side, list_sum(e) / 4 AS m, list_sum(l) / 4 AS l, list_sum(x) / 4 AS x, list_max(x) AS top, u FROM y),
    k AS (SELECT *, row_number() OVER (PARTITION BY tx, ty, side ORDER BY top) AS rn, count(*) OVER (PARTITION BY tx, ty, side) AS n FROM m),
    v AS (SELECT tx, ty, side, count(*) AS pixels, round(avg(m), 9) AS mean, round(avg(l), 9) AS local, round(avg(x), 9) AS excess, round(avg((top > 32)::INT), 9) AS hard_share,
                 max(top) FILTER (rn = ceil(0.95 * n))::BIGINT AS p95, max(top) FILTER (rn = ceil(0.99 * n))::BIGINT AS p99, max(top)::BIGINT AS top, count(*) FILTER (u) AS unmatched_alpha
          FROM k GROUP BY ALL),
    s AS (SELECT *, excess > 8 OR hard_share > 0.1 AS flagged FROM v)"""


@R.add("f10_seam_metrics", SEAM + " SELECT * FROM s")
def f10(t):
    return raster.seam_metrics(pixels(t), TILE)


POP = SEAM + """, q AS (SELECT *, CASE WHEN floor((tx + 1) / 3) = floor((CASE side WHEN 'east' THEN tx + 1 ELSE tx END + 1) / 3) AND floor((ty + 1) / 3) = floor((CASE side WHEN 'north' THEN ty - 1 ELSE ty END + 1) / 3) THEN 'same' ELSE 'cross' END AS population FROM s),
    z AS (SELECT *, row_number() OVER (PARTITION BY population ORDER BY excess) AS rn, count(*) OVER (PARTITION BY population) AS c FROM q),
    o AS (SELECT population, round(avg(excess), 9) AS mean, max(excess) FILTER (rn = ceil(0.95 * c)) AS p95, round(max(excess), 9) AS top, round(avg(flagged::INT), 9) AS share FROM z GROUP BY population),
    broken AS (SELECT tx || ',' || ty || ',' || side AS id FROM q WHERE population = 'cross' AND (excess > 8 OR p99 > 8 OR top > 32 OR hard_share > 0.01)),
    told AS (SELECT 'absolute_mean' AS condition, population, mean::DOUBLE AS value, 4.0::DOUBLE AS "limit" FROM o UNION ALL SELECT 'absolute_p95', population, p95, 8 FROM o UNION ALL SELECT 'absolute_top', population, top, 32 FROM o
             UNION ALL SELECT 'absolute_flagged_share', population, share, 0.01 FROM o
             UNION ALL SELECT 'relative_mean', 'cross', a.mean, b.mean + 0.5 FROM o a, o b WHERE a.population = 'cross' AND b.population = 'same'
             UNION ALL SELECT 'relative_p95', 'cross', a.p95, b.p95 + 2 FROM o a, o b WHERE a.population = 'cross' AND b.population = 'same'
             UNION ALL SELECT 'structural_failures', 'cross', count(*), 0 FROM broken)"""


def seams(t):
    """The metrics of all pairs, and whether a pair lies across shards."""
    from cairnlake.functions.grid import shard_center

    nx, ny = F.col("tx") + (F.col("side") == "east").cast("int"), F.col("ty") - (F.col("side") == "north").cast("int")
    same = (shard_center(F.col("tx")) == shard_center(nx)) & (shard_center(F.col("ty")) == shard_center(ny))
    return cut(raster.seam_metrics(pixels(t), TILE)), ~same


@R.add("f12_population_gate", POP + ' SELECT condition, population, value, "limit", value <= "limit" AS passed FROM told')
def f12(t):
    return gates.population_gate(*seams(t))


@R.add("r11_seam_audit", POP + """
    SELECT bool_and(value <= "limit") AS passes, array_to_string(list_sort(list(DISTINCT condition) FILTER (value > "limit")), ';') AS failed,
           (SELECT count(*) FROM q) AS pairs, (SELECT count(*) FROM q WHERE population = 'same') AS same, (SELECT count(*) FROM q WHERE population = 'cross') AS cross, (SELECT count(*) FROM q WHERE flagged) AS flagged,
           (SELECT count(*) FROM broken) AS structural_failures, (SELECT string_agg(id, ';' ORDER BY id) FROM (SELECT id FROM broken ORDER BY id LIMIT 20)) AS failure_ids
    FROM told""")
def r11(t):
    found = gates.seam_audit(*seams(t), F.concat_ws(",", "tx", "ty", "side"))
    return found.withColumns({c: F.array_join(c, ";") for c in ("failed", "failure_ids")})


@R.add("f11_nearest_rank",
    "WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER "
    "(PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (rn = ceil(0.95 * n)) AS p95, "
    "max(value) FILTER (rn = ceil(0.5 * n)) AS p50 FROM k GROUP BY 1")
def f11(t):
    return summaries.nearest_rank_percentile(t.events, ["event_type"], "value", {"p95": 0.95, "p50": 0.5})


ALPHA = (
    "SELECT tx, ty, count(*) FILTER (a = 0) AS transparent, count(*) FILTER (a <> 0) AS nonzero, count(*) FILTER (a = 255) "
    "AS opaque, count(*) FILTER (a > 0 AND a < 255) AS intermediate FROM px GROUP BY ALL"
)


@R.add("f13_alpha_stats", f"WITH {PIX} {ALPHA}")
def f13(t):
    return raster.alpha_stats(pixels(t), ["tx", "ty"])


@R.add("f14_binary_gate",
    f"WITH {PIX}, s AS ({ALPHA}) SELECT count(*) AS tiles, count(*) FILTER (intermediate > 0) AS failing, sum(opaque)::BIGINT "
    "AS opaque, sum(intermediate) = 0 AS passed FROM s")
def f14(t):
    return summaries.binary_gate(raster.alpha_stats(pixels(t), ["tx", "ty"]))


DIFF = (
    "j AS (SELECT p.tx, p.ty, p.px, p.py, [abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b), abs(p.a - q.a)] AS d FROM {a} p "
    "JOIN {b} q ON p.tx = q.tx AND p.ty = q.ty AND p.px = q.px AND p.py = q.py)"
)
DIFFSUM = (
    " SELECT count(*) AS pixels, count(*) FILTER (list_max(d) > 0) AS differing, round(avg(list_sum(d) / 4), 6) AS mean, "
    "max(list_max(d))::BIGINT AS top, count(*) FILTER (list_max(d) > 32) AS hard, 0::BIGINT AS unpaired FROM j"
)


@R.add("f15_pixel_difference", f"WITH {PIX}, gr AS ({GRADED}), {DIFF.format(a='px', b='gr')} {DIFFSUM}")
def f15(t):
    return raster.pixel_difference(pixels(t), raster.grade(pixels(t), 320, 280, 5), ["tx", "ty", "px", "py"])


VISUAL = """, pa AS (SELECT tx, ty, px, py, (r * a + 127) // 255 AS r, (g * a + 127) // 255 AS g, (b * a + 127) // 255 AS b, a FROM px), pb AS (SELECT tx, ty, px, py, (r * a + 127) // 255 AS r, (g * a + 127) // 255 AS g, (b * a + 127) // 255 AS b, a FROM {other}),
    j AS (SELECT tx, ty, px, py, [abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b), abs(p.a - q.a)] AS d, p.a <> q.a AS alpha, p.a = 255 AND q.a = 255 AS solid, {inside} AS inside FROM pa p JOIN pb q USING (tx, ty, px, py)),
    i AS (SELECT *, list_max(d) AS m, list_sum(d) AS s, row_number() OVER (PARTITION BY tx, ty ORDER BY list_max(d)) AS rn, count(*) OVER (PARTITION BY tx, ty) AS n FROM j WHERE inside),
    h AS (SELECT tx, ty, px, py, row_number() OVER (ORDER BY tx, ty, px, py) AS id FROM i WHERE m > {hard}), e AS (SELECT a.id AS u, b.id AS v FROM h a JOIN h b ON a.tx = b.tx AND a.ty = b.ty AND abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1),
    w AS (SELECT id, id AS seen FROM h UNION SELECT w.id, e.v FROM w JOIN e ON e.u = w.seen), c AS (SELECT tx, ty, g, count(*) AS size FROM (SELECT id, min(seen) AS g FROM w GROUP BY id) JOIN h USING (id) GROUP BY ALL),
    vd AS (SELECT t.tx, t.ty, t.pixels, t.compared, t.pixels - t.compared AS ignored, 0::BIGINT AS unpaired, coalesce(f.differing, 0) AS differing, round(coalesce(f.differing, 0) / greatest(t.compared, 1), 9) AS differing_share,
                  coalesce(f.alpha, 0) AS alpha_differing, round(coalesce(f.alpha, 0) / greatest(t.compared, 1), 9) AS alpha_share, coalesce(f.opaque, 0) AS opaque_differing, round(coalesce(f.s, 0) / (4 * greatest(t.compared, 1)), 9) AS mean,
                  coalesce(f.p99, 0) AS p99, coalesce(f.hard, 0) AS hard, round(coalesce(f.hard, 0) / greatest(t.compared, 1), 9) AS hard_share, coalesce(f.top, 0) AS top, coalesce(f.top_opaque, 0) AS top_opaque, coalesce(g.components, 0) AS components, coalesce(g.largest, 0) AS largest
           FROM (SELECT tx, ty, count(*) AS pixels, count(*) FILTER (inside) AS compared FROM j GROUP BY ALL) t
           LEFT JOIN (SELECT tx, ty, count(*) FILTER (m > 0) AS differing, count(*) FILTER (alpha) AS alpha, count(*) FILTER (m > 0 AND solid) AS opaque, sum(s)::DOUBLE AS s, max(m) FILTER (rn = ceil(0.99 * n))::BIGINT AS p99, count(*) FILTER (m > {hard}) AS hard, max(m)::BIGINT AS top, max(m) FILTER (m > 0 AND solid)::BIGINT AS top_opaque FROM i GROUP BY ALL) f USING (tx, ty)
           LEFT JOIN (SELECT tx, ty, count(*) AS components, max(size) AS largest FROM c GROUP BY ALL) g USING (tx, ty))"""


@R.add("f16_visual_difference", f"WITH RECURSIVE {PIX}, gr AS ({GRADED})" + VISUAL.format(other="gr", inside="px > 0 AND py < 7", hard=32) + " SELECT * FROM vd")
def f16(t):
    return raster.visual_difference(pixels(t), raster.grade(pixels(t), 320, 280, 5), ["tx", "ty"], TILE, 32, ("west", "south"))


AGAIN = "ag AS (SELECT tx, ty, px, py, CASE WHEN (tx + ty) % 3 = 0 THEN least(r + px // 7 * 60, 255) ELSE r END AS r, CASE WHEN (tx + ty) % 3 = 1 AND py = 7 THEN least(g + 1, 255) ELSE g END AS g, b, a FROM px)"


@R.add("f17_repeat_gate", f"WITH RECURSIVE {PIX}, {AGAIN}" + VISUAL.format(other="ag", inside="true", hard=8) + """
    , told AS (SELECT tx, ty, unnest(['differing_share', 'alpha_share', 'mean', 'p99', 'hard_share', 'top_opaque', 'largest']) AS condition, unnest([differing_share, alpha_share, mean, p99, hard_share, top_opaque, largest]::DOUBLE[]) AS value,
                      unnest([0.03, 0.02, 0.1, 8, 0.01, 48, 16]::DOUBLE[]) AS "limit" FROM vd)
    SELECT *, value <= "limit" AS passed FROM told""")
def f17(t):
    """A second rendering of which a third of the tiles differs much in one column and a third by one level in one row."""
    turn = (F.col("tx") + F.col("ty")) % 3
    brighter = F.least(F.col("r") + F.floor(F.col("px") / 7) * 60, F.lit(255))
    again = pixels(t).withColumns({"r": F.when(turn == 0, brighter).otherwise(F.col("r")).cast("long"), "g": F.when((turn == 1) & (F.col("py") == 7), F.least(F.col("g") + 1, F.lit(255))).otherwise(F.col("g")).cast("long")})
    return gates.repeat_gate(raster.visual_difference(pixels(t), again, ["tx", "ty"], TILE, gates.REPEAT_HARD_DELTA), ["tx", "ty"])


@R.add("f18_overlap_compare",
    f"WITH {PIX}, "
    f"{DIFF.format(a='(SELECT * FROM px WHERE px >= 6)', b='(SELECT tx - 1 AS tx, ty, px + 6 AS px, py, r, g, b, a FROM px WHERE px < 2)')} "
    f"{DIFFSUM}")
def f18(t):
    return summaries.overlap_compare(pixels(t), 8, 2)


@R.add("f9_hard_components",
    f"WITH RECURSIVE {PIX}, gr AS ({GRADED}), {DIFF.format(a='px', b='gr')}, h AS (SELECT ty * 20 + tx AS tile, px, py, "
    "row_number() OVER (ORDER BY ty * 20 + tx, px, py) AS id FROM j WHERE list_max(d) > 32), e AS (SELECT a.id AS u, b.id AS "
    "v FROM h a JOIN h b ON a.tile = b.tile AND abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1), w AS (SELECT id, id AS "
    "seen FROM h UNION SELECT w.id, e.v FROM w JOIN e ON e.u = w.seen), k AS (SELECT id, min(seen) AS a FROM w GROUP BY id), "
    "s AS (SELECT tile, a, count(*) AS n FROM k JOIN h USING (id) GROUP BY ALL) SELECT tile, count(*) AS components, max(n) "
    "AS largest FROM s GROUP BY tile")
def f9h(t):
    flat = lambda p: p.withColumn("tile", F.col("ty") * 20 + F.col("tx")).drop("tx", "ty")
    return raster.hard_components(flat(pixels(t)), flat(raster.grade(pixels(t), 320, 280, 5)), "tile")


VERT = (
    "v AS (SELECT vec_id % 20 AS gx, vec_id // 20 AS gy, (i - 1) // 8 AS \"row\", (i - 1) % 8 AS col, floor(v * 100)::DOUBLE "
    "AS value FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(1, 65)) AS i FROM embeddings))"
)


def vertices(t):
    rows = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return rows.select((F.col("vec_id") % 20).alias("gx"), F.floor(F.col("vec_id") / 20).alias("gy"), F.floor(F.col("i") / 8).alias("row"), (F.col("i") % 8).cast("long").alias("col"), F.floor(F.col("v").cast("double") * 100).cast("double").alias("value"))


@R.add("d15_decode_deltas",
    f"WITH {VERT}, f AS (SELECT gx, gy, \"row\", sum(value) OVER (PARTITION BY gx, gy ORDER BY \"row\") + 10 AS first FROM v "
    "WHERE col = 0) SELECT gx, gy, \"row\", col, (first + sum(CASE WHEN col > 0 THEN value ELSE 0 END) OVER (PARTITION BY "
    "gx, gy, \"row\" ORDER BY col)) * 8 AS height FROM v JOIN f USING (gx, gy, \"row\")")
def d15(t):
    rows = vertices(t).withColumnRenamed("value", "delta").withColumn("base", F.lit(10.0))
    return raster.decode_deltas(rows, ["gx", "gy"], "base").select("gx", "gy", "row", "col", "height")


@R.add("d16_deblock",
    "SELECT event_id, (event_id % 256 // 64 * 4 + event_id % 16 // 4)::BIGINT AS \"row\", (event_id % 256 // 16 % 4 * 4 + "
    "event_id % 4)::BIGINT AS col FROM events")
def d16(t):
    return raster.deblock(t.events.select("event_id", (F.col("event_id") % 256).alias("i")), "i").select("event_id", "row", "col")


SAMPLE = (
    "q AS (SELECT event_id AS id, (event_id % 97) * 2.5 AS x, (value % 37) * 6.25 AS y FROM events), c AS (SELECT id, "
    "floor(x / 10)::BIGINT AS gx, floor(y / 10)::BIGINT AS gy, (x - floor(x / 10) * 10) * 7 / 10 AS u, (y - floor(y / 10) * "
    "10) * 7 / 10 AS w FROM q), k AS (SELECT *, least(floor(u), 6)::BIGINT AS ci, least(floor(w), 6)::BIGINT AS ri FROM c)"
)


def sample_points(t):
    return t.events.select(F.col("event_id").alias("id"), ((F.col("event_id") % 97) * 2.5).alias("x"), (F.floor(F.col("value")) % 37 * 6.25).alias("y"))


@R.add("d17_bilinear_sample",
    f"WITH {VERT}, {SAMPLE.replace('(value % 37)', '(floor(value) % 37)')}, e AS (SELECT id, gx, gy, ri + i AS \"row\", ci + "
    "j AS col, (CASE i WHEN 1 THEN w - ri ELSE 1 - (w - ri) END) * (CASE j WHEN 1 THEN u - ci ELSE 1 - (u - ci) END) AS wt "
    "FROM k, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) SELECT id, round(sum(coalesce(value, 0) * wt), 3) AS value FROM "
    "e LEFT JOIN v USING (gx, gy, \"row\", col) GROUP BY id")
def d17(t):
    return raster.bilinear_sample(sample_points(t), vertices(t), "id", 10.0, 7).withColumn("value", F.round("value", 3))


@R.add("d18_slot_weights",
    "WITH s AS (SELECT s_suppkey % 40 AS sx, s_suppkey // 40 AS sy, s_nationkey AS slot FROM supplier QUALIFY row_number() "
    "OVER (PARTITION BY s_suppkey % 40, s_suppkey // 40 ORDER BY s_suppkey) = 1), "
    f"{SAMPLE.replace('(value % 37)', '(floor(value) % 37)')}, g AS (SELECT id, x / 2.5 - 0.5 AS u, y / 2.5 - 0.5 AS w FROM "
    "q), e AS (SELECT id, floor(u)::BIGINT + i AS sx, floor(w)::BIGINT + j AS sy, (CASE i WHEN 1 THEN u - floor(u) ELSE 1 - "
    "(u - floor(u)) END) * (CASE j WHEN 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) AS wt FROM g, (VALUES (0), (1)) "
    "a(i), (VALUES (0), (1)) b(j)) SELECT id, slot, round(sum(wt), 3) AS weight FROM e LEFT JOIN s USING (sx, sy) WHERE wt > "
    "0 GROUP BY id, slot")
def d18(t):
    slots = t.supplier.select((F.col("s_suppkey") % 40).alias("sx"), F.floor(F.col("s_suppkey") / 40).alias("sy"), F.col("s_nationkey").alias("slot"))
    return raster.slot_weights(sample_points(t), slots, "id", 10.0, 4).withColumn("weight", F.round("weight", 3))


MOVED = (
    "q AS (SELECT event_id AS id, i, (event_id % 97) * 2.5 + dx AS x, (floor(value) % 37) * 6.25 + dy AS y FROM events, "
    "(VALUES (0, 1.0, 0.0), (1, -1.0, 0.0), (2, 0.0, 1.0), (3, 0.0, -1.0)) m(i, dx, dy)), c AS (SELECT id, i, floor(x / "
    "10)::BIGINT AS gx, floor(y / 10)::BIGINT AS gy, (x - floor(x / 10) * 10) * 7 / 10 AS u, (y - floor(y / 10) * 10) * 7 / "
    "10 AS w FROM q), k AS (SELECT *, least(floor(u), 6)::BIGINT AS ci, least(floor(w), 6)::BIGINT AS ri FROM c)"
)


@R.add("d19_surface_normal", f"""WITH {VERT}, {MOVED}, e AS (SELECT id, k.i AS s, gx, gy, ri + a.i AS "row", ci + b.j AS col, (CASE a.i WHEN 1 THEN w - ri ELSE 1 - (w - ri) END) * (CASE b.j WHEN 1 THEN u - ci ELSE 1 - (u - ci) END) AS wt FROM k, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
    h AS (SELECT id, s, round(sum(coalesce(value, 0) * wt), 6) AS h FROM e LEFT JOIN v USING (gx, gy, "row", col) GROUP BY id, s),
    d AS (SELECT id, (max(h) FILTER (s = 0) - max(h) FILTER (s = 1)) / 2 AS dx, (max(h) FILTER (s = 2) - max(h) FILTER (s = 3)) / 2 AS dy FROM h GROUP BY id)
    SELECT id, round(-dx / sqrt(dx * dx + dy * dy + 1), 6) + 0.0 AS nx, round(-dy / sqrt(dx * dx + dy * dy + 1), 6) + 0.0 AS ny, round(1 / sqrt(dx * dx + dy * dy + 1), 6) AS nz FROM d""")
def d19(t):
    n = raster.surface_normal(sample_points(t), vertices(t), "id", 10.0, 1.0, 7)
    return n.select("id", *[(F.col(c) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


@R.add("e22_edge_vertex_compare",
    f"WITH {VERT} SELECT a.gx, a.gy, max(abs(a.value - b.value)) AS delta, count(*) AS shared, 'east' AS side FROM v a JOIN v "
    "b ON b.gx = a.gx + 1 AND b.gy = a.gy AND b.\"row\" = a.\"row\" WHERE a.col = 7 AND b.col = 0 GROUP BY a.gx, a.gy UNION "
    "ALL SELECT a.gx, a.gy, max(abs(a.value - b.value)), count(*), 'north' FROM v a JOIN v b ON b.gx = a.gx AND b.gy = a.gy "
    "+ 1 AND b.col = a.col WHERE a.\"row\" = 7 AND b.\"row\" = 0 GROUP BY a.gx, a.gy")
def e22(t):
    return raster.edge_vertex_compare(vertices(t), 7)
