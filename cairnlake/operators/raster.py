"""Raster and terrain operators over pixel and vertex rows. Everything is integer or double column arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.plans.checkpoints import cut

CHANNELS = ("r", "g", "b")


def downsample2(pixels: DataFrame, keys: list[str], px: str = "px", py: str = "py") -> DataFrame:
    """2 by 2 alpha-weighted means in whole numbers: (sum of c*a + half the alphas) // alphas; alpha (sum + 2) // 4."""
    a = F.col("a").cast("long")
    sums = pixels.groupBy(*keys, F.floor(F.col(px) / 2).alias(px), F.floor(F.col(py) / 2).alias(py)).agg(F.sum(a).alias("_a"), *[F.sum(F.col(c) * a).alias(f"_{c}") for c in CHANNELS])
    mean = lambda c: F.when(F.col("_a") == 0, 0).otherwise(F.floor((F.col(f"_{c}") + F.floor(F.col("_a") / 2)) / F.when(F.col("_a") != 0, F.col("_a"))))
    return sums.select(*keys, px, py, *[mean(c).cast("long").alias(c) for c in CHANNELS], F.floor((F.col("_a") + 2) / 4).cast("long").alias("a"))


def binary_alpha(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("a", F.when(F.col("a") != 0, 255).otherwise(0).cast("long"))


def premultiply(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({c: F.floor((F.col(c) * F.col("a") + 127) / 255).cast("long") for c in CHANNELS})


def global_pixels(pixels: DataFrame, tile: int) -> DataFrame:
    """Pixels by their place in the whole zoom level, so that quadrants of parents fall out of the arithmetic."""
    return pixels.withColumn("px", F.col("tx") * tile + F.col("px")).withColumn("py", F.col("ty") * tile + F.col("py")).drop("tx", "ty")


def tiled(pixels: DataFrame, tile: int) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / tile).cast("long")
    return pixels.withColumn("tx", at("px")).withColumn("ty", at("py")).withColumn("px", (F.col("px") % tile).cast("long")).withColumn("py", (F.col("py") % tile).cast("long"))


def compose_parent(pixels: DataFrame, tile: int) -> DataFrame:
    """Parents of the tiles of one level: up to four children in their quadrants, holes transparent, alpha made binary."""
    return binary_alpha(tiled(downsample2(global_pixels(pixels, tile), []), tile))


def build_pyramid(pixels: DataFrame, tile: int, zoom: int) -> DataFrame:
    """All levels from zoom down to 0 with their z. At most a few levels; each is cut off so that none is worked out twice."""
    level = pixels
    out = level.withColumn("z", F.lit(zoom))
    for z in range(zoom - 1, -1, -1):
        level = cut(compose_parent(level, tile))
        out = out.unionByName(level.withColumn("z", F.lit(z)))
    return out


def grade(pixels: DataFrame, saturation: int, contrast: int, brightness: int) -> DataFrame:
    """Integer colour grading in 256ths: luminance 54/183/19, saturation, contrast about 128, brightness, clamped to bytes."""
    lum = F.floor((F.col("r") * 54 + F.col("g") * 183 + F.col("b") * 19) / 256)
    def one(c):
        s = lum + F.floor((F.col(c) - lum) * saturation / 256)
        k = F.lit(128) + F.floor((s - 128) * contrast / 256) + brightness
        return F.least(F.greatest(k, F.lit(0)), F.lit(255)).cast("long")

    return pixels.withColumns({c: one(c) for c in CHANNELS})


def blend(p: dict[str, Column], q: dict[str, Column]) -> dict[str, Column]:
    """A premultiplied 1:2 blend of pixel q into p; equal pixels stay, zero alpha gives 0."""
    alpha = F.floor((p["a"] * 2 + q["a"] + 1) / 3)
    total = p["a"] * 2 + q["a"]
    same = (p["r"] == q["r"]) & (p["g"] == q["g"]) & (p["b"] == q["b"]) & (p["a"] == q["a"])
    out = {c: F.when(same, p[c]).when(total == 0, F.lit(0)).otherwise(F.floor((p[c] * p["a"] * 2 + q[c] * q["a"] + F.floor(total / 2)) / F.when(total != 0, total))).cast("long") for c in CHANNELS}
    return out | {"a": F.when(same, p["a"]).otherwise(alpha).cast("long")}


def edge_rows(pixels: DataFrame, tile: int) -> DataFrame:
    """Boundary and inner row or column of every tile: side, depth (0 boundary, 1 inner) and position along the side."""
    last = tile - 1
    sides = [("west", "px", 0, 1, "py"), ("east", "px", last, last - 1, "py"), ("north", "py", 0, 1, "px"), ("south", "py", last, last - 1, "px")]
    hits = F.array_compact(F.array(*[F.when(F.col(at) == v, F.struct(F.lit(name).alias("side"), F.lit(depth).alias("depth"), F.col(along).alias("along"))) for name, at, outer, inner, along in sides for depth, v in ((0, outer), (1, inner))]))
    return pixels.withColumn("_e", F.explode(hits)).select("*", "_e.side", "_e.depth", "_e.along").drop("_e")


def seam_pairs(pixels: DataFrame, tile: int) -> DataFrame:
    """One row per boundary pixel pair of neighbouring tiles: premultiplied boundary (0) and inner (1) pixels of both."""
    rows = edge_rows(premultiply(pixels), tile)
    pack = F.struct(*CHANNELS, "a")
    wide = rows.groupBy("tx", "ty", "side", "along").agg(F.max(F.when(F.col("depth") == 0, pack)).alias("outer"), F.max(F.when(F.col("depth") == 1, pack)).alias("inner"))
    a = wide.where("side in ('east', 'north')").select(F.col("tx"), F.col("ty"), "side", "along", F.col("outer").alias("ao"), F.col("inner").alias("ai"))
    step = F.col("side") == "west"
    b = wide.where("side in ('west', 'south')").select((F.col("tx") - step.cast("int")).alias("tx"), (F.col("ty") + (~step).cast("int")).alias("ty"), F.when(step, "east").otherwise("north").alias("side"), "along", F.col("outer").alias("bo"), F.col("inner").alias("bi"))
    return a.join(b, ["tx", "ty", "side", "along"])


def seam_metrics(pixels: DataFrame, tile: int, hard: int = 32, mean_limit: float = 8.0, hard_limit: float = 0.10) -> DataFrame:
    """Per pair of neighbours, from premultiplied pixels of all four channels: mean boundary difference, mean local baseline (the
    larger difference to the inner row on either side), mean excess over it, share of hard pixels, nearest-rank p95 and p99 and
    maximum of a pixel's largest excess, pixels whose alpha is matched on one side only, and whether the pair is flagged."""
    d = lambda p, q: [F.abs(F.col(f"{p}.{c}") - F.col(f"{q}.{c}")) for c in (*CHANNELS, "a")]
    edge, left, right = d("ao", "bo"), d("ao", "ai"), d("bo", "bi")
    mean = lambda cs: sum(cs[1:], cs[0]) / 4
    local = [F.greatest(p, q) for p, q in zip(left, right)]
    excess = [F.greatest(e - k, F.lit(0)) for e, k in zip(edge, local)]
    rows = seam_pairs(pixels, tile).select(
        "tx", "ty", "side", mean(edge).alias("m"), mean(local).alias("l"), mean(excess).alias("x"), F.greatest(*excess).alias("top"), ((F.col("ao.a") == 0) != (F.col("bo.a") == 0)).alias("u"),
    )
    rank = lambda share: F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY top)").cast("long")
    found = rows.groupBy("tx", "ty", "side").agg(  # a pair has as many rows as a tile has pixels along a side
        F.count("*").alias("pixels"), F.round(F.avg("m"), 9).alias("mean"), F.round(F.avg("l"), 9).alias("local"), F.round(F.avg("x"), 9).alias("excess"),
        F.round(F.avg((F.col("top") > hard).cast("double")), 9).alias("hard_share"),
        rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.max("top").alias("top"), F.count_if("u").alias("unmatched_alpha"),
    )
    return found.withColumn("flagged", (F.col("excess") > mean_limit) | (F.col("hard_share") > hard_limit))


def alpha_stats(pixels: DataFrame, keys: list[str]) -> DataFrame:
    a = F.col("a")
    return pixels.groupBy(*keys).agg(F.count_if(a == 0).alias("transparent"), F.count_if(a != 0).alias("nonzero"), F.count_if(a == 255).alias("opaque"), F.count_if((a > 0) & (a < 255)).alias("intermediate"))


def pixel_difference(a: DataFrame, b: DataFrame, keys: list[str], hard: int = 32) -> DataFrame:
    """One row: pixels, differing ones, mean absolute channel difference, largest, hard pixels, and pixels on one side only."""
    pack = lambda df, n: df.select(*keys, F.struct(*CHANNELS, "a").alias(n))
    rows = pack(a, "p").join(pack(b, "q"), keys, "full")
    both = F.col("p").isNotNull() & F.col("q").isNotNull()
    d = [F.abs(F.col(f"p.{c}") - F.col(f"q.{c}")) for c in (*CHANNELS, "a")]
    top = F.greatest(*d)
    return rows.agg(
        F.count_if(both).alias("pixels"), F.count_if(top > 0).alias("differing"), F.round(F.avg(sum(d[1:], d[0]) / 4), 6).alias("mean"),
        F.max(top).alias("top"), F.count_if(top > hard).alias("hard"), F.count_if(~both).alias("unpaired"),
    )


def hard_components(a: DataFrame, b: DataFrame, bucket: str, hard: int = 32) -> DataFrame:
    """Per bucket, the number and largest size of connected groups of pixels that differ by more than `hard`."""
    keys = [bucket, "px", "py"]
    rows = a.select(*keys, *[F.col(c).alias(f"_{c}") for c in (*CHANNELS, "a")]).join(b, keys)
    return component_sizes(rows.where(F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in (*CHANNELS, "a")]) > hard), bucket, "px", "py")


def component_sizes(cells: DataFrame, bucket: str, x: str, y: str) -> DataFrame:
    """(bucket, components, largest): how many groups of touching cells a bucket has, and the size of the largest."""
    from cairnlake.operators.catalog import components8

    sizes = components8(cells, bucket, x, y).groupBy(bucket, "anchor_x", "anchor_y").agg(F.count("*").alias("n"))
    return sizes.groupBy(bucket).agg(F.count("*").alias("components"), F.max("n").alias("largest"))


SIDES = {"west": ("px", False), "east": ("px", True), "north": ("py", False), "south": ("py", True)}


def visual_difference(a: DataFrame, b: DataFrame, images: list[str], tile: int, hard: int, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Per image (images: its keys; pixels px and py from 0 to tile - 1) how two renderings differ.

    Differences are those of premultiplied pixels, the largest of the four channels; pixels on the ignored border sides do not
    count, pixels that one rendering lacks are `unpaired`. Told are: pixels, compared, ignored, unpaired, differing ones and
    their share, those whose alpha differs and their share, differing ones that are opaque in both, the mean over channels,
    nearest-rank p99, hard pixels (a difference above `hard`), their share, their components by 8 neighbours and the largest of
    these, the largest difference, and the largest of opaque pixels. An image has pixels in bounded number.
    """
    if not set(ignored) <= set(SIDES):
        raise ValueError("sides are west, east, north and south")
    keys = [*images, "px", "py"]
    pack = lambda df, n: premultiply(df).select(*keys, F.struct(*CHANNELS, "a").alias(n))
    rows = pack(a, "p").join(pack(b, "q"), keys, "full")
    border = F.lit(False)
    for side in ignored:
        column, last = SIDES[side]
        border = border | (F.col(column) == (tile - 1 if last else 0))
    d = [F.abs(F.col(f"p.{c}") - F.col(f"q.{c}")) for c in (*CHANNELS, "a")]
    both = F.col("p").isNotNull() & F.col("q").isNotNull()
    rows = rows.select(*keys, both.alias("both"), (both & ~border).alias("in"), F.greatest(*d).alias("d"), sum(d[1:], d[0]).alias("sum"), (F.col("p.a") != F.col("q.a")).alias("alpha"), ((F.col("p.a") == 255) & (F.col("q.a") == 255)).alias("solid"))
    of = lambda c, x: F.when(F.col("in") & c, x)
    some, opaque = F.col("d") > 0, (F.col("d") > 0) & F.col("solid")
    n = F.greatest(F.count_if("in"), F.lit(1))
    share = lambda c: F.round(F.count_if(F.col("in") & c) / n, 9)
    found = rows.groupBy(*images).agg(
        F.count_if("both").alias("pixels"), F.count_if("in").alias("compared"), F.count_if(F.col("both") & ~F.col("in")).alias("ignored"), F.count_if(~F.col("both")).alias("unpaired"),
        F.count_if(F.col("in") & some).alias("differing"), share(some).alias("differing_share"), F.count_if(F.col("in") & F.col("alpha")).alias("alpha_differing"), share(F.col("alpha")).alias("alpha_share"),
        F.count_if(F.col("in") & opaque).alias("opaque_differing"), F.round(F.coalesce(F.sum(of(F.lit(True), F.col("sum"))), F.lit(0)) / (4 * n), 9).alias("mean"),
        F.coalesce(F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY if(in, d, null))").cast("long"), F.lit(0)).alias("p99"),
        F.count_if(F.col("in") & (F.col("d") > hard)).alias("hard"), share(F.col("d") > hard).alias("hard_share"),
        F.coalesce(F.max(of(F.lit(True), F.col("d"))), F.lit(0)).alias("top"), F.coalesce(F.max(of(opaque, F.col("d"))), F.lit(0)).alias("top_opaque"),
    )
    cells = rows.where(F.col("in") & (F.col("d") > hard)).select(F.struct(*images).alias("_image"), "px", "py")
    groups = component_sizes(cells, "_image", "px", "py").select("_image.*", "components", "largest")
    return found.join(groups, images, "left").fillna(0, ["components", "largest"])


def stabilize_borders(pixels: DataFrame, tile: int, k: int = 3) -> DataFrame:
    """Boundary pixels next to a tile of another shard are blended with the neighbour's boundary pixel: first west and east,
    then north and south with the corrected pixels of both tiles; alpha is then made binary. Other pixels never move."""
    from cairnlake.functions.grid import shard_center

    fields = (*CHANNELS, "a")
    rows = pixels
    for axis, at, t in (("x", "px", "tx"), ("y", "py", "ty")):
        last = tile - 1
        edge = rows.where(F.col(at).isin(0, last))
        step = F.when(F.col(at) == 0, -1).otherwise(1)
        other = edge.select((F.col("tx") + (step if t == "tx" else F.lit(0))).alias("_tx"), (F.col("ty") + (step if t == "ty" else F.lit(0))).alias("_ty"), (F.lit(last) - F.col("px") if at == "px" else F.col("px")).alias("_px"), (F.lit(last) - F.col("py") if at == "py" else F.col("py")).alias("_py"), *[F.col(c).alias(f"_{c}") for c in fields], F.col(t).alias("_own"))
        other = other.where(shard_center(F.col("_own"), k) != shard_center(F.col(f"_{t}"), k))
        on = (F.col("tx") == F.col("_tx")) & (F.col("ty") == F.col("_ty")) & (F.col("px") == F.col("_px")) & (F.col("py") == F.col("_py"))
        joined = edge.join(other, on, "left")
        mixed = blend({c: F.col(c) for c in fields}, {c: F.col(f"_{c}") for c in fields})
        fixed = joined.select("tx", "ty", "px", "py", *[F.when(F.col("_tx").isNull(), F.col(c)).otherwise(mixed[c]).cast("long").alias(c) for c in fields])
        rows = cut(rows.where(~F.col(at).isin(0, last)).unionByName(fixed))
    return binary_alpha(rows)


def decode_deltas(deltas: DataFrame, keys: list[str], base: str, scale: int = 8) -> DataFrame:
    """Heights from differences: the first column adds up down the rows from the base, and each row adds up across. A map cell
    has a fixed number of vertices, so its windows are small."""
    down = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    first = deltas.where("col = 0").select(*keys, "row", (F.sum("delta").over(down) + F.col(base)).alias("_first"))
    rows = deltas.join(first, [*keys, "row"])
    return rows.withColumn("height", (F.col("_first") + F.sum(F.when(F.col("col") > 0, F.col("delta")).otherwise(0)).over(across)) * scale).drop("_first")


def deblock(df: DataFrame, index: str) -> DataFrame:
    """(row, col) of a value stored in 4 by 4 blocks of 4 by 4."""
    i = F.col(index)
    block, inner = F.floor(i / 16), i % 16
    return df.withColumn("row", (F.floor(block / 4) * 4 + F.floor(inner / 4)).cast("long")).withColumn("col", ((block % 4) * 4 + inner % 4).cast("long"))


def _heights(points: DataFrame, vertices: DataFrame, keep: list[str], cell: float, n: int, default: float) -> DataFrame:
    """keep and `_h`, the height at each point. Each point meets the one row that holds all vertices of its cell, so that no row
    is made for a corner; repeated vertices count as often as they stand there."""
    gx, gy = F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)
    local = lambda c, g: F.least(F.greatest((F.col(c) - g * cell) * n / cell, F.lit(0.0)), F.lit(float(n)))
    rows = points.select(*keep, gx.alias("gx"), gy.alias("gy"), local("x", gx).alias("_u"), local("y", gy).alias("_v"))
    inside = F.col("row").between(0, n) & F.col("col").between(0, n)
    given = vertices.where(inside).select("gx", "gy", (F.col("row") * (n + 1) + F.col("col")).cast("long").alias("_at"), F.coalesce("value", F.lit(default)).alias("_value"))
    every = given.select("gx", "gy").distinct().select("gx", "gy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n + 1) ** 2 - 1).cast("long"))).alias("_at"), F.lit(None).cast("double").alias("_value"))
    met = given.unionByName(every).groupBy("gx", "gy", "_at").agg(F.sum("_value").alias("_value"))
    cells = met.groupBy("gx", "gy").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_value"))), lambda v: v["_value"]).alias("_cell"))
    rows = rows.join(cells, ["gx", "gy"], "left")
    rows = rows.withColumns({"_c": F.least(F.floor("_u"), F.lit(n - 1)), "_r": F.least(F.floor("_v"), F.lit(n - 1))})
    fu, fv = F.col("_u") - F.col("_c"), F.col("_v") - F.col("_r")
    corner = lambda i, j: F.coalesce(F.get("_cell", ((F.col("_r") + i) * (n + 1) + F.col("_c") + j).cast("int")), F.lit(default))
    height = reduce(lambda a, b: a + b, [corner(i, j) * ((fv if i else 1 - fv) * (fu if j else 1 - fu)) for i in (0, 1) for j in (0, 1)])
    return rows.select(*keep, height.alias("_h"))


def bilinear_sample(points: DataFrame, vertices: DataFrame, id_col: str, cell: float, n: int = 64, default: float = 0.0) -> DataFrame:
    """(id, value): heights at points between the four vertices around; a missing cell counts `default`. vertices: gx, gy, row,
    col, value, with rows and cols 0..n."""
    return _heights(points, vertices, [id_col], cell, n, default).groupBy(id_col).agg(F.round(F.sum("_h"), 6).alias("value"))


def surface_normal(points: DataFrame, vertices: DataFrame, id_col: str, cell: float, step: float, n: int = 64) -> DataFrame:
    """(id, nx, ny, nz): normalised central differences of the sampled heights, all four samples in one pass."""
    moved = points.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dx * step).alias("dx"), F.lit(dy * step).alias("dy")) for i, (dx, dy) in enumerate(((1, 0), (-1, 0), (0, 1), (0, -1)))])))
    moved = moved.select(id_col, F.col("_s.i").alias("_i"), (F.col("x") + F.col("_s.dx")).alias("x"), (F.col("y") + F.col("_s.dy")).alias("y"))
    h = _heights(moved, vertices, [id_col, "_i"], cell, n, 0.0)
    wide = h.groupBy(id_col).agg(*[F.round(F.sum(F.when(F.col("_i") == i, F.col("_h"))), 6).alias(f"h{i}") for i in range(4)])
    dx, dy = (F.col("h0") - F.col("h1")) / (2 * step), (F.col("h2") - F.col("h3")) / (2 * step)
    length = F.sqrt(dx * dx + dy * dy + 1)
    return wide.select(id_col, F.round(-dx / length, 6).alias("nx"), F.round(-dy / length, 6).alias("ny"), F.round(1 / length, 6).alias("nz"))


def slot_weights(points: DataFrame, slots: DataFrame, id_col: str, cell: float, n: int = 16) -> DataFrame:
    """(id, slot, weight): bilinear weights of the four nearest slot centres, across cell borders, summed per slot value;
    zero weights are left out and a missing slot counts under null. slots: sx, sy (global slot numbers), slot."""
    size = cell / n
    u, v = F.col("x") / size - 0.5, F.col("y") / size - 0.5
    rows = points.select(id_col, F.floor(u).alias("_i"), F.floor(v).alias("_j"), (u - F.floor(u)).alias("_fu"), (v - F.floor(v)).alias("_fv"))
    corners = F.array(*[F.struct((F.col("_i") + i).alias("sx"), (F.col("_j") + j).alias("sy"), ((F.col("_fu") if i else 1 - F.col("_fu")) * (F.col("_fv") if j else 1 - F.col("_fv"))).alias("w")) for i in (0, 1) for j in (0, 1)])
    rows = rows.select(id_col, F.explode(corners).alias("k")).select(id_col, "k.sx", "k.sy", "k.w").where("w > 0")
    return rows.join(slots, ["sx", "sy"], "left").groupBy(id_col, "slot").agg(F.round(F.sum("w"), 6).alias("weight"))


def edge_vertex_compare(vertices: DataFrame, n: int = 64) -> DataFrame:
    """Per pair of neighbouring cells the largest difference of their shared edge vertices. vertices: gx, gy, row, col, value."""
    def side(outer, inner, dx, dy, along, name):
        a = vertices.where(outer).select("gx", "gy", F.col(along).alias("along"), "value")
        b = vertices.where(inner).select((F.col("gx") - dx).alias("gx"), (F.col("gy") - dy).alias("gy"), F.col(along).alias("along"), F.col("value").alias("other"))
        return a.join(b, ["gx", "gy", "along"]).groupBy("gx", "gy").agg(F.max(F.abs(F.col("value") - F.col("other"))).alias("delta"), F.count("*").alias("shared")).withColumn("side", F.lit(name))

    return side(F.col("col") == n, F.col("col") == 0, 1, 0, "row", "east").unionByName(side(F.col("row") == n, F.col("row") == 0, 0, 1, "col", "north"))


def verify_pyramid(pyramid: DataFrame, tile: int) -> DataFrame:
    """Pixels of parents that are not what their children give: (z, tx, ty, differing), for levels that have children."""
    keys = ["tx", "ty", "px", "py"]
    z = F.col("z")
    children = pyramid.withColumn("px", F.col("tx") * tile + F.col("px")).withColumn("py", F.col("ty") * tile + F.col("py")).withColumn("z", z - 1).drop("tx", "ty")
    wanted = binary_alpha(tiled(downsample2(children, ["z"]), tile)).select("z", *keys, F.struct(*[F.col(c).cast("long").alias(c) for c in (*CHANNELS, "a")]).alias("want"))
    floor = pyramid.agg(F.max("z").alias("_top"))
    have = pyramid.crossJoin(F.broadcast(floor)).where(z < F.col("_top")).select("z", *keys, F.struct(*[F.col(c).cast("long").alias(c) for c in (*CHANNELS, "a")]).alias("have"))
    rows = wanted.where("z >= 0").join(have, ["z", *keys], "full").where(~F.col("want").eqNullSafe(F.col("have")))
    return rows.groupBy("z", "tx", "ty").agg(F.count("*").alias("differing"))
