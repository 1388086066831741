"""Summaries of catalogs and networks, and nested catalogs: small compositions that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnlake.functions.keys import casefold


def catalog_counts(df: DataFrame, axes: dict[str, str]) -> DataFrame:
    """(axis, value, n): rows in all (axis `total`, value empty), and by each value of each axis; axes = {name: column}. One pass."""
    sets = [[], *[[F.col(c)] for c in axes.values()]]
    found = df.groupingSets(sets, *[F.col(c) for c in axes.values()]).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in axes.values()])
    axis = F.lit("total")
    for name, c in axes.items():
        axis = F.when(F.col(f"_g_{c}") == 0, name).otherwise(axis)
    return found.select(axis.alias("axis"), F.coalesce(*[F.col(c).cast("string") for c in axes.values()], F.lit("")).alias("value"), "n")


def size_histogram(df: DataFrame, group: str) -> DataFrame:
    """(size, groups): how many groups have how many rows."""
    return df.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def nested_catalog(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """parents with an array `name` of their children's fields, sorted by them; empty where there are none. Children of one
    parent fit a row by nature: they become one object of a document."""
    own = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    kind = f"array<struct<{', '.join(f'{f}:{children.schema[f].dataType.simpleString()}' for f in fields)}>>"
    return parents.join(own, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def write_nested_catalog(nested: DataFrame, order: list[str], path: str) -> None:
    """One canonical JSON object a line, keys in order of name, lines in order."""
    from cairnlake.sources.io import write_canonical_ndjson

    write_canonical_ndjson(nested, order, path)


def explode_catalog(spark: SparkSession, path: str, schema: StructType | str, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of a nested catalog in JSON: one row per child, with the parent's other fields and the child's; a parent
    without children gives one row of nulls. Lines that are not strict JSON objects are problems."""
    from cairnlake.sources.io import read_strict_ndjson

    parents, problems = read_strict_ndjson(spark, path, schema, canonical=False)
    others = [c for c in parents.columns if c != name]
    return parents.select(*others, F.explode_outer(name).alias("_child")).select(*others, "_child.*"), problems


def artifact_metrics(nested: DataFrame, name: str) -> DataFrame:
    """One row: places, those with children, children in all and most in one."""
    size = F.greatest(F.size(name), F.lit(0)).cast("long")
    return nested.agg(F.count("*").alias("places"), F.count_if(size > 0).alias("interiors"), F.coalesce(F.sum(size), F.lit(0)).alias("entrances"), F.max(size).alias("most"))


def chebyshev_span(cells: DataFrame, group: str, x: str, y: str, above: int = 1) -> DataFrame:
    """(group, span, cells) of groups whose cells spread over more than `above` steps in x or y."""
    span = F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y))
    return cells.groupBy(group).agg(span.alias("span"), F.count("*").alias("cells")).where(F.col("span") > above)


def split_names(df: DataFrame, name: str, id_col: str) -> DataFrame:
    """(name, n, ids): names that several rows bear, with their sorted ids."""
    return df.groupBy(name).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(id_col)).alias("ids")).where("n > 1")


def nearest_rank_percentile(df: DataFrame, group: list[str], value: str, shares: dict[str, float], **limits) -> DataFrame:
    """Values at the nearest rank, ceil(share * n) from the least, for each group; shares = {column: share}. limits: those of
    selection.nearest_ranks, which finds the ranks of large groups without holding their values."""
    from cairnlake.operators.selection import nearest_ranks

    return nearest_ranks(df, group, value, shares, **limits)


def duplicate_values(df: DataFrame, value: str) -> DataFrame:
    """Values that occur more than once."""
    return df.groupBy(value).count().where("count > 1").select(value)


def casefold_collisions(df: DataFrame, value: str) -> DataFrame:
    """(folded, spellings): trimmed and folded forms that different spellings share."""
    spelled = df.select(F.col(value).alias("_w")).where("_w is not null").distinct()
    return spelled.groupBy(casefold(F.col("_w")).alias("folded")).agg(F.count("*").alias("spellings")).where("spellings > 1")


def runtime_rollup(runs: DataFrame, group: str, took: str, variant: str, memory: str | None = None, markers: str | None = None) -> DataFrame:
    """(group, runs, total, most, variants), and with memory and markers the largest memory and the sum of markers."""
    more = [F.max(memory).alias("memory")] if memory else []
    more += [F.sum(markers).alias("markers")] if markers else []
    return runs.groupBy(group).agg(F.count("*").alias("runs"), F.round(F.sum(took), 2).alias("total"), F.max(took).alias("most"), F.count_distinct(variant).alias("variants"), *more)


def variant_counts(runs: DataFrame, group: str, variant: str) -> DataFrame:
    """(group, variant, runs, share): how often each variant ran in its group."""
    found = runs.groupBy(group, variant).agg(F.count("*").alias("runs"))
    whole = found.groupBy(group).agg(F.sum("runs").alias("_all"))
    return found.join(whole, group).select(group, variant, "runs", F.round(F.col("runs") / F.col("_all"), 6).alias("share"))


def texture_usage(df: DataFrame, group: str, slot: str, none=0) -> DataFrame:
    """(group, used): the distinct slots of each group in order, without the one that stands for nothing."""
    return df.where(F.col(slot) != none).groupBy(group).agg(F.array_sort(F.collect_set(slot)).alias("used"))


def group_extent(df: DataFrame, group: str, x: str, y: str, pad: float, bounds: tuple[float, float, float, float]) -> DataFrame:
    """(group, min_x, min_y, max_x, max_y): the box of each group's points, padded and kept within bounds."""
    x0, y0, x1, y1 = (F.lit(float(b)) for b in bounds)
    return df.groupBy(group).agg(
        F.greatest(F.min(x) - pad, x0).alias("min_x"), F.greatest(F.min(y) - pad, y0).alias("min_y"),
        F.least(F.max(x) + pad, x1).alias("max_x"), F.least(F.max(y) + pad, y1).alias("max_y"),
    )


def deterministic_order(df: DataFrame, columns: list[str], tie: str) -> DataFrame:
    """Rows in an order that never depends on the plan: by the columns, then by a unique key."""
    return df.orderBy(*columns, tie)


def union_keys(*keys: DataFrame) -> DataFrame:
    """The distinct values of one-column tables in order."""
    out = keys[0].toDF("k")
    for other in keys[1:]:
        out = out.union(other.toDF("k"))
    return out.distinct().orderBy("k")


def binary_gate(stats: DataFrame) -> DataFrame:
    """One row over alpha statistics of tiles: tiles, failing ones, opaque pixels, and whether no pixel is half transparent."""
    return stats.agg(F.count("*").alias("tiles"), F.count_if(F.col("intermediate") > 0).alias("failing"), F.sum("opaque").alias("opaque"), (F.sum("intermediate") == 0).alias("passed"))


def gates(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(gate, passed) for each rule over a table of one row, and `all` of them."""
    every = {**rules, "all": F.reduce(F.array(*rules.values()), F.lit(True), lambda a, b: a & b)}
    return df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), c.alias("passed")) for n, c in every.items()])).alias("g")).select("g.gate", "g.passed")


def overlap_compare(pixels: DataFrame, tile: int, margin: int) -> DataFrame:
    """pixel_difference of the last `margin` columns of each tile and the first of its eastern neighbour, where both are there."""
    from cairnlake.operators.raster import pixel_difference

    tiles = pixels.select("tx", "ty").distinct()
    left = pixels.where(F.col("px") >= tile - margin).join(tiles.select((F.col("tx") - 1).alias("tx"), "ty"), ["tx", "ty"], "left_semi")
    right = pixels.where(F.col("px") < margin).withColumn("tx", F.col("tx") - 1).withColumn("px", F.col("px") + (tile - margin)).join(tiles, ["tx", "ty"], "left_semi")
    return pixel_difference(left, right, ["tx", "ty", "px", "py"])


def topology_summary(tiles: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """(group, tiles, min_x, max_x, min_y, max_y, east, north): extent of the distinct tiles and their adjacent pairs."""
    from cairnlake.operators.sets import adjacency

    found = tiles.select(group, x, y).distinct()
    edges = adjacency(found, x, y, [group]).groupBy(group).agg(F.count_if(F.col("side") == "east").alias("east"), F.count_if(F.col("side") == "north").alias("north"))
    sizes = found.groupBy(group).agg(F.count("*").alias("tiles"), F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))
    return sizes.join(edges, group, "left").fillna(0, ["east", "north"])


def land_topology(cells: DataFrame, x: str, y: str, zoom: int, size: int, k: int = 3) -> DataFrame:
    """(z, tiles, east, north, cells, min_x, min_y, max_x, max_y, origin_x, origin_y, shards, cross_shard): the tiles and adjacent pairs
    of each zoom of a map whose cells are the tiles of the largest zoom, numbered from the top left; the extent in the world and the
    origin, its top left corner; how many shards of k by k cells there are, and at the largest zoom the pairs that lie across two
    of them (null at others)."""
    from cairnlake.functions.grid import shard_center
    from cairnlake.operators.sets import adjacency

    own = cells.select(F.col(x).cast("long").alias("cx"), F.col(y).cast("long").alias("cy")).distinct()
    shard = lambda a, b: F.struct(shard_center(a, k).alias("x"), shard_center(b, k).alias("y"))
    frame = own.agg(F.count("*").alias("cells"), F.min("cx").alias("x0"), F.min("cy").alias("y0"), F.max("cx").alias("x1"), F.max("cy").alias("y1"), F.count_distinct(shard(F.col("cx"), F.col("cy"))).alias("shards"))
    placed = own.crossJoin(F.broadcast(frame))  # with one row
    tiles = placed.select((F.col("cx") - F.col("x0")).alias("tx"), (F.col("y1") - F.col("cy")).alias("ty"), F.explode(F.sequence(F.lit(0), F.lit(zoom))).alias("z"))
    wide = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(zoom) - F.col("z"))).alias(c)
    levels = tiles.select("z", wide("tx"), wide("ty")).distinct()
    pairs = adjacency(levels, "tx", "ty", ["z"])
    cell = lambda tx, ty: shard(F.col(tx) + F.col("x0"), F.col("y1") - F.col(ty))
    native = pairs.where(F.col("z") == zoom).crossJoin(F.broadcast(frame))
    across = native.agg(F.count_if(cell("tx", "ty") != cell("nx", "ny")).alias("_across"))
    sides = pairs.groupBy("z").agg(F.count_if(F.col("side") == "east").alias("east"), F.count_if(F.col("side") == "north").alias("north"))
    found = levels.groupBy("z").agg(F.count("*").alias("tiles")).join(sides, "z", "left").fillna(0, ["east", "north"]).crossJoin(F.broadcast(frame)).crossJoin(F.broadcast(across))
    left, top = F.col("x0") * size, (F.col("y1") + 1) * size
    return found.select(
        "z", "tiles", "east", "north", "cells", left.alias("min_x"), (F.col("y0") * size).alias("min_y"), ((F.col("x1") + 1) * size).alias("max_x"), top.alias("max_y"),
        left.alias("origin_x"), top.alias("origin_y"), "shards", F.when(F.col("z") == zoom, F.col("_across")).alias("cross_shard"),
    )


def network_summary(routes: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: routes, distinct stops, and destinations without a match."""
    ends = routes.select(F.col("start").alias("v")).union(routes.select("finish")).agg(F.count_distinct("v").alias("stops"))
    return routes.agg(F.count("*").alias("routes")).crossJoin(ends).crossJoin(matched.agg(F.count_if(F.col("match") == "none").alias("unmatched")))


def exclusions(providers: DataFrame, key: str) -> DataFrame:
    """(key, reason) of providers that are left out."""
    return providers.where(F.col("reason").isNotNull()).select(key, "reason")


def exclusion_texts(providers: DataFrame, name: str) -> DataFrame:
    """(text): `name: reason` of all that are left out, each text once, in order."""
    return exclusions(providers, name).select(F.concat(F.col(name), F.lit(": "), F.col("reason")).alias("text")).distinct().orderBy("text")


def asset_fingerprint(slots: DataFrame, asset: str) -> DataFrame:
    """One row: a digest of the slots whatever their order, their number, and the number of distinct assets in them."""
    from cairnlake.operators.quality import set_digest

    return set_digest(slots).crossJoin(slots.agg(F.count_distinct(asset).alias("payloads")))
