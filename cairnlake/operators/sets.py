"""Adjacency, coverage, comparisons and other set-like operators over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjacency(tiles: DataFrame, x: str, y: str, keep: list[str] = ()) -> DataFrame:
    """Each pair of side neighbours once: (x, y) with its neighbour to the east and its neighbour to the north (y - 1)."""
    t = tiles.select(*keep, x, y).distinct()
    def side(dx, dy, name):
        other = t.select(*keep, (F.col(x) - dx).alias(x), (F.col(y) - dy).alias(y), F.col(x).alias("nx"), F.col(y).alias("ny"))
        return t.join(other, [*keep, x, y]).withColumn("side", F.lit(name))

    return side(1, 0, "east").unionByName(side(0, -1, "north"))


def cross_group_edges(edges: DataFrame, a: Column, b: Column) -> DataFrame:
    """Edges whose ends lie in different groups, the groups given as columns of the ends."""
    return edges.where(a != b)


def neighbor_map(edges: DataFrame, x: str, y: str) -> DataFrame:
    """Per tile its west, east, north and south neighbours as (x, y), null where there is none."""
    forward = edges.select(x, y, "side", F.struct(F.col("nx").alias("x"), F.col("ny").alias("y")).alias("n"))
    back = edges.select(F.col("nx").alias(x), F.col("ny").alias(y), F.when(F.col("side") == "east", "west").otherwise("south").alias("side"), F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("n"))
    return forward.unionByName(back).groupBy(x, y).pivot("side", ["west", "east", "north", "south"]).agg(F.first("n"))


def covered(points: DataFrame, coverage: DataFrame, keys: list[str], value: str, low: str, high: str) -> DataFrame:
    """points with `covered`: whether the value lies in a range of its keys. The keys join; the range only filters."""
    ranges = coverage.select(*keys, low, high)
    hits = points.select(*keys, value).distinct().join(ranges, keys).where(F.col(value).between(F.col(low), F.col(high))).select(*keys, value).distinct()
    return points.join(hits.withColumn("_c", F.lit(True)), [*keys, value], "left").withColumn("covered", F.coalesce("_c", F.lit(False))).drop("_c")


def parent_topology(tiles: DataFrame, z: str, x: str, y: str) -> DataFrame:
    """Tiles that break the pyramid: `missing` parents of the level below, and parents `without_child`. The top level needs
    no parent, the lowest no child."""
    t = tiles.select(z, x, y).distinct()
    ends = t.agg(F.min(z).alias("_lo"), F.max(z).alias("_hi"))
    wanted = t.crossJoin(F.broadcast(ends)).where(F.col(z) > F.col("_lo")).select((F.col(z) - 1).alias(z), F.floor(F.col(x) / 2).alias(x), F.floor(F.col(y) / 2).alias(y)).distinct()
    inner = t.crossJoin(F.broadcast(ends)).where(F.col(z) < F.col("_hi")).select(z, x, y)
    return wanted.join(t, [z, x, y], "left_anti").withColumn("problem", F.lit("missing")).unionByName(inner.join(wanted, [z, x, y], "left_anti").withColumn("problem", F.lit("without_child")))


def full_compare(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str], names: tuple[str, ...] = ("missing", "extra", "mismatched", "same")) -> DataFrame:
    """Every key of either side with its state; values are compared null-safely."""
    e = expected.select(*keys, F.struct(*values).alias("before"))
    a = actual.select(*keys, F.struct(*values).alias("after"))
    state = F.when(F.col("after").isNull(), names[0]).when(F.col("before").isNull(), names[1]).when(~F.col("before").eqNullSafe(F.col("after")), names[2]).otherwise(names[3])
    return e.join(a, keys, "full").withColumn("state", state)


def referential_check(routes: DataFrame, stops: DataFrame, route: str, start: str, end: str, stop: str, mode: str, modes: list[str]) -> DataFrame:
    """One row per broken rule and route: no_start, no_end, loop, mode, repeated."""
    known = stops.select(F.col(stop).alias("_s")).distinct()
    def lost(col, rule):
        return routes.join(known, F.col(col) == F.col("_s"), "left_anti").select(route, F.lit(rule).alias("rule"))

    return (
        lost(start, "no_start").unionByName(lost(end, "no_end"))
        .unionByName(routes.where(F.col(start) == F.col(end)).select(route, F.lit("loop").alias("rule")))
        .unionByName(routes.where(~F.col(mode).isin(modes)).select(route, F.lit("mode").alias("rule")))
        .unionByName(routes.groupBy(route).count().where("count > 1").select(route, F.lit("repeated").alias("rule")))
    )


def unknown_keys(child: DataFrame, parent: DataFrame, dataset: str, key: str) -> DataFrame:
    """Child rows whose key its dataset does not know; datasets without any known key are not judged."""
    judged = child.join(parent.select(dataset).distinct(), dataset, "left_semi")
    return judged.join(parent.select(dataset, key).distinct(), [dataset, key], "left_anti")


def verify_log(log: DataFrame, decoded: DataFrame, key: str, digest: str) -> DataFrame:
    """Log entries with `state`: duplicate (a later entry of the same key), missing, differs or verified. log: key, digest, seq."""
    again = F.row_number().over(Window.partitionBy(key).orderBy("seq")) > 1
    rows = log.withColumn("_again", again).join(decoded.select(key, F.col(digest).alias("_d")), key, "left")
    return rows.withColumn("state", F.when(F.col("_again"), "duplicate").when(F.col("_d").isNull(), "missing").when(F.col("_d") != F.col(digest), "differs").otherwise("verified")).drop("_again", "_d")


def hop_audit(usage: DataFrame, palette: DataFrame, assets: DataFrame, slot: str, asset: str, examples: str, n: int = 5) -> DataFrame:
    """usage -> palette -> assets: occurrences and the first n examples per reason (missing_palette, missing_asset) and slot."""
    rows = usage.join(palette.select(slot, asset), slot, "left").join(assets.select(asset).distinct().withColumn("_a", F.lit(True)), asset, "left")
    rows = rows.withColumn("reason", F.when(F.col(asset).isNull(), "missing_palette").when(F.col("_a").isNull(), "missing_asset")).where("reason is not null")
    firsts = rows.withColumn("_r", F.row_number().over(Window.partitionBy("reason", slot).orderBy(examples)))
    return firsts.groupBy("reason", slot).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= n, F.col(examples)))).alias("examples"))


def pending(targets: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return targets.join(done.select(*key).distinct(), key, "left_anti")


def positional_slices(items: DataFrame, parts: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """Consecutive items dealt to parts by their declared counts: per part whether count and size agree. parts: key, part,
    count, bytes. Ordinals meet running counts by an equi-join on the key and a range filter."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = items.withColumn("_i", F.row_number().over(w).cast("long"))
    running = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    bounds = parts.withColumn("_hi", F.sum("count").over(running)).withColumn("_lo", F.col("_hi") - F.col("count"))
    joined = bounds.join(numbered.select(key, "_i", size), key, "left").where(F.col("_i").isNull() | ((F.col("_i") > F.col("_lo")) & (F.col("_i") <= F.col("_hi"))))
    got = joined.groupBy(key, "part").agg(F.count("_i").alias("items"), F.sum(size).alias("total"))
    rows = parts.join(got, [key, "part"], "left")
    return rows.withColumn("agrees", (F.coalesce("items", F.lit(0)) == F.col("count")) & (F.coalesce("total", F.lit(0)) == F.col("bytes")))


def snapshot_pairs(before: DataFrame, after: DataFrame, id_col: str, product: str) -> DataFrame:
    """Pairs of two snapshots: by id; then, among the rest, by a product key that is unique on both whole sides."""
    b, a = before.select(F.col(id_col).alias("before_id"), F.col(product).alias("_pb")), after.select(F.col(id_col).alias("after_id"), F.col(product).alias("_pa"))
    by_id = b.join(a, F.col("before_id") == F.col("after_id"))
    rest_b = b.join(a, F.col("before_id") == F.col("after_id"), "left_anti")
    rest_a = a.join(b, F.col("before_id") == F.col("after_id"), "left_anti")
    once_b = b.groupBy("_pb").count().where("count = 1 and _pb is not null").select("_pb")
    once_a = a.groupBy("_pa").count().where("count = 1 and _pa is not null").select("_pa")
    by_product = rest_b.join(once_b, "_pb").join(rest_a.join(once_a, "_pa"), F.col("_pb") == F.col("_pa")).select("before_id", "after_id")
    lost = rest_b.select("before_id").join(by_product.select("before_id"), "before_id", "left_anti").withColumn("after_id", F.lit(None).cast("long"))
    new = rest_a.select("after_id").join(by_product.select("after_id"), "after_id", "left_anti").select(F.lit(None).cast("long").alias("before_id"), "after_id")
    how = lambda df, name: df.select("before_id", "after_id", F.lit(name).alias("how"))
    return how(by_id, "id").unionByName(how(by_product, "product")).unionByName(how(lost, "removed")).unionByName(how(new, "added"))


def used_nodes(edges: DataFrame, ends: list[str], nodes: DataFrame, node: str) -> DataFrame:
    seen = None
    for e in ends:
        s = edges.select(F.col(e).alias(node))
        seen = s if seen is None else seen.unionByName(s)
    return nodes.join(seen.distinct(), node, "left_semi")


def set_difference_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: only_a, only_b, equal (as bags)."""
    left = a.exceptAll(b).agg(F.count("*").alias("only_a"))
    right = b.exceptAll(a).agg(F.count("*").alias("only_b"))
    return left.crossJoin(right).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def ordered_distinct(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Each value once, at its first place."""
    return df.groupBy(*keys, value).agg(F.min(position).alias(position))


def diff_summary(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return full_compare(before, after, keys, values, ("removed", "added", "changed", "unchanged")).groupBy("state").agg(F.count("*").alias("n"))


def diff_records(before: DataFrame, after: DataFrame, key: str, prefix: str, fields: list[str]) -> DataFrame:
    """Changed records: the fields that differ and a digest of either side. A prefix is taken off keys before comparing."""
    from cairnlake.functions.keys import canonical_json, strip_prefix

    plain = strip_prefix(F.col(key), prefix)
    b = before.select(plain.alias("key"), F.struct(*fields).alias("b"))
    a = after.select(plain.alias("key"), F.struct(*fields).alias("a"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), f) for f in fields]))
    digest = lambda side: F.when(F.col(side).isNotNull(), F.sha2(canonical_json(*[F.col(f"{side}.{f}").alias(f) for f in sorted(fields)]), 256))
    rows = b.join(a, "key", "full").withColumn("state", F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added").when(F.size(changed) > 0, "changed"))
    fields_out = F.when(F.col("state") == "changed", changed).otherwise(F.array().cast("array<string>"))
    return rows.where("state is not null").select("key", "state", fields_out.alias("fields"), digest("b").alias("before_hash"), digest("a").alias("after_hash"))


def assemble_snapshot(places: DataFrame, names: DataFrame, tiles: DataFrame, dataset: str) -> DataFrame:
    """Per dataset its places, names and tiles counted, and whether any key repeats. Each input: dataset, key."""
    def part(df, name):
        per = df.groupBy(dataset, "key").count()
        return per.groupBy(dataset).agg(F.sum("count").alias(name), F.count_if(F.col("count") > 1).alias(f"{name}_repeated"))

    rows = part(places, "places").join(part(names, "names"), dataset, "full").join(part(tiles, "tiles"), dataset, "full")
    return rows.fillna(0)


def plan_files(files: DataFrame, path: str, size: str, digest: str) -> DataFrame:
    """Every referenced file once; `conflict` where one path comes with different contents."""
    return files.groupBy(path).agg(F.min(size).alias(size), F.min(digest).alias(digest), F.count("*").alias("referenced"), (F.count_distinct(F.struct(size, digest)) > 1).alias("conflict"))


def checkpoint_progress(chain: DataFrame, order: str, key: str, digest: str) -> DataFrame:
    """Per checkpoint: keys it has, new ones, ones that the one before had and it lost, and ones whose digest changed."""
    w = Window.partitionBy(key).orderBy(order)
    rows = chain.withColumn("_before", F.lag(order).over(w)).withColumn("_digest", F.lag(digest).over(w)).withColumn("_next", F.lead(order).over(w))
    last = chain.agg(F.max(order).alias("_last"))
    have = rows.groupBy(order).agg(
        F.count("*").alias("have"), F.count_if(F.col("_before").isNull() | (F.col("_before") < F.col(order) - 1)).alias("new"),
        F.count_if((F.col("_before") == F.col(order) - 1) & (F.col("_digest") != F.col(digest))).alias("changed"),
    )
    gone = rows.crossJoin(F.broadcast(last)).where((F.col(order) < F.col("_last")) & (F.col("_next").isNull() | (F.col("_next") > F.col(order) + 1))).groupBy((F.col(order) + 1).alias(order)).agg(F.count("*").alias("lost"))
    return have.join(gone, order, "left").fillna(0)
