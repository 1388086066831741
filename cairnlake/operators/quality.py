"""Data-quality rules. Every rule set returns (path, rule, message, key) rows; none means that all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.keys import ascii_fold, canonical_json, casefold
from cairnlake.plans.checkpoints import cut


def _rows(df: DataFrame, path: str, rule: str, message: str, key) -> DataFrame:
    return df.select(F.lit(path).alias("path"), F.lit(rule).alias("rule"), F.lit(message).alias("message"), F.col(key).cast("string").alias("key") if isinstance(key, str) else key.cast("string").alias("key"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_rules(df: DataFrame, path: str, key: str, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """Rows that break a rule; rules = {name: (broken, message)}. One pass over df whatever the number of rules."""
    broken = F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(m).alias("message"))) for n, (c, m) in rules.items()])
    hits = df.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(broken)).alias("b"))
    return hits.select(F.lit(path).alias("path"), "b.rule", "b.message", "key")


def unique_rule(df: DataFrame, path: str, columns: list, rule: str, message: str) -> DataFrame:
    """Values that occur more than once. columns may be expressions; keys are joined by a bar."""
    key = F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])
    return _rows(df.groupBy(key.alias("key")).count().where("count > 1"), path, rule, message, "key")


def missing_rule(child: DataFrame, parent: DataFrame, on: list[str], path: str, rule: str, message: str) -> DataFrame:
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in on])
    return _rows(child.select(*on).distinct().join(parent.select(*on).distinct(), on, "left_anti"), path, rule, message, key)


def index_rules(df: DataFrame, id_col: str, url: str, order: str, default: str, file: str) -> DataFrame:
    """Ids, urls and orders are unique, the default is there, and each file is named by its id."""
    absent = df.agg(F.count_if(F.col(id_col) == default).alias("n")).where("n = 0")
    return union([
        unique_rule(df, "index", [id_col], "unique_id", "an id is repeated"), unique_rule(df, "index", [url], "unique_url", "a url is repeated"),
        unique_rule(df, "index", [order], "unique_order", "an order is repeated"), _rows(absent, "index", "default", "the default is missing", F.lit(default)),
        row_rules(df, "index", id_col, {"file_name": (F.col(file) != F.concat(F.col(id_col).cast("string"), F.lit(".json")), "the file is not named by its id")}),
    ])


def on_cycles(links: DataFrame, start: str, end: str) -> DataFrame:
    """(node): what lies on a cycle of links, of which one at most leaves each node (of several the least counts). Pointers double:
    once they reach over more links than there are nodes, what is still led to are exactly the nodes on cycles. Paths that end drop
    out on the way, and if nothing is left there is no cycle."""
    step = cut(links.where(F.col(end).isNotNull()).groupBy(F.col(start).alias("a")).agg(F.min(end).alias("b")))
    reach, left = 1, step.count()
    n = left
    while left and reach < n:
        onward = step.select(F.col("a").alias("b"), F.col("b").alias("c"))
        step = cut(step.join(onward, "b").select("a", F.col("c").alias("b")))
        reach, left = 2 * reach, step.count()
    return step.select(F.col("b").alias("node")).distinct()


def locale_rules(df: DataFrame, id_col: str, status: str, coverage: str, fallback: str) -> DataFrame:
    """Coverage fits the status; fallbacks are declared, not the locale itself, and form no cycle, however long."""
    c = F.col(coverage)
    fits = F.when(F.col(status) == "available", c == 1).when(F.col(status) == "partial", (c > 0) & (c < 1)).otherwise(c == 0)
    known = df.select(F.col(id_col).alias("_f")).distinct()
    undeclared = df.where(F.col(fallback).isNotNull()).join(known, F.col(fallback) == F.col("_f"), "left_anti")
    return union([
        row_rules(df, "locales", id_col, {"coverage": (~fits, "coverage does not fit the status"), "own_fallback": (F.col(fallback) == F.col(id_col), "a locale falls back to itself")}),
        _rows(undeclared, "locales", "fallback", "the fallback is not declared", id_col),
        _rows(on_cycles(df, id_col, fallback), "locales", "cycle", "fallbacks form a cycle", "node"),
    ])


def profile_rules(df: DataFrame, id_col: str, name: str, order: str, enabled: str, kind: str, excluded: str, confirmed: str, values: list[str]) -> DataFrame:
    nulls = reduce(lambda a, b: a | b, [F.col(v).isNull() for v in values])
    return union([
        unique_rule(df, "profile", [ascii_fold(name)], "unique_name", "a name is repeated but for case"),
        unique_rule(df.where(F.col(enabled)), "profile", [order], "unique_order", "an order of enabled rows is repeated"),
        row_rules(df, "profile", id_col, {
            "kind": (ascii_fold(F.regexp_extract(name, r"\.([^.]*)$", 1)) != F.col(kind), "the kind is not the extension"),
            "excluded": (F.col(excluded) & F.col(enabled), "an excluded row is enabled"), "confirmed": (F.col(confirmed) & nulls, "a confirmed row has nulls"),
        }),
    ])


def exact_table(actual: DataFrame, expected: DataFrame, ordinal: str, fields: list[str]) -> DataFrame:
    """Ordered rows equal a pinned list: what is missing, extra, or differs at an ordinal."""
    a, e = actual.select(ordinal, F.struct(*fields).alias("_a")), expected.select(ordinal, F.struct(*fields).alias("_e"))
    rows = a.join(e, ordinal, "full").where(~F.col("_a").eqNullSafe(F.col("_e")))
    rule = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise("differs")
    return rows.select(F.lit("table").alias("path"), rule.alias("rule"), F.lit("a row is not as pinned").alias("message"), F.col(ordinal).cast("string").alias("key"))


def manifest_rules(df: DataFrame, id_col: str, box: list[str], centre: list[str], size: float, resolutions: str, ready: str, needs: list[str], origin: list[str] | None = None, more: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Extent, alignment, centre, falling resolutions, what a ready map needs, and the origin (the top left corner of the extent)
    where its columns are given. more: further rules of row_rules, such as readiness_rules."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    cx, cy = (F.col(c) for c in centre)
    falling = F.forall(F.sequence(F.lit(2), F.size(resolutions)), lambda i: F.element_at(resolutions, i) < F.element_at(resolutions, i - 1))
    lacks = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in needs])
    off = reduce(lambda a, b: a | b, [F.col(c) % size != 0 for c in box])
    rules = {
        "extent": ((x0 >= x1) | (y0 >= y1), "the extent is not ordered"), "aligned": (off, "the extent is not aligned to cells"),
        "centre": (~(cx.between(x0, x1) & cy.between(y0, y1)), "the centre is outside"), "resolutions": ((F.size(resolutions) > 1) & ~falling, "resolutions do not fall"),
        "ready": (F.col(ready) & lacks, "a ready map lacks something"),
    }
    if origin:
        rules["origin"] = ((F.col(origin[0]) != x0) | (F.col(origin[1]) != y1), "the origin is not the top left corner")
    return row_rules(df, "manifest", id_col, rules | (more or {}))


def readiness_rules(status: str, blockers: str, exact: str, confirmed: str, kind: str) -> dict[str, tuple[Column, str]]:
    """What a manifest's status implies. blockers: how many there are; exact, confirmed: of the profile; kind: of the provenance."""
    is_status, n = (lambda s: F.col(status) == s), F.col(blockers)
    return {
        "blocked": (is_status("blocked") & (n == 0), "blocked without a blocker"), "unblocked": (~is_status("blocked") & (n > 0), "blockers although it is not blocked"),
        "exact": (F.col(exact) & ~F.col(confirmed), "an exact profile is not confirmed"), "ready_exact": (is_status("ready") & ~F.col(exact), "ready without an exact profile"),
        "generated": (is_status("ready") & (F.col(kind) != "generated"), "ready but not generated"),
    }


def catalog_rules(places: DataFrame, id_col: str, scope: str, x: str, y: str, cx: str, cy: str, size: float) -> DataFrame:
    return union([
        unique_rule(places, "places", [id_col], "unique_id", "an id is repeated"),
        row_rules(places, "places", id_col, {
            "scope": (~F.col(id_col).cast("string").startswith(scope + "."), "an id is out of scope"),
            "cell": ((F.floor(F.col(x) / size) != F.col(cx)) | (F.floor(F.col(y) / size) != F.col(cy)), "coordinates and cell differ"),
        }),
    ])


def names_rules(names: DataFrame, id_col: str, name: str, aliases: str) -> DataFrame:
    """Aliases differ, and from the name, by more than outer blanks and case; no name or alias is blank."""
    folded = F.transform(aliases, lambda a: casefold(a))
    return row_rules(names, "names", id_col, {
        "aliases": (F.size(F.array_distinct(folded)) != F.size(folded), "aliases repeat but for case"), "primary": (F.array_contains(folded, casefold(F.col(name))), "the name is its own alias"),
        "blank": ((casefold(F.col(name)) == "") | F.exists(folded, lambda a: a == ""), "a name is blank"),
    })


def map_asset_rules(rasters: DataFrame, pyramids: DataFrame, id_col: str, low: str, high: str, resolutions: str) -> DataFrame:
    ids = rasters.select(id_col).unionByName(pyramids.select(id_col))
    return union([
        unique_rule(ids, "assets", [id_col], "unique_id", "an id is repeated over both lists"),
        row_rules(pyramids, "assets", id_col, {"zooms": (F.col(low) > F.col(high), "zooms are not ordered"), "resolutions": (F.size(resolutions) != F.col(high) - F.col(low) + 1, "not one resolution per zoom")}),
    ])


def coverage_rules(ranges: DataFrame, z: str, x: str, low: str, high: str, lowest: int, highest: int, columns: Column) -> DataFrame:
    """Order and bounds of ranges, and that no zoom is missing."""
    from cairnlake.operators.ranges import order_violations

    bad = order_violations(ranges, [z, x], low, high, adjacent_allowed=False)
    key = F.concat_ws("|", F.col(z).cast("string"), F.col(x).cast("string"), F.col(low).cast("string"))
    zooms = ranges.sparkSession.range(lowest, highest + 1).select(F.col("id").cast(ranges.schema[z].dataType).alias(z))
    return union([
        bad.select(F.lit("coverage").alias("path"), "rule", F.lit("ranges are not in order").alias("message"), key.alias("key")),
        _rows(ranges.where((F.col(x) < 0) | (F.col(x) >= columns)), "coverage", "bounds", "a column is outside", key),
        missing_rule(zooms, ranges, [z], "coverage", "zoom", "a zoom is missing"),
    ])


def coverage_identity(ranges: DataFrame, declared: DataFrame, pyramids: DataFrame, key: str, identity: dict) -> DataFrame:
    """Whether coverages are those of the pyramids that they name.

    ranges: key, z, x, low, high; declared: key, tiles, pyramid and the identity columns; pyramids: pyramid, tiles, lowest, highest zoom,
    width and height of the extent in the world, finest (units per pixel at the highest zoom) and tile (pixels of a side). identity =
    {column: value} must hold for each coverage, the pyramid must exist, both numbers of tiles must be that of the ranges, every zoom of
    the pyramid must be there and no other, and columns and rows must lie inside the pyramid's grid of that zoom.
    """
    counts = ranges.groupBy(key).agg(F.sum(F.col("high") - F.col("low") + 1).alias("_have"))
    named = pyramids.withColumnRenamed("tiles", "_tiles").withColumn("_known", F.lit(True))
    rows = declared.join(counts, key, "left").join(named, "pyramid", "left")
    told = row_rules(rows, "coverage", key, {
        **{c: (~F.col(c).eqNullSafe(F.lit(v)), f"the {c} is another one") for c, v in identity.items()},
        "pyramid": (F.col("_known").isNull(), "the pyramid is not declared"),
        "declared": (F.col("tiles") != F.coalesce("_have", F.lit(0)), "the number of tiles is not that of the ranges"),
        "integrity": (F.col("tiles") != F.col("_tiles"), "the number of tiles is not that of the pyramid"),
    })
    joined = cut(rows.where("_known").select(key, "lowest", "highest", "width", "height", "finest", "tile"))
    wanted = joined.select(key, F.explode(F.sequence("lowest", "highest").cast(f"array<{ranges.schema['z'].dataType.simpleString()}>")).alias("z"), F.lit(True).alias("_wanted"))
    zooms = ranges.select(key, "z").distinct().withColumn("_there", F.lit(True)).join(joined.select(key), key, "left_semi").join(wanted, [key, "z"], "full").where("_wanted is null or _there is null")
    side = F.col("tile") * F.col("finest") * F.pow(F.lit(2.0), F.col("highest") - F.col("z"))
    placed = ranges.join(joined, key).where(F.col("z").between(F.col("lowest"), F.col("highest")))
    placed = placed.withColumn("_place", F.concat_ws("|", *[F.col(c).cast("string") for c in (key, "z", "x", "low")]))
    return union([
        told,
        _rows(zooms, "coverage", "zooms", "the zooms are not those of the pyramid", F.concat_ws("|", F.col(key).cast("string"), F.col("z").cast("string"))),
        row_rules(placed, "coverage", "_place", {
            "columns": ((F.col("x") < 0) | (F.col("x") >= F.ceil(F.col("width") / side)), "a column is outside"),
            "rows": ((F.col("low") < 0) | (F.col("high") >= F.ceil(F.col("height") / side)), "a row is outside"),
        }),
    ])


def backup_rules(df: DataFrame, keys: list[str], datasets: list, dataset: str, created: str, updated: str, deleted: str) -> DataFrame:
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    rows = df.withColumn("_k", key)
    return union([
        unique_rule(df, "backup", keys, "unique", "an identity is repeated"),
        row_rules(rows, "backup", "_k", {
            "dataset": (~F.col(dataset).isin(datasets), "the dataset is not declared"), "times": (F.col(created) > F.col(updated), "updated before it was created"),
            "deleted": (F.col(deleted).isNotNull() & ~F.col(deleted).between(F.col(created), F.col(updated)), "deleted outside its life"),
        }),
    ])


def expected_counts(actual: DataFrame, expected: DataFrame, metric: str, value: str, missing_is_zero: bool = True) -> DataFrame:
    """Pinned metrics that do not agree, with both values."""
    rows = expected.select(metric, F.col(value).alias("expected")).join(actual.select(metric, F.col(value).alias("actual")), metric, "left")
    if missing_is_zero:
        rows = rows.withColumn("actual", F.coalesce("actual", F.lit(0)))
    return rows.where(~F.col("expected").eqNullSafe(F.col("actual")))


def reconcile(a: DataFrame, b: DataFrame, metric: str, value: str, excepted: list[str]) -> DataFrame:
    """Metrics worked out in two ways that differ, but for the named exceptions."""
    rows = a.select(metric, F.col(value).alias("a")).join(b.select(metric, F.col(value).alias("b")), metric, "full")
    return rows.where(~F.col("a").eqNullSafe(F.col("b")) & ~F.col(metric).isin(excepted))


def fixed_exceptions(mismatches: DataFrame, allowed: DataFrame, columns: list[str]) -> DataFrame:
    """Mismatches that no exact exception allows (`unexpected`), and exceptions that no mismatch uses (`stale`)."""
    return mismatches.select(*columns).join(allowed.select(*columns), columns, "left_anti").withColumn("state", F.lit("unexpected")).unionByName(
        allowed.select(*columns).join(mismatches.select(*columns), columns, "left_anti").withColumn("state", F.lit("stale")))


def self_hash_mismatches(df: DataFrame, stored: str, fields: list[str]) -> DataFrame:
    """Rows whose stored digest is not that of their other fields in order of name."""
    return df.where(F.sha2(canonical_json(*[F.col(f) for f in sorted(fields)]), 256) != F.col(stored))


def rule_totals(counts: DataFrame, group: str, n: str, totals: DataFrame, total: str) -> DataFrame:
    """Groups with a negative count, or whose counts do not sum to the total."""
    have = counts.groupBy(group).agg(F.sum(n).alias("have"), F.min(n).alias("least"))
    return have.join(totals, group, "full").where((F.col("least") < 0) | ~F.col("have").eqNullSafe(F.col(total)))


def gate_summary(gates: DataFrame, gate: str, ok: str) -> DataFrame:
    """One row per gate, and one named `all`."""
    per = gates.groupBy(gate).agg(F.bool_and(ok).alias("passed"), F.count_if(~F.col(ok)).alias("failures"))
    return per.unionByName(per.agg(F.lit("all").alias(gate), F.bool_and("passed").alias("passed"), F.sum("failures").alias("failures")))


def inventory_rules(tiles: DataFrame, z: str, x: str, y: str, path: str, ordinal: str, low: int, high: int, root: str = "") -> DataFrame:
    """Unique places and paths, paths that follow from z/x/y, zooms in range, rows in order: ordinal is a row's place in the
    inventory, and each row comes after the one before it by (z, x, y). Neighbours are joined by their ordinals, so no task
    needs to see the whole order."""
    wanted = F.concat(F.lit(root), F.concat_ws("/", F.col(z).cast("string"), F.col(x).cast("string"), F.col(y).cast("string")), F.lit(".webp"))
    before = tiles.select((F.col(ordinal) + 1).alias(ordinal), F.struct(F.col(z).alias("z"), F.col(x).alias("x"), F.col(y).alias("y")).alias("_before"))
    place = F.struct(F.col(z).alias("z"), F.col(x).alias("x"), F.col(y).alias("y"))
    rows = tiles.join(before, ordinal, "left").withColumn("_sorted", F.coalesce(F.col("_before") < place, F.lit(True)))
    return union([
        unique_rule(tiles, "inventory", [z, x, y], "unique_tile", "a tile is repeated"), unique_rule(tiles, "inventory", [path], "unique_path", "a path is repeated"),
        row_rules(rows, "inventory", path, {"path": (F.col(path) != wanted, "the path does not follow from the tile"), "zoom": (~F.col(z).between(low, high), "a zoom is out of range"), "order": (~F.col("_sorted"), "rows are not in order")}),
    ])


def log_findings(lines: DataFrame, expected: DataFrame, log: str, line: str, failure: str, benign: str) -> DataFrame:
    """Per expected log its failures and benign matches; `found` is false for a log without any line."""
    hit, fine = F.col(line).rlike(failure), F.col(line).rlike(benign)
    counts = lines.groupBy(log).agg(F.count_if(hit & ~fine).alias("failures"), F.count_if(hit & fine).alias("benign"))
    return expected.join(counts, log, "left").withColumn("found", F.col("failures").isNotNull()).fillna(0, ["failures", "benign"])


def set_digest(df: DataFrame) -> DataFrame:
    """One row: a digest of the rows as a bag, whatever their order, and their number. Each row's SHA-256 is read as eight
    numbers of 32 bits, which are added up each for itself, and the sums and the number of rows are digested: no task holds
    more than sums, at any size, and a repeated row counts each time."""
    h = F.sha2(canonical_json(*[F.col(c) for c in sorted(df.columns)]), 256)
    words = [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = df.agg(*[F.coalesce(F.sum(w), F.lit(0)).cast("string").alias(f"s{i}") for i, w in enumerate(words)], F.count("*").alias("n"))
    return sums.select(F.sha2(F.concat_ws(",", *[f"s{i}" for i in range(8)], F.col("n").cast("string")), 256).alias("digest"), "n")
