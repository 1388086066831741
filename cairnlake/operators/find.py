"""Faceted, prioritised and fuzzy search over places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.keys import ascii_fold


def facet_filter(df: DataFrame, region: str = "all", types: list | None = None, statuses: list | None = None, zoom: float | None = None, columns=("region", "type", "status", "min_zoom")) -> DataFrame:
    """OR inside an axis, AND across; an empty list is no filter, nor is the region `all`."""
    r, ty, st, mz = columns
    if region != "all":
        df = df.where(F.col(r) == region)
    if types:
        df = df.where(F.col(ty).isin(types))
    if statuses:
        df = df.where(F.col(st).isin(statuses))
    return df if zoom is None else df.where(F.col(mz) <= zoom)


def status_or_default(places: DataFrame, progress: DataFrame, key: str, status: str, default: str = "unvisited") -> DataFrame:
    return places.join(progress.select(key, status), key, "left").withColumn(status, F.coalesce(status, F.lit(default)))


def available_values(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Distinct values that the order knows, with their rank."""
    ranks = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], f"{value} string, rank int")
    return df.select(value).distinct().join(F.broadcast(ranks), value).orderBy("rank")


def visible_edges(routes: DataFrame, stops: DataFrame, modes: list[str], region: str, start: str, end: str, mode: str, stop: str, stop_region: str) -> DataFrame:
    rows = routes.where(F.col(mode).isin(modes))
    if region == "all":
        return rows
    inside = stops.where(F.col(stop_region) == region).select(F.col(stop).alias("_s")).distinct()
    hit = lambda c, name: inside.select(F.col("_s").alias(c), F.lit(True).alias(name))
    return rows.join(hit(start, "_a"), start, "left").join(hit(end, "_b"), end, "left").where("_a or _b").drop("_a", "_b")


def facet_counts(df: DataFrame, axes: dict[str, list], chosen: dict[str, list]) -> DataFrame:
    """(axis, value, n): counts of each axis under the filters of the other axes, zero where nothing is left."""
    out = None
    for axis, values in axes.items():
        rows = df
        for other, wanted in chosen.items():
            if other != axis and wanted:
                rows = rows.where(F.col(other).isin(wanted))
        counts = rows.groupBy(F.col(axis).cast("string").alias("value")).agg(F.count("*").alias("n"))
        every = df.sparkSession.createDataFrame([(str(v),) for v in values], "value string")
        part = every.join(counts, "value", "left").select(F.lit(axis).alias("axis"), "value", F.coalesce("n", F.lit(0)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def label_priority(df: DataFrame, selected: Column, matches: Column, ranks: list[Column], id_col: str, n: int = 20) -> DataFrame:
    """The n rows to label first: selected, then search hits, then by ranks, then by id. One TakeOrdered."""
    return df.withColumn("_s", selected).withColumn("_m", matches).orderBy(F.desc("_s"), F.desc("_m"), *ranks, id_col).limit(n).drop("_s", "_m")


def weighted_fuzzy(df: DataFrame, query: str, weights: dict[str, float], cutoff: float = 0.32, shortest: int = 2) -> DataFrame:
    """Adds `score` (0 best, at most cutoff): the least, over fields, of 1 - weight-scaled likeness of the query to the field's
    best word: 1 - weight * (1 - levenshtein / longer length). Equal words give 1 - weight."""
    q = query.strip().lower()
    if len(q) < shortest:
        return df.where(F.lit(False)).withColumn("score", F.lit(0.0))
    def of(field, weight):
        tokens = F.filter(F.split(ascii_fold(field), r"[^\p{L}\p{N}]+"), lambda t: t != "")
        like = F.array_max(F.transform(tokens, lambda t: F.lit(1.0) - F.levenshtein(t, F.lit(q)) / F.greatest(F.length(t), F.lit(len(q)))))
        return F.lit(1.0) - F.lit(weight) * F.coalesce(like, F.lit(0.0))

    scores = [of(f, w) for f, w in weights.items()]
    return df.withColumn("score", F.round(F.least(*scores) if len(scores) > 1 else scores[0], 6)).where(F.col("score") <= cutoff)


def top_k_search(df: DataFrame, query: str, weights: dict[str, float], order: str, k: int = 40, cutoff: float = 0.32) -> DataFrame:
    """A blank query gives the first k rows by order; else the k best scores, ties by order."""
    if not query.strip():
        return df.withColumn("score", F.lit(0.0)).orderBy(order).limit(k)
    return weighted_fuzzy(df, query, weights, cutoff).orderBy("score", order).limit(k)


def page(df: DataFrame, keys: list[str], order: list, size: int, n: int) -> DataFrame:
    """The first n pages of each group together."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= size * n).drop("_r")


def departures(routes: DataFrame, stops: DataFrame, start: str, end: str, stop: str, name: str, of) -> DataFrame:
    """Routes out of one stop, by the name of where they go."""
    return routes.where(F.col(start) == of).join(stops.select(F.col(stop).alias(end), name), end).orderBy(name, end)


def normalize_state(urls: DataFrame, url: str, regions: list[str], types: list[str], place_regions: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """A log of state URLs to legal states: unknown regions become `all`, unknown places null, a place's own region wins,
    types are put in canonical order (none or all of them: no filter), a view is clamped, and dropped whole if any part of
    it is not a finite number. place_regions: place, place_region."""
    arg = lambda name: F.try_parse_url(F.col(url), F.lit("QUERY"), F.lit(name))
    rows = urls.withColumn("_r", arg("region")).withColumn("place", arg("place")).withColumn("_t", F.split(arg("types"), ",")).join(place_regions, "place", "left")
    rows = rows.withColumn("place", F.when(F.col("place_region").isNotNull(), F.col("place")))
    region = F.coalesce("place_region", F.when(F.col("_r").isin(regions), F.col("_r")), F.lit("all"))
    wanted = F.filter(F.array(*[F.lit(t) for t in types]), lambda t: F.array_contains("_t", t))
    wanted = F.when(F.size(wanted).isin(0, -1, len(types)) | F.col("_t").isNull(), F.lit(None)).otherwise(wanted)
    parts = {n: arg(n).try_cast("double") for n in limits}
    finite = F.lit(True)
    for p in parts.values():
        finite = finite & p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    out = rows.withColumn("region", region).withColumn("types", wanted)
    for n, (low, high) in limits.items():
        out = out.withColumn(n, F.when(F.coalesce(finite, F.lit(False)), F.least(F.greatest(parts[n], F.lit(low)), F.lit(high))))
    return out.drop("_r", "_t", "place_region")
