"""Transport networks: anchors, stops, routes and their checks."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cairnlake.functions.keys import ascii_fold, piped_id
from cairnlake.operators.nearest import nearest_in_groups
from cairnlake.plans.checkpoints import cut


def nearest_named(stops: DataFrame, places: DataFrame, stop: str, place: str, region: str, name: str, names: str) -> DataFrame:
    """(stop, place): the nearest place of the stop's region that has its name, ties by place; null if there is none."""
    named = places.select(region, place, "x", "y", F.explode(F.array_distinct(F.transform(names, lambda n: ascii_fold(F.trim(n))))).alias("_n")).where(F.col(region).isNotNull() & F.col("_n").isNotNull())
    best = nearest_in_groups(stops.withColumn("_n", ascii_fold(F.trim(name))), named, [region, "_n"], stop, place).select(stop, place)
    return stops.select(stop).join(best, stop, "left")


def node_flags(routes: DataFrame, ends: list[str], mode: str, local: str, intercity: str) -> DataFrame:
    """Per node of either end: its modes, whether any route is local, whether any is intercity."""
    rows = routes.select(F.explode(F.array(*ends)).alias("node"), mode, local, intercity)
    return rows.groupBy("node").agg(F.array_sort(F.collect_set(mode)).alias("modes"), F.bool_or(local).alias("any_local"), F.bool_or(intercity).alias("any_intercity"))


def reciprocal_edges(routes: DataFrame, start: str, end: str, same: list[str]) -> DataFrame:
    """Routes once for each undirected pair (by the lesser end), with `reciprocal`: the reverse exists with the same fields."""
    keys = routes.select(start, end, *same).distinct()
    back = keys.select(F.col(start).alias(end), F.col(end).alias(start), *same).withColumn("_r", F.lit(True))
    rows = keys.join(back, [start, end, *same], "left").withColumn("reciprocal", F.col("_r").isNotNull()).drop("_r")
    return rows.where(~F.col("reciprocal") | (F.col(start) <= F.col(end)))


def providers(actors: DataFrame, placements: DataFrame, key: str, excluded: list, label: str) -> DataFrame:
    """One row per placement with `reason`: no_placement, excluded, unclassified, or null."""
    rows = actors.join(placements, key, "left")
    return rows.withColumn("reason", F.when(F.col("place").isNull(), "no_placement").when(F.col(key).isin(excluded), "excluded").when(F.col(label).isNull(), "unclassified"))


def service_class(df: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """mode and subtype of the first rule (field, value, mode, subtype) that holds; null if none does."""
    chain = None
    for field, value, mode, subtype in rules:
        out = F.struct(F.lit(mode).alias("mode"), F.lit(subtype).alias("subtype"))
        hit = ascii_fold(F.col(field).cast("string")) == value
        chain = F.when(hit, out) if chain is None else chain.when(hit, out)
    return df.withColumn("_c", chain).withColumn("mode", F.col("_c.mode")).withColumn("subtype", F.col("_c.subtype")).drop("_c")


def annotations(df: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """notes: the texts of all rules that hold, in order, each text once."""
    return df.withColumn("notes", F.array_distinct(F.array_compact(F.array(*[F.when(c, t) for c, t in rules]))))


def nearest_compatible(dests: DataFrame, providers: DataFrame, dest: str, provider: str, reach: float) -> DataFrame:
    """For every destination the nearest compatible provider.

    Both: cell (null outdoors), name, mode, x, y. Compatible in mode, and in the same cell, or both outdoors with the same name
    or within `reach`. Nearest first, then provider id; taken if indoors or within reach, else `match` is `none`. What is
    taken outdoors is thus within reach, whatever its name, so the nearest of each cell and mode decides, outdoors being a cell.
    """
    able = lambda df: df.where("mode is not null")
    best = nearest_in_groups(able(dests), able(providers), ["cell", "mode"], dest, provider)
    rows = dests.select(dest, "cell").join(best.groupBy(dest).agg(F.min(F.struct("distance", provider)).alias("_b")), dest, "left")
    fine = F.col("_b").isNotNull() & (F.col("cell").isNotNull() | (F.col("_b.distance") <= reach))
    return rows.select(dest, F.when(fine, F.col(f"_b.{provider}")).alias(provider), F.when(fine, F.col("_b.distance")).alias("distance"), F.when(fine, "matched").otherwise("none").alias("match"))


def ways_to_exit(doors: DataFrame, depth: int) -> DataFrame:
    """(room, dest, left): pairs of rooms with a door from one to the other and an exit within `depth` doors that way, `left` of
    them from the room; dest is null for exits. One search backwards from all exits at once: a round meets the ways that are
    left over with the rooms of the last one, so each way is taken once, in the first round that reaches its dest."""
    exits = cut(doors.where("room is not null and dest is null").select("room", "dest").distinct().withColumn("left", F.lit(1)))
    last, rest, found = exits, doors.where("room is not null and dest is not null").select("room", "dest").distinct(), exits
    for left in range(2, depth + 1):
        met = last.select(F.col("room").alias("dest"), F.lit(True).alias("met")).distinct()
        ways = cut(rest.join(met, "dest", "left").select("room", "dest", F.col("met").isNotNull().alias("met")))
        last, rest = cut(ways.where("met").select("room", "dest", F.lit(left).alias("left"))), ways.where("not met").drop("met")
        if last.isEmpty():
            break
        found = found.unionByName(last)  # each part is cut already, and read without the ways left over
    return found


def exit_anchor(starts: DataFrame, doors: DataFrame, start: str, depth: int = 9) -> DataFrame:
    """The exit that a breadth-first walk through doors reaches first from each start.

    starts: start, room (null outdoors), x, y, z. doors: door, room, x, y, z, dest (room, or null for an exit), dx, dy, dz. In
    every room doors are tried by distance from the point of arrival, then by key; rooms are entered once. Returns start, door,
    steps (0 and no door for starts outdoors, nulls if no exit lies within `depth` doors).

    A search backwards from the exits gives each room its least number of doors to go. The walk reaches its first exit after
    as many doors, and from each room it takes the nearest of the doors that lead one nearer: any other way is longer or comes
    later in the queue. Which door follows a door depends on that door alone, so the next door of each point of arrival is
    looked up once, among the useful doors of its room and without all pairs of a room. The doors then point to their exits by
    doubling, and each start meets its first door once. Of doors between the same rooms at the same place only the least is
    ever taken. Doors without a place, or without one to arrive at, are not walked through.
    """
    key, at, to = doors.schema["door"].dataType, ["x", "y", "z"], ["dx", "dy", "dz"]
    known = lambda names: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
    through = doors.where(known(["room", *at]) & (F.col("dest").isNull() | known(to)))
    through = cut(through.groupBy("room", "dest", *at).agg(F.min(F.struct("door", *to)).alias("d")).select("room", "dest", *at, "d.*"))
    found = ways_to_exit(through, depth)
    left = cut(found.groupBy("room").agg(F.min("left").alias("left")))
    nearer = found.where("dest is not null").join(left, ["room", "left"]).select("room", "dest")
    useful = cut(through.where("dest is null").unionByName(through.join(nearer, ["room", "dest"])))

    outside = starts.where("room is null").select(start, F.lit(None).cast(key).alias("door"), F.lit(0).alias("steps"))
    inside = starts.where("room is not null").join(left, "room", "left").select(start, "room", *at, F.when(known(at), F.col("left")).alias("steps"))
    who = lambda s, d, steps: F.struct(s.cast(starts.schema[start].dataType).alias("s"), d.cast(key).alias("d"), steps.cast("int").alias("steps")).alias("who")
    none = F.lit(None)
    from_starts = inside.where("steps is not null").select(who(F.col(start), none, F.col("steps")), "room", *at)
    from_doors = useful.where("dest is not null").select(who(none, F.col("door"), none), F.col("dest").alias("room"), *[F.col(d).alias(c) for c, d in zip(at, to)])
    chosen = cut(nearest_in_groups(from_starts.unionByName(from_doors), useful, ["room"], "who", "door", tuple(at), 6).select("who", "door"))
    after = chosen.where("who.d is not null").select(F.col("who.d").alias("door"), F.col("door").alias("next"))
    for _ in range(max(depth - 2, 0).bit_length()):  # an exit has no next door
        after = cut(after.join(after.select(F.col("door").alias("next"), F.col("next").alias("_next")), "next", "left").select("door", F.coalesce("_next", "next").alias("next")))
    met = chosen.where("who.d is null").select(F.col("who.s").alias(start), "door", F.col("who.steps").alias("steps")).join(after, "door", "left")
    lost = inside.where("steps is null").select(start, F.lit(None).cast(key).alias("door"), "steps")
    return reduce(DataFrame.unionByName, [outside, lost, met.select(start, F.coalesce("next", "door").alias("door"), "steps")])


def stops(providers: DataFrame, shared_mode: str, shown: DataFrame, region: str) -> DataFrame:
    """Stops of providers: one per hall for the shared mode, else one per placement; external if the region is not shown.
    providers: placement, hall, mode, region."""
    key = F.when((F.col("mode") == shared_mode) & F.col("hall").isNotNull(), F.concat(F.lit("hall:"), F.col("hall").cast("string"))).otherwise(F.concat(F.lit("at:"), F.col("placement").cast("string")))
    rows = providers.withColumn("stop", piped_id(F.col("mode"), key))
    one = rows.groupBy("stop").agg(F.min("mode").alias("mode"), F.min(region).alias(region), F.count("*").alias("providers"))
    return one.join(shown.select(region).distinct().withColumn("_s", F.lit(True)), region, "left").withColumn("external", F.col("_s").isNull()).drop("_s")


def routes(legs: DataFrame, matched: DataFrame, stop_of: DataFrame) -> DataFrame:
    """Directed routes: legs (provider, leg, dest) whose destination has a match, without loops and pairs that are both external.
    matched: dest, provider; stop_of: provider, stop, external."""
    ends = matched.where("match = 'matched'").select("dest", F.col("provider").alias("_p"))
    a = stop_of.select("provider", F.col("stop").alias("start"), F.col("external").alias("_ea"))
    b = stop_of.select(F.col("provider").alias("_p"), F.col("stop").alias("finish"), F.col("external").alias("_eb"))
    rows = legs.join(ends, "dest").join(a, "provider").join(b, "_p").where((F.col("start") != F.col("finish")) & ~(F.col("_ea") & F.col("_eb")))
    return rows.select("provider", "leg", "start", "finish").distinct()


def _runs(batches):
    """In each batch of edges (a, b): every run of edges that follow each other becomes one link (inner false) from its first
    node to its last, n edges long, and each node between has its place on it: n edges after a (inner true). Edges that come
    in about the order of their chain shrink to a few links a batch; in any other order little changes. Loops go."""
    for batch in batches:
        froms, tos = (c.to_pylist() for c in batch.columns)
        after, reached, rows = dict(zip(froms, tos)), set(tos), []
        for head in froms:
            if head in reached:
                continue
            node, n = after[head], 1
            while node in after:
                rows.append((node, head, n, True))
                node, n = after[node], n + 1
            rows.append((node, head, n, False))
        kind = batch.schema.field(0).type
        types = [kind, kind, pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], ["node", "a", "n", "inner"])


def _halved(links: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """links (a, b, n, first, last) with about a quarter of the inner nodes taken out, and (node, a, n): where each was. A node
    goes if its mark is 1 and that of the node before is 0, so no two neighbours go at once."""
    mark = lambda c: F.xxhash64(F.col(c).cast("string"), F.lit(turn)).bitwiseAND(F.lit(1)) == 1
    kind = links.schema["a"].dataType.simpleString()
    ends = links.select(F.explode(F.array(
        F.struct(F.col("b").alias("node"), F.struct("a", "n", "first").alias("before"), F.lit(None).cast(f"struct<b:{kind},n:bigint,last:boolean>").alias("after")),
        F.struct(F.col("a").alias("node"), F.lit(None).cast(f"struct<a:{kind},n:bigint,first:boolean>").alias("before"), F.struct("b", "n", "last").alias("after")),
    )).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.max("before").alias("p"), F.max("after").alias("s"))
    nodes = cut(nodes.where("s is not null").withColumn("gone", F.col("p").isNotNull() & mark("node") & ~mark("p.a")))
    dropped = ~F.col("gone") & ~F.col("s.last") & mark("s.b") & ~mark("node")  # its end goes, which bridges it
    gone = lambda x, y: F.when(F.col("gone"), x).otherwise(y)
    left = nodes.where(~dropped).select(
        gone(F.col("p.a"), F.col("node")).alias("a"), F.col("s.b").alias("b"), (F.col("s.n") + gone(F.col("p.n"), F.lit(0))).alias("n"),
        gone(F.col("p.first"), F.col("p").isNull()).alias("first"), F.col("s.last").alias("last"),
    )
    return left.where("a <> b"), nodes.where("gone").select("node", "p.a", "p.n")


def _contracted(edges: DataFrame, few: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """At most `few` links (a, b, n) of the paths in edges (a, b; one link at most from and to each node), the links that each
    are a whole path, and what was taken out, in turn. A path that has become one link is set aside, as nothing of it can go
    any more; of the others each turn works on what the last one left, so all turns together read four times the links."""
    kind = edges.schema["a"].dataType.simpleString()
    runs = cut(edges.mapInArrow(_runs, f"node {kind}, a {kind}, n long, inner boolean"))
    links = runs.where("not inner").select("a", F.col("node").alias("b"), "n").where("a <> b")
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(True).alias("starts")), F.struct(F.col("b").alias("node"), F.lit(False).alias("starts")))).alias("e")).select("e.*")
    ends = cut(ends.groupBy("node").agg(F.min("starts").alias("first"), (~F.max("starts")).alias("last")).where("first or last"))
    known = lambda c, flag: ends.where(flag).select(F.col("node").alias(c), flag)
    links = links.join(known("a", "first"), "a", "left").join(known("b", "last"), "b", "left")
    links = cut(links.select("a", "b", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("first", "last")]))
    whole, history, turn = [], [runs.where("inner").select("node", "a", "n")], 0
    while True:
        whole.append(links.where("first and last").select("a", "b", "n"))
        links = links.where("not (first and last)")
        if links.count() <= few:
            return links.select("a", "b", "n"), whole, history
        links, out = _halved(links, turn)
        history.append(out)
        turn += 1


def _followed(kind: str):
    """In one task, which gets at most `few` links: (node, head, n) of each node on a path, n links from its head."""

    def work(batches):
        after, schema = {}, None
        for batch in batches:
            schema = batch.schema
            after.update({a: (b, n) for a, b, n in zip(*(batch.column(i).to_pylist() for i in range(3)))})
        if not after:
            return
        rows = []
        for head in after.keys() - {b for b, _ in after.values()}:
            node, n = head, 0
            rows.append((head, head, 0))
            while node in after:
                node, step = after[node]
                n += step
                rows.append((node, head, n))
        types = [schema.field(0).type, schema.field(0).type, pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], ["node", "head", "n"])

    return work


def chain_places(edges: DataFrame, start: str, end: str, few: int = 1_000_000) -> DataFrame:
    """(node, head, n) for every node of the paths that edges form: the node its path begins with, and how many links on it lies.

    At most one edge may leave and reach each node. Runs of edges inside a batch become links, then independent nodes are taken
    out by random marks until `few` links are left besides those that are a whole path. One task follows the few; then the
    nodes are put back in reverse. What lies in a loop has no place and no row.
    """
    e = edges.select(F.col(start).alias("a"), F.col(end).alias("b"))
    kind = e.schema["a"].dataType.simpleString()
    links, whole, history = _contracted(e, few)
    followed = links.coalesce(1).mapInArrow(_followed(kind), f"node {kind}, head {kind}, n long")
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).cast("long").alias("n")), F.struct(F.col("b").alias("node"), "n"))).alias("e")
    places = cut(reduce(DataFrame.unionByName, [w.select(F.col("a").alias("head"), ends).select("e.node", "head", "e.n") for w in whole], followed))
    for out in reversed(history):
        back = out.join(places.select(F.col("node").alias("a"), "head", F.col("n").alias("m")), "a").select("node", "head", (F.col("m") + F.col("n")).alias("n"))
        places = places.unionByName(cut(back))  # each part is cut already
    return places


def chain_end(edges: DataFrame, start: str, end: str, few: int = 1_000_000) -> Row:
    """What from -> to receipts form, whatever their end should be: starts, nodes, repeated, and of one chain its last node (at)
    and length. See chain_places for the method; what lies in a loop never gets to an end."""
    e = cut(edges.select(F.col(start).alias("a"), F.col(end).alias("b")))
    kind = e.schema["a"].dataType.simpleString()
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("s")).select("s.*")
    nodes = ends.groupBy("x").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    n_nodes, n_heads, repeated = nodes.agg(F.count("*"), F.count_if(F.col("into") == 0), F.count_if((F.col("out") > 1) | (F.col("into") > 1))).first()
    length = at = None
    if n_heads == 1 and not repeated:
        links, whole, _ = _contracted(e, few)
        followed = links.coalesce(1).mapInArrow(_followed(kind), f"node {kind}, head {kind}, n long")
        found = reduce(DataFrame.unionByName, [w.select(F.col("b").alias("node"), F.col("a").alias("head"), "n") for w in whole], followed)
        at, length = found.agg(F.max_by("node", "n"), F.max("n")).first()
    return Row(starts=n_heads, nodes=n_nodes, repeated=repeated > 0, at=at, length=length)


def linear_chain(edges: DataFrame, start: str, end: str, current, few: int = 1_000_000, found: Row | None = None) -> DataFrame:
    """One row: whether from -> to receipts form one chain that ends at `current`: starts, length, repeated, ends_at_current, ok.

    The work grows with the links, not with their logarithm; see chain_end, whose row for these edges may be given as `found`.
    """
    c = found or chain_end(edges, start, end, few)
    ok = c.starts == 1 and not c.repeated and c.length == c.nodes - 1 and c.at == current
    return edges.sparkSession.createDataFrame([(c.starts, c.length, c.repeated, c.at == current, ok)], "starts long, length long, repeated boolean, ends_at_current boolean, ok boolean")
