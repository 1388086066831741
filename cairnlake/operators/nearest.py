"""The nearest place of each point inside a group, without all pairs of a group.

Where a group has at most `leaf` places, its points meet all of them. The places of other groups lie in squares (in three dimensions, cubes) that are halved along each side as long as they hold more than
`leaf` places. Points go down level by level: a square is looked into only while its nearest corner of places may still beat the
nearest place met so far, of which one in each square seen is known. In the end a point meets the places of a few squares of at
most `leaf` places each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.operators.skew import heavy_keys, join_by_key, without_keys
from cairnlake.plans.checkpoints import cut

DEPTH = 30


def _length(parts: list[Column]) -> Column:
    return F.hypot(*parts) if len(parts) == 2 else F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


class _Squares:
    """Names of the columns of d dimensions: q of points, p of places, i of places in the group's frame, b of squares, u of the
    squares above, low and high of their boxes."""

    def __init__(self, d: int):
        self.d = range(d)
        self.q, self.p, self.i, self.b, self.u = ([f"{c}{k}" for k in self.d] for c in "qpibu")

    def to(self, one: Column) -> Column:
        return _length([F.col(q) - one[p] for q, p in zip(self.q, self.p)])

    def to_one(self) -> Column:
        return self.to(F.col("one"))

    def to_place(self) -> Column:
        return _length([F.col(q) - F.col(p) for q, p in zip(self.q, self.p)])

    def to_box(self) -> Column:
        return _length([F.greatest(F.col(f"low{k}") - F.col(q), F.col(q) - F.col(f"high{k}"), F.lit(0.0)) for k, q in zip(self.d, self.q)])

    def at(self, level: int) -> list[Column]:
        return [F.shiftright(i, DEPTH - level).alias(b) for i, b in zip(self.i, self.b)]

    def of(self, places: DataFrame, level: int) -> DataFrame:
        """The squares of a level that hold places: their number, their box, and one of them."""
        boxes = [f(p).alias(f"{name}{k}") for k, p in zip(self.d, self.p) for name, f in (("low", F.min), ("high", F.max))]
        return places.groupBy("g", *self.at(level)).agg(F.count("*").alias("n"), *boxes, F.min(F.struct(*self.p)).alias("one"))


def _among_few(s: _Squares, asking: DataFrame, given: DataFrame, digits: int) -> DataFrame:
    """(key, place, distance) of points in groups whose places are few, so that those of a group come in one row."""
    lists = given.groupBy("g").agg(F.collect_list(F.struct(*s.p, F.col("key").alias("place"))).alias("places"))
    near = F.transform("places", lambda one: F.struct(F.round(s.to(one), digits).alias("distance"), one["place"].alias("place")))
    return asking.join(lists, "g").withColumn("best", F.array_min(near)).select("key", "best.place", "best.distance")


def nearest_in_groups(points: DataFrame, places: DataFrame, keys: list[str], point: str, place: str, at: tuple[str, ...] = ("x", "y"), digits: int = 3, leaf: int = 32) -> DataFrame:
    """(point, place, distance): for each point the place of the same keys that is nearest (by the distance rounded to `digits`, then
    the least place). Null keys are equal to each other; points without a place in their group, and those with a null coordinate, are
    left out. Both tables have the keys and the coordinates `at`. In groups of more than `leaf` places points that share a position are looked up once.
    """
    s, slack = _Squares(len(at)), 2 * 10.0**-digits

    def placed(df: DataFrame, key: str, names: list[str]) -> DataFrame:
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in at])
        return df.where(known).select(F.struct(*keys).alias("g"), *[F.col(c).cast("double").alias(n) for c, n in zip(at, names)], F.col(key).alias("key"))

    asking, given = placed(points, point, s.q), placed(places, place, s.p)
    size = F.greatest(*[F.max(p) - F.min(p) for p in s.p])
    frames = cut(given.groupBy("g").agg(F.count("*").alias("n"), size.alias("size"), *[F.min(p).alias(f"f{k}") for k, p in zip(s.d, s.p)]))
    large = frames.where(F.col("n") > leaf)
    total, most = frames.agg(F.sum("n"), F.max("n")).first()
    if (most or 0) <= leaf:
        return _among_few(s, asking, given, digits).select(F.col("key").alias(point), F.col("place").alias(place), "distance")
    heavy = heavy_keys(large, "g", "n", total)
    light = without_keys(given, given, "g", heavy).join(large.select("g"), "g", "left_anti")
    few = _among_few(s, without_keys(asking, given, "g", heavy), light, digits)

    scaled = [F.least(F.floor(F.coalesce(F.try_divide(F.col(p) - F.col(f"f{k}"), F.col("size")), F.lit(0.0)) * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("long").alias(i) for k, p, i in zip(s.d, s.p, s.i)]
    spots = join_by_key(given, large.drop("n"), "g", heavy).select("g", *s.p, "key", *scaled)
    active = cut(spots.groupBy("g", *s.p, *s.i).agg(F.min("key").alias("place")))
    asked = cut(join_by_key(asking, large.select("g"), "g", heavy).select("g", *s.q).distinct().withColumn("q", F.monotonically_increasing_id()))

    per_point = Window.partitionBy("q")
    told = ["q", "g", *s.q, *s.b, "n", "best", "low"]
    squares = cut(s.of(active, 0))
    front = asked.join(squares, "g").withColumns({"best": s.to_one(), "low": s.to_box()}).select(*told)
    looked, kept = [], []
    for level in range(DEPTH + 1):
        front = cut(front)
        fine = (F.col("n") <= leaf) if level < DEPTH else F.lit(True)
        looked.append(front.where(fine).withColumn("level", F.lit(level)))
        # squares that hold few places keep them; those of the others go on
        counted = active.select("*", *s.at(level)).join(squares.select("g", *s.b, "n"), ["g", *s.b])
        kept.append(counted.where(fine).select("g", F.lit(level).alias("level"), *s.b, *s.p, "place"))
        if level == DEPTH or not squares.where(~fine).limit(1).count():
            break
        rest = front.where(~fine)
        active = cut(counted.where(~fine).select("g", *s.p, "place", *s.i))
        squares = cut(s.of(active, level + 1))
        below = squares.withColumns({u: F.shiftright(b, 1) for u, b in zip(s.u, s.b)})
        met = rest.select("q", "g", *s.q, *[F.col(b).alias(u) for u, b in zip(s.u, s.b)], F.col("best").alias("was")).join(below, ["g", *s.u])
        met = met.withColumns({"low": s.to_box(), "best": F.least("was", s.to_one())})
        front = met.withColumn("best", F.min("best").over(per_point)).where(F.col("low") <= F.col("best") + slack).select(*told)
    last = reduce(DataFrame.unionByName, looked).withColumn("best", F.min("best").over(per_point)).where(F.col("low") <= F.col("best") + slack)
    pairs = last.join(reduce(DataFrame.unionByName, kept), ["g", "level", *s.b])
    best = pairs.groupBy("q").agg(F.min(F.struct(F.round(s.to_place(), digits).alias("distance"), "place")).alias("b"))
    answers = asked.join(best, "q").select("g", *s.q, F.col("b.place").alias("place"), F.col("b.distance").alias("distance"))
    many = asking.join(answers, ["g", *s.q]).select("key", "place", "distance")
    return few.unionByName(many).select(F.col("key").alias(point), F.col("place").alias(place), "distance")
