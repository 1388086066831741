"""Trees of digests over ordered rows."""

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import merkle


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(300).selectExpr("id", "id % 7 as v", "cast(null as string) as s")


def ranges(old, new):
    return sorted((r.first, r.last, r.n) for r in merkle.changed_ranges(old, new).collect())


def test_order_counts_and_partitions_do_not(spark, rows):
    base = merkle.tree(rows, ["id"], fan=4)
    assert base.rows == 300 and len(base.levels) == 6 and [x.count() for x in base.levels] == [300, 75, 19, 5, 2, 1]
    assert merkle.tree(rows.repartition(17), ["id"], fan=4).digest == base.digest
    backwards = rows.withColumn("at", -F.col("id"))
    assert merkle.tree(backwards, ["at"], ["id", "s", "v"], fan=4).digest != base.digest
    assert merkle.tree(rows, ["id"], fan=8).digest != base.digest


def test_changes_are_found_from_the_top(rows):
    base = merkle.tree(rows, ["id"], fan=4)
    one = merkle.tree(rows.withColumn("v", F.when(F.col("id") == 123, -1).otherwise(F.col("v"))), ["id"], fan=4)
    assert ranges(base, one) == [(123, 123, 1)]
    some = merkle.tree(rows.withColumn("s", F.when(F.col("id").isin(0, 1, 2, 40, 298, 299), "x")), ["id"], fan=4)
    assert ranges(base, some) == [(0, 2, 3), (40, 40, 1), (298, 299, 2)]
    assert ranges(base, merkle.tree(rows.repartition(3), ["id"], fan=4)) == []


def test_tables_of_other_lengths(spark, rows):
    base = merkle.tree(rows, ["id"], fan=4)
    assert ranges(base, merkle.tree(rows.where("id < 70"), ["id"], fan=4)) == [(70, 299, 230)]
    assert ranges(merkle.tree(rows.where("id < 1"), ["id"], fan=4), base) == [(1, 299, 299)]
    none = merkle.tree(rows.limit(0), ["id"], fan=4)
    assert none.digest is None and none.rows == 0 and ranges(none, none) == [] and ranges(none, base) == [(0, 299, 300)]
    with pytest.raises(ValueError):
        merkle.changed_rows(base, merkle.tree(rows, ["id"], fan=8))


def test_ordered_digest(rows):
    found = merkle.ordered_digest(rows, ["id"], fan=4).first()
    assert (found.n, found.levels, found.digest) == (300, 5, merkle.tree(rows, ["id"], fan=4).digest)
    assert tuple(merkle.ordered_digest(rows.limit(0), ["id"]).first()) == (0, 0, None)
