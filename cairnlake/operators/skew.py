"""Joins of many rows to the one row of their key, where a few keys hold much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A key with more than one in SHARE of all rows is heavy; so there are fewer than SHARE heavy keys in any table.
SHARE = 1000


def heavy_keys(counts: DataFrame, key: str, n: str, total: int) -> list:
    """The keys of counts (one row per key, n rows each, total in all) that are heavy: fewer than SHARE."""
    return [r[0] for r in counts.where(F.col(n) * SHARE > total).select(key).collect()]


def join_by_key(left: DataFrame, right: DataFrame, key: str, heavy: list) -> DataFrame:
    """The inner join of left with right, which has one row per key. Rows of heavy keys stay where they are and meet the
    broadcast rows of right, fewer than SHARE; the others are shuffled."""
    if not heavy:
        return left.join(right, key)
    if not isinstance(left.schema[key].dataType, StructType):
        is_heavy = F.col(key).isin(heavy)
        rest = left.where(~is_heavy).join(right.where(~is_heavy), key)
        return rest.unionByName(left.where(is_heavy).join(F.broadcast(right.where(is_heavy)), key))
    keys = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in heavy], left.select(key).schema))
    rest = left.join(keys, key, "left_anti").join(right.join(keys, key, "left_anti"), key)
    return rest.unionByName(left.join(F.broadcast(right.join(keys, key, "left_semi")), key))


def without_keys(df: DataFrame, like: DataFrame, key: str, heavy: list) -> DataFrame:
    """df without the rows of heavy keys, whose type is that of `like`; the others stay where they are."""
    if not heavy:
        return df
    return df.join(F.broadcast(df.sparkSession.createDataFrame([(k,) for k in heavy], like.select(key).schema)), key, "left_anti")
