"""Small helpers for text inside tasks."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utf8(column) -> list:
    """The values of a string column as bytes (None stays), without decoding them first."""
    kind = column.type
    if pa.types.is_large_string(kind):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(kind):
        column = column.cast(pa.binary())
    return column.to_pylist()


def stretches(texts: pa.Array, size: int):
    """(from, to) of runs of texts with about `size` bytes together; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, to
        at = to


def tokenizer_path(name: str) -> str:
    """A vocabulary file by its name in the public collection, or any path as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def tasks(rows: DataFrame) -> int:
    """The session's number of shuffle partitions: for exchanges of few bytes before much work, which Spark would otherwise
    join into few tasks."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(rows: DataFrame) -> DataFrame:
    """rows over as many tasks as the cluster has cores, if the scan alone gives fewer (a small table, or one row group).
    Larger tables are left as they are: work that needs no exchange gets none."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores after those that are taken (in any case)."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def spread(docs: DataFrame, id_col: str, text_col: str, bytes_per_group: int, seed: int) -> tuple[Column, int, bool]:
    """A pseudo-random group of each row with about bytes_per_group of text, the bytes of all texts, and whether groups follow
    from places of rows, which another run of the same input may change: who reads groups more than once then cuts lineage.

    Copies of a text have different ids and so different groups. Rows that repeat both share a hash; where those make a
    group too large by themselves, which shows in the sums of 65,536 hash buckets without their longest text, they are dealt
    over groups by their places.
    """
    hashed = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    bucket = F.pmod(hashed, F.lit(1 << 16))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(64)
    sums = docs.groupBy(bucket.alias("b")).agg(F.sum(size).alias("n"), F.max(size).alias("longest")).collect()
    total = sum(r.n for r in sums)
    groups = max(1, -(-total // bytes_per_group))
    large = {r.b: -(-r.n // bytes_per_group) for r in sums if r.n - r.longest > max(bytes_per_group, 4 * total >> 16)}
    placed = bool(large) and groups > 1
    if placed:
        parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in large.items() for x in pair]), bucket), F.lit(1))
        hashed = F.when(parts > 1, F.xxhash64(hashed, F.pmod(F.monotonically_increasing_id(), parts))).otherwise(hashed)
    return F.pmod(F.shiftright(hashed, 16), F.lit(groups)), total, placed
