"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

Fingerprints of 64 bits are cut into three segments. If two differ in at most 4 bits, then the first or the second segment
differs in at most one bit, or else both differ in two and the third is equal. So each distinct fingerprint goes into three
tables, and looks into the first two with a ball of radius one and into the third with its own value. For a pair whose
segment differs in one bit, the side that has 0 there looks up the other, so each pair meets once per segment.

Table and look-up rows of a segment value are brought together by one shuffle and sort, and read as a stream. Complete
distances decide; of the links in one bucket only a spanning forest leaves the task. A bucket of more than `hot` rows is not
compared in pairs: its rows are spread again by the values that they reach with a few more flipped bits outside the
segment (two for table rows, one for look-up rows), and all that meet there are linked. That is exact as well: 2 + 2
flips, or 1 + 2 + 1 with the bit in the segment, make 4; and whatever is within 4 meets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.words import dealt, stretches, utf8
from cairnlake.operators.components import connected_components
from cairnlake.operators.skew import heavy_keys, join_by_key
from cairnlake.plans.checkpoints import cut

#: Offset and width of each segment. Two fingerprints within RADIUS bits meet in one of them, see above.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
RADIUS = 4


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The majority of each bit over the shingles' XXH64 (seed 42): set if more than half have it. No words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)[: len(ends) - shingle + 1].tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id_col and fp (the fingerprint as a signed long) of every row."""

    def work(batches):
        for batch in batches:
            for at, to in stretches(batch.column(1), 4_000_000):
                b = batch.slice(at, to - at)
                fps = np.array([fingerprint(t, shingle) for t in utf8(b.column(1))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], [id_col, "fp"])

    return dealt(docs.select(id_col, text_col)).mapInArrow(work, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def _lookups(value: Column, width: int) -> Column:
    """The values with one of the zero bits of value set."""
    bits = F.array(*[F.lit(1 << j).cast("long") for j in range(width)])
    zero = F.filter(bits, lambda bit: value.bitwiseAND(bit) == 0)
    return F.transform(zero, lambda bit: F.struct(value.bitwiseOR(bit).alias("bucket"), F.lit(True).alias("look")))


def _entries() -> Column:
    """(bucket, look) for each table a fingerprint is in (look false) and each value it looks up (look true)."""
    rows = []
    for k, (offset, width) in enumerate(SEGMENTS):
        value = F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(k << 32))
        rows.append(F.array(F.struct(value.alias("bucket"), F.lit(False).alias("look"))))
        if k < 2:
            rows.append(_lookups(value, width))
    return F.concat(*rows)


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within RADIUS bits in one bucket: one for each fingerprint but the first of a group."""
    rest = np.unique(fps)
    us, vs = [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= RADIUS
            if near.any():
                found, rest = rest[near], rest[~near]
                us.append(found)
                vs.append(np.full(len(found), x))
                queue.extend(found)
    none = np.empty(0, np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _links(bucket: np.ndarray, fp: np.ndarray, look: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links in whole buckets, which come sorted with their table rows first."""
    starts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1))
    sizes = np.diff(np.append(starts, len(bucket)))
    us, vs = [], []
    small = np.repeat(sizes, sizes) <= 32
    i = np.flatnonzero(~look & small)
    for step in range(1, 32):
        i = i[i + step < len(bucket)]
        i = i[bucket[i] == bucket[i + step]]
        if not len(i):
            break
        near = np.bitwise_count(fp[i] ^ fp[i + step]) <= RADIUS
        us.append(fp[i[near]])
        vs.append(fp[i[near] + step])
    for s, n in zip(starts[sizes > 32], sizes[sizes > 32]):
        if not look[s]:
            u, v = _forest(fp[s : s + n])
            us.append(u)
            vs.append(v)
    none = np.empty(0, np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _match(hot: int):
    def rows(u, v, bucket=None, look=None):
        n = len(u)
        return pa.RecordBatch.from_arrays(
            [pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.nulls(n, pa.int64()) if bucket is None else pa.array(bucket), pa.nulls(n, pa.bool_()) if look is None else pa.array(look)],
            ["u", "v", "bucket", "look"],
        )

    def work(batches):
        held, crowded = None, None
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
            bucket, fp, look = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if crowded is not None:
                more = bucket == crowded
                if more.any():
                    yield rows(fp[more], fp[more], bucket[more], look[more])
                bucket, fp, look = bucket[~more], fp[~more], look[~more]
                if not len(bucket):
                    held = None
                    continue
                crowded = None
            if not len(bucket):
                continue
            last = int(np.searchsorted(bucket, bucket[-1]))
            yield from _whole(bucket[:last], fp[:last], look[:last], hot, rows)
            held = [bucket[last:], fp[last:], look[last:]]
            if len(held[0]) > hot:
                yield rows(held[1], held[1], held[0], held[2])
                crowded, held = held[0][0], None
        if held is not None and len(held[0]):
            yield from _whole(*held, hot, rows)

    return work


def _whole(bucket, fp, look, hot, rows):
    if not len(bucket):
        return
    starts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1))
    sizes = np.diff(np.append(starts, len(bucket)))
    full = np.repeat(sizes, sizes) > hot
    if full.any():
        yield rows(fp[full], fp[full], bucket[full], look[full])
        bucket, fp, look = bucket[~full], fp[~full], look[~full]
    if len(bucket):
        yield rows(*_links(bucket, fp, look))


def _balls(batches):
    """The values that the rows of crowded buckets reach with flips outside the bucket's segment."""
    flips = []
    for offset, width in SEGMENTS:
        free = [1 << j for j in range(64) if not offset <= j < offset + width]
        one = np.array([0, *free], np.uint64)
        flips.append((np.concatenate([one, np.array([a | b for a, b in combinations(free, 2)], np.uint64)]), one))
    for batch in batches:
        buckets, fps, looks = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 512):
            out = []
            for bucket, fp, look in zip(buckets[at : at + 512], fps[at : at + 512], looks[at : at + 512]):
                offset, width = SEGMENTS[bucket >> 32]
                inside = np.uint64(((1 << width) - 1) << offset)
                centre = (fp & ~inside) | (np.uint64(bucket & 0xFFFFFFFF) << np.uint64(offset))
                values = centre ^ flips[bucket >> 32][1 if look else 0]
                out.append((np.full(len(values), bucket), values, np.full(len(values), fp)))
            b, z, f = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(z.view(np.int64)), pa.array(f.view(np.int64))], ["bucket", "z", "fp"])


def links(prints: DataFrame, hot: int = 8192) -> DataFrame:
    """(u, v) of distinct fingerprints at most 4 bits apart, enough of them to connect all that are linked in any chain."""
    entries = prints.select("fp", F.explode(_entries()).alias("e")).select("e.bucket", "fp", "e.look")
    met = cut(entries.repartition("bucket").sortWithinPartitions("bucket", "look").mapInArrow(_match(hot), "u long, v long, bucket long, look boolean"))
    plain = met.where("bucket is null").select("u", "v")
    reached = met.where("bucket is not null").select("bucket", F.col("u").alias("fp"), "look").mapInArrow(_balls, "bucket long, z long, fp long")
    # at most 1 + 64 + 2016 distinct fingerprints reach one value
    stars = reached.groupBy("bucket", "z").agg(F.min("fp").alias("v"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return plain.unionByName(stars.select(F.explode("all").alias("u"), "v").where("u <> v").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, hot: int = 8192) -> DataFrame:
    """id_col, fp long, component_id: the smallest id reachable by links of at most 4 differing bits, for every row of docs.

    Null, empty and blank texts have fingerprint 0 and are linked like others. Texts of fewer than `shingle` words have the
    hash of all of them. Repeated rows stay. Rows without an id have the component of their fingerprint, but never name
    one (null if nobody there has an id). An empty table gives no rows; other columns are ignored. Fingerprints and components
    that hold more than a thousandth of the rows, fewer than a thousand of each, are joined by broadcast.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")))
    nodes = connected_components(links(distinct.select("fp"), hot), "u", "v")
    classes = cut(distinct.join(nodes, distinct.fp == nodes.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("class")))
    named = classes.groupBy("class").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    large = heavy_keys(named, "class", "n", classes.count())
    names = cut(join_by_key(classes.select("fp", "class"), named.drop("n"), "class", large).select("fp", "component_id"))
    common = heavy_keys(distinct, "fp", "n", prints.count())
    return join_by_key(prints, names, "fp", common).select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without near-duplicates: of each component the row with its smallest id, all columns as they are.

    Of rows that share that id one stays. Rows without an id stay: nothing can name them as a copy.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    kept = found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    return docs.join(kept, id_col, "left_semi").dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
