"""Record logs and inventories of files that are longer than a task should hold."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from cairnlake.sources import io


def frame(tag, payload, flags=0):
    return struct.pack(io.HEADER, tag, len(payload), 0, flags) + payload


@pytest.fixture()
def logs(tmp_path):
    rng = random.Random(3)
    folder = tmp_path / "logs and more"
    folder.mkdir()
    whole = b"".join(frame(rng.choice([b"AAAA", b"BBBB"]), rng.randbytes(rng.choice([0, 3, 50, 700])), i) for i in range(2000))
    files = {
        "whole": whole, "empty": b"", "one": frame(b"LONG", b"x" * 100_000, 7), "cut": whole[:50_000] + b"", "head": frame(b"AAAA", b"abc") + b"12345",
        "past": frame(b"AAAA", b"abc") + struct.pack(io.HEADER, b"BBBB", 99, 0, 5) + b"short", "ends": frame(b"AAAA", b"") * 3,
    }
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return folder


@pytest.mark.parametrize("range_bytes", [1, 1000, 64 << 20])
def test_ranges_give_the_rows_of_whole_files(spark, logs, range_bytes):
    key = lambda r: (r.path, r.offset)
    expected = sorted(io.scan_record_log(spark, str(logs)).collect(), key=key)
    assert len(expected) > 2000 and {r.error for r in expected} == {None, "truncated header", "payload passes the end"}
    found = io.scan_large_record_log(spark, str(logs), range_bytes=range_bytes, batch_bytes=5000)
    assert sorted(found.collect(), key=key) == expected and found.columns == [*expected[0].asDict()]
    below = found.where("tag <> 'AAAA'").groupBy("tag").count()
    assert sorted(map(tuple, below.collect())) == sorted(map(tuple, io.scan_record_log(spark, str(logs)).where("tag <> 'AAAA'").groupBy("tag").count().collect()))


def test_ranges_cover_files_without_gaps(spark, logs):
    rows = io.record_ranges(spark, str(logs), 2000).collect()
    by_path = {}
    for r in rows:
        by_path.setdefault(r.path, []).append((r.from_offset, r.to_offset, r.length))
    for ranges in by_path.values():
        ranges.sort()
        assert ranges[0][0] == 0 and ranges[-1][1] == ranges[-1][2] and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    sizes = {p.rsplit("/", 1)[1]: [b - a for a, b, _ in x] for p, x in by_path.items()}
    assert max(sizes["whole"]) <= 2000 and len(sizes["whole"]) > 100 and sizes["one"] == [100_016] and "empty" not in sizes


def test_one_long_file_is_read_by_many_tasks_in_bounded_batches(spark, tmp_path):
    path = tmp_path / "long.log"
    record = frame(b"DATA", bytes(1 << 20))
    with open(path, "wb") as f:
        for _ in range(96):
            f.write(record)
    found = io.scan_large_record_log(spark, str(path), range_bytes=4 << 20)
    task = found.select(F.spark_partition_id().alias("task"), F.octet_length("payload").alias("n")).groupBy("task").agg(F.sum("n").alias("n")).collect()
    assert sum(r.n for r in task) == 96 << 20 and len(task) >= 3 and max(r.n for r in task) < 96 << 20


def test_inventory_in_chunks(spark, logs):
    (logs / "_SUCCESS").write_bytes(b"")
    expected = sorted(map(tuple, io.file_inventory(spark, str(logs)).collect()))
    assert sorted(map(tuple, io.large_file_inventory(spark, str(logs), chunk_bytes=1000).collect())) == expected and len(expected) == 6  # an empty file is none for Spark's reader


def test_records_and_children_leave_a_task_in_bounded_batches(spark, tmp_path):
    """A file of many short records and a record of many short children never become one batch."""
    child = struct.pack(io.CHILD, b"KIDS", 3) + b"abc"
    (tmp_path / "many").write_bytes(b"".join(frame(b"AAAA", child, i) for i in range(3000)) + frame(b"MANY", child * 5000, 9) + b"cut")
    kept = {}

    class Caught:
        """A frame whose work is run here, to see its batches."""

        def __init__(self, df):
            self.df = df

        def __getattr__(self, name):
            return lambda *a: Caught(getattr(self.df, name)(*a))

        def mapInArrow(self, work, schema):
            kept["sizes"] = [b.num_rows for b in work(iter(self.df.toArrow().to_batches()))]
            return self.df.mapInArrow(work, schema)

    real = spark.read.format("binaryFile").load(str(tmp_path))

    class Session:
        class read:
            format = staticmethod(lambda _: type("Reader", (), {"load": staticmethod(lambda _: Caught(real))}))

    records = io.scan_record_log(Session, str(tmp_path), batch_bytes=1000)
    assert max(kept["sizes"]) <= 1000 // (16 + len(child)) + 1 and sum(kept["sizes"]) == 3002
    assert [r.flags for r in records.orderBy("offset").collect()] == [*range(3000), 9, None]
    children = io.explode_subrecords(Caught(records), batch_bytes=1000)
    assert max(kept["sizes"]) <= 1000 // len(child) + 1 and sum(kept["sizes"]) == 8000
    found = children.where("offset = 81000").orderBy("idx").collect()
    assert [r.idx for r in found] == list(range(5000)) and {bytes(r.value) for r in found} == {b"abc"}
