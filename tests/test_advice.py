"""Whole results where a cut or a single task once stood."""

import random
import struct

from pyspark.sql import functions as F

from cairnlake import catalogue
from cairnlake.operators import greedy
from cairnlake.sources import io

FOLDER = "/root/testdata/sf0.001"


def test_exit_anchor_query_opens_the_ninth_door_of_all_orders(spark):
    orders = [r[0] for r in spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey").collect()]
    rooms = max(300, len(orders) // 5)
    doors = {}
    for k in orders:
        doors.setdefault(k % rooms, []).append((float(k * 17 % 1000), f"d{k:09}", (k * 7 + 11) % rooms if k % 23 else None, float(k % 500)))
    expected = set()
    for c, x in spark.read.parquet(f"{FOLDER}/customer.parquet").select("c_custkey", "c_acctbal").collect():
        queue, seen, found = [(c % rooms, x, 0)] if c % 10 else [], set(), (None, None if c % 10 else 0)
        while queue:
            room, x, depth = queue.pop(0)
            if room in seen or depth > 8:
                continue
            seen.add(room)
            ranked = sorted(doors.get(room, []), key=lambda d: (round(abs(d[0] - x), 6), d[1]))
            out = next((i for i, d in enumerate(ranked) if d[2] is None), None)
            if out is not None:
                found = (ranked[out][1], depth + 1)
                break
            queue += [(d[2], d[3], depth + 1) for d in ranked]
        expected.add((c, *found))
    assert any(steps == 9 for _, _, steps in expected)
    assert {tuple(r) for r in catalogue.QUERIES["t1_exit_anchor"](spark, FOLDER).select("id", "door", "steps").collect()} == expected


def test_next_fit_deals_one_large_group_over_tasks(spark):
    rng = random.Random(4)
    items = [(g, i, rng.choice([0, 1, 700, rng.randint(0, 9000)])) for g, n in (("a", 30), ("hot", 3000), (None, 5), ("z", 400)) for i in range(n)]
    expected, state = set(), {}
    for g, o, s in items:
        part, used = state.get(g, (0, 0))
        padded = 512 + -(-s // 512) * 512
        if used + padded > 20_000:
            part, used = part + 1, 0
        state[g] = part, used + padded
        expected.add((g, o, padded, part))
    rng.shuffle(items)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "100"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = greedy.next_fit_parts(spark.createDataFrame(items, "grp string, o int, size int"), "grp", "o", "size", 20_000)
        rows = found.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == len(expected) and {tuple(r)[:4] for r in rows} == expected
    assert len({r.task for r in rows if r.grp == "hot"}) > 2


def test_live_counts_are_read_from_files_of_the_last_batch(spark):
    found = catalogue.QUERIES["l1_live_counts"](spark, FOLDER)
    assert found.inputFiles() and all("/version=" in f for f in found.inputFiles())
    expected = spark.read.parquet(f"{FOLDER}/events.parquet").where("event_type = 'click'").groupBy("user_id").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_record_logs_are_many_bounded_files_of_frames(spark, tmp_path):
    frames = [struct.pack(io.HEADER, b"A\xffB\n", len(p), 0, i) + p for i, p in enumerate(bytes([i % 256, 0, 10, 13, 255]) * (i % 60) for i in range(900))]
    frames.append(struct.pack(io.HEADER, b"BIG_", 9000, 0, 900) + bytes(9000))
    out = str(tmp_path / "log")
    io.write_record_log(spark.createDataFrame([(bytearray(f),) for f in frames], "frame binary").coalesce(2), out, 1000, 3)
    sizes = [p.stat().st_size for p in (tmp_path / "log").glob("part-*")]
    assert len(sizes) > 40 and max(sizes) < 9000 + 2 * 1000 + 3 * 16 + 1
    found = io.scan_record_log(spark, out).where(F.col("tag") != io.FILLER).collect()
    assert not any(r.error for r in found)
    assert sorted((r.flags, r.tag.encode("latin-1"), bytes(r.payload)) for r in found) == [(i, f[:4], f[16:]) for i, f in enumerate(frames)]


def test_record_log_queries_read_framed_files(spark):
    for name in ("a1_scan_record_log", "a2_explode_subrecords"):
        files = catalogue.QUERIES[name](spark, FOLDER).inputFiles()
        assert files
        for f in files:
            with open(f.removeprefix("file://").removeprefix("file:"), "rb") as data:
                assert not any(frame[-1] for frame in io._frames(f, data.read()))
