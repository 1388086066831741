"""Streams that die, replay and come in any order inside a trigger."""

import random

import pytest
from pyspark.sql import functions as F

from cairnlake.streaming import jobs


def write(df, folder):
    df.write.mode("append").parquet(folder)


def test_commit_log(spark, tmp_path):
    log = jobs.CommitLog(spark, str(tmp_path / "out"))
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert log.numbers() == [] and log.read("id long").count() == 0
    assert log.write(rows(1, 2), 0)
    assert log.write(rows(7, 8, 9), 1, commit=False)  # dies before the commit
    assert [r.id for r in log.read("id long").orderBy("id").collect()] == [1, 2]
    assert log.write(rows(3), 1)  # the replay
    assert not log.write(rows(3, 4), 1) and not log.write(rows(5), 0)
    assert [(r.id, r.batch) for r in log.read("id long").orderBy("id").collect()] == [(1, 0), (2, 0), (3, 1)]
    assert log.named("plan", "a") == "a" and log.named("plan", "b") == "a"


def test_a_job_that_dies_between_write_and_commit(spark, tmp_path, monkeypatch):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    write(spark.range(0, 50).coalesce(1), source)
    stream = lambda: jobs.file_stream(spark, source, "id long")
    run = lambda: jobs.resume_incremental(stream(), ["id"], "p", out, log, spark.range(0, 5)).awaitTermination()
    whole = jobs.CommitLog.write

    def dying(self, rows, number, commit=True):
        whole(self, rows, number, commit=False)
        raise RuntimeError("lost")

    monkeypatch.setattr(jobs.CommitLog, "write", dying)
    with pytest.raises(Exception, match="lost"):
        run()
    read = lambda: sorted(r.id for r in jobs.CommitLog(spark, out).read("id long").collect())
    assert read() == []
    monkeypatch.setattr(jobs.CommitLog, "write", whole)
    run()
    assert read() == list(range(5, 50))
    write(spark.range(40, 60).coalesce(1), source)  # ten keys were done before
    run()
    run()
    assert read() == list(range(5, 60))
    with pytest.raises(ValueError):
        jobs.resume_incremental(stream(), ["id"], "another", out, log)


def test_live_counts_write_changed_keys_only(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    run = lambda: jobs.live_counts_stream(jobs.file_stream(spark, source, "k long"), "k", out, log).awaitTermination()
    for ids in ([1, 1, 2], [2, 3], [3, 3, 3]):
        write(spark.createDataFrame([(i,) for i in ids], "k long").coalesce(1), source)
        run()
    assert {r.k: r.n for r in jobs.counts_now(spark, out, "k long, n long").collect()} == {1: 2, 2: 2, 3: 4}
    batches = jobs.CommitLog(spark, out).read("k long, n long").groupBy("batch").agg(F.array_sort(F.collect_list("k")).alias("k"))
    assert [r.k for r in batches.orderBy("batch").collect() if r.k] == [[1, 2], [2, 3], [3]]


def test_generation_guard_with_negative_orders(spark, tmp_path):
    r = random.Random(8)
    rows = [(at, r.randrange(6) if at % 2 else 0, r.choice(["start", "start", "finish", "finish", "fail", "other"]), r.randrange(3)) for at in range(-600, 600, 3)]
    schema = "at long, k long, kind string, gen long"
    expected, state = set(), {}
    for at, k, kind, gen in sorted(rows):
        started, failed = state.get(k, (None, None))
        if kind == "start":
            state[k] = ((at, gen), failed)
        elif kind == "fail":
            state[k] = (started, at)
        elif kind == "finish" and started and started[1] == gen and (failed is None or failed < started[0]):
            expected.add(at)
    assert any(at < 0 for at in expected)
    frame = spark.createDataFrame(rows, schema)
    for limits in ({}, {"most": 10, "share": 1000}):
        assert {x.at for x in jobs.generation_guard(frame, "k", ["at"], "kind", "gen", **limits).collect()} == expected
    out = str(tmp_path / "guard")
    for low, high in ((-600, -100), (-100, 200), (200, 600)):
        part = [x for x in rows if low <= x[0] < high]
        r.shuffle(part)
        write(spark.createDataFrame(part, schema).repartition(4), f"{out}/in")
        stream = jobs.file_stream(spark, f"{out}/in", schema, files_per_trigger=1000)
        kept = jobs.drained(jobs.generation_guard_stream(stream, "k", "at", "kind", "gen"), spark, "append", out)
    assert sorted(x.at for x in kept.collect()) == sorted(expected)
