"""Whole tables against plain loops, for queries that have no SQL, and for paths that small tables do not take."""

import math
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import keys
from cairnlake.operators import greedy, quality, ranges
from cairnlake.plans import flow_queries
from cairnlake.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def walk(start, doors, last_depth=8):
    """Breadth first through doors; rooms deeper than last_depth are not searched."""
    if start[0] is None:
        return None, 0
    queue, seen = deque([(*start, 0)]), {start[0]}
    while queue:
        room, x, y, z, depth = queue.popleft()
        if depth > last_depth:
            continue
        ways = sorted(doors[room], key=lambda d: (round(math.dist((x, y, z), d[1:4]), 6), d[0]))
        for key, _, _, _, dest, dx, dy, dz in ways:
            if dest is None:
                return key, depth + 1
            if dest not in seen:
                seen.add(dest)
                queue.append((dest, dx, dy, dz, depth + 1))
    return None, None


def test_exit_anchor_over_the_tables(spark):
    n = table(spark, "orders").count()
    rooms = max(300, n // 5)
    doors = defaultdict(list)
    for (k,) in table(spark, "orders").select("o_orderkey").collect():
        doors[k % rooms].append((f"d{k:09d}", k * 17 % 1000, 0, 0, None if k % 23 == 0 else (k * 7 + 11) % rooms, k % 500, 0, 0))
    expected = {}
    for k, x in table(spark, "customer").select("c_custkey", "c_acctbal").collect():
        expected[k] = walk((None if k % 10 == 0 else k % rooms, x, 0.0, 0.0), doors)
    found = flow_queries.R.queries["t1_exit_anchor"](spark, FOLDER).collect()
    assert {r.id: (r.door, r.steps) for r in found} == expected
    assert len({s for _, s in expected.values()}) > 2


def picked(rows, metrics, quota, k):
    """rows: (id, direction, pinned, *metrics), all of them; the rounds over whole rankings."""
    chosen = sorted(r[0] for r in rows if r[2])
    have = set(chosen)
    for d in sorted({r[1] for r in rows}, key=str):
        part = [r for r in rows if r[1] == d]
        ranked = [[r[0] for r in sorted(part, key=lambda r: (-r[3 + i], r[0]))] for i in range(metrics)]
        n = sum(r[0] in have for r in part)
        while n < quota and any(i not in have for ranking in ranked for i in ranking):
            for ranking in ranked:
                i = next((i for i in ranking if i not in have), None)
                if i is not None and n < quota:
                    have.add(i)
                    chosen.append(i)
                    n += 1
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        if len(chosen) < k and r[0] not in have:
            have.add(r[0])
            chosen.append(r[0])
    return list(enumerate(chosen[:k]))


def test_multi_metric_pick_over_the_table(spark):
    lines = defaultdict(list)
    for o, n, *values in table(spark, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity", "l_discount").collect():
        lines[o * 10 + n].append(values)
    rows = [(i, min(v[0] for v in vs), i % 30011 == 7, *[max(v[j] for v in vs) for j in (1, 2, 3)]) for i, vs in lines.items()]
    found = flow_queries.R.queries["g9_multi_metric_pick"](spark, FOLDER).collect()
    assert sorted((r.place, r.id) for r in found) == picked(rows, 3, 8, 40)


@pytest.mark.parametrize("pinned", [0, 3, 30, 200])
def test_pins_of_any_number(spark, pinned):
    rows = [(i, "abc"[i % 3], i % 7 == 3 and i < 7 * pinned, float(i * 37 % 101), float(i * 53 % 97)) for i in range(1500)]
    frame = spark.createDataFrame(rows, "id long, d string, pin boolean, a double, b double")
    found = greedy.multi_metric_pick(frame, "id", "d", ["a", "b"], F.col("pin"), 5, 25).collect()
    assert sorted((r.place, r.id) for r in found) == picked(rows, 2, 5, 25)


def test_next_fit_parts_over_the_table(spark):
    found = flow_queries.R.queries["g11_next_fit_parts"](spark, FOLDER).collect()
    group, order = found[0].__fields__[:2]
    by_group = defaultdict(list)
    for r in found:
        by_group[r[group]].append(r)
    parts = set()
    cap = 20_000
    for items in by_group.values():
        used, part = 0, 0
        for r in sorted(items, key=lambda r: r[order]):
            if used + r.padded > cap:
                used, part = 0, part + 1
            used += r.padded
            assert r.part == part
        parts.add(part)
    assert len(parts) > 1 and len(found) == table(spark, "lineitem").count()


def test_floors_among_many_thresholds(spark):
    steps = sorted({(i * 7919 % 100_003) / 7 for i in range(3000)})
    frame = spark.createDataFrame([(i, float(i * 31 % 16_000) - 500) for i in range(500)] + [(1000 + i, x) for i, x in enumerate(steps[::500])] + [(2000, None)], "id long, x double")
    few = spark.createDataFrame([(x,) for x in steps] * 2 + [(None,)], "t double")
    expected = {r.id: max((s for s in steps if r.x is not None and s <= r.x), default=None) for r in frame.collect()}
    for limit in (1000, 7, 10_000):
        assert {r.id: r.floor for r in ranges.threshold_floor(frame, "x", few, "t", few=limit).collect()} == expected, limit


def test_set_digest_counts_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    one, other = quality.set_digest(df).first(), quality.set_digest(df.distinct()).first()
    assert one.digest != other.digest and (one.n, other.n) == (3, 2)
    assert quality.set_digest(df.repartition(5).orderBy("v")).first() == one
    assert quality.set_digest(df.limit(0)).first().n == 0


def test_state_of_a_stream_is_merged_and_replayed(spark, tmp_path):
    rows = [(i % 40, i, i % 9 == 0, i) for i in range(400)]
    schema = "k long, at long, gone boolean, seq long"
    for n in range(5):
        spark.createDataFrame(rows[n * 80 : n * 80 + 80], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rule = (["k"], "at", "gone", "seq")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
    jobs.lww_stream(stream, *rule, f"{tmp_path}/state", f"{tmp_path}/log", merge_every=2).awaitTermination()
    expected = sorted(map(tuple, jobs.lww_merge(None, spark.createDataFrame(rows, schema), *rule).collect()))
    state = lambda: sorted(tuple(r[c] for c in ("k", "at", "gone", "seq")) for r in jobs.lww_state(spark, f"{tmp_path}/state", *rule, schema).collect())
    assert state() == sorted((r[0], r[1], r[2], r[3]) for r in expected)
    assert jobs._numbered(spark, f"{tmp_path}/state", "base") and len(jobs._numbered(spark, f"{tmp_path}/state", "change")) == 5
    assert jobs.lww_state(spark, f"{tmp_path}/none", *rule, schema).count() == 0


def test_folding_of_names(spark):
    forms = [" Straße ", "STRASSE", "Σίσυφος", "ΣΊΣΥΦΟΣ", "É", "é\t"]
    found = [r[0] for r in spark.createDataFrame([(f,) for f in forms], "w string").select(keys.casefold(F.col("w"))).collect()]
    assert found == [f.strip().casefold() for f in forms]


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from cairnlake.plans import checkpoints

    class Context:
        master, folder = "spark://somewhere", None
        getCheckpointDir = lambda self: self.folder
        setCheckpointDir = lambda self, d: setattr(self, "folder", d)

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        checkpoints.use_checkpoint_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "/shared"}
    assert checkpoints.use_checkpoint_dir(Session()) == "/shared"
