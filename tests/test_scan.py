"""Running states in blocks against plain loops, with one key that holds half of all rows, null keys and null values."""

import random

import pytest

from pyspark.sql import functions as F

from cairnlake.operators import merge, scan, userdata

SCHEMA = "k long, at long, v long, tag string, claim long"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = []
    for i in range(3000):
        k = 7 if r.random() < 0.5 else r.choice([None, 1, 2, *range(10, 200)])
        out.append((k, i, r.choice([None, r.randrange(50)]), r.choice("mmpttto"), r.randrange(3)))
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_key(rows):
    found = {}
    for row in sorted(rows, key=lambda r: r[1]):
        found.setdefault(row[0], []).append(row)
    return found


LIMITS = [{"most": 10_000}, {"most": 20, "share": 1000}, {"most": 0, "share": 10**9}]


@pytest.mark.parametrize("limits", LIMITS)
def test_states(frame, rows, limits):
    s = scan.Scan(frame, ["k"], ["at"], **limits)
    assert bool(s.heavy) == (limits["most"] < 10_000)
    s = s.add(n=scan.total(F.lit(1)), most=scan.highest("v"), least=scan.lowest("v", back=True), known=scan.latest("v", before=True), begun=scan.earliest("v"), ended=scan.earliest("v", back=True), prev=scan.previous("v"), nxt=scan.following("v"))
    got = {r.at: r for r in s.add(two=scan.previous("prev")).rows.collect()}
    assert len(got) == len(rows)
    for key, own in by_key(rows).items():
        values = [r[2] for r in own]
        for i, row in enumerate(own):
            g, before, after = got[row[1]], values[:i], values[i + 1 :]
            solid = lambda vs: [v for v in vs if v is not None]
            assert (g.k, g.n, g.begun, g.ended) == (key, i + 1, values[0], values[-1])
            assert g.most == max(solid([*before, row[2]]), default=None) and g.least == min(solid([row[2], *after]), default=None)
            assert g.known == (solid(before) or [None])[-1]
            assert (g.prev is None, g.nxt is None) == (i == 0, i == len(own) - 1)
            assert i == 0 or g.prev.v == values[i - 1]
            assert i < 2 or g.two.prev.v == values[i - 2]
            assert not after or g.nxt.v == after[0]


def test_without_keys(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 v").repartition(13)
    got = scan.Scan(df, [], ["id"], most=10).add(n=scan.total("v")).rows.collect()
    assert {r.id: r.n for r in got} == {i: sum(j % 7 for j in range(i + 1)) for i in range(1000)}


def test_empty(frame):
    assert scan.Scan(frame.limit(0), ["k"], ["at"], most=0).add(n=scan.total("v")).rows.count() == 0


def plain_groups(own):
    """The groups as a reader of one record after the other forms them."""
    tags, out, i, grp = [r[3] for r in own], {}, 0, 0
    while i < len(own) and tags[i] not in "mp":
        out[own[i][1]] = (0, None)
        i += 1
    open_group = None
    while i < len(own):
        if tags[i] == "m":
            grp += 1
            open_group = grp
            led = i >= 2 and tags[i - 2 : i] == ["p", "t"]
            out[own[i][1]] = (grp, "identity_mismatch" if led and own[i - 2][4] != own[i][2] else None)
        elif tags[i] == "p":
            open_group = None
            target = i + 1 < len(own) and tags[i + 1] == "t"
            leads = target and i + 2 < len(own) and tags[i + 2] == "m"
            out[own[i][1]] = (grp + 1 if leads else None, None if target else "prefix_without_target")
            if target:
                i += 1
                out[own[i][1]] = (grp + 1 if leads else None, None)
        else:
            out[own[i][1]] = (open_group, None)
        i += 1
    return out


@pytest.mark.parametrize("limits", LIMITS)
def test_marker_groups_with_prefixes(frame, rows, limits):
    tag = lambda t: F.col("tag") == t
    got = merge.marker_groups(frame, ["k"], ["at"], tag("m"), tag("p"), tag("t"), F.col("v"), F.col("claim"), **limits).collect()
    expected = {at: g for own in by_key(rows).values() for at, g in plain_groups(own).items()}
    assert {r.at: (r.grp, r.problem) for r in got} == expected
    assert {p for _, p in expected.values()} == {None, "identity_mismatch", "prefix_without_target"}
    plain = merge.marker_groups(frame, ["k"], ["at"], tag("m"), **limits).collect()
    assert all(r.grp == sum(o[3] == "m" for o in by_key(rows)[r.k] if o[1] <= r.at) for r in plain)


@pytest.mark.parametrize("limits", LIMITS)
def test_monotonic_time_of_a_hot_user(spark, limits):
    r = random.Random(2)
    rows = [(7 if i % 2 else i % 40, i, r.randrange(300)) for i in range(2000)]
    got = {x.at: x.t for x in userdata.monotonic_time(spark.createDataFrame(rows, "k long, at long, given long"), "k", ["at"], "given", "t", **limits).collect()}
    last = {}
    for k, at, given in rows:
        last[k] = max(given, last[k] + 1) if k in last else given
        assert got[at] == last[k]


@pytest.mark.parametrize("limits", LIMITS)
def test_the_other_users_of_scans(frame, rows, limits):
    flagged = frame.withColumn("gone", F.col("tag") == "p")
    got = merge.override_counters(flagged, "k", ["at"], "gone", **limits).first()
    overrides = sum(own[i][3] != "p" and own[i - 1][3] != "p" for own in by_key(rows).values() for i in range(1, len(own)))
    assert tuple(got) == (len(rows), sum(own[-1][3] != "p" for own in by_key(rows).values()), overrides, sum(x[3] == "p" for x in rows))
    paired = {x.at: x.paired for x in merge.pair_consecutive(frame, ["k"], ["at"], "tag", "v", "m", "t", **limits).collect()}
    for own in by_key(rows).values():
        own = [x for x in own if x[3] in "mt"]
        for i, x in enumerate(own):
            if x[3] == "m":
                assert paired[x[1]] == (own[i + 1][2] if i + 1 < len(own) and own[i + 1][3] == "t" else None)
