import numpy as np
import pytest

from cairnlake.llm import ann


def brute(rows, every=50, k=5):
    """rows: (id, vector) -> {query: [(id, score)]} by exact cosines."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = np.einsum("ij,j->i", x, x[i]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[i]))
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[i]), key=lambda j: (-s[j], ids[j]))[:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_on_a_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    expected = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    got = {}
    for r in ann.nearest(vectors).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(expected)
    hits = sum(len({v for v, _ in e} & {v for v, _ in got[q].values()}) for q, e in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))
    scores = {q: dict(brute_scores) for q, brute_scores in expected.items()}
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, len(ranks) + 1))
        found = [ranks[i] for i in sorted(ranks)]
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        for v, s in found:
            assert v != q and (v not in scores[q] or s == pytest.approx(scores[q][v], abs=1e-12))


def found_by(frame, **options):
    got = {}
    for r in ann.nearest(frame, **options).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def test_copies_gaps_and_ties(spark):
    rng = np.random.default_rng(3)
    copy = rng.normal(size=5).tolist()
    rows = [(i, copy) for i in range(40)] + [(100 + i, rng.normal(size=5).tolist()) for i in range(30)]
    bad = [(50, None), (150, [0.0] * 5), (200, [1.0, None, 0.0, 0.0, 0.0]), (250, [float("nan"), 1.0, 0.0, 0.0, 0.0]), (300, [float("inf"), 1.0, 0.0, 0.0, 0.0]), (350, [1.0, 2.0]), (None, copy)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows + bad + rows[:3]], "vec_id long, embedding array<float>, score string")
    expected = brute([(i, np.array(v, np.float32)) for i, v in rows], every=10)
    for options in ({"scout": 10**6}, {"scout": 10**6, "rows_per_block": 7}, {"miss": 1e-9}):
        got = found_by(frame, every=10, **options)
        assert {q: [v for _, v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in expected.items()}


@pytest.mark.parametrize("n", [1, 2, 4, 31, 300])
def test_defaults_give_every_query_as_many_as_there_are(spark, n):
    """Few rows, and a query that lies opposite to all others."""
    rng = np.random.default_rng(n)
    rows = [(i + 1, (np.eye(16)[0] * 3 + rng.normal(size=16) / 4).tolist()) for i in range(n - 1)] + [(50, (-np.eye(16)[0]).tolist())]
    rows = [r for r in rows[:-1] if r[0] != 50] + rows[-1:]
    got = found_by(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    expected = brute(rows)
    assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in expected.items() if x}
    assert [v for _, v, _ in got.get(50, [])] == [v for v, _ in expected[50]]  # far from all: every cell was looked into
    for q, x in got.items():
        assert [r for r, _, _ in x] == list(range(1, len(x) + 1))


def test_rows_of_one_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [1.0, 0.1]), (7, [0.1, 1.0]), (8, [1.0, 1.0])]
    got = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((r["rank"], r.vec_id) for r in ann.nearest(got).collect())
    assert found == [(1, 7), (1, 7), (2, 8), (2, 8)]


def test_chances_are_those_of_random_vectors():
    rng = np.random.default_rng(1)
    q, s = rng.normal(size=64), 0.45
    q /= np.linalg.norm(q)
    g = rng.normal(size=(50_000, 64))
    g -= np.outer(g @ q, q)
    x = s * q + np.sqrt(1 - s * s) * g / np.linalg.norm(g, axis=1, keepdims=True)
    met = np.bincount(np.concatenate([x, -x], axis=1).argmax(axis=1), minlength=128) / len(x)
    assert np.abs(ann.axis_chances(q[None], np.array([s]), 64)[0] - met).max() < 0.02


def test_long_vectors(spark):
    """200 components: hashed by 64 of the 256 coordinates of the rotated form."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=200).tolist()) for i in range(1500)]
    got = found_by(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    expected = brute(rows)
    assert sum(len({v for _, v, _ in got[q]} & {v for v, _ in e}) for q, e in expected.items()) >= 0.9 * 5 * len(expected)


def test_nearer_neighbours_need_fewer_cells():
    x = np.random.default_rng(2).normal(size=(20, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = [ann.further_cells(x, np.full(20, s), 4, 0.1, 256, 11).sum() for s in (0.45, 0.6, 0.8, 0.95)]
    assert cells == sorted(cells, reverse=True) and cells[-1] < cells[0] / 100
    assert ann.further_cells(x, np.full(20, np.nan), 4, 0.1, 256, 11).sum() == 20 * 128 * 128


def test_empty(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
