import hashlib
import re
from collections import Counter

from cairnlake.llm import substring
from cairnlake.llm.words import spread


def brute(rows, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, *_), w in zip(rows, words):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_fixture_with_blocks_and_rows_of_the_sketch(docs, rows):
    expected = brute(rows)
    assert any(r[2] for r in expected)
    kept = substring.remove_repeats(docs)
    assert kept.columns == [*docs.columns, "kept_text", "n_words_", "n_removed"]  # the fixture has an n_words of its own
    assert sorted(((r.doc_id, r.n_words_, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in kept.collect()), key=repr) == expected
    frame = docs.drop("n_words")
    # several groups and blocks; a sketch so narrow that it flags nearly everything; one row and three rows of counters
    for options in ({}, {"least_blocks": 4, "cell_bits": 10}, {"depth": 1}, {"depth": 3, "cell_bits": 12}, {"bytes_per_block": 100}):
        assert result(substring.digest_columns(substring.remove_repeats(frame, bytes_per_group=600, **options))) == expected, options


def test_clashing_names(docs, rows):
    names = {"grp": "1", "kept_text": "'k'", "n_removed": "2", "block": "3", "home": "4", "payload": "5", "grp_": "6"}
    more = docs.selectExpr("*", *[f"{v} as {k}" for k, v in names.items()])
    kept = substring.remove_repeats(more, bytes_per_group=600)
    assert kept.columns == [*more.columns, *substring.result_names(more)] == [*more.columns, "kept_text_", "n_words_", "n_removed_"]
    found = kept.collect()
    assert sorted(((r.doc_id, r.n_words_, r.n_removed_, hashlib.sha256(r.kept_text_.encode()).hexdigest()) for r in found), key=repr) == brute(rows)
    assert {(r.grp, r.kept_text, r.n_removed, r.block) for r in found} == {(1, "k", 2, 3)}


def test_many_repeated_rows(spark):
    text = " ".join(f"q{i}" for i in range(60))
    rows = [(7, text)] * 300 + [(None, None)] * 200 + [(i, f"{i} " * 20) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(substring.digest_columns(substring.remove_repeats(frame, bytes_per_group=4_000))) == brute(rows)


def test_steps_agree_whatever_the_order_of_rows():
    texts = [" ".join(f"w{(i * 7 + j) % 90}" for i in range(100 + j)).encode() for j in range(6)] + [None, b"", b"x"]
    args = (35, 30, 2, 256)
    flags = substring.Group(texts, *args).repeated({})
    back = {block: data for block, _, data in substring.Group(texts, *args).exact(3, flags) if block < 0}
    one = substring.Group(texts, *args)
    other = substring.Group(texts[::-1], *args)
    a = dict(zip([texts[i] for i in one.order], one.covered(back, 3)))
    b = dict(zip([texts[::-1][i] for i in other.order], other.covered(back, 3)))
    assert {t: m is None or m.tolist() for t, m in a.items()} == {t: m is None or m.tolist() for t, m in b.items()}


def test_the_sketch_never_underestimates():
    import numpy as np

    texts = [" ".join(f"w{i * j % 50}" for i in range(90)).encode() for j in range(8)] * 2
    group = substring.Group(texts, 35, 12, 2, 4)
    flags = group.repeated({})
    seen = Counter(tuple(d.words[i : i + 35]) for d in group.docs for i in range(d.windows))
    true = np.array([seen[tuple(d.words[i : i + 35])] > 1 for d in group.docs for i in range(d.windows)])
    assert (flags | ~true).all()


def test_table(spark):
    from cairnlake.llm.queries import op4_substring_dedup

    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op4_substring_dedup(spark, path)) == brute(rows)


def test_empty(empty):
    assert substring.remove_repeats(empty).count() == 0


def test_planes_round_trip():
    import numpy as np

    for values in ([], [0], [5, 6, 300, 1 << 37], list(range(1000))):
        x = np.array(values, np.uint64)
        assert (substring._unplanes(substring._planes(x), len(x)) == x).all()


def test_repeated_rows_dealt_by_places_are_cut(spark, tmp_path):
    """Rows that repeat id and text are more than a group: groups follow places, and lineage is cut before they are read."""
    hot, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    frame = spark.createDataFrame([(7, hot, i) for i in range(4000)] + [(8, other, -1)], "doc_id long, text string, n int").repartition(5, "n")
    group, _, placed = spread(frame, "doc_id", "text", 20_000, 29)
    assert placed and frame.withColumn("g", group).where("doc_id = 7").select("g").distinct().count() > 5
    found = substring.remove_repeats(frame, bytes_per_group=20_000)
    assert found.count() == 4001
    assert found.select("n").distinct().count() == 4001
    assert {(r.doc_id, r.n_words, r.n_removed) for r in found.select("doc_id", "n_words", "n_removed").distinct().collect()} == {(7, 50, 50), (8, 50, 0)}
    long = spark.createDataFrame([(1, hot * 900)] + [(i, other) for i in range(2, 60)], "doc_id long, text string")
    assert not spread(long, "doc_id", "text", 20_000, 29)[2]  # one long text is no such case
