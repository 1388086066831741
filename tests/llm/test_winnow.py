import hashlib

from pyspark.sql import functions as F
import xxhash

from cairnlake.llm import winnow

K, W = 8, 8


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute_prints(text):
    data = (text or "").encode()
    if not data:
        return []
    grams = [data[i : i + K] for i in range(max(1, len(data) - K + 1))]
    hashes = [signed(xxhash.xxh64_intdigest(g, 42)) >> 20 for g in grams]
    out = []
    for i in range(max(1, len(hashes) - W + 1)):
        window = hashes[i : i + W]
        at = i + max(j for j, h in enumerate(window) if h == min(window))
        if (hashes[at], at) not in out[-1:]:
            out.append((hashes[at], at))
    return out


def brute(rows):
    """rows in order of id, then of the text's hash as a signed number."""
    rows = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    out = []
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        own, changed, ahead = ({h for h, _ in brute_prints(t)} for t in (text, edited, following))
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), like(own, changed), like(own, ahead)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r[0], r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in df.collect()), key=repr)


def test_positions_and_blocks(spark, rows):
    texts = [(t,) for t in {r[1] for r in rows if r[1]}] + [("a" * 40,), ("ab" * 30,)]
    frame = spark.createDataFrame(texts, "text string")
    for block in (4096, 5):
        got = frame.select("text", winnow.prints(F.col("text"), K, W, block).alias("p")).collect()
        for r in got:
            assert [(p["hash"], p.position) for p in r.p] == brute_prints(r.text)


def test_fixture(docs, rows):
    assert result(winnow.compare_with_edits(docs)) == brute(rows)
    assert result(winnow.compare_with_edits(docs, rows_per_range=2)) == brute(rows)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = winnow.compare_with_edits(docs, rows_per_range=50)
    assert result(found) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    by_text = found.join(docs.select("doc_id", "text"), "doc_id").groupBy("text").agg(F.count_distinct("fingerprint").alias("n"))
    assert by_text.where("n <> 1").count() == 0
    assert found.where("near_edited > near_next").count() > 0.95 * found.count()


def test_hot_ids_and_missing_ids_are_split(spark):
    """Half of all rows share an id, a quarter has none; every row still meets the one that follows."""
    rows = [(5, f"the same id {i * 7919 % 1000} and a text of its own {i}") for i in range(400)] + [(None, f"no id {i} at all {i * i}") for i in range(200)] + [(i, f"text number {i}") for i in range(10, 110)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(winnow.compare_with_edits(frame, rows_per_range=16)) == brute(rows)
    parts = winnow.in_ranges(frame, "doc_id", "text", rows_per_range=16).groupBy("part").count().collect()
    assert max(r["count"] for r in parts) < 64 and len(parts) > 30


def test_positions_let_matches_be_placed(spark):
    shared = "a passage that two texts share"
    frame = spark.createDataFrame([(1, "before it " + shared), (2, shared + " and after it"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in winnow.fingerprints(frame).collect()}
    a, b = ({p["hash"]: p.position for p in found[i].prints} for i in (1, 2))
    common = set(a) & set(b)
    assert common and all(a[h] - b[h] == 10 for h in common)
    assert found[3].prints == [] and len(found[1].fingerprint) == 32
    by_edit = {r.doc_id: r for r in winnow.compare_with_edits(frame).collect()}
    assert all(by_edit[i].fingerprint == found[i].fingerprint and by_edit[i].prints == found[i].prints for i in (1, 2, 3))


def test_edits_one_by_one(spark):
    text = "the quick brown fox jumps over the lazy dog and the quick cat, the quick brown fox"
    pairs = [(text[:n], text[:n][: n - q] + tail) for n in range(len(text)) for q in (0, 1, n // 4, n) if q <= n for tail in ("", "x", text[: q + 3])]
    pairs = [(a, a[:m], b) for a, b in pairs for m in [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))]]
    frame = spark.createDataFrame(pairs, "text string, kept string, edited string").repartition(8)
    own = winnow.prints(F.col("text"))
    rows = frame.select("edited", winnow.prints_after_edit(own, F.encode("kept", "UTF-8"), F.encode("edited", "UTF-8")).alias("p")).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        assert [(p["hash"], p.position) for p in r.p] == brute_prints(r.edited)


def test_empty(empty):
    assert winnow.compare_with_edits(empty).count() == 0
