import random
import re

import xxhash
from pyspark.sql import functions as F

from cairnlake.llm import simhash


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """pairs: (id, fingerprint) -> sorted (id, smallest reachable)."""
    parent = list(range(len(pairs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, fp, least.get(find(i))) for i, (doc, fp) in enumerate(pairs)), key=repr)


def result(df):
    return sorted(((r[0], r.fp & (1 << 64) - 1, r.component_id) for r in df.collect()), key=repr)


def test_fixture(docs, rows):
    expected = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows])
    assert result(simhash.near_duplicates(docs)) == expected


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert result(simhash.near_duplicates(docs)) == brute_components([(r[0], brute_fingerprint(r[1])) for r in rows])
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {r[0] for r in brute_components([(r[0], brute_fingerprint(r[1])) for r in rows]) if r[0] == r[2]}


def test_links_of_crowded_and_plain_buckets(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):  # clouds around centres, chains, and noise
        c = rng.getrandbits(64)
        for _ in range(25):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    for _ in range(3):
        x = rng.getrandbits(64)
        for _ in range(20):
            x ^= sum(1 << b for b in rng.sample(range(64), 4))
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    expected = [r[2] for r in sorted(brute_components(list(enumerate(fps))))]
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    frame = spark.createDataFrame(signed, "id long, fp long")
    of = dict(signed)
    back = {f: i for i, f in signed}
    for hot in (8192, 20, 3, 1):
        got = list(range(len(fps)))
        edges = [(back[r.u], back[r.v]) for r in simhash.links(frame.select("fp"), hot).collect()]
        for u, v in edges:
            assert ((of[u] ^ of[v]) & (1 << 64) - 1).bit_count() <= 4
        changed = True
        while changed:
            changed = False
            for u, v in edges:
                m = min(got[u], got[v])
                changed |= got[u] != m or got[v] != m
                got[u] = got[v] = m
        assert got == expected, hot


def test_keep_one_keeps_rows_without_id(docs):
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert kept.count(None) == 1 and kept.count(11) == 1 and 3 not in kept and 1 in kept


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_hash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_one_fingerprint_in_half_of_all_rows(spark):
    """Copies, empty texts and a cloud of near copies around them."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base)) for i in range(600)] + [(600 + i, None) for i in range(200)]
    rows += [(1000 + i, " ".join(base[:i] + ["other"] + base[i + 1 :])) for i in range(100)] + [(2000 + i, f"text {i} of its own kind {i * i}") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    fps = [(i, simhash.fingerprint(None if t is None else t.encode())) for i, t in rows]
    assert sorted((i, f, c) for i, (f, c) in found.items()) == sorted((i, f, c) for i, f, c in brute_components(fps))
