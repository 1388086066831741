import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnlake.llm import packing
from cairnlake.llm.words import spread, tokenizer_path


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return [np.array(e.ids + [2], "<u4").tobytes() for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, pieces, capacity=4096):
    """Every id in exactly one piece of its document, sequences gapless, and padded by nothing."""
    expected = defaultdict(list)
    for r, ids in zip(rows, library([r[1] for r in rows])):
        expected[r[0]].append(ids)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(expected)
    for doc, all_ids in expected.items():
        own = by_doc[doc]
        if len(all_ids) == 1:
            ids, at = all_ids[0], 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids) // 4 and p.length > 0
                assert p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
                at += p.length
            assert 4 * at == len(ids)
        else:
            assert sum(p.length for p in own) == sum(map(len, all_ids)) // 4
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)


def test_fixture(docs, rows):
    check(rows, packing.pack(docs).collect())
    check(rows, packing.pack(docs, bytes_per_group=500, cache_limit=50).collect())


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], packing.pack(docs, bytes_per_group=60_000).collect())


def test_empty(empty):
    assert packing.pack(empty).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 60))]
        bins = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            for b in bins:
                if sum(sizes[j] for j in b) + sizes[i] <= 100:
                    b.append(i)
                    break
            else:
                bins.append([i])
        assert packing.first_fit_decreasing(sizes, 100) == bins


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30) | st.text("aB'é<|>1,ß×İſK\u0301 \t", max_size=30), max_size=5))
def test_ids_of_any_text(texts):
    for text, ids in zip(texts, library(texts)):
        assert CODER.encode(text.encode()) == ids[:-4]


CODER = packing.ChunkIds(tokenizer_path("word_bpe_49k.json"), 500)


def test_repeated_rows_are_dealt_over_groups(spark):
    rows = [(1, "again and again " * 50)] * 400 + [(None, None)] * 300 + [(i, f"text {i}") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, packing.pack(frame, bytes_per_group=9_000).collect())
    group, _, placed = spread(frame, "doc_id", "text", 9_000, 17)
    assert placed
    assert max(r["count"] for r in frame.groupBy(group).count().collect()) < 200


def test_what_groups_leave_over_is_packed_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = defaultdict(int)
    for p in packing.pack(docs, bytes_per_group=30_000).collect():
        sizes[p.sequence_id] += p.length
    short = [n for n in sizes.values() if n < 4096]
    assert len(sizes) > 20 and len(short) == len(set(short)) and sum(short) < 4096


def test_held_chunks_are_bounded_by_bytes():
    held = packing.ChunkIds(tokenizer_path("word_bpe_49k.json"), room=100_000)
    for i in range(3000):
        chunk = (f"w{i}x" + "字" * (i % 120)).encode()
        assert held[chunk] == held.fresh(chunk)
    size = lambda d: sum(len(k) + len(v) + 150 for k, v in d.items())
    assert size(held) <= 101_000 and size(held.older) <= 101_000
    before = len(held)
    assert held["字".encode() * 4000] and len(held) == before
