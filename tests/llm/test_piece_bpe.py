import hashlib
import time

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnlake.llm import piece_bpe, queries
from cairnlake.llm.words import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODER = piece_bpe.PieceEncoder(PATH, cache_bytes=30_000)
END = LIBRARY.eos_id()


def expected(text):
    ids = LIBRARY.encode(text or "", add_eos=True)
    numbers = " ".join(map(str, ids))
    return len(ids), hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def result(docs):
    found = piece_bpe.digest_columns(piece_bpe.decode(piece_bpe.encode(docs, bytes_at_once=500), bytes_at_once=500))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_fixture(docs, rows):
    assert result(docs) == sorted(((r[0], *expected(r[1])) for r in rows), key=repr)


def test_clashing_columns(docs, rows):
    odd = docs.withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    assert result(odd) == sorted(((r[0], *expected(r[1])) for r in rows), key=repr)


def test_query_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = sorted(tuple(r) for r in queries.op11_sentencepiece(spark, "/root/testdata/sf0.001").collect())
    assert found == sorted((r.doc_id, *expected(r.text)) for r in docs.collect())


def test_empty(empty):
    assert piece_bpe.decode(piece_bpe.encode(empty)).count() == 0


def test_null_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [END]), (4, [LIBRARY.unk_id(), 259, 260])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in piece_bpe.decode(rows).collect()} == {1: "", 2: "", 3: "", 4: LIBRARY.decode([LIBRARY.unk_id(), 259, 260])}


@settings(max_examples=500, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab \n▁.,e0", max_size=60), st.sampled_from([1, 7, 1_000_000]))
def test_any_text(text, at_once):
    ids = LIBRARY.encode(text, add_eos=True)
    assert CODER.encode(text, at_once).tolist() == ids
    assert CODER.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 300), max_size=12))
def test_any_ids(ids):
    assert CODER.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("unit", [" ", "a", "aA", "=", "ab", "0", "un", "the"])
def test_runs(unit):
    for n in range(70):
        assert CODER.encode(unit * n + "x").tolist() == LIBRARY.encode(unit * n + "x", add_eos=True)


def test_long_text_without_spaces_takes_linear_time():
    began = time.time()
    for text in ("ab" * 100_000, "的一是不了人我" * 20_000, hashlib.sha256(b"x").hexdigest() * 3_000):
        assert CODER.encode(text).tolist() == LIBRARY.encode(text, add_eos=True)
    assert time.time() - began < 20
    assert CODER.used <= CODER.room


def test_neighbours_are_compatible():
    ids = CODER.encode("unbelievable internationalisation of strengths")[:-1]
    assert all(CODER.merged(CODER.pieces[a] + CODER.pieces[b]) == [a, b] for a, b in zip(ids, ids[1:]))


@settings(max_examples=2000, deadline=None)
@given(st.integers(259, 31_999), st.integers(259, 31_999) | st.integers(28_700, 29_000))
def test_compatible_is_merging_both_again(left, right):
    if CODER.merged(CODER.pieces[left]) == [left] and CODER.merged(CODER.pieces[right]) == [right]:
        assert CODER.compatible(left, right) == (CODER.merged(CODER.pieces[left] + CODER.pieces[right]) == [left, right])
