import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairnlake.llm import bpe_trie
from cairnlake.llm.words import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    back = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def result(docs):
    return sorted((tuple(r) for r in bpe_trie.digest_columns(bpe_trie.encode(docs, bytes_at_once=500)).collect()), key=repr)


def test_fixture(docs, rows):
    assert result(docs) == sorted(((r[0], *expected(r[1])) for r in rows), key=repr)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(docs) == sorted(((r.doc_id, *expected(r.text)) for r in docs.collect()), key=repr)


def test_empty(empty):
    assert bpe_trie.encode(empty).count() == 0


CODER = bpe_trie.TrieEncoder(PATH, limit=2000)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=6))
def test_any_text(texts):
    texts = texts + [t + "<|endoftext|>" + t for t in texts[:1]]
    for text, ids in zip(texts, CODER.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert CODER.decode(ids) == LIBRARY.decode(LIBRARY.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)
