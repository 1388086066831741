"""run() against the four stages in plain loops: language from the naive model, all pairs of fingerprints, all windows."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from cairnlake.llm import packing, simhash
from test_langid import naive_predictions
from test_packing import check

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_language(rows):
    found = naive_predictions([(r["doc_id"], r["text"], r["lang"]) for r in rows])
    return [r for r in rows if found[r["doc_id"]][0] != "und" and found[r["doc_id"]][1] >= 0.25]


def one_of_each_group(rows):
    prints = [simhash.fingerprint(None if r["text"] is None else r["text"].encode()) for r in rows]
    least = [r["doc_id"] for r in rows]
    fp = np.array(prints, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(fp ^ x) <= 4) for x in fp]
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            m = min(least[j] for j in js)
            if m < least[i]:
                least[i], changed = m, True
    return [r for r, m in zip(rows, least) if r["doc_id"] == m]


def without_passages(rows, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        if gone:
            text = " ".join(x for j, x in enumerate(w) if j not in gone)
            if not text:
                continue
            r = r | {"text": text, "n_chars": len(text)}
        out.append(r)
    return out


@pytest.fixture(scope="module")
def documents(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def test_run_against_plain_loops(spark, documents):
    expected = without_passages(one_of_each_group(by_language(documents)))
    assert len(expected) < len(documents)
    check([(r["doc_id"], r["text"]) for r in expected], corpus_pipeline.run(spark, SMALL).collect())


def test_stages_one_by_one_with_clashing_columns(spark, documents):
    """Every stage gives what the plain loops give, and carries columns named as its own inner and result columns."""
    extra = {"text_copy": "'t'", "score": "1.5", "lang_pred": "'l'", "grp": "2", "kept_text": "'k'", "n_words": "3", "n_removed": "4", "fp": "5", "component_id": "6", "class": "7", "pack_group": "8"}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("*", *[f"{v} as {k}" for k, v in extra.items()])
    names, plain = docs.columns, documents
    values = {k: docs.first()[k] for k in extra}
    for (name, stage), twin in zip(corpus_pipeline.STAGES, (by_language, one_of_each_group, without_passages)):
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        plain = twin(plain)
        assert docs.columns == names, name
        found = [r.asDict() for r in docs.orderBy("doc_id").collect()]
        assert [{c: r[c] for c in COLUMNS} for r in found] == sorted(plain, key=lambda r: r["doc_id"]), name
        assert all(r[k] == v for r in found for k, v in values.items()), name
    check([(r["doc_id"], r["text"]) for r in plain], packing.pack(docs).collect())


def test_empty_and_odd_rows(spark, docs, empty):
    docs = docs.drop("n_words")
    for rows in (docs, empty.drop("n_words")):
        for name, stage in corpus_pipeline.STAGES[:3]:
            rows = spark.createDataFrame(stage(spark, rows, SMALL).collect(), rows.schema)
        corpus_pipeline.STAGES[3][1](spark, rows, SMALL).count()
