import itertools
import random
import zlib
from collections import Counter

import numpy as np

from cairnlake.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict_with_folds(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()
    assert found.count() == docs.count() and found.where("score < 0 or score > 1").count() == 0


def test_fixture(spark, docs, rows):
    found = langid.predict_with_folds(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert (by_id[4].lang_pred, by_id[4].score) == ("und", 0.0) and by_id[5].lang_pred == by_id[6].lang_pred == "und"
    assert by_id[None].held_out is True
    kept = [r.doc_id for r in langid.identified(docs).collect()]
    assert 4 not in kept and 5 not in kept and 9 in kept
    assert langid.identified(docs).columns == docs.columns


def test_spans_scripts_and_nothing_learned(spark, empty):
    counts = [("en", g, 9) for w in ("the", "house", "and") for g in langid.grams(w)] + [("de", g, 9) for w in ("der", "und", "haus") for g in langid.grams(w)]
    counts += [("ru", g, 9) for g in langid.grams("дом")] + [("en", "\0latin", 50), ("de", "\0latin", 50), ("ru", "\0cyrillic", 50)]
    model = langid.Model(counts)
    frame = spark.createDataFrame([(1, "the house and the house der und haus der und дом дом дом"), (2, "123"), (3, "汉字")], "doc_id long, text string")
    found = {r.doc_id: r for r in langid.label(frame, model, ["doc_id"], penalty=3.0, spans=True).collect()}
    assert [(s.lang, s.first_word, s.words) for s in found[1].spans] == [("en", 0, 5), ("de", 5, 5), ("ru", 10, 3)]
    assert found[2].lang_pred == "und" and found[2].spans == []
    assert {r.lang_pred for r in langid.label(frame, langid.Model([]), ["doc_id"]).collect()} == {"und"}
    assert langid.predict_with_folds(empty).count() == 0


def test_viterbi_against_all_paths():
    rng = random.Random(2)
    for _ in range(20):
        lengths = [rng.randint(0, 5) for _ in range(6)]
        scores = np.array([[rng.uniform(-5, 0) for _ in range(3)] for _ in range(sum(lengths))], np.float32).reshape(-1, 3)
        labels, at = langid.viterbi(scores, np.array(lengths), 2.0), 0
        for n in lengths:
            own = scores[at : at + n]
            value = lambda path: sum(own[i, x] for i, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731,B023
            best = max((value(p) for p in itertools.product(range(3), repeat=n)), default=0)
            assert abs(value(labels[at : at + n].tolist()) - best) < 1e-3
            at += n


def test_folds_are_crc32(spark):
    import zlib

    rows = spark.range(50).select("id", langid.fold("id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in rows)


def naive_predictions(rows, longest=4, least=2, penalty=12.0):
    """Everything once more in plain loops: counts, scores of each word, and a Viterbi pass over one text at a time."""
    counts, words_by_script = Counter(), Counter()
    for doc_id, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1:
            for word in letters_only(text):
                words_by_script[langid.script(word), lang] += 1
                marked = f"<{word}>"
                for n in range(2, longest + 1):
                    for i in range(len(marked) - n + 1):
                        counts[marked[i : i + n], lang] += 1
                counts[marked, lang] += 1
    langs = sorted({lang for _, lang in words_by_script})
    every = Counter()
    for (g, _), n in counts.items():
        every[g] += n
    kept = [g for g, n in every.items() if n >= least]
    total = {x: sum(counts[g, x] + 0.3 for g in kept) + 0.3 for x in langs}
    log = {x: {g: float(np.float32(np.log(counts[g, x] + 0.3) - np.log(total[x]))) for g in kept} for x in langs}
    none = {x: float(np.float32(np.log(0.3) - np.log(total[x]))) for x in langs}
    by_lang = {x: sum(n for (_, y), n in words_by_script.items() if y == x) for x in langs}
    out, memo, unknown = {}, {}, set()

    def scores(word):
        if word not in memo:
            marked = f"<{word}>"
            own = [marked[i : i + n] for n in range(2, longest + 1) for i in range(len(marked) - n + 1)] + [marked]
            s = {x: sum(log[x].get(g, none[x]) for g in own) for x in langs}
            top = max(s.values())
            unknown.discard(word)
            possible = [x for x in langs if words_by_script[langid.script(word), x] >= 0.01 * by_lang[x] and any(words_by_script[langid.script(word), y] for y in langs)]
            s = {x: (max(s[x] - top, -8.0) if x in possible else -32.0) if possible else 0.0 for x in langs}
            memo[word] = {x: v - max(s.values()) for x, v in s.items()}
            if not possible:
                unknown.add(word)
        return memo[word]

    for doc_id, text, _ in rows:
        words = letters_only(text or "")
        best, back = dict.fromkeys(langs, 0.0), []
        for i, w in enumerate(words):
            came, new = {}, {}
            for x in langs:
                y = max(langs, key=lambda y: best[y] - (penalty if y != x else 0) * (i > 0))
                came[x] = x if not i or best[x] >= best[y] - (penalty if y != x else 0) else y
                new[x] = best[came[x]] - (penalty if came[x] != x and i else 0) + scores(w)[x]
            best = new
            back.append(came)
        share, x = Counter(), max(langs, key=best.get) if words else None
        for w, came in zip(reversed(words), reversed(back)):
            share[x] += len(w) * (w not in unknown)
            x = came[x]
        top = min(share, key=lambda x: (-share[x], x)) if share else "und"
        out[doc_id] = (top, share[top] / sum(map(len, words)) if share else 0.0)
    return out


def letters_only(text):
    return ["".join(g) for k, g in itertools.groupby(text.lower(), str.isalpha) if k]


def test_whole_prediction_against_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    expected = naive_predictions([tuple(r) for r in docs.collect()])
    found = langid.predict_with_folds(docs).collect()
    assert len(found) == len(expected)
    for r in found:
        assert r.lang_pred == expected[r.doc_id][0] and abs(r.score - expected[r.doc_id][1]) < 1e-9, r.doc_id


def test_only_letters_count(spark):
    counts = [("en", g, 9) for g in langid.grams("the")] + [("en", "\0latin", 50)]
    frame = spark.createDataFrame(enumerate(["½ ² ① Ⅻ ٣ 12 _ !", "½a", "", None, "the ²"]), "i int, text string")
    assert [r.lang_pred for r in langid.label(frame, langid.Model(counts), ["i"]).orderBy("i").collect()] == ["und", "en", "und", "und", "en"]
    assert langid.WORDS.findall("a½b²c ϖ٣x") == ["a", "b", "c", "ϖ", "x"]


def test_scripts_that_no_language_was_learned_in(spark):
    counts = [(x, g, 9) for x, w in (("en", "the"), ("de", "der"), ("fr", "les")) for g in langid.grams(w)] + [(x, "\0latin", 50) for x in ("en", "de", "fr")]
    frame = spark.createDataFrame([(1, "привет мир"), (2, "中文字"), (3, "les les мир"), (4, "les les les")], "i int, text string")
    found = {r.i: (r.lang_pred, r.score) for r in langid.label(frame, langid.Model(counts), ["i"]).collect()}
    assert found == {1: ("de", 0.0), 2: ("de", 0.0), 3: ("fr", 6 / 9), 4: ("fr", 1.0)}
    words = [(i, "the house of the people and it was for them " * 3, "en") for i in range(30)] + [(99, "привет мир " * 9, None), (98, None, None)]
    kept = langid.identified(spark.createDataFrame(words, "doc_id long, text string, lang string"))
    assert {r.doc_id for r in kept.collect()} == set(range(30))


def test_clashing_names_and_long_texts(spark, docs):
    more = docs.selectExpr("*", "text as text_copy", "1 as score", "'q' as lang_pred", "2 as grp", "'k' as kept_text", "3 as n_removed", "4 as spans")
    kept = langid.identified(more)
    assert kept.columns == more.columns and kept.where("score <> 1 or lang_pred <> 'q' or not (text_copy <=> text)").count() == 0
    assert kept.count() == langid.identified(docs).count()
    found = langid.label(more, langid.learn_from_folds(more), ["score", "lang_pred"], spans=True)
    assert found.columns == ["score", "lang_pred", "lang_pred_", "score_", "spans"]
    long = spark.createDataFrame([(i, ("der und haus " if i == 3 else "the of house ") * (200_000 if i == 3 else 3), "de" if i == 3 else "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.predict_with_folds(long).collect()}[3] in ("de", "en")


def test_more_languages_than_a_byte_holds():
    rng = np.random.default_rng(1)
    scores = rng.uniform(-5, 0, (40, 200)).astype(np.float32)
    scores[:, 180] = 0
    assert set(langid.viterbi(scores, np.array([25, 15]), 12.0).tolist()) == {180}


def test_grams_looked_up_at_once_are_those_of_each_word():
    rng = random.Random(7)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    known = {g for _ in range(60) for g in langid.grams(word("abcд汉\U00020000"))}
    rows = {g: i for i, g in enumerate(sorted(known))}
    words = [word("abcxд汉字\U00020000\U00020001") for _ in range(500)]
    expected = [[rows.get(g, len(rows)) for g in langid.grams(w)] for w in words]
    wide = langid.Lookup(rows | {chr(0x10000 + i): len(rows) for i in range(1 << 16)})
    assert wide.wide
    wide.grams = rows
    for lookup in (langid.Lookup(rows), wide):
        found, counts = lookup.found(words)
        assert counts.tolist() == [len(e) for e in expected] and found.tolist() == [i for e in expected for i in e]
    assert set(langid.Lookup({}).found(["ab"])[0].tolist()) == {0}
