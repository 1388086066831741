import re

from cairnlake.llm import licenses


def grams(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def brute(rows):
    out = []
    for doc, text, *_ in rows:
        own, best = grams(text), {}
        for name, texts in licenses.TEMPLATES.items():
            for i, t in enumerate(texts):
                wanted = set(grams(t))
                share = len(wanted & set(own)) / len(wanted)
                if share >= 0.8:
                    best[name] = min(best.get(name, (0, 0, 0, 0)), (-share, -len(wanted), i, next(k for k, g in enumerate(own) if g in wanted)))
        out += [(doc, name, i, -share, at) for name, (share, _, i, at) in best.items()]
    return sorted(out, key=repr)


def test_fixture(spark, docs, rows):
    notices = [t for texts in licenses.TEMPLATES.values() for t in texts]
    more = [(100 + i, f"{'filler word ' * (i % 9)}{t} and then more of the text", "en", "s", 1, None) for i, t in enumerate(notices)]
    more += [(200 + i, " ".join(t.split()[: -max(1, len(t.split()) // 12)]), "en", "s", 1, None) for i, t in enumerate(notices)]
    more += [(300, "\n".join(notices), "en", "s", 1, None), (301, "Released\tUNDER  the m.i.t. license", None, None, 1, None), (302, "released, under the -- MIT license!", None, None, 1, None)]
    more += more[:2]
    frame = docs.unionByName(spark.createDataFrame(more, docs.schema))
    assert sorted(map(tuple, licenses.scan(frame).collect()), key=repr) == brute(rows + more)


def test_own_templates_and_empty(docs, empty):
    assert licenses.scan(empty).count() == 0
    found = licenses.scan(docs, templates={"L": ["no id here at all"], "none": [""]}).collect()
    assert [(r.doc_id, r.license, r.containment, r.first_word) for r in found] == [(None, "L", 1.0, 0)]
    assert licenses.scan(docs, templates={"none": [""]}).count() == 0


def test_short_notices_at_both_ends_of_texts(spark):
    """A template of one shingle lies in a single window at a text's end, between any seven neighbours."""
    rows = []
    for i in range(3000):
        words = " ".join(f"v{i * 31 + j}" for j in range(12))
        rows.append((i, f"Released under the MIT License. {words}" if i % 2 else f"{words} Released under the MIT License."))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert found.where("license = 'MIT'").count() == len(rows)


def test_whole_texts_and_no_templates(spark):
    words = " ".join(f"z{i}" for i in range(300))
    rows = [(i, f"{words} {licenses.TEMPLATES[name][0].lower()} {words}") for i, name in enumerate(n for n in licenses.TEMPLATES if n.endswith("-text"))]
    names = [n for n in licenses.TEMPLATES if n.endswith("-text")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license, r.first_word) for r in found if r.license.endswith("-text")} >= {(i, n, 300) for i, n in enumerate(names)}
    assert all(r.containment == 1 for r in found if r.license == names[r.doc_id])
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates={"none": ["!!!"]}).count() == 0
