import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnlake.llm import queries, turns

TURNS = "conv_id long, turn long, role string, text string, part string"


def damage(rows):
    """(turn, role, text) by conversation, in order, after the damage; no other order than that of turns matters here."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        said = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, kind = " " if role is None else role, " " if text is None else text, crc32(said.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(conv, said):
    """Every cheapest way by state as (cost, letters, turns), forwards; of equal costs the least letters."""
    said = sorted(said, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, faults = set(), []
    for _, role, text in said:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    to = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    asked = {"": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}

    def insert(best):
        for _ in range(3):
            for s, (cost, audit, kept) in list(best.items()):
                nxt, role = asked[s]
                new = (cost + 5, audit + "I", kept + ((role, ""),))
                best[nxt] = min(best.get(nxt, new), new)
        return best

    best = insert({"": (0, "", ())})
    for (_, role, text), fault in zip(said, faults):
        nxt = {}
        for s, (cost, audit, kept) in best.items():
            options = [(s, (cost + 2, audit + "D", kept))]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if (s, role[:1]) in to:
                    options.append((to[s, role[:1]], (cost + extra, audit + "K", kept + ((role, text),))))
                options.append((asked[s][0], (cost + extra + 1, audit + "R", kept + ((asked[s][1], text),))))
            for state, new in options:
                nxt[state] = min(nxt.get(state, new), new)
        best = insert(nxt)
    cost, audit, kept = min(best[s] for s in ("", "a") if s in best)
    numbers = [t for t, _, _ in said if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [role[:1] for _, role, _ in said]
    illegal = sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(initials, initials[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def wanted(rows):
    by_conv = damage(rows)
    return sorted((expected(c, said) for c, said in by_conv.items()), key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in turns.audits(turns.repaired_parts(turns.damaged(df), copies_col="copies", **options)).collect()), key=repr)


ODD = [
    (1, 0, "system", "Be kind.", "x"), (1, 1, "user", "Hi.", "x"), (1, 2, "assistant", "Hello!", "x"), (1, 5, "user", "And", "x"),
    (2, None, None, None, None), (2, 3, "tool", "out.", None), (2, None, "user", "first?", None),
    (3, 1, "assistant", "", None), (4, 7, "", "x.", None), (5, 1, "user", " \t\n", None),
    (None, 1, "user", "No id.", None), (None, 2, "assistant", "None.", None), (6, -3, "Ünknown", "ß…", None),
    (7, 1, "user", "Long. " * 40_000, None), (7, 2, "assistant", "é" * 100_000 + ".", None),
    (8, 1, "user", "same.", None), (8, 2, "user", "same.", None), (8, 3, "user", "same.", None), (8, 9_007_199_254_740_993, "user", "far.", None),
]


@pytest.fixture(scope="module")
def giant():
    r = random.Random(7)
    roles, ends = ["system", "user", "assistant", "tool", "user", "assistant", "user", "assistant"], [".", "!", "", "?"]
    rows = [(100, t, r.choice(roles), f"{r.choice(['w', 'v'])}{r.randrange(600)}{r.choice(ends)}", None) for t in range(3000) if r.random() < 0.95]
    return rows + [(100 + c, t, r.choice(roles), f"t{r.randrange(30)}{r.choice(ends)}", None) for c in range(1, 60) for t in range(r.randint(1, 12))]


@pytest.mark.parametrize("options", [{}, {"stretch": 16}, {"stretch": 1}, {"stretch": 64, "stretch_bytes": 200}])
def test_odd_and_giant(spark, giant, options):
    df = spark.createDataFrame(ODD + giant, TURNS).repartition(5)
    assert found(df, **options) == wanted([r[:4] for r in ODD + giant])


def test_query_over_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_conversation_repair(spark, "/root/testdata/sf0.01")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == wanted(rows)


def test_one_key_holds_all_rows(spark):
    df = spark.range(20_000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('t', id % 700, '.') text", "'' part")
    parts = turns.repaired_parts(df, stretch=256).cache()
    assert parts.count() > 70
    rows = [(r.turn, r.role, r.text) for r in df.collect()]
    assert [tuple(r) for r in turns.audits(parts).collect()] == [expected(1, rows)]


def test_equal_rows_and_equal_turns(spark):
    df = spark.createDataFrame([(1, 1, "user", "a.", "")] * 50 + [(2, None, "user", "b.", "")] * 3, TURNS)
    assert found(df, stretch=4) == wanted([(1, 1, "user", "a.")] * 50 + [(2, None, "user", "b.")] * 3)


def test_empty(spark):
    assert found(spark.createDataFrame([], TURNS)) == []


def test_all_rows_dropped(spark):
    gone = next(c for c in range(1000) if crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert found(spark.createDataFrame([(gone, 0, "user", "x.", "")], TURNS)) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]


def test_repaired_turns_are_legal(spark, giant):
    df = spark.createDataFrame(giant, TURNS)
    by_conv = defaultdict(list)
    for r in turns.repaired_parts(df, stretch=100).orderBy("conv_id", "part").collect():
        by_conv[r.conv_id] += [role[0] for role in r.roles]
    assert all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in by_conv.values())


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["a.", "b", "", "c!", "d?"])), max_size=14))
def test_edits(said):
    rows = [(i, *r) for i, r in enumerate(said)]
    marks = turns._repeats(bytes(turns.mark(*r) for r in said), [turns._digest(*r) for r in said], set())
    audit = turns.edits(marks)
    roles, texts, cost = turns.applied(audit, marks, [r for r, _ in said], [t for _, t in said])
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in zip(roles, texts)).encode()).hexdigest()
    assert (cost, audit, digest) == expected(0, rows)[6:]
    m = turns.matrix(marks)
    after = turns._with_inserts(turns.AT_END)
    assert min(m[s] + after[s] for s in turns.STATES) == cost
