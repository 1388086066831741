import random
from collections import defaultdict
from functools import cache

from cairnlake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, action string"


@cache
def least(roles, state=0):
    """Cheapest repair by trying everything."""
    if not roles:
        return chat.CLOSING[state][0]
    role, rest, best = roles[0], roles[1:], float("inf")
    for to in (1, 2, 3):
        relabel = 0 if to == role else chat.RELABEL
        if to in chat.NEXT[state]:
            best = min(best, relabel + least(rest, to))
        if to == state:
            best = min(best, relabel + chat.MERGE + least(rest, to))
        for m in chat.NEXT[state]:
            if to in chat.NEXT[m]:
                best = min(best, relabel + chat.INSERT + least(rest, to))
    return best


def check(rows, found):
    """Costs are least, the sequence of roles is legal, and the pieces render it."""
    given, got = defaultdict(list), defaultdict(list)
    for r in rows:
        given[r[0]].append(r)
    for r in found:
        got[r.conv_id].append(r)
    assert set(given) == set(got)
    for conv, turns in given.items():
        key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
        turns, out = sorted(turns, key=key), sorted(got[conv], key=lambda r: (r.turn is not None, r.turn or 0, r.role_in or "", r.rendered.lstrip()))
        if len({(t[1]) for t in turns}) < len(turns):
            assert len(turns) == len(out)
            continue
        cost, sequence, rendering = 0, [], ""
        for t, o in zip(turns, out):
            cost += chat.RELABEL * ("relabel" in o.action) + chat.MERGE * ("merge" in o.action) + chat.INSERT * bool(o.inserted_before)
            if o.inserted_before:
                sequence.append([o.inserted_before, ""])
            if "merge" in o.action:
                sequence[-1][1] += "\n\n" + (t[3] or "")
                assert sequence[-1][0] == o.role_out
            else:
                sequence.append([o.role_out, t[3] or ""])
            rendering += o.rendered
            for role in (o.inserted_after or "").split(","):
                if role:
                    cost += chat.INSERT
                    sequence.append([role, ""])
                    assert o is out[-1]
        assert cost == least(tuple(chat.role_number(t[2]) for t in turns))
        state = 0
        for role, _ in sequence:
            assert chat.ROLES.index(role) in chat.NEXT[state]
            state = chat.ROLES.index(role)
        assert state == 3
        assert rendering == "".join(f"<|{role}|>\n{text}{chat.END}" for role, text in sequence)


def test_random_conversations_in_stretches(spark):
    rng = random.Random(4)
    names = ["user", "assistant", "system", "human", "GPT", None, "tool"]
    rows = [(conv, turn, rng.choice(names), rng.choice(["hi", "", None, "x\ny"]), "x") for conv in range(40) for turn in range(rng.randint(1, 9))]
    rows += [(None, t, "user", "t", "x") for t in range(3)] + [(99, t * 7, ["user", "assistant"][t % 2], f"t{t}", None) for t in range(60)]
    rows += [(100, None, "user", "no number", None), (100, 1, "assistant", "b", None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for stretch in (512, 4, 2):
        check(rows, chat.repair(frame, stretch=stretch).collect())


def test_repeated_rows_stay(spark):
    rows = [(1, 0, "user", "a", None)] * 3 + [(1, 1, "assistant", "b", None)]
    found = chat.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("turn", "action").collect()
    assert [r.action for r in found] == ["keep", "merge", "merge", "keep"]


def test_table_and_empty(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    check([tuple(r) for r in turns.collect()], chat.repair(turns).collect())
    assert chat.repair(turns.limit(0)).count() == 0


def test_one_conversation_with_most_turns_without_numbers(spark):
    """No turn number, one turn number and no conversation id: all are split, and repaired at the cost of one pass over all."""
    rng = random.Random(6)
    names = ["user", "assistant", "system", None]
    rows = [(7, None, rng.choice(names), f"t{i}", None) for i in range(700)] + [(7, 3, rng.choice(names), f"s{i}", None) for i in range(500)] + [(7, 3, "user", "equal", None)] * 300
    rows += [(None, 1, rng.choice(names), f"n{i}", None) for i in range(400)] + [(8, 0, "user", "word " * 200_000, None), (8, 1, "bot", "", None)] + [(i, 0, "user", "hi", None) for i in range(20, 80)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = chat.repair(frame, stretch=32).collect()
    assert len(found) == len(rows)
    ordered = frame.selectExpr("conv_id", "turn", "role", "xxhash64(text) h").orderBy("conv_id", "turn", "role", "h").collect()
    for conv in (7, None, 8, 20):
        costs = chat.forward([chat.role_number(r.role) for r in ordered if r.conv_id == conv], 0)[0]
        least = min(c + chat.CLOSING[s][0] for s, c in enumerate(costs))
        own = [r for r in found if r.conv_id == conv]
        cost = sum(chat.RELABEL * ("relabel" in r.action) + chat.MERGE * ("merge" in r.action) + chat.INSERT * bool(r.inserted_before) + chat.INSERT * len([x for x in (r.inserted_after or "").split(",") if x]) for r in own)
        assert cost == least, conv
        assert sum(bool(r.inserted_after) or r.rendered.endswith(chat.END) for r in own) <= 1 or conv == 8


def test_clashing_names(spark):
    names = ["done", "part", "seq", "conv", "hash", "place"]
    frame = spark.createDataFrame([(1, 0, "user", "a", None), (1, 1, "bot", "b", None)], SCHEMA).selectExpr("*", *[f"'x' as {n}" for n in names])
    assert [r.role_out for r in chat.repair(frame).orderBy("turn").collect()] == ["user", "assistant"]
    renamed = frame.selectExpr("conv_id as done", "turn as part", "role as seq", "text as hash")
    assert chat.repair(renamed, "done", "part", "seq", "hash").columns[:2] == ["done", "part"]
