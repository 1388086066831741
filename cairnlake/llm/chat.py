"""Repairing and rendering conversations.

Legal conversations are what an automaton accepts: perhaps one system turn, then user and assistant in turn, ending with the
assistant. Each turn may keep its role or be relabelled, may be merged into the turn before, and an empty turn may be put in
before it; dynamic programming finds the cheapest repair.

All turns are sorted once over the cluster, by conversation and number. A conversation that lies in one task and is not long
is repaired there and then. The others are worked off in stretches of consecutive turns. A stretch is a small matrix, the least
cost from each state of the automaton to each other, and matrices of neighbours combine by a min-plus product, level by
level. The states chosen at the top then go down again, and each stretch is rendered by itself. So no conversation, however
long, meets in one task, nor do the turns that share a number or have none.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.words import tasks
from cairnlake.plans.checkpoints import cut

ROLES = ("", "system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "chatbot": "assistant", "developer": "system", "instructions": "system"}
NEXT = ((1, 2), (2,), (3,), (2,))
MERGE, INSERT, RELABEL = 1.0, 2.0, 3.0
STATES = range(4)
INF = math.inf
END = "\n<|end|>\n"
#: What is still to come after the last turn, by state, and its cost.
CLOSING = ((0.0, ()), (2 * INSERT, (2, 3)), (INSERT, (3,)), (0.0, ()))


def role_number(role: str | None) -> int:
    role = (role or "").strip().lower()
    role = ALIASES.get(role, role)
    return ROLES.index(role) if role in ROLES else 0


def _moves() -> list[list[list[tuple]]]:
    """By role as given and state: (cost, next state, merged, inserted role), the best of each kind, preferred ones first."""
    table = []
    for role in STATES:
        rows = []
        for state in STATES:
            found = {}
            for to in dict.fromkeys([*([role] if role else []), 2, 3, 1]):
                relabel = 0 if to == role else RELABEL
                options = [(relabel, to, False, 0)] if to in NEXT[state] else []
                if state == to:
                    options.append((relabel + MERGE, to, True, 0))
                options += [(relabel + INSERT, to, False, m) for m in NEXT[state] if to in NEXT[m]]
                if options:
                    found[to] = min(options, key=lambda o: o[0])
            rows.append(list(found.values()))
        table.append(rows)
    return table


MOVES = _moves()


def forward(roles: list[int], state: int) -> tuple[list[float], list[list[tuple | None]]]:
    """Least cost of each state after the turns, from one before them, and the move that led there at each turn."""
    costs, back = [INF] * 4, []
    costs[state] = 0.0
    for role in roles:
        new, came = [INF] * 4, [None] * 4
        for s in STATES:
            if costs[s] < INF:
                for cost, to, merged, inserted in MOVES[role][s]:
                    if costs[s] + cost < new[to]:
                        new[to], came[to] = costs[s] + cost, (s, merged, inserted)
        costs = new
        back.append(came)
    return costs, back


def through(matrices: list[list[float]], state: int, end: int) -> list[tuple[int, int]]:
    """States before and after each stretch on the cheapest way from state to end."""
    costs, back = [INF] * 4, []
    costs[state] = 0.0
    for m in matrices:
        new, came = [INF] * 4, [0] * 4
        for s in STATES:
            for to in STATES:
                if costs[s] + m[4 * s + to] < new[to]:
                    new[to], came[to] = costs[s] + m[4 * s + to], s
        costs = new
        back.append(came)
    ways = []
    for came in reversed(back):
        ways.append((came[end], end))
        end = came[end]
    return ways[::-1]


def product(matrices: list[list[float]]) -> list[float]:
    total = matrices[0]
    for m in matrices[1:]:
        total = [min(total[4 * a + b] + m[4 * b + c] for b in STATES) for a in STATES for c in STATES]
    return total


def render(turns: list[tuple], before: int, after: int, last: bool) -> list[list]:
    """role_out, action, inserted_before, inserted_after and rendered piece of each (role, text), on the cheapest way between two
    states; last says whether the conversation ends here."""
    _, back = forward([role_number(role) for role, _ in turns], before)
    state, moves, out = after, [], []
    for came in reversed(back):
        came_from, merged, inserted = came[state]
        moves.append((came_from, state, merged, inserted))
        state = came_from
    for (role_in, text), (came_from, role, merged, inserted) in zip(turns, reversed(moves)):
        text = text or ""
        if merged:
            piece = "\n\n" + text
        else:
            piece = (END if came_from else "") + (f"<|{ROLES[inserted]}|>\n{END}" if inserted else "") + f"<|{ROLES[role]}|>\n{text}"
        relabel = role_number(role_in) != role
        out.append([ROLES[role], "+".join(["relabel"] * relabel + ["merge"] * merged) or "keep", ROLES[inserted] or None, None, piece])
    if last and out:
        closing = CLOSING[after][1]
        out[-1][3] = ",".join(ROLES[c] for c in closing) or None
        out[-1][4] += END + "".join(f"<|{ROLES[c]}|>\n{END}" for c in closing)
    return out


def _end(costs: list[float]) -> int:
    return min(STATES, key=lambda s: (costs[s] + CLOSING[s][0], -s))


_LEVEL = "conv string, part long, m array<double>"
_WAY = "conv string, part long, before int, after int, last boolean"
_RESULT = ["role_out", "action", "inserted_before", "inserted_after", "rendered"]


def _level(rows: list[dict]) -> pa.Table:
    return pa.table({"conv": pa.array([r["conv"] for r in rows], pa.string()), "part": pa.array([r["part"] for r in rows], pa.int64()), "m": pa.array([r["m"] for r in rows], pa.list_(pa.float64()))})


def _ways(rows: list[tuple]) -> pa.Table:
    columns = [*zip(*rows)] or [[]] * 5
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv", "part", "before", "after", "last"])


def _in_order(stretch: int):
    """Over the sorted turns of a task: repairs the conversations that are seen whole and have no more than `stretch` turns,
    and cuts what is left, such as what may go on in the tasks before or after, into numbered stretches."""

    def emit(kinds, keys, turns, first, whole):
        """keys: conv, conv_id, turn of each turn (role, text)."""
        n = len(turns)
        columns = [[k[0] for k in keys], [first + i // stretch for i in range(n)], [i % stretch for i in range(n)], [k[1] for k in keys], [k[2] for k in keys], [t[0] for t in turns]]
        if whole:
            end = _end(forward([role_number(role) for role, _ in turns], 0)[0])
            columns += [[None] * n, *zip(*render(turns, 0, end, True)), [True] * n]
        else:
            columns += [[t[1] for t in turns], *[[None] * n] * 5, [False] * n]
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=pa.schema(kinds))

    def work(batches):
        held, first, begun, kinds = ([], []), TaskContext.get().partitionId() << 32, False, None
        started = False  # whether what is held began in this task, after another conversation
        for b in batches:
            names = ["conv", "part", "seq", "conv_id", "turn", "role", "text", *_RESULT, "done"]
            types = [pa.string(), pa.int64(), pa.int32(), b.schema.field(1).type, pa.int64(), *[pa.string()] * 7, pa.bool_()]
            kinds = [pa.field(n, t) for n, t in zip(names, types)]
            ready = []
            for conv, conv_id, turn, role, text in zip(*[c.to_pylist() for c in b.columns]):
                if held[0] and held[0][0][0] != conv:
                    ready.append(emit(kinds, *held, first, started and len(held[1]) <= stretch))
                    first += -(-len(held[1]) // stretch)
                    held, started = ([], []), True
                elif len(held[1]) == 8 * stretch:
                    ready.append(emit(kinds, *held, first, False))
                    first += 8
                    held, started = ([], []), False
                held[0].append((conv, conv_id, turn))
                held[1].append((role, text))
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
        if held[0]:
            yield emit(kinds, *held, first, False)

    return work


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stretch: int = 512) -> DataFrame:
    """One row per row of turns: conv_col, turn_col, role_in, role_out, action, inserted_before, inserted_after, rendered string.

    action is keep, relabel, merge or relabel+merge; inserted_before names the role of an empty turn put in before, and
    inserted_after those that close the conversation (comma-separated). The rendered pieces of a conversation in order of
    turn are its rendering. Turns without a number come first; turns of one number follow by role (none first) and then by a
    hash of the text; repeated rows stay. A null role is relabelled, a null text is empty; rows without a conversation id form
    one conversation. An empty table gives no rows; other columns are ignored. Any run of turns is split over tasks where it
    is long; a task holds eight stretches.
    """
    spark_type = turns.schema[conv_col].dataType.simpleString()
    conv = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit(""))
    rows = turns.select(conv.alias("conv"), F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    # equal rows are told apart by their places, so that even they can be split
    order = ["conv", "turn", "role", "hash", "place"]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()}).repartitionByRange(tasks(turns), *order).sortWithinPartitions(*order)
    inner = f"conv string, part long, seq int, conv_id {spark_type}, turn long, role string, text string, {', '.join(f'{c} string' for c in _RESULT)}, done boolean"
    rows = cut(rows.select("conv", "conv_id", "turn", "role", "text").mapInArrow(_in_order(stretch), inner))
    left = rows.where(~F.col("done")).select("conv", "part", "seq", "conv_id", "turn", "role", "text")

    def measure(key, table):
        roles = [role_number(r["role"]) for r in sorted(table.to_pylist(), key=lambda r: r["seq"])]
        return _level([{"conv": key[0].as_py(), "part": key[1].as_py(), "m": [c for s in STATES for c in forward(roles, s)[0]]}])

    def join(key, table):
        parts = sorted(table.to_pylist(), key=lambda r: r["own"])
        return _level([{"conv": key[0].as_py(), "part": key[1].as_py(), "m": product([r["m"] for r in parts])}])

    def above(level):
        return level.select("conv", F.floor(F.col("part") / stretch).alias("part"), "m", F.col("part").alias("own"))

    levels = [cut(left.select("conv", "part", "seq", "role").groupBy("conv", "part").applyInArrow(measure, _LEVEL))]
    while (levels[-1].groupBy("conv").count().agg(F.max("count")).first()[0] or 0) > stretch:
        levels.append(cut(above(levels[-1]).groupBy("conv", "part").applyInArrow(join, _LEVEL)))

    def top(key, table):
        parts = sorted(table.to_pylist(), key=lambda r: r["part"])
        found = through([r["m"] for r in parts], 0, _end(product([r["m"] for r in parts])))
        return _ways([(key[0].as_py(), r["part"], a, b, r is parts[-1]) for r, (a, b) in zip(parts, found)])

    def down(key, table, way):
        parts, way = sorted(table.to_pylist(), key=lambda r: r["own"]), way.to_pylist()[0]
        found = through([r["m"] for r in parts], way["before"], way["after"])
        return _ways([(key[0].as_py(), r["own"], a, b, way["last"] and r is parts[-1]) for r, (a, b) in zip(parts, found)])

    ways = levels[-1].repartition(tasks(turns), "conv").groupBy("conv").applyInArrow(top, _WAY)
    for level in reversed(levels[:-1]):
        ways = above(level).groupBy("conv", "part").cogroup(ways.groupBy("conv", "part")).applyInArrow(down, _WAY)

    def finish(key, table, way):
        own, way = sorted(table.to_pylist(), key=lambda r: r["seq"]), way.to_pylist()[0]
        found = render([(r["role"], r["text"]) for r in own], way["before"], way["after"], way["last"])
        columns = [[r["conv_id"] for r in own], [r["turn"] for r in own], [r["role"] for r in own], *zip(*found)]
        kinds = [table.schema.field("conv_id").type, pa.int64(), *[pa.string()] * 6]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "turn", "role", *_RESULT])

    schema = f"conv_id {spark_type}, turn long, role string, {', '.join(f'{c} string' for c in _RESULT)}"
    later = left.groupBy("conv", "part").cogroup(ways.groupBy("conv", "part")).applyInArrow(finish, schema)
    found = rows.where("done").select("conv_id", "turn", "role", *_RESULT).unionByName(later)
    return found.toDF(conv_col, turn_col, "role_in", *_RESULT)
