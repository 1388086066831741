"""Repairing the structure of conversations.

A conversation should be empty or read `(system)? (user assistant)+`. Keeping a turn costs nothing, giving it the role of a
user or an assistant 1, deleting it 2 (blank turns and repeated ones must go), putting in an empty turn 5, and each truncated
turn that is not deleted 5. A dynamic program over the four states of that automaton finds the cheapest edits, and of equally
cheap ones those whose initials (Delete, Insert, Keep, Rerole) come first in ASCII order: from the last turn to the first it
keeps the least cost to go from each state and, two bits a state, the first letter that reaches it; read forwards from the
start, these bytes spell the edits.

Turns are sorted once over the cluster by conversation and number, and one pass carries the open conversation from batch to
batch. Conversations that are seen whole are repaired there. One that is longer than a stretch, or may go on in the tasks
before or after, is spilled as stretches of consecutive turns, a byte a turn besides the texts. A stretch is a small matrix
of least costs between states; a pass over a conversation's stretches from the last to the first carries the costs to go,
each stretch then spills its bytes of back-pointers, and a pass from the first to the last carries the state. So no
conversation, however long, meets in one task; only what a whole conversation has one of (its counts, its digest and the
letters of its edits) is put together in order, a stretch at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.words import tasks
from cairnlake.plans.checkpoints import cut

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
INF = math.inf
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
LETTERS = "DIKR"
#: States: nothing yet, after the system turn, after a user's turn, after an assistant's turn.
STATES = range(4)
#: The state after the turn that a state asks for, and the role of that turn.
ASKED = (2, 2, 3, 2)
ASKED_ROLE = ("user", "user", "assistant", "user")
#: By state and initial of a role (s, u, a, other): the state after the turn is kept, or -1.
KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
LEGAL = {(0, 1), (1, 2), (2, 1)}
AT_END = (0, INF, INF, 0)
#: Kinds of turns, times four, plus the initial: the mark of a turn.
SOUND, CUT_SHORT, BLANK, REPEATED = range(4)


def mark(role: str, text: str) -> int:
    """The mark of a turn by itself; whether it repeats another is added later."""
    bare = text.rstrip(WHITE)
    kind = SOUND if bare and bare[-1] in ".!?" else CUT_SHORT if bare else BLANK
    return 4 * kind + ("sua".find(role[0]) if role and role[0] in "sua" else 3)


def _with_inserts(w: list) -> list:
    two, three = min(w[2], INSERT + w[3]), min(w[3], INSERT + w[2])
    return [min(w[0], INSERT + two), min(w[1], INSERT + two), two, three]


def _step(m: int, after: list) -> tuple[list, list]:
    """Costs to go before a turn, without and with inserts before it, from those after it (inserts counted)."""
    kind, initial = divmod(m, 4)
    w = [DELETE + after[s] for s in STATES]
    if kind < BLANK:
        extra = TRUNCATED if kind == CUT_SHORT else 0
        for s in STATES:
            kept = KEPT[s][initial]
            w[s] = min(w[s], extra + REROLE + after[ASKED[s]], extra + after[kept] if kept >= 0 else INF)
    return w, _with_inserts(w)


def pointers(marks: bytes, after: list) -> tuple[bytes, list]:
    """A byte of letters a turn (two bits a state), and the costs to go before the first turn; after: those after the last."""
    out = bytearray(len(marks))
    for i in range(len(marks) - 1, -1, -1):
        kind, initial = divmod(marks[i], 4)
        extra = TRUNCATED if kind == CUT_SHORT else 0
        _, costs = _step(marks[i], after)
        byte = 0
        for s in STATES:
            kept = KEPT[s][initial]
            if DELETE + after[s] == costs[s]:
                letter = 0
            elif INSERT + costs[ASKED[s]] == costs[s]:
                letter = 1
            elif kind < BLANK and kept >= 0 and extra + after[kept] == costs[s]:
                letter = 2
            else:
                letter = 3
            byte |= letter << 2 * s
        out[i] = byte
        after = costs
    return bytes(out), after


def letters(marks: bytes, pointed: bytes, state: int, last: bool) -> tuple[str, int]:
    """The edits of a stretch from a state on, and the state after it; last adds the inserts that close the conversation."""
    out = []
    for m, byte in zip(marks, pointed):
        while (letter := byte >> 2 * state & 3) == 1:
            out.append("I")
            state = ASKED[state]
        out.append(LETTERS[letter])
        if letter:
            state = ASKED[state] if letter == 3 else KEPT[state][m % 4]
    while last and state in (1, 2):
        out.append("I")
        state = ASKED[state]
    return "".join(out), state


@lru_cache(100_000)
def _short_edits(marks: bytes) -> str:
    return letters(marks, pointers(marks, _with_inserts(AT_END))[0], 0, True)[0]


def edits(marks: bytes) -> str:
    """The edits of a whole conversation."""
    return _short_edits(marks) if len(marks) <= 64 else _short_edits.__wrapped__(marks)


def matrix(marks: bytes) -> list[float]:
    """Least costs from each state before a stretch to each after it, no inserts after it."""
    columns = []
    for to in STATES:
        costs = [0 if s == to else INF for s in STATES]
        for m in reversed(marks):
            costs = _step(m, costs)[1]
        columns.append(costs)
    return [float(columns[to][s]) for s in STATES for to in STATES]


def applied(audit: str, marks: bytes, roles: list, texts: list, state: int = 0) -> tuple[list, list, int]:
    """Roles and texts after the edits, and what they cost."""
    out_roles, out_texts, cost, i = [], [], 0, 0
    for letter in audit:
        if letter == "D":
            cost += DELETE
            i += 1
            continue
        if letter == "I":
            out_roles.append(ASKED_ROLE[state])
            out_texts.append("")
            state, cost = ASKED[state], cost + INSERT
            continue
        cost += (TRUNCATED if marks[i] // 4 == CUT_SHORT else 0) + (REROLE if letter == "R" else 0)
        out_roles.append(roles[i] if letter == "K" else ASKED_ROLE[state])
        out_texts.append(texts[i])
        state = KEPT[state][marks[i] % 4] if letter == "K" else ASKED[state]
        i += 1
    return out_roles, out_texts, cost


def _digest(role: str, text: str) -> bytes:
    r = role.encode("utf-8", "surrogatepass")
    return hashlib.md5(len(r).to_bytes(4, "little") + r + text.encode("utf-8", "surrogatepass")).digest()


def _repeats(marks: bytes, digests: list, before: set) -> bytes:
    """Marks with the turns that repeat an earlier one; blank ones stay blank."""
    seen, out = set(before), bytearray(marks)
    for i, d in enumerate(digests):
        if d in seen and out[i] < 4 * BLANK:
            out[i] = 4 * REPEATED + out[i] % 4
        seen.add(d)
    return bytes(out)


def _counts(marks: bytes) -> dict:
    kinds = [m // 4 for m in marks]
    initials = [m % 4 for m in marks]
    return {
        "blank": kinds.count(BLANK),
        "duplicate": kinds.count(REPEATED),
        "truncated": kinds.count(CUT_SHORT),
        "illegal": sum(pair not in LEGAL for pair in zip(initials, initials[1:])),
    }


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]
_TURNS = ["least", "most", "distinct"]


def _part_schema(kind: str) -> str:
    counts = ", ".join(f"{c} long" for c in [*_TURNS, *_COUNTS])
    return f"conv string, conv_id {kind}, part long, whole boolean, marks binary, {counts}, audit string, roles array<string>, texts array<string>"


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})


class _Open:
    """The conversation that a pass carries from batch to batch: its turns since the last stretch was spilled."""

    def __init__(self, conv: str, conv_id, known: bool):
        self.conv, self.conv_id = conv, conv_id
        self.whole = known  # nothing of it lies in the task before, nothing is spilled yet
        self.roles, self.texts, self.numbers, self.bytes = [], [], [], 0

    def add(self, turn, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self.roles.append(role)
            self.texts.append(text)
            self.numbers.append(turn)
            self.bytes += len(text) + 64

    def row(self, part: int, closed: bool) -> dict:
        marks = bytes(map(mark, self.roles, self.texts))
        digests = [_digest(r, t) for r, t in zip(self.roles, self.texts)]
        turns = [t for t in self.numbers if t is not None]
        out = {"conv": self.conv, "conv_id": self.conv_id, "part": part, "whole": closed and self.whole, "roles": self.roles, "texts": self.texts}
        out |= {"least": min(turns, default=None), "most": max(turns, default=None), "distinct": len(set(turns)), "marks": marks, "digests": digests}
        if out["whole"]:
            marks = _repeats(marks, digests, set())
            audit = edits(marks)
            roles, texts, cost = applied(audit, marks, self.roles, self.texts)
            out |= {"marks": marks, "audit": audit, "roles": roles, "texts": texts, "cost": cost, "digests": None} | _counts(marks)
        self.roles, self.texts, self.numbers, self.bytes = [], [], [], 0
        return out


def _streamed(names: list[str], stretch: int, stretch_bytes: int):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, part, ready = None, TaskContext.get().partitionId() << 32, []
        for frame in frames:
            columns = [frame[c].tolist() for c in ("conv", "conv_id", "numbered", "turn", "role", "text", "copies")]
            for conv, conv_id, numbered, turn, role, text, copies in zip(*columns):
                if held is None or held.conv != conv:
                    if held is not None:
                        ready.append(held.row(part, True))
                        part += 1
                    held = _Open(conv, None if conv == "" else conv_id, held is not None)
                elif len(held.roles) >= stretch or held.bytes >= stretch_bytes:
                    held.whole = False
                    ready.append(held.row(part, False))
                    part += 1
                held.add(turn if numbered else None, role, text, copies)
                if len(ready) >= 1000 or ready and ready[-1]["whole"] is False:
                    yield _frame(ready, names)
                    ready = []
        if held is not None:
            ready.append(held.row(part, False))
        if ready:
            yield _frame(ready, names)

    return work


def _marked(frames):
    """Stretches with the digests that stand in the stretches before them: final marks and the matrix."""
    for frame in frames:
        rows = []
        for conv, part, marks, digests, seen in zip(*(frame[c].tolist() for c in ("conv", "part", "marks", "digests", "seen"))):
            marks = _repeats(marks, list(digests), set() if seen is None else set(seen))
            rows.append({"conv": conv, "part": part, "marks": marks, "m": matrix(marks)})
        yield _frame(rows, ["conv", "part", "marks", "m"])


def _carry_costs(frames):
    """Over the stretches of conversations from the last to the first: the costs to go after each."""
    conv, after = None, None
    for frame in frames:
        rows = []
        for own, part, m in zip(frame["conv"].tolist(), frame["part"].tolist(), frame["m"].tolist()):
            last = own != conv
            after = _with_inserts(AT_END) if last else after
            conv = own
            rows.append({"conv": conv, "part": part, "after": [float(c) for c in after], "last": last})
            after = [min(m[4 * s + to] + after[to] for to in STATES) for s in STATES]
        yield _frame(rows, ["conv", "part", "after", "last"])


def _pointed(frames):
    """The back-pointers of stretches, and the state after each by the state before it."""
    for frame in frames:
        rows = []
        for conv, part, marks, after, last in zip(*(frame[c].tolist() for c in ("conv", "part", "marks", "after", "last"))):
            found, _ = pointers(marks, list(after))
            rows.append({"conv": conv, "part": part, "pointed": found, "exits": [letters(marks, found, s, False)[1] for s in STATES], "marks": marks, "last": last})
        yield _frame(rows, ["conv", "part", "marks", "pointed", "exits", "last"])


def _carry_state(frames):
    """Over the stretches of conversations from the first to the last: the state before each, and the initial before it."""
    conv, state, initial = None, 0, None
    for frame in frames:
        rows = []
        for own, part, exits, ends in zip(*(frame[c].tolist() for c in ("conv", "part", "exits", "ends"))):
            if own != conv:
                conv, state, initial = own, 0, None
            rows.append({"conv": conv, "part": part, "entry": state, "initial": initial})
            state = int(exits[state])
            initial = ends if ends is not None and ends == ends else initial
        yield _frame(rows, ["conv", "part", "entry", "initial"])


def _finished(names):
    def work(frames):
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                marks, state = row["final"], int(row["entry"])
                audit, _ = letters(marks, row["pointed"], state, bool(row["last"]))
                roles, texts, cost = applied(audit, marks, list(row["roles"]), list(row["texts"]), state)
                counts = _counts(marks)
                before = row["initial"]
                if marks and before is not None and before == before and (int(before), marks[0] % 4) not in LEGAL:
                    counts["illegal"] += 1
                rows.append(row | counts | {"marks": marks, "audit": audit, "roles": roles, "texts": texts, "cost": cost, "least": _whole_number(row["least"]), "most": _whole_number(row["most"])})
            yield _frame(rows, names)

    return work


def _exact(rows: DataFrame) -> DataFrame:
    """Numbers that may be null as texts: pandas would make them floating."""
    return rows.withColumns({c: F.col(c).cast("string") for c in ("least", "most")})


def _whole_number(x):
    return None if x is None or x != x else int(x)


def repaired_parts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, stretch: int = 4096, stretch_bytes: int = 4_000_000) -> DataFrame:
    """The repaired turns of all conversations, one row per stretch: conv_id, part, whole, roles and texts of the turns that
    remain, the initials of the edits, counts of faults, the least, largest and number of distinct turn numbers, and the cost.

    A conversation that is `whole` is one row; the parts of others follow by `part`. A turn's first fault counts: blank (no
    `[^\\x20\\x09-\\x0D]`), duplicate (its role and text stand earlier in the conversation), truncated (its last such character is
    none of `.!?`). Null roles and texts are one space; turns without a number come first, and those of one number follow by role
    and by a hash of the text. copies_col may say how often a row counts; a conversation whose rows count 0 times has a row without
    turns. Rows without a conversation id are one conversation. An empty table gives no rows; other columns are ignored.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    conv = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit(""))
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col)]
    number = F.col(turn_col).cast("long")
    copies = F.lit(1) if copies_col is None else F.col(copies_col).cast("int")
    rows = turns.select(conv.alias("conv"), F.col(conv_col).alias("conv_id"), number.isNotNull().alias("numbered"), F.coalesce(number, F.lit(0)).alias("turn"), said[0].alias("role"), said[1].alias("text"), copies.alias("copies"))
    # equal rows are told apart by their places, so that even they can be split; ids that are null must not make pandas guess
    order = ["conv", "numbered", "turn", "role", "hash", "place"]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    if kind in ("bigint", "int", "smallint", "tinyint"):
        rows = rows.withColumn("conv_id", F.coalesce("conv_id", F.lit(0).cast(kind)))
    rows = rows.repartitionByRange(tasks(turns), *order).sortWithinPartitions(*order).drop("hash", "place")
    schema = _part_schema(kind)
    names = [c.split(" ")[0] for c in schema.split(", ")]
    first = cut(rows.mapInPandas(_streamed([*names, "digests"], stretch, stretch_bytes), f"{schema}, digests array<binary>"))

    left = first.where(~F.col("whole"))
    # of the stretches that hold a turn, all but the first
    later = left.select("conv", "part", F.explode(F.array_distinct("digests")).alias("d")).groupBy("conv", "d").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    later = later.where(F.size("parts") > 1).select("conv", "d", F.explode(F.expr("slice(parts, 2, size(parts) - 1)")).alias("part"))
    seen = later.groupBy("conv", "part").agg(F.collect_list("d").alias("seen"))
    marked = left.select("conv", "part", "marks", "digests").join(seen, ["conv", "part"], "left")
    marked = cut(marked.mapInPandas(_marked, "conv string, part long, marks binary, m array<double>"))
    backwards = marked.select("conv", "part", "m").repartition(tasks(turns), "conv").sortWithinPartitions("conv", F.desc("part"))
    after = backwards.mapInPandas(_carry_costs, "conv string, part long, after array<double>, last boolean")
    pointed = marked.select("conv", "part", "marks").join(after, ["conv", "part"])
    pointed = cut(pointed.mapInPandas(_pointed, "conv string, part long, marks binary, pointed binary, exits array<int>, last boolean"))
    initial = F.when(F.length("marks") > 0, F.conv(F.hex(F.substring("marks", -1, 1)), 16, 10).cast("double") % 4)
    forwards = pointed.select("conv", "part", "exits", initial.alias("ends")).repartition(tasks(turns), "conv").sortWithinPartitions("conv", "part")
    states = forwards.mapInPandas(_carry_state, "conv string, part long, entry int, initial double")
    open_rows = left.drop("digests").join(pointed.withColumnRenamed("marks", "final").drop("exits"), ["conv", "part"]).join(states, ["conv", "part"])
    done = _exact(open_rows).mapInPandas(_finished(names), schema)
    whole = first.where("whole").drop("digests").unionByName(done)
    return whole.withColumn("conv_id", F.when(F.col("conv") != "", F.col("conv_id")))


def _put_together(names):
    def work(frames):
        conv, row, digest, pieces, begun = None, None, None, [], False

        def closed():
            return row | {"audit": "".join(pieces), "repaired_sha256": digest.hexdigest()}

        for frame in frames:
            ready = []
            for own in frame.to_dict("records"):
                if own["conv"] != conv:
                    if row is not None:
                        ready.append(closed())
                    conv, digest, pieces, begun = own["conv"], hashlib.sha256(), [], False
                    row = {"conv": conv, "conv_id": own["conv_id"], "least": None, "most": None, "distinct": 0} | dict.fromkeys(_COUNTS, 0)
                for c in _COUNTS:
                    row[c] += int(own[c])
                low, high = _whole_number(own["least"]), _whole_number(own["most"])
                if low is not None:
                    row["distinct"] += int(own["distinct"]) - (row["most"] == low)
                    row["least"], row["most"] = low if row["least"] is None else row["least"], high
                pieces.append(own["audit"])
                for role, text in zip(own["roles"], own["texts"]):
                    digest.update((("\n" if begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    begun = True
            if ready:
                yield _frame(ready, names)
        if row is not None:
            yield _frame([closed()], names)

    return work


def audits(parts: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps (numbers missing between the least and the largest), counts of faults and of
    illegal neighbours, cost, audit (initials of the edits in order) and repaired_sha256 of the `role:text` lines that remain."""
    spoken = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    whole = parts.where("whole").select("conv_id", *_TURNS, *_COUNTS, "audit", F.sha2(F.encode(spoken, "UTF-8"), 256).alias("repaired_sha256"))
    kind = parts.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in [*_TURNS, *_COUNTS])}, audit string, repaired_sha256 string"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    split = parts.where(~F.col("whole"))
    if kind in ("bigint", "int", "smallint", "tinyint"):
        split = split.withColumn("conv_id", F.coalesce("conv_id", F.lit(0).cast(kind)))
    split = split.repartition(tasks(parts), "conv").sortWithinPartitions("conv", "part").select("conv", "conv_id", *_TURNS, *_COUNTS, "audit", "roles", "texts")
    put = _exact(split).mapInPandas(_put_together(["conv", *names]), f"conv string, {schema}")
    put = put.withColumn("conv_id", F.when(F.col("conv") != "", F.col("conv_id"))).drop("conv")
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("distinct"), F.lit(0).cast("long"))
    return whole.unionByName(put).select("conv_id", gaps.alias("gaps"), *_COUNTS, "audit", "repaired_sha256")


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The damage of the registered query, by the CRC-32 of `conv_id:turn`: of twenty rows one is dropped (copies 0), one loses
    its text, one its `[.!?]`, one is there twice (copies 2) and one is said by the user. Nulls are one space."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col, role_col, text_col)]
    kind = F.crc32(F.encode(F.concat(said[0], F.lit(":"), said[1]), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said[3], "[.!?]", "")).otherwise(said[3])
    return turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.when(kind == 4, "user").otherwise(said[2]).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
