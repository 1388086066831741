"""Removing word sequences that occur more than once in the corpus, exactly.

Three steps over groups of documents, each reading the same shuffled texts:

1. every group counts its windows in a count-min sketch of `depth` rows of 2^cell_bits counters, each with a hash of its own,
   kept sparsely: the sorted cells that are not zero, and a bit for "two or more". Sketches are cut into ranges of cells,
   shuffled, and added up; what goes back to a group is one bit for each cell that it sent: is the merged count two or more?
   A window is estimated as repeated if that holds in every row. Equal windows share their cells, so no estimate, the least
   over the rows, is ever too low.
2. only windows estimated as repeated are grouped exactly: the groups send distinct 128-bit digests of the windows' words,
   and again get back one bit for each.
3. each group marks the words under its repeated windows and drops them.

Before either shuffle a group sends each cell or digest once, so a passage found in a third of all documents costs one
entry per group. A sparse row takes about 2 bytes a window; the sketch is never gathered in one place.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.words import free_names, spread, utf8
from cairnlake.plans.checkpoints import cut

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Odd factors that make the rows of the sketch independent of each other.
_ROWS = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_powers: list[tuple[np.ndarray, np.ndarray]] = []
_STEP = 1 << 16
_MESSAGE = "block long, home long, payload binary"


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """b^0..b^n and their inverses modulo 2^64."""
    if not _powers or len(_powers[0][0]) <= n:
        size = 1 << (n + 1).bit_length()
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _powers[:] = [tuple(both)]
    return _powers[0]


class Document:
    """Words of one text, joined by one space, and where each starts and ends."""

    def __init__(self, text: bytes | None, window: int):
        self.words = (text or b"").split()
        self.joined = b" ".join(self.words)
        self.windows = max(0, len(self.words) - window + 1)
        if self.windows:
            self.bytes = np.frombuffer(self.joined, np.uint8)
            self.ends = np.append(np.flatnonzero(self.bytes == 32), len(self.bytes))
            self.starts = np.append(0, self.ends[:-1] + 1)

    def hashes(self, window: int) -> np.ndarray:
        """64 bits of each window: a polynomial hash of its bytes from prefix sums, a stretch at a time."""
        out = np.empty(self.windows, np.uint64)
        for a in range(0, self.windows, _STEP):
            b = min(a + _STEP, self.windows)
            low, high = self.starts[a], self.ends[b + window - 2]
            up, down = _power(int(high - low))
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((self.bytes[low:high].astype(np.uint64) + np.uint64(1)) * down[: high - low], out=sums[1:])
            s, e = self.starts[a:b] - low, self.ends[a + window - 1 : b + window - 1] - low
            h = (sums[e] - sums[s]) * up[s]
            h ^= h >> np.uint64(31)
            h *= _MIX
            out[a:b] = h ^ (h >> np.uint64(33))
        return out

    def digests(self, which: np.ndarray, window: int) -> np.ndarray:
        """128-bit digests of the chosen windows' words, as rows of two unsigned 64-bit numbers."""
        digest, joined = xxhash.xxh3_128_digest, self.joined
        spans = zip(self.starts[which].tolist(), self.ends[which + window - 1].tolist())
        return np.frombuffer(b"".join([digest(joined[s:e]) for s, e in spans]), ">u8").astype(np.uint64).reshape(-1, 2)


def _planes(values: np.ndarray) -> bytes:
    """Sorted numbers as byte planes of their differences; the planes of high bytes are nearly all zero and compress away."""
    deltas = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(deltas.max()).bit_length() + 7) // 8) if len(deltas) else 1
    return bytes([width]) + deltas.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((n, 8), np.uint8)
    planes[:, : data[0]] = np.frombuffer(data, np.uint8, n * data[0], 1).reshape(data[0], n).T
    return np.cumsum(planes.reshape(-1).view("<u8"), dtype=np.uint64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _unbits(data: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).view(bool)


def _messages(rows: list[tuple]) -> pa.Table:
    block, home, payload = [*zip(*rows)] or [[], [], []]
    return pa.table({"block": pa.array(block, pa.int64()), "home": pa.array(home, pa.int64()), "payload": pa.array(payload, pa.binary())})


class Group:
    """Windows of a group of documents: their cells, and after the first answer the digests of those that may repeat.

    Windows are numbered over the documents in order of their texts, since rows come in another order in each step.
    """

    def __init__(self, texts: list, window: int, bits: int, depth: int, blocks: int):
        self.order = sorted(range(len(texts)), key=lambda i: texts[i] or b"")
        self.docs, self.window, self.bits, self.depth, self.shift = [Document(texts[i], window) for i in self.order], window, bits, depth, bits - (blocks - 1).bit_length()
        self.blocks, self.total = blocks, sum(d.windows for d in self.docs)

    def hashes(self) -> np.ndarray:
        return np.concatenate([d.hashes(self.window) for d in self.docs if d.windows] or [np.empty(0, np.uint64)])

    def row(self, hashes: np.ndarray, r: int):
        """Distinct cells of a row of the sketch in order, which is whose, and whether a cell has two windows here."""
        cells = hashes * _ROWS[r]
        cells = (cells ^ (cells >> np.uint64(32))) * _MIX >> np.uint64(64 - self.bits)
        distinct, whose, counts = np.unique(cells, return_inverse=True, return_counts=True)
        return distinct, whose, counts > 1

    def parts(self, distinct: np.ndarray, shift: int):
        """(block, from, to) of the blocks that have any of these sorted numbers."""
        of = distinct >> np.uint64(shift)
        cuts = np.flatnonzero(np.diff(of, prepend=of[:1] + np.uint64(1))) if len(of) else np.empty(0, int)
        return [(int(of[a]), int(a), int(b)) for a, b in zip(cuts, np.append(cuts[1:], len(of)))]

    def sketch(self, home: int) -> list[tuple]:
        out, hashes = [], self.hashes()
        for r in range(self.depth):
            distinct, _, twice = self.row(hashes, r)
            for block, a, b in self.parts(distinct, self.shift):
                out.append((r * self.blocks + block, home, (b - a).to_bytes(4, "little") + _bits(twice[a:b]) + _planes(distinct[a:b] - np.uint64(block << self.shift))))
        return out

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """Whether each window is estimated to occur twice or more: in every row of the sketch."""
        out, hashes = np.ones(self.total, bool), self.hashes()
        for r in range(self.depth):
            distinct, whose, flags = self.row(hashes, r)
            for block, a, b in self.parts(distinct, self.shift):
                if (answer := answers.get(r * self.blocks + block)) is not None:
                    flags[a:b] |= _unbits(answer, b - a)
            out &= flags[whose]
        return out

    def digests(self, flags: np.ndarray):
        """Distinct digests of the flagged windows in order, which is whose, and whether one occurs twice here."""
        found, at = [np.empty((0, 2), np.uint64)], 0
        for d in self.docs:
            if d.windows:
                if len(which := np.flatnonzero(flags[at : at + d.windows])):
                    found.append(d.digests(which, self.window))
                at += d.windows
        pairs = np.concatenate(found)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
        rank = np.cumsum(new) - 1
        whose = np.empty(len(pairs), np.int64)
        whose[order] = rank
        return pairs[new], whose, np.bincount(rank, minlength=int(new.sum())) > 1

    def exact(self, home: int, flags: np.ndarray) -> list[tuple]:
        """The digests to be grouped, and a message to the group itself (of a block below 0) of whose they are."""
        if not flags.any():
            return []
        distinct, _, twice = self.digests(flags)
        rows = [
            (block, home, (b - a).to_bytes(4, "little") + _bits(twice[a:b]) + distinct[a:b].tobytes())
            for block, a, b in self.parts(distinct[:, 0], 64 - (self.blocks - 1).bit_length())
        ]
        return [(-1 - home, home, _bits(flags)), *rows]

    def covered(self, answers: dict[int, bytes], home: int) -> list[np.ndarray | None]:
        """For each document, in order of texts, a mask of the words under a repeated window, or None where there is none."""
        if -1 - home not in answers:
            return [None] * len(self.docs)
        flags = _unbits(answers[-1 - home], self.total)
        distinct, whose, again = self.digests(flags)
        for block, a, b in self.parts(distinct[:, 0], 64 - (self.blocks - 1).bit_length()):
            if (answer := answers.get(block)) is not None:
                again[a:b] |= _unbits(answer, b - a)
        sure = np.zeros(self.total, bool)
        sure[flags] = again[whose]
        out, at = [], 0
        for d in self.docs:
            which = np.flatnonzero(sure[at : at + d.windows])
            at += d.windows
            if not len(which):
                out.append(None)
                continue
            edge = np.zeros(len(d.words) + 1, np.int32)
            edge[which] += 1
            np.add.at(edge, which + self.window, -1)
            out.append(np.cumsum(edge[:-1]) > 0)
        return out


def _merge(key, table: pa.Table, digests: bool) -> pa.Table:
    """Adds up what the groups sent for one block; a bit for each entry says if it occurs twice or more in all."""
    if key[0].as_py() < 0:
        return table.select(["block", "home", "payload"])
    homes, entries, twice = table.column("home").to_pylist(), [], []
    for data in table.column("payload").to_pylist():
        n = int.from_bytes(data[:4], "little")
        head = 4 + (n + 7) // 8
        twice.append(_unbits(data, n, 4))
        entries.append(np.frombuffer(data, np.uint64, 2 * n, head).reshape(n, 2) if digests else _unplanes(data[head:], n))
    every = np.concatenate(entries)
    order = np.lexsort((every[:, 1], every[:, 0])) if digests else np.argsort(every, kind="stable")
    every = every[order]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:] != every[:-1]).any(axis=1) if digests else every[1:] != every[:-1]
    rank = np.cumsum(new) - 1
    counts = np.bincount(rank, weights=1 + np.concatenate(twice)[order])
    flags = np.empty(len(every), bool)
    flags[order] = counts[rank] > 1
    rows, at = [], 0
    for home, e in zip(homes, entries):
        if (own := flags[at : at + len(e)]).any():
            rows.append((key[0].as_py(), home, _bits(own)))
        at += len(e)
    return _messages(rows)


def _answers(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("block").to_pylist(), table.column("payload").to_pylist()))


def result_names(docs: DataFrame) -> list[str]:
    """What remove_repeats calls kept_text, n_words and n_removed: with underscores where docs has such a column itself."""
    return free_names(docs.columns, "kept_text", "n_words", "n_removed")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, cell_bits: int = 34, depth: int = 2,
    bytes_per_group: int = 4 << 20, bytes_per_block: int = 32 << 20, least_blocks: int = 256, seed: int = 29,
) -> DataFrame:
    """All columns of docs, then kept_text string, n_words long, n_removed long (see result_names).

    Words are runs of anything but the ASCII white space characters. A word goes if it lies in a window of `window`
    consecutive words whose sequence starts anywhere else too, in the same text or another; windows are judged on the
    input. kept_text joins what stays by one space. A null text has no words (kept_text is empty); a text shorter than
    the window is kept; repeated rows count as documents of their own, so their long texts go wholly; an empty table gives
    no rows. Equality is that of 128-bit digests.

    A group has about bytes_per_group of text. Each row of the sketch is cut into one block for every bytes_per_block of the
    corpus, least_blocks at least: that bounds what a block's task adds up at any size. A group sends a block a message only
    if it has windows there, so there are never more messages than windows; above some 100 GB larger groups keep them full.
    """
    group, total, placed = spread(docs, id_col, text_col, bytes_per_group, seed)
    blocks = 1 << (max(least_blocks, -(-total // bytes_per_block)) - 1).bit_length()
    args = (window, cell_bits, depth, blocks)
    own = free_names(docs.columns, "grp")[0]
    texts, names, place = docs.withColumn(own, group), result_names(docs), docs.columns.index(text_col)
    if placed:  # the three passes below must see the same groups, whatever is computed anew
        texts = cut(texts)

    def sketch(key, table):
        return _messages(Group(utf8(table.column(place)), *args).sketch(key[0].as_py()))

    def exact(key, table, replies):
        if not table.num_rows:
            return _messages([])
        group = Group(utf8(table.column(place)), *args)
        return _messages(group.exact(key[0].as_py(), group.repeated(_answers(replies))))

    def finish(key, table, replies):
        group = Group(utf8(table.column(place)), *args)
        masks = group.covered(_answers(replies), key[0].as_py())
        kept, words, removed = [None] * len(masks), [0] * len(masks), [0] * len(masks)
        for i, d, m in zip(group.order, group.docs, masks):
            kept[i] = d.joined if m is None else b" ".join(compress(d.words, (~m).tolist()))
            words[i], removed[i] = len(d.words), 0 if m is None else int(m.sum())
        table = table.drop_columns([own]).append_column(names[0], pa.array(kept, pa.binary()).cast(pa.string()))
        return table.append_column(names[1], pa.array(words, pa.int64())).append_column(names[2], pa.array(removed, pa.int64()))

    def back(messages, digests):
        return messages.groupBy("block").applyInArrow(lambda key, table: _merge(key, table, digests), _MESSAGE).groupBy("home")

    by_group = texts.groupBy(own)
    first = back(by_group.applyInArrow(sketch, _MESSAGE), False)
    second = back(by_group.cogroup(first).applyInArrow(exact, _MESSAGE), True)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{names[0]}` string, `{names[1]}` long, `{names[2]}` long"
    return by_group.cogroup(second).applyInArrow(finish, schema)


def digest_columns(kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return kept.select(id_col, "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
