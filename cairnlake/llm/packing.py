"""Packing documents into fixed-length token sequences.

Documents are dealt into random groups; each group tokenises its texts and packs them by itself, so one shuffle of the
texts is the whole exchange and no group depends on another. In a group every full run of `capacity` tokens is a sequence
of its own, and what remains of each document goes through first-fit decreasing over a tournament tree of free capacities.
The emptiest bins are then dissolved: their pieces are cut to fill the others exactly. What is left over of a group, less than
one sequence, goes to a second round, which packs the rests of many groups in the same way; only what is left over there is
cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.words import byte_alphabet, free_names, spread, tokenizer_path, utf8
from cairnlake.plans.checkpoints import cut

#: Rests of so many groups are packed together in the second round: some 4 MB of ids.
GROUPS_AT_ONCE = 512
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: The ids of a piece that waits for the second round.
_REST = "pack_rest_ids"
_caches: dict[tuple[str, int], "ChunkIds"] = {}


#: Characters whose normal form, lower case and class are plain: printable ASCII but the apostrophe (contractions), and the
#: letters of Latin-1. A chunk of these needs no more than lower case and cutting into letters, digits and other marks.
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class ChunkIds(dict):
    """Token ids (little-endian unsigned 32-bit) of text between white space, each distinct chunk encoded once.

    White space always separates the tokens of this vocabulary and leaves none itself, so the ids of a text are those of
    its chunks. Plain chunks go straight to the library's model, others through its whole chain. When `limit` chunks or `room`
    bytes are held they become the older half, and the half before them is dropped; what is asked for again moves back. Chunks
    of more than `longest` bytes (texts without spaces) are encoded each time.
    """

    def __init__(self, path: str, limit: int = 400_000, room: int = 80_000_000, longest: int = 256):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.limit, self.room, self.longest, self.used = limit, room, longest, 0
        self.older, self.tokenizer = {}, Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        with open(path, encoding="utf-8") as f:
            self.special = [a["content"] for a in json.load(f)["added_tokens"]]

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.fresh(chunk)
            if len(chunk) > self.longest:
                return ids
        if len(self) >= self.limit or self.used > self.room:
            self.older, self.used = dict(self), 0
            self.clear()
        self[chunk] = ids
        self.used += len(chunk) + len(ids) + 150
        return ids

    def fresh(self, chunk: bytes) -> bytes:
        packed = self.packed
        if chunk.isalpha():
            return b"".join([packed[t.id] for t in self.tokenize(chunk.lower().decode())])
        text = chunk.decode()
        if _PLAIN.fullmatch(text) and not ("<" in text and any(s in text for s in self.special)):
            pieces = _PIECES.findall(text.lower())
            if not text.isascii():
                pieces = [p.encode().decode("latin-1").translate(self.alphabet) for p in pieces]
            return b"".join([packed[t.id] for p in pieces for t in self.tokenize(p)])
        return b"".join([packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions in sizes. A tournament tree over the bins' free room finds the leftmost that fits."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    tree, bins, height = [capacity] * (2 * leaves), [], leaves.bit_length() - 1
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        need, node = sizes[item], 1
        if need > capacity:
            raise ValueError(f"an item of {need} is larger than a bin of {capacity}")
        for _ in range(height):
            node = 2 * node if tree[2 * node] >= need else 2 * node + 1
        tree[node] -= need
        if (place := node - leaves) == len(bins):
            bins.append([])
        bins[place].append(item)
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins


def fill_up(rests: list[tuple[int, int, int]], capacity: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full sequences of (document, start, length) for what is left of each document, and what they leave over: less than one."""
    bins = [[rests[i] for i in b] for b in first_fit_decreasing([r[2] for r in rests], capacity)]
    loads = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (-loads[i], i))
    whole = sum(loads) // capacity
    full, loose = [bins[i] for i in order[:whole]], [p for i in order[whole:] for p in bins[i]]
    loose.reverse()
    for b, i in zip(full, order):
        b += take(loose, capacity - loads[i])
    return full, loose[::-1]


def take(loose: list[tuple[int, int, int]], room: int) -> list[tuple[int, int, int]]:
    """Pieces of this many tokens from the end of loose, which keeps what is cut off."""
    got = []
    while room:
        doc, start, length = loose.pop()
        cut_off = min(room, length)
        got.append((doc, start, cut_off))
        if cut_off < length:
            loose.append((doc, start + cut_off, length - cut_off))
        room -= cut_off
    return got


def powers(loose: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Sequences of falling powers of two."""
    left, loose = sum(p[2] for p in loose), loose[::-1]
    return [take(loose, 1 << bit) for bit in reversed(range(left.bit_length())) if left >> bit & 1]


def _table(rows: list[tuple], id_col: str, kind: pa.DataType) -> pa.Table:
    columns = [*zip(*rows)] or [[]] * 8
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", _REST]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, [kind, *[pa.int64()] * 6, pa.binary()])})


def _rows(sequences, group: int, docs: list, ids: list[bytes], first: list[int], tokens: list[int]) -> list[tuple]:
    """The pieces of sequences as rows; ids of each document from its first id on."""
    rows = []
    for k, pieces in enumerate(sequences):
        offset = 0
        for i, start, length in pieces:
            at = 4 * (start - first[i])
            rows.append((docs[i], start, length, zlib.crc32(ids[i][at : at + 4 * length]), tokens[i], (group << 32) + k, offset, None))
            offset += length
    return rows


def _pack_group(key, table: pa.Table, path, end_id, capacity, limit, id_col) -> pa.Table:
    if (path, limit) not in _caches:
        _caches[path, limit] = ChunkIds(path, limit)
    encode, end = _caches[path, limit].encode, struct.pack("<I", end_id)
    docs = table.column(0).to_pylist()
    ids = [encode(t or b"") + end for t in utf8(table.column(1))]
    order = sorted(range(len(docs)), key=lambda i: (docs[i] is None, docs[i] or 0, ids[i]))
    sequences, rests = [], []
    for i in order:
        n = len(ids[i]) // 4
        sequences += [[(i, at, capacity)] for at in range(0, n - capacity + 1, capacity)]
        if rest := n % capacity:
            rests.append((i, n - rest, rest))
    full, loose = fill_up(rests, capacity)
    tokens, group = [len(x) // 4 for x in ids], key[0].as_py()
    rows = _rows(sequences + full, group, docs, ids, [0] * len(docs), tokens)
    rows += [(docs[i], start, length, 0, tokens[i], group, 0, ids[i][4 * start : 4 * (start + length)]) for i, start, length in loose]
    return _table(rows, id_col, table.schema.field(0).type)


def _pack_rests(key, table: pa.Table, capacity, id_col) -> pa.Table:
    rows = sorted(zip(*[c.to_pylist() for c in table.select([id_col, "start", "doc_tokens", _REST]).columns]), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
    docs, first, tokens, ids = ([r[j] for r in rows] for j in range(4))
    full, loose = fill_up([(i, first[i], len(x) // 4) for i, x in enumerate(ids)], capacity)
    return _table(_rows(full + powers(loose), key[0].as_py(), docs, ids, first, tokens), id_col, table.schema.field(id_col).type)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = 4096, bytes_per_group: int = 4 << 20, seed: int = 17, cache_limit: int = 400_000) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids are those of `tokenizer` without special tokens added, then `end_id`; every id lies in exactly one
    piece and a sequence's pieces are gapless from offset 0. Sequences hold `capacity` ids, or a smaller power of two.
    Groups have about bytes_per_group of text. Null and empty texts are one `end_id`; repeated rows are packed each for itself; an empty table gives no rows; other
    columns are ignored, whatever their names. A document's whole ids must fit a task's memory (4 bytes an id).
    """
    path = tokenizer_path(tokenizer)
    group, total, _ = spread(docs, id_col, text_col, bytes_per_group, seed)
    groups = max(1, -(-total // bytes_per_group))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {PIECES}, `{_REST}` binary"

    def first(key, table):
        return _pack_group(key, table, path, end_id, capacity, cache_limit, id_col)

    def second(key, table):
        return _pack_rests(key, table.drop_columns(["pack_round"]), capacity, id_col)

    own = free_names([id_col, text_col], "pack_group")[0]
    packed = cut(docs.select(id_col, text_col, group.alias(own)).groupBy(own).applyInArrow(first, schema))
    rests = packed.where(F.col(_REST).isNotNull()).withColumn("pack_round", F.lit(groups) + F.floor(F.col("sequence_id") / GROUPS_AT_ONCE))
    rests = rests.groupBy("pack_round").applyInArrow(second, schema)
    return packed.where(F.col(_REST).isNull()).unionByName(rests).drop(_REST)
