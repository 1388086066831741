"""Byte-pair encoding by a trie of words that share their prefixes, and decoding.

The encoding of a text is fixed by the last token of each of its prefixes: the token t that ends there such that t and the
last token of what comes before t stay apart when only these two are merged. So each trie node needs one token, found from
its ancestors' tokens, and words that share a prefix share that work. Words are inserted in order, which visits new nodes
depth first.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.words import byte_alphabet, dealt, stretches, tokenizer_path

#: The public byte-level split pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes are the same in all recent Unicode versions; a text with others is split by the library itself.
SETTLED = "\x00-՗Ḁ-⁯ぁ-ゖ一-龥가-힣"
_loaded: dict[tuple, "TrieEncoder"] = {}


class TrieEncoder:
    """Encodes as the tokenizers library does with a byte-level BPE file, and decodes. `limit` bounds nodes and words held."""

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        plain = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.ids = {bytes(alphabet[c] for c in t): i for t, i in plain.items()}
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.merges = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.merges[plain[a], plain[b]] = (rank, plain[a + b])
        self.longest = max(map(len, self.ids))
        self.pattern, self.unsettled = regex.compile(PATTERN), re.compile(f"[^{SETTLED}]")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library, self.limit, self.apart = Tokenizer.from_file(path).pre_tokenizer, limit, {}
        self.words: dict[str, bytes] = {}
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}
        self.last: list[int] = [-1]

    def merged(self, tokens: list[int]) -> list[int]:
        """Plain merging, lowest rank first and leftmost among equals; only ever used on the bytes of one or two tokens."""
        while len(tokens) > 1:
            _, at, new = self._best(tokens)
            if new < 0:
                break
            tokens[at : at + 2] = [new]
        return tokens

    def _best(self, tokens: list[int]) -> tuple[int, int, int]:
        best = (1 << 60, 0, -1)
        for i, pair in enumerate(zip(tokens, tokens[1:])):
            if (m := self.merges.get(pair)) and m[0] < best[0]:
                best = (m[0], i, m[1])
        return best

    def stays(self, before: int, token: int) -> bool:
        """Whether two tokens next to each other are what merging their bytes gives; before is -1 at a word's start."""
        key = before << 32 | token if before >= 0 else -1 - token
        if (known := self.apart.get(key)) is None:
            data = (self.bytes[before] if before >= 0 else b"") + self.bytes[token]
            known = self.merged([self.ids[data[i : i + 1]] for i in range(len(data))]) == ([before, token] if before >= 0 else [token])
            if len(self.apart) >= 8 * self.limit:
                self.apart.clear()
            self.apart[key] = known
        return known

    def insert(self, word: bytes) -> list[int]:
        """Walks or grows the trie along word and returns its tokens."""
        child, last, ids = self.child, self.last, self.ids
        path = [0]
        node = 0
        for depth, byte in enumerate(word, 1):
            key = node << 8 | byte
            node = child.get(key, -1)
            if node < 0:
                for start in range(max(0, depth - self.longest), depth):
                    token = ids.get(word[start:depth])
                    if token is not None and self.stays(last[path[start]], token):
                        break
                else:
                    raise ValueError("the vocabulary has no token for a byte")
                node = child[key] = len(last)
                last.append(token)
            path.append(node)
        tokens, at = [], len(word)
        while at:
            token = last[path[at]]
            tokens.append(token)
            at -= len(self.bytes[token])
        return tokens[::-1]

    def split(self, text: str) -> list[str]:
        if self.unsettled.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers. Words new to this batch go into the trie in order."""
        parts = [[(p, p in self.special) for p in self.cut.split(t)] if self.cut and any(s in t for s in self.special) else [(t, False)] for t in texts]
        split = [[([p] if special else self.split(p), special) for p, special in ps] for ps in parts]
        new = {w for ps in split for ws, special in ps if not special for w in ws}.difference(self.words)
        if len(self.words) + len(new) > self.limit:
            self.words = {}
            new = {w for ps in split for ws, special in ps if not special for w in ws}
        for word in sorted(new):
            if len(self.last) > 4 * self.limit:
                self.reset()
            self.words[word] = np.array(self.insert(word.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        word = self.words.__getitem__
        return [b"".join(b"".join([self.special[w].to_bytes(4, "little") for w in ws] if special else map(word, ws)) for ws, special in ps) for ps in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def loaded(path: str, limit: int) -> TrieEncoder:
    if (path, limit) not in _loaded:
        _loaded[path, limit] = TrieEncoder(path, limit)
    return _loaded[path, limit]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", bytes_at_once: int = 1_000_000, limit: int = 300_000) -> DataFrame:
    """id_col, ids binary (little-endian unsigned 32-bit), n_tokens int, decoded string: one row per row of docs.

    Ids and decoded text are those of the tokenizers library with this byte-level BPE file (special tokens in a text are
    recognised, none are added). Null and empty texts have no ids and decode to the empty text; repeated rows stay; an empty
    table gives no rows; other columns are ignored, whatever their names. A task holds about `bytes_at_once` of texts, or one that is longer,
    and `limit` distinct words; rows are dealt over idle tasks only where the table has fewer splits than the cluster has cores.
    """
    path = tokenizer_path(tokenizer)

    def work(batches):
        coder = loaded(path, limit)
        for batch in batches:
            for at, to in stretches(batch.column(1), bytes_at_once):
                part = batch.slice(at, to - at)
                ids = coder.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([coder.decode(i) for i in ids], pa.string())],
                    [id_col, "ids", "n_tokens", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return dealt(docs.select(id_col, text_col)).mapInArrow(work, f"`{id_col}` {kind}, ids binary, n_tokens long, decoded string")


def digest_columns(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )
