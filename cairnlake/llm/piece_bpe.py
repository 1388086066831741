"""SentencePiece BPE encoding and decoding.

A BPE encoding is the one sequence of pieces in which each two neighbours are compatible: merging the text of both by the
rules gives these two again. So it can be found from left to right. An Aho-Corasick automaton over the reversed pieces gives
the longest piece that starts at each place; the encoder takes it if it is compatible with the piece before, else the next
shorter one, and steps back where none fits. Places from which no way leads on are marked in a bitfield, so that no place is
tried twice and long texts without spaces take time in proportion to their length.

No piece has a space after another character, so texts are cut before each run of spaces, and between classes of
characters that stand together in no piece. The ids of short cuts are held.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from functools import cache
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.words import dealt, stretches, tokenizer_path, utf8

SPACE = "▁"
#: Longer cuts are encoded each time instead of being held.
LONGEST_HELD = 128
NONE = float("-inf")


class PieceEncoder:
    """The pieces of a model file, with the ids of words and the compatible pairs that were met; both are bounded by bytes."""

    def __init__(self, path: str, cache_bytes: int = 130_000_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and spaces before words are read")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("only models that leave texts as they are, but for a space put before, are read")
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end, unknown = library.eos_id(), library.unk_id()
        kinds = model.SentencePiece
        self.pieces = [p.piece for p in model.pieces]
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with pieces of the user's own are not read")
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space after another character")
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        #: What a piece is in a decoded text; bytes and the piece for unknown characters are told apart.
        self.shown = ["" if p.type == kinds.CONTROL else p.piece.replace(SPACE, " ") for p in model.pieces]
        self.shown[unknown] = trained.unk_surface
        self.bare = frozenset([unknown])
        self.lengths = [len(p) for p in self.pieces]
        self.room, self.used = cache_bytes, 0
        self.held: dict[str, tuple[int, ...]] = {}
        self.cuts = _cuts(self.ids)
        self.pairs: dict[int, bool] = {}
        self.traces: dict[int, tuple] = {}

        self.shorter, self.automaton = [-1] * len(self.pieces), ahocorasick.Automaton()
        kept = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merged(p) == [i]}
        for piece, i in kept.items():
            self.automaton.add_word(piece[::-1], i)
            self.shorter[i] = next((kept[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in kept), -1)
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[int]:
        """The encoding of a short text of known characters by the rules: the pair with the best score merges, the leftmost first."""
        parts, score = list(text), self.score.get
        scores = [score(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == NONE:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], NONE)
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], NONE)
        return [self.ids[p] for p in parts]

    def _trace(self, piece: int) -> tuple[list[float], list[str], list[str]]:
        """How a piece comes about from its characters: the score of each merge in turn, and the first and the last part before
        each merge and at the end."""
        found = self.traces.get(piece)
        if found is None:
            parts, score = list(self.pieces[piece]), self.score.get
            steps, first, last = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                scores = [score(a + b, NONE) for a, b in zip(parts, parts[1:])]
                i = scores.index(max(scores))
                steps.append(scores[i])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                first.append(parts[0])
                last.append(parts[-1])
            found = self.traces[piece] = ([*steps, NONE], first, last)
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of both pieces from its characters ends with these two: both come about as they do alone,
        the better merge first, unless one over the border is better than either (the leftmost of equal ones goes first)."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) * 200 > self.room:
                self.pairs.clear()
            (of_left, _, last), (of_right, first, _), score = self._trace(left), self._trace(right), self.score.get
            i = j = 0
            while True:
                over, a, b = score(last[i] + first[j], NONE), of_left[i], of_right[j]
                if over > a and over >= b and over > NONE:
                    found = False
                    break
                if a == b == NONE:
                    found = True
                    break
                if a >= b:
                    i += 1
                else:
                    j += 1
            self.pairs[key] = found
        return found

    def longest(self, text: str) -> list[int]:
        """By place the id of the longest piece that starts there, or -1."""
        met = list(self.automaton.iter(text[::-1]))
        met.reverse()  # of the pieces that end at one place the longest comes first, so now it is the one that stays
        return [*map(dict(met).get, range(len(text) - 1, -1, -1), repeat(-1))]

    def _search(self, longest: list[int], start: int, stop: int) -> list[int]:
        """The encoding of the known characters from start to stop."""
        lengths, shorter, pairs, compatible = self.lengths, self.shorter, self.pairs, self.compatible
        failed = None  # the bitfield, once there is anything to mark
        out, at, piece, last = [], start, longest[start], -1
        while True:
            end = at + lengths[piece]
            gone = end - start
            if end <= stop and not (failed and failed[gone >> 3] >> (gone & 7) & 1):
                fits = last < 0 or pairs.get(last << 32 | piece)
                if fits is None:
                    fits = compatible(last, piece)
                if fits:
                    out.append(piece)
                    if end == stop:
                        return out
                    at, last, piece = end, piece, longest[end]
                    continue
            piece = shorter[piece]
            while piece < 0:
                failed = failed or bytearray((stop - start >> 3) + 1)
                gone = at - start
                failed[gone >> 3] |= 1 << (gone & 7)
                if not out:
                    raise ValueError("the rules of this model are not those of BPE")
                piece, at = shorter[last], at - lengths[out.pop()]
                last = out[-1] if out else -1

    def cut_ids(self, text: str) -> tuple[int, ...]:
        """The ids of a cut: unknown characters become bytes, and nothing merges over them."""
        longest, start, out = self.longest(text), 0, []
        while start < len(text):
            if longest[start] < 0:
                out += [self.byte_ids[b] for b in text[start].encode("utf-8")]
                start += 1
                continue
            stop = longest.index(-1, start) if -1 in longest else len(text)
            out += self._search(longest, start, stop)
            start = stop
        found = tuple(out)
        if len(text) <= LONGEST_HELD:
            cost = 250 + len(text) + 8 * len(found)
            if self.used + cost > self.room:
                self.held.clear()
                self.used = 0
            self.held[text] = found
            self.used += cost
        return found

    def encode(self, text: str, at_once: int = 1_000_000) -> array:
        """The ids of a text and the end id. A long text is worked off in stretches that end before a space."""
        ids, at = array("i"), 0
        text = SPACE + text.replace(" ", SPACE) if text else ""
        while at < len(text):
            to = len(text)
            if to - at > at_once:
                before = _BOUNDARY.search(text, at + at_once)
                to = before.start() + 1 if before else to
            cuts = self.cuts.findall(text, at, to)
            found = list(map(self.held.get, cuts))
            if None in found:
                found = [self.held.get(c) or self.cut_ids(c) if f is None else f for c, f in zip(cuts, found)]
            ids.extend(chain.from_iterable(found))
            at = to
        ids.append(self.end)
        return ids

    def decode(self, ids) -> str:
        """The text of ids: the space put before the first piece goes, bytes are read as UTF-8, each that cannot be read
        is the replacement character, and control ids are nothing."""
        ids = list(ids)
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            out, run = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(_read(bytes(run)))
                    run.clear()
                out.append(self.shown[i])
            text = "".join(out) + (_read(bytes(run)) if run else "")
        first = next((i for i in ids if i in self.byte_of or self.shown[i]), None)
        return text[1:] if first is not None and first not in self.bare and self.pieces[first].startswith(SPACE) else text


def _cuts(pieces) -> re.Pattern:
    """Where texts can be cut without any piece lying over a cut: before a run of spaces; between characters of the largest
    class of those that meet in pieces (letters, mostly) and others; and around characters that meet none."""
    group = {}  # union-find over characters

    def top(c):
        while group.setdefault(c, c) != c:
            group[c] = c = group[group[c]]
        return c

    for piece in pieces:
        for a, b in zip(piece, piece[1:]):
            if SPACE not in (a, b):
                group[top(a)] = top(b)
    sizes = Counter(map(top, list(group)))
    if not sizes:
        return re.compile(f"(?s){SPACE}*[^{SPACE}]|{SPACE}+")
    main = sizes.most_common(1)[0][0]
    classes = [[c for c in group if (top(c) == main) == inside] for inside in (True, False)]
    runs = [f"{SPACE}*[{''.join(map(re.escape, sorted(c)))}]+" for c in classes if c]
    return re.compile("|".join([*runs, f"{SPACE}*[^{SPACE}]", f"{SPACE}+"]))


_BOUNDARY = re.compile(f"[^{SPACE}]{SPACE}")


def _read(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            width = next((n for n in (1, 2, 3, 4) if _whole(raw[at : at + n])), 0)
            out.append(raw[at : at + width].decode("utf-8") if width else "�")
            at += width or 1
        return "".join(out)


def _whole(raw: bytes) -> bool:
    try:
        return len(raw.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


@cache
def loaded(path: str, cache_bytes: int) -> PieceEncoder:
    return PieceEncoder(path, cache_bytes)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", bytes_at_once: int = 1_000_000, cache_bytes: int = 130_000_000) -> DataFrame:
    """id_col, ids array<int>: the ids that the sentencepiece library gives with this model, then the end id, for each row of docs.

    Null and empty texts have the end id alone; bytes that are not UTF-8 count as replacement characters; repeated rows stay;
    an empty table gives no rows; other columns are ignored, whatever their names. A task holds about bytes_at_once of texts,
    or one that is longer, and cache_bytes of ids of short cuts.
    """
    path = tokenizer_path(model)

    def work(batches):
        coder = loaded(path, cache_bytes)
        for batch in batches:
            for at, to in stretches(batch.column(1), bytes_at_once):
                part = batch.slice(at, to - at)
                found = [coder.encode((t or b"").decode("utf-8", "replace")) for t in utf8(part.column(1))]
                ends = np.cumsum([0, *map(len, found)])
                flat = np.concatenate([np.frombuffer(f, np.int32) for f in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return dealt(docs.select(id_col, text_col)).mapInArrow(work, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = "piece_bpe_32k.model", bytes_at_once: int = 1_000_000, cache_bytes: int = 130_000_000) -> DataFrame:
    """id_col, ids_col, decoded string: what the sentencepiece library's decode gives for each row's ids.

    Null ids are as none, which give the empty text; ids that the model does not have are an error."""
    path = tokenizer_path(model)

    def work(batches):
        coder = loaded(path, cache_bytes)
        for batch in batches:
            ends, at = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + bytes_at_once // 4, side="right")))
                part = batch.slice(at, to - at)
                texts = [coder.decode(v.values.to_numpy().tolist() if v.is_valid else []) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [id_col, ids_col, "decoded"])
                at = to

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(work, f"`{id_col}` {kind}, `{ids_col}` array<int>, decoded string")


def digest_columns(decoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, n_tokens long, ids_sha256 of the decimal ids joined by one space, decoded_sha256 of the decoded text in UTF-8."""
    numbers = F.array_join(F.col(ids_col).cast("array<string>"), " ")
    return decoded.select(
        id_col,
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.encode(numbers, "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
