"""Language identification of mixed-language text.

A model of character n-grams per language is counted by Spark over a bounded sample of labelled rows. To label a text, the
script of each word narrows its candidate languages, the n-grams give the word a score in each, and a Viterbi pass with a
penalty for switching finds the best sequence of labels, whose runs are the spans. Documents of a batch walk through it
side by side, one step per word.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.words import dealt, free_names, stretches

#: First code points of script ranges; what lies between two counts to the first.
SCRIPTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "other"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF65, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x30000, "other")]
_STARTS = [s for s, _ in SCRIPTS]


def _numerals() -> str:
    """Ranges of the characters that count as words for Python and are neither letters nor decimal digits, such as fractions."""
    own = [c for c in range(sys.maxunicode + 1) if (x := chr(c)).isalnum() and not x.isalpha() and not x.isdecimal()]
    starts = [c for i, c in enumerate(own) if not i or own[i - 1] + 1 < c]
    ends = [c for i, c in enumerate(own) if i + 1 == len(own) or own[i + 1] > c + 1]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends))


#: Runs of letters.
WORDS = re.compile(rf"[^\W\d_{_numerals()}]+")
UNKNOWN = "und"
_scorers: dict[str, "Scorer"] = {}


def script(word: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def grams(word: str, longest: int = 4) -> list[str]:
    """The n-grams of a marked word from 2 up to `longest`, and the whole word."""
    w = f"<{word}>"
    return [w[i : i + n] for n in range(2, longest + 1) for i in range(len(w) - n + 1)] + [w]


class Model:
    """Log-probabilities of n-grams in each language, and the languages of each script."""

    def __init__(self, counts: list[tuple[str, str, int]], smoothing: float = 0.3):
        self.langs = sorted({lang for lang, _, _ in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        names = sorted({g for _, g, _ in counts if not g.startswith("\0")})
        self.grams = {g: i for i, g in enumerate(names)}
        table = np.full((len(names) + 1, len(self.langs)), smoothing)
        by_script: dict[str, Counter] = {}
        for lang, gram, n in counts:
            if gram.startswith("\0"):
                by_script.setdefault(gram[1:], Counter())[lang] += n
            else:
                table[self.grams[gram], at[lang]] += n
        totals = table.sum(axis=0)
        self.table = (np.log(table) - np.log(totals)).astype(np.float32) if self.langs else table
        words = Counter()
        for c in by_script.values():
            words.update(c)
        self.scripts = {s: np.array([c[lang] >= 0.01 * words[lang] for lang in self.langs]) for s, c in by_script.items()}
        self.key = hashlib.sha256(repr(sorted(counts)).encode()).hexdigest()


class Lookup:
    """The rows of many n-grams at once. Characters in n-grams have numbers (from 1; 0 is any other), and by n the n-grams are
    sorted numbers of 16 bits a character; models of more than 65,535 characters are looked up n-gram by n-gram."""

    def __init__(self, rows: dict[str, int]):
        self.grams, self.packed = rows, {}
        own = sorted({ord(c) for g in rows for c in g})
        self.wide = len(own) >= 1 << 16
        if self.wide:
            return
        self.chars = np.zeros(sys.maxunicode + 1, np.uint16)
        self.chars[own] = np.arange(1, len(own) + 1)
        for n in range(2, 5):
            names = [g for g in rows if len(g) == n]
            keys = np.zeros(len(names), np.uint64)
            codes = self.chars[code_points("".join(names))].reshape(-1, n)
            for k in range(n):
                keys = keys << np.uint64(16) | codes[:, k].astype(np.uint64)
            order = np.argsort(keys)
            self.packed[n] = keys[order], np.array([rows[g] for g in names], np.int64)[order]

    def found(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all grams of words, in the order of `grams` word by word, and how many each word has."""
        if self.wide:
            found = [[self.grams.get(g, len(self.grams)) for g in grams(w)] for w in words]
            return np.array([i for f in found for i in f], np.int64), np.fromiter(map(len, found), np.int64, len(found))
        marked = [f"<{w}>" for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        codes = self.chars[code_points("".join(marked))].astype(np.uint64)
        starts = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(marked)), sizes)
        place = np.arange(len(codes)) - starts[word]
        counts = 1 + sum(np.maximum(sizes - n + 1, 0) for n in self.packed)
        at = np.cumsum(counts) - counts
        rows = np.empty(int(counts.sum()), np.int64)
        keys = codes
        for n, (known, row) in self.packed.items():
            keys = keys[:-1] << np.uint64(16) | codes[n - 1 :]
            own = np.flatnonzero(place[: len(keys)] + n <= sizes[word[: len(keys)]])
            asked, unknown = keys[own], len(self.grams)
            if len(known):
                i = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                hit = np.where(known[i] == asked, row[i], unknown)
            else:
                hit = np.full(len(asked), unknown)
            rows[at[word[own]] + place[own]] = hit
            at = at + np.maximum(sizes - n + 1, 0)
        rows[at] = [self.grams.get(w, len(self.grams)) for w in marked]
        return rows, counts


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def train(labelled: DataFrame, text_col: str, lang_col: str, order: Column, rows_per_language: int = 600, least: int = 2, longest: int = 4) -> Model:
    """A model from about rows_per_language rows of each language, chosen by the hash in `order`: all their n-grams that occur
    `least` times or more, counted over all languages together, so that an n-gram is kept for all of them or for none. The
    sample bounds what reaches the driver at any table size."""
    counts = dict(labelled.groupBy(lang_col).count().collect())
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, rows_per_language / n)))]) if counts else None
    if share is None:
        return Model([])
    chosen = labelled.where(F.pmod(order, F.lit(1 << 30)) < F.try_element_at(share, F.col(lang_col)) * (1 << 30)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        for b in batches:
            found = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for word, n in Counter(WORDS.findall((text or "").lower())).items():
                    found[lang, "\0" + script(word)] += n
                    for g in grams(word, longest):
                        found[lang, g] += n
            lang, gram = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(found.values(), pa.int64())], ["lang", "gram", "n"])

    every = chosen.mapInArrow(count, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    every = every.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("all"))
    # a script is kept however rare it is
    kept = every.where((F.col("all") >= least) | F.col("gram").startswith("\0")).select("gram", F.explode("by").alias("b"))
    return Model([tuple(r) for r in kept.select("b.lang", "gram", "b.n").collect()])


class Scorer:
    """Scores of words in every language, worked out once per distinct word and held for at most `limit` of them."""

    def __init__(self, model: Model, limit: int = 200_000, floor: float = 8.0):
        self.model, self.limit, self.floor = model, limit, floor
        self.lookup = Lookup(model.grams)
        self.index: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.langs)), np.float32)
        self.known = np.zeros(1024, bool)

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words, the best language at 0, floored where a language is possible, far below where it is not; and
        whether any language was learned in the script of each word (where none was, all scores are 0)."""
        model = self.model
        index, sizes = self.lookup.found(words)
        s = np.add.reduceat(model.table[index], np.cumsum(sizes) - sizes, axis=0)
        s = np.maximum(s - s.max(axis=1, keepdims=True), -self.floor)
        every = np.ones(len(model.langs), bool)
        none = ~every
        allowed = np.array([model.scripts.get(script(w), none) for w in words])
        known = allowed.any(axis=1, keepdims=True)
        s = np.where(known, np.where(allowed, s, -4 * self.floor), 0)
        return s - s.max(axis=1, keepdims=True), known[:, 0]

    def add(self, words: list[str]) -> None:
        new = sorted(set(words).difference(self.index))
        if len(self.index) + len(new) > self.limit:
            self.index, new = {}, sorted(set(words))
        need = len(self.index) + len(new)
        if need > len(self.scores):
            grown = np.zeros((max(need, 2 * len(self.scores)), self.scores.shape[1]), np.float32)
            grown[: len(self.scores)] = self.scores
            self.scores = grown
            self.known = np.append(self.known, np.zeros(len(grown) - len(self.known), bool))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            first = len(self.index)
            self.scores[first : first + len(part)], self.known[first : first + len(part)] = self.rows(part)
            self.index.update(zip(part, range(first, first + len(part))))


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word. scores: words of all texts one after the other; lengths: words of each text."""
    n_langs = scores.shape[1]
    starts = np.append(0, np.cumsum(lengths)[:-1])
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    most = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(most), side="left")  # texts with more than t words
    kind = np.int8 if n_langs <= 128 else np.int32
    came = np.empty(scores.shape, kind)
    own = np.arange(n_langs, dtype=kind)
    v = np.zeros((len(lengths), n_langs), np.float32)
    ends = np.zeros(len(lengths), kind)
    for t in range(most):
        k = active[t]
        x = v[:k]
        if t:
            best = x.argmax(axis=1)
            switch = x[np.arange(k), best] - penalty
            better = x < switch[:, None]
            came[starts[:k] + t] = np.where(better, best[:, None].astype(kind), own)
            x = np.maximum(x, switch[:, None])
        x = x + scores[starts[:k] + t]
        x -= x.max(axis=1, keepdims=True)
        v[:k] = x
    labels = np.empty(len(scores), kind)
    if most:
        ends = v.argmax(axis=1).astype(kind)
    current = ends
    for t in range(most - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        labels[at] = current[:k]
        if t:
            current[:k] = came[at, current[:k]]
    return labels


def _readings(texts: pa.Array, model: Model, penalty: float, bytes_at_once: int = 2_000_000):
    """(first row, predictions, scores, words of each text, label of each word) of texts, a stretch of about bytes_at_once
    at a time (a longer text by itself)."""
    names = np.array(model.langs, object)
    if model.key not in _scorers:
        _scorers.clear()
        _scorers[model.key] = Scorer(model)
    scorer = _scorers[model.key]
    for at, until in stretches(texts, bytes_at_once):
        words = [WORDS.findall((t or "").lower()) if len(names) else [] for t in texts.slice(at, until - at).to_pylist()]
        flat = [w for ws in words for w in ws]
        scorer.add(flat)
        index = np.fromiter(map(scorer.index.__getitem__, flat), np.int64, len(flat))
        lengths = np.array([len(ws) for ws in words], np.int64)
        labels = viterbi(scorer.scores[index], lengths, penalty)
        letters = np.zeros((len(words), max(1, len(names))))
        of = np.repeat(np.arange(len(words)), lengths)
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        np.add.at(letters, (of, labels), sizes * scorer.known[index])
        best, total = letters.argmax(axis=1), np.bincount(of, sizes, len(words))
        pred = [names[b] if t else UNKNOWN for b, t in zip(best, total)]
        score = [float(letters[i, b] / t) if t else 0.0 for i, (b, t) in enumerate(zip(best, total))]
        yield at, pred, score, lengths, labels


def label(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text", penalty: float = 12.0, spans: bool = False) -> DataFrame:
    """id_cols, lang_pred string, score double, and with spans also spans array<struct<lang, first_word, words>>.

    lang_pred is the label with most letters (of equals the first by name), score its share of the letters. Words in a script
    that no language was learned in count for none, so that a text of such words has score 0. Texts that are
    null or have no letters are `und` with score 0, and so is every text if nothing was learned. Rows are dealt over idle
    tasks only where the table has fewer splits than the cluster has cores; repeated ones stay; an empty table gives no rows.
    Names of id_cols that are those of results keep the column, and the result's name gets an underscore.
    """
    names = np.array(model.langs, object)
    results = free_names(id_cols, "lang_pred", "score", "spans")

    def work(batches):
        for batch in batches:
            for at, pred, score, lengths, labels in _readings(batch.column(len(id_cols)), model, penalty):
                part = batch.slice(at, len(pred))
                columns = [*part.columns[: len(id_cols)], pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    runs, start = [], 0
                    for n in lengths.tolist():
                        own = labels[start : start + n]
                        cuts = np.flatnonzero(np.diff(own, prepend=own[:1] + 1)).tolist() if n else []
                        runs.append([{"lang": names[own[a]], "first_word": a, "words": b - a} for a, b in zip(cuts, [*cuts[1:], n])])
                        start += n
                    columns.append(pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(columns, [*id_cols, *results[: 2 + spans]])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols) + f", `{results[0]}` string, `{results[1]}` double"
    schema += f", `{results[2]}` array<struct<lang: string, first_word: int, words: int>>" * spans
    return dealt(docs.select(*id_cols, F.col(text_col).alias(free_names(id_cols, "text")[0]))).mapInArrow(work, schema)


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def learn_from_folds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """A model from rows with a language whose fold is not 1 (rows without an id have no fold and teach nothing)."""
    rows = docs.where((fold(id_col) != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col, lang_col)
    return train(rows, text_col, lang_col, F.xxhash64(F.lit("langid"), F.col(id_col)), **options)


def predict_with_folds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """id_col, held_out (fold 1, or no id), lang_pred, score for every row; see train and label."""
    model = learn_from_folds(docs, id_col, text_col, lang_col)
    found = label(docs, model, [id_col], text_col, **options)
    return found.withColumn("held_out", F.coalesce(fold(id_col) == 1, F.lit(True)))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.25, penalty: float = 12.0) -> DataFrame:
    """docs whose language can be told, with all columns as they are, whatever their names: rows whose prediction is `und`, or
    holds less than least_score of the letters, go. The model is learned as in predict_with_folds. Repeated rows stay, an
    empty table gives no rows."""
    model = learn_from_folds(docs, id_col, text_col, lang_col)
    place = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            for at, pred, score, *_ in _readings(batch.column(place), model, penalty):
                keep = [p != UNKNOWN and s >= least_score for p, s in zip(pred, score)]
                yield batch.slice(at, len(pred)).filter(pa.array(keep))

    return dealt(docs).mapInArrow(work, docs.schema)
