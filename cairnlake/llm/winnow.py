"""Document fingerprints by winnowing, in DataFrame functions only.

Every k consecutive bytes of a text's UTF-8 form are hashed, at each position; of every w consecutive hashes the least is
selected, the rightmost among equals, and kept with its position. Two texts that share k + w - 1 bytes therefore share a
selected hash, and nothing shorter than k is ever matched. Hash and position travel in one number (44 bits of hash above
20 bits that count down from the right), so that one minimum per window decides both. A text is worked off in blocks of
windows, which bounds what one row holds while it is fingerprinted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW = (1 << 20) - 1


def _with(value: Column, body) -> Column:
    """body applied to value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _keys(data: Column, first: Column, last: Column, k: int) -> Column:
    """Hash above position, for k bytes at each of first..last (counted from 0)."""
    return _with(
        F.lit(_LOW + 1) + first,
        lambda top: F.transform(
            F.sequence(first + F.lit(1), last + F.lit(1)),
            lambda i: F.xxhash64(F.substring(data, i, F.lit(k))).bitwiseAND(F.lit(~_LOW)).bitwiseOR(top - i),
        ),
    )


def _minima(keys: Column, count: Column, w: int) -> Column:
    """The least of each of the first `count` runs of w keys: runs of 2, 4, 8 ... come from the one before, and two of the
    longest power of two overlap to make w. A run past the end is as long as there are keys."""

    def wider(runs, length):
        if 2 * length > w:
            return F.transform(F.sequence(F.lit(0), count - F.lit(1)), lambda i: F.least(F.get(runs, i), F.get(runs, i + F.lit(w - length)))) if w > length else F.slice(runs, F.lit(1), count)
        if 2 * length == w:
            return F.transform(F.sequence(F.lit(0), count - F.lit(1)), lambda i: F.least(F.get(runs, i), F.get(runs, i + F.lit(length))))
        return _with(F.transform(runs, lambda x, i: F.least(x, F.get(runs, i + F.lit(length)))), lambda more: wider(more, 2 * length))

    return _with(keys, lambda k: wider(k, 1))


def _placed(key: Column, first: Column) -> Column:
    return F.struct(F.shiftright(key, 20).alias("hash"), (first + F.lit(_LOW) - key.bitwiseAND(F.lit(_LOW)).cast("int")).alias("position"))


def _once(prints: Column) -> Column:
    """Without repeats of a position, which follow each other where two runs of windows meet."""
    return _with(prints, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - F.lit(1)) != x)))


def _none() -> Column:
    return F.array().cast("array<struct<hash:bigint,position:int>>")


def prints_of_bytes(data: Column, k: int = 8, w: int = 8, block: int = 4096) -> Column:
    """prints of a binary column."""
    if block + w > _LOW:
        raise ValueError("a block of windows must be shorter than 2^20")

    def selected(data):
        last = F.greatest(F.octet_length(data) - F.lit(k), F.lit(0))
        windows = F.greatest(last - F.lit(w - 2), F.lit(1))

        def of_block(b):
            first = b * F.lit(block)
            end = F.least(first + F.lit(block), windows) - first
            keys = _keys(data, first, F.least(first + F.lit(block + w - 2), last), k)
            return F.transform(F.array_distinct(_minima(keys, end, w)), lambda x: _placed(x, first))

        blocks = F.sequence(F.lit(0), F.floor((windows - F.lit(1)) / F.lit(block)).cast("int"))
        return F.flatten(F.transform(blocks, of_block))

    return F.when(F.octet_length(data) > 0, _once(_with(data, selected))).otherwise(_none())


def prints(text: Column, k: int = 8, w: int = 8, block: int = 4096) -> Column:
    """array<struct<hash: long, position: int>>: the selected hashes of a text in order, positions in bytes from 0.

    A text of fewer than k bytes is one k-gram of its own; one of fewer than w hashes is one window. An empty or null text
    has none.
    """
    return prints_of_bytes(F.encode(text, "UTF-8"), k, w, block)


def prints_after_edit(own: Column, kept: Column, edited: Column, k: int = 8, w: int = 8) -> Column:
    """prints of `edited`, which begins with the bytes `kept` of a text whose prints are `own`.

    A window's choice depends on its own bytes only, and later windows never choose an earlier place. So the prints up to
    the choice of the last window inside `kept` stay as they are, and only what follows is worked out.
    """

    def joined(data):
        start = F.octet_length(kept) - F.lit(k + w - 1)

        def with_start(s):
            at = _placed(F.array_min(_keys(data, s, s + F.lit(w - 1), k)), s)["position"]
            before = _with(at, lambda p: F.filter(own, lambda x: x["position"] <= p))
            tail = F.substring(data, s + F.lit(2), F.octet_length(data))
            after = F.transform(prints_of_bytes(tail, k, w), lambda x: F.struct(x["hash"].alias("hash"), (x["position"] + s + F.lit(1)).alias("position")))
            return F.when(s < 0, prints_of_bytes(data, k, w)).when(F.octet_length(data) == F.octet_length(kept), before).otherwise(_once(F.concat(before, after)))

        return _with(start, with_start)

    return _with(edited, joined)


def fingerprint(hashes: Column) -> Column:
    """32 hexadecimal digits over the selected hashes in order; equal for equal texts."""
    parts = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), hashes))), 16, "0") for seed in (1, 2)]
    return F.concat(*parts)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every).cast("double")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8, w: int = 8) -> DataFrame:
    """id_col, prints array<struct<hash: long, position: int>>, fingerprint string, for every row of docs.

    Wherever two texts share k + w - 1 bytes in a row, their prints share a hash, at the positions of the same k bytes; see
    prints. A null or empty text has no prints; equal texts have equal fingerprints; repeated rows stay; an empty table gives
    no rows; other columns are ignored.
    """
    rows = docs.select(id_col, F.explode(F.array(prints(F.col(text_col), k, w))).alias("prints"))
    return rows.withColumn("fingerprint", fingerprint(F.transform("prints", lambda p: p["hash"])))


def _ranges(docs: DataFrame, id_col: str, rows_per_range: int, most: int) -> Column:
    """A range number of each id, ascending with it, of about rows_per_range rows; from approximate quantiles. An id that fills
    whole ranges has one to itself, and so have rows without an id (-1)."""
    n = min(most, max(1, math.ceil(docs.count() / rows_per_range)))
    shares = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else None
    found = [] if shares is None else docs.agg(F.percentile_approx(id_col, shares, F.lit(max(10_000, 4 * n)))).first()[0] or []
    cuts = sorted({*found, *(a + 1 for a, b in zip(found, found[1:]) if a == b)})
    longs = lambda values: F.array(*[F.lit(c).cast("long") for c in values])
    below = lambda values: F.size(F.filter(values, lambda c: c <= F.col(id_col)))
    if not cuts:
        return F.when(F.col(id_col).isNull(), -1).otherwise(0)
    step = max(1, math.isqrt(len(cuts)))
    fine = F.array(*[longs(cuts[i : i + step]) for i in range(0, len(cuts), step)])
    at = _with(below(longs(cuts[::step])), lambda a: F.when(a == 0, F.lit(0)).otherwise((a - 1) * F.lit(step) + below(F.element_at(fine, F.greatest(a, F.lit(1))))))
    return F.when(F.col(id_col).isNull(), -1).otherwise(at)


def in_ranges(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = 4096, most_ranges: int = 32_768) -> DataFrame:
    """part, extra, id_col, tie, text: the rows of docs dealt into ranges of ids, so that a window over a range sees the row
    that follows each: after its last row stands a copy (extra 1) of the first row of the next range, or of the first of all.

    Rows of one id follow each other in order of `tie`, their texts' hashes; rows without an id come first. Where one id, or
    none, has more rows than a few ranges hold, its rows are dealt into parts by their ties. Of each range only its number
    and the id and tie of its first row reach the driver and are broadcast: at most most_ranges times 28 bytes (and as many
    for parts); texts never are. Beyond most_ranges * rows_per_range rows the ranges grow, and their sort spills.
    """
    least = F.lit(-(1 << 63))
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text"), _ranges(docs, id_col, rows_per_range, most_ranges).cast("long").alias("range"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    first = F.min(F.struct(F.coalesce(id_col, least).alias("i"), "tie"))
    seen = rows.groupBy("range").agg(F.count("*").alias("n"), F.min(id_col).alias("a"), F.max(id_col).alias("b"), first.alias("h")).collect()
    split = {r.range: min(-(-r.n // rows_per_range), most_ranges) for r in seen if r.a == r.b and r.n > 4 * rows_per_range}
    part = F.col("range") * F.lit(1 << 20)
    if split:
        parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast("long") for pair in split.items() for x in pair]), F.col("range")), F.lit(1).cast("long"))
        part = part + F.shiftright(F.shiftrightunsigned(F.col("tie").bitwiseXOR(least), 24) * parts, 40)
    rows = rows.withColumn("part", part)
    heads = [(r.range << 20, r.h.i, r.h.tie) for r in seen if r.range not in split]
    if split:
        hot = rows.where(F.col("range").isin(list(split))).groupBy("part").agg(first.alias("h"))
        heads += [(r.part, r.h.i, r.h.tie) for r in hot.collect()]
    heads.sort()
    back = [(*h, heads[k - 1][0]) for k, h in enumerate(heads)]
    back = F.broadcast(docs.sparkSession.createDataFrame(back, "part long, i long, tie long, before long"))
    rows = rows.withColumn("i", F.coalesce(id_col, least)).join(back, ["part", "i", "tie"], "left")
    own, copy = F.struct(F.col("part"), F.lit(0).alias("extra")), F.struct(F.col("before").alias("part"), F.lit(1).alias("extra"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))
    return rows.select(F.explode(places).alias("at"), id_col, "tie", "text").select("at.part", "at.extra", id_col, "tie", "text")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8, w: int = 8, rows_per_range: int = 4096) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they and the next text's are.

    Edited: the last floor(n/4) code points replaced by the first as many (or all) of the next row by ascending id. Returns
    id_col, n_chars long, edited_sha256, fingerprint, edited_fingerprint string, near_edited, near_next double, n_prints int,
    prints array<struct<hash: long, position: int>>. A null text counts as empty; an empty table gives no rows; repeated
    rows stay; other columns are ignored. Rows that share id and text are only parted by whole ranges.
    """
    rows = in_ranges(docs, id_col, text_col, rows_per_range=rows_per_range)
    order = Window.partitionBy("part").orderBy("extra", F.col(id_col).asc_nulls_first(), "tie")
    hashes = lambda prints: F.transform(prints, lambda p: p["hash"])
    df = rows.withColumn("ahead", F.lead("text").over(order))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    kept = F.substring("text", F.lit(1), n - quarter)
    # exploding an array of one keeps the optimiser from working anything out anew wherever it is used
    held = lambda c, name: F.explode(F.array(c)).alias(name)
    keys = ["part", "extra", "tie", id_col]
    df = df.select(*keys, n.cast("long").alias("n_chars"), F.encode(kept, "UTF-8").alias("kept"), F.substring(F.coalesce("ahead", F.lit("")), F.lit(1), quarter).alias("taken"), held(prints(F.col("text"), k, w), "prints"))
    df = df.select(*keys, "n_chars", "prints", "kept", held(F.concat("kept", F.encode("taken", "UTF-8")), "edited"))
    df = df.select(*keys, "n_chars", "prints", hashes(F.col("prints")).alias("hashes"), F.sha2("edited", 256).alias("edited_sha256"), held(hashes(prints_after_edit(F.col("prints"), F.col("kept"), F.col("edited"), k, w)), "changed"))
    # of the arrays only the hashes go through the second window
    df = df.select(*keys, "n_chars", "prints", "hashes", "edited_sha256", fingerprint(F.col("hashes")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("hashes"), F.col("changed")).alias("near_edited"))
    df = df.withColumn("ahead", F.lead("hashes").over(order)).where("extra = 0")
    return df.select(
        id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
        likeness(F.col("hashes"), F.col("ahead")).alias("near_next"), F.size("hashes").alias("n_prints"), "prints",
    )
