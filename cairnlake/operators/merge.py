"""Ordered, overridable record logs merged into effective tables.

Where one row per key is wanted, a grouped maximum is used: it aggregates before the shuffle, so a hot key costs one row for
each task. Where the history of a key matters, states run along it, in blocks where a key is large (see scan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.operators.scan import Scan, following, latest, previous, total


def pick(df: DataFrame, keys: list[str], order: list[Column | str], last: bool = True) -> DataFrame:
    """The last (or first) row of each key by order, all columns."""
    best = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(best(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def latest_wins(df: DataFrame, keys: list[str], order: list[str], deleted: str) -> DataFrame:
    """Last version of each key, without keys whose last version is a tombstone. Filters after ranking."""
    return pick(df, keys, order).where(~F.col(deleted))


def latest_then_qualify(df: DataFrame, keys: list[str], order: list[str], predicate: Column) -> DataFrame:
    """A last row that fails the predicate hides the earlier ones too."""
    return pick(df, keys, order).where(predicate)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return pick(df, keys, order, last=False)


def epoch_merge(df: DataFrame, key: str, order: list[str], deleted: str, always: list[str] = (), carry: list[str] = (), first: list[str] = (), collect: list[str] = ()) -> DataFrame:
    """One row per live key: each tombstone starts a new epoch, and only the last epoch counts.

    always: last value even if empty; carry: last that is not null; first: first value; collect: sorted set of values that
    are neither null nor empty. Also returns `epoch`, the tombstones before it.
    """
    rows = with_epoch(df, key, order, deleted).where(~F.col(deleted))
    stamp = F.struct(*order)
    last = pick(with_epoch(df, key, order, deleted).select(key, *order, deleted, "epoch"), [key], order).where(~F.col(deleted)).select(key, "epoch")
    aggs = [F.max_by(c, stamp).alias(c) for c in always]
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), stamp)).alias(c) for c in carry]
    aggs += [F.min_by(c, stamp).alias(c) for c in first]
    aggs += [F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(c) for c in collect]
    return rows.join(last, [key, "epoch"], "left_semi").groupBy(key, "epoch").agg(*aggs)


def with_epoch(df: DataFrame, key: str, order: list[str], deleted: str, **limits) -> DataFrame:
    """Adds `epoch`: how many tombstones of the key come up to and with this row. limits: those of Scan."""
    return Scan(df, [key], order, **limits).add(epoch=total(F.col(deleted).cast("long"))).rows


def child_of_live_epoch(children: DataFrame, parents: DataFrame, key: str, epoch: str = "epoch") -> DataFrame:
    """Children whose parent context is still the live one."""
    return children.join(parents.select(key, epoch).distinct(), [key, epoch], "left_semi")


def two_tier_latest(df: DataFrame, keys: list[str], order: list[str], tier: str) -> DataFrame:
    """Whole-row replacement in which the higher tier beats the lower whatever their order; deleted rows stay, flagged."""
    return pick(df, keys, [tier, *order])


def remap_identity(refs: DataFrame, parents: DataFrame, raw: str, owner: str) -> DataFrame:
    """(origin, local): the high byte of raw names a parent by 1-based ordinal; without such a parent it is the owner's own raw
    value, unmasked. parents: owner, ordinal, parent. One row per owner and ordinal, so the join is never many-to-many."""
    rows = refs.withColumn("ordinal", F.shiftrightunsigned(raw, 24).bitwiseAND(F.lit(255)))
    joined = rows.join(parents.select(owner, "ordinal", "parent"), [owner, "ordinal"], "left")
    return joined.withColumn("origin", F.coalesce("parent", owner)).withColumn("local", F.when(F.col("parent").isNull(), F.col(raw)).otherwise(F.col(raw).bitwiseAND(F.lit(0xFFFFFF)))).drop("ordinal", "parent")


def check_dependencies(links: DataFrame, sources: DataFrame) -> DataFrame:
    """links (idx, parent) with `problem`: missing, or not_earlier, or null. sources: idx, name."""
    known = sources.select(F.col("idx").alias("parent_idx"), F.col("name").alias("parent"))
    return links.join(known, "parent", "left").withColumn(
        "problem", F.when(F.col("parent_idx").isNull(), "missing").when(F.col("parent_idx") >= F.col("idx"), "not_earlier")
    )


def override_counters(df: DataFrame, key: str, order: list[str], deleted: str, **limits) -> DataFrame:
    """One row: raw, effective, overrides (a live key written again), deletions (every tombstone). limits: those of Scan."""
    rows = Scan(df.select(key, *[c for c in order if c != key], deleted), [key], order, **limits).add(_before=previous(deleted), _after=following(deleted)).rows
    rows = rows.withColumn("was_live", ~F.coalesce(F.col(f"_before.{deleted}"), F.lit(True))).withColumn("is_last", F.col("_after").isNull())
    return rows.agg(
        F.count("*").alias("raw"), F.count_if(F.col("is_last") & ~F.col(deleted)).alias("effective"),
        F.count_if(F.col("was_live") & ~F.col(deleted)).alias("overrides"), F.count_if(deleted).alias("deletions"),
    )


def type_counts_by_source(df: DataFrame, source: str, kind: str) -> DataFrame:
    return df.groupBy(source, kind).count().withColumnRenamed("count", "records")


def drop_flagged(df: DataFrame, flags: str, mask: int) -> tuple[DataFrame, DataFrame]:
    """(rows without the flag, one row with how many had it)."""
    hit = F.coalesce(F.col(flags).bitwiseAND(F.lit(mask)) != 0, F.lit(False))
    return df.where(~hit), df.agg(F.count_if(hit).alias("dropped"))


def overlay_resolve(df: DataFrame, keys: list[str], class_rank: Column, mount: str) -> DataFrame:
    """Of each key the row of the best class (highest rank), inside a class of the latest mount."""
    return pick(df, keys, [class_rank, mount])


def overlay_conflicts(df: DataFrame, keys: list[str], mount: str) -> DataFrame:
    """Keys that one mount holds more than once."""
    return df.groupBy(*keys, mount).count().where("count > 1").withColumnRenamed("count", "n")


def candidate_fallback(df: DataFrame, id_col: str, candidates: str, known: DataFrame, known_key: str) -> DataFrame:
    """(id, resolved, position): the first candidate that exists, or nulls. Repeated candidates keep their first place."""
    tried = df.select(id_col, F.posexplode(F.array_distinct(candidates)).alias("position", "candidate"))
    hit = tried.join(known.select(F.col(known_key).alias("candidate")).distinct(), "candidate")
    best = hit.groupBy(id_col).agg(F.min_by("candidate", "position").alias("resolved"), F.min("position").alias("position"))
    return df.select(id_col).join(best, id_col, "left")


def marker_groups(df: DataFrame, keys: list[str], order: list[str], is_marker: Column, is_prefix: Column | None = None, is_target: Column | None = None, identity: Column | None = None, claimed: Column | None = None, **limits) -> DataFrame:
    """Adds `grp`: 0 for header rows before the first marker, then one number for each marker and what follows it.

    A prefix belongs to the marker after it: a prefix row, its target row, then the marker form the beginning of that marker's
    group. With is_prefix and is_target a column `problem` is added: prefix_without_target where no target follows a prefix,
    identity_mismatch on a marker whose identity is not what its prefix claimed (nulls are equal). Rows after a prefix that no marker
    follows are in no group (null), up to the next marker. A target without a prefix is a row like others. limits: those of Scan.
    """
    if is_prefix is None:
        return Scan(df, keys, order, **limits).add(grp=total(is_marker.cast("long"))).rows
    kind = F.when(is_marker, "marker").when(is_prefix, "prefix").when(is_target, "target").otherwise("other")
    said = df.withColumns({"_kind": kind, "_claim": F.lit(None) if claimed is None else claimed})
    found = Scan(said, keys, order, **limits).add(
        grp=total((F.col("_kind") == "marker").cast("long")), _anchor=latest(F.when(F.col("_kind").isin("marker", "prefix"), F.col("_kind"))),
        _b1=previous("_kind", "_claim"), _f1=following("_kind"),
    )
    rows = found.add(_b2=previous("_b1"), _f2=following("_f1")).rows
    is_kind = lambda path, name: F.coalesce(F.col(path) == name, F.lit(False))
    marker, prefix, target = (is_kind("_kind", k) for k in ("marker", "prefix", "target"))
    of_prefix = target & is_kind("_b1._kind", "prefix")
    leads = (prefix & is_kind("_f1._kind", "target") & is_kind("_f2._f1._kind", "marker")) | (of_prefix & is_kind("_f1._kind", "marker"))
    led = marker & is_kind("_b1._kind", "target") & is_kind("_b2._b1._kind", "prefix")
    grp = (
        F.when(marker, F.col("grp")).when(leads, F.col("grp") + 1).when(prefix | of_prefix, F.lit(None))
        .when(F.col("_anchor").isNull(), F.lit(0)).when(F.col("_anchor") == "marker", F.col("grp"))
    )
    problem = F.when(prefix & ~is_kind("_f1._kind", "target"), "prefix_without_target")
    if identity is not None:
        problem = problem.when(led & ~F.col("_b2._b1._claim").eqNullSafe(identity), "identity_mismatch")
    return rows.withColumns({"problem": problem, "grp": grp.cast("long")}).drop("_kind", "_claim", "_anchor", "_b1", "_b2", "_f1", "_f2")


def pivot_tags(df: DataFrame, keys: list[str], tag: str, value: str, order: list[Column | str], tags: dict[str, str]) -> DataFrame:
    """One column per tag of its last or first value, by tags = {tag: "last" or "first"}."""
    def of(name, how):
        best = F.max_by if how == "last" else F.min_by
        return best(F.col(value), F.when(F.col(tag) == name, F.struct(*order))).alias(f"{how}_{name}")

    return df.groupBy(*keys).agg(*[of(n, h) for n, h in tags.items()])


def pair_consecutive(df: DataFrame, keys: list[str], order: list[str], tag: str, value: str, head: str, tail: str, **limits) -> DataFrame:
    """Each head with the value of the next tail, null if another head comes before it. Other tags do not count. limits: those of Scan."""
    rows = Scan(df.where(F.col(tag).isin(head, tail)), keys, order, **limits).add(_next=following(F.col(tag).alias("tag"), F.col(value).alias("value"))).rows
    return rows.withColumn("paired", F.when(F.col("_next.tag") == tail, F.col("_next.value"))).drop("_next").where(F.col(tag) == head)


def head_with_tails(df: DataFrame, keys: list[str], order: list[str], tag: str, value: str, head: str, tail: str) -> DataFrame:
    """Each head (its group number and value) with the last tail after it and the number of tails."""
    grouped = marker_groups(df.where(F.col(tag).isin(head, tail)), keys, order, F.col(tag) == head).where("grp > 0")
    stamp = F.struct(*order)
    return grouped.groupBy(*keys, "grp").agg(
        F.min_by(value, stamp).alias("head_value"), F.max_by(F.col(value), F.when(F.col(tag) == tail, stamp)).alias("last_tail"),
        F.count_if(F.col(tag) == tail).alias("tails"),
    )
