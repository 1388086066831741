"""Records that users write: patches, tombstones, bindings and backups, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.operators.scan import Scan, earliest, highest, previous, total


def apply_patches(events: DataFrame, keys: list[str], order: list[str], defaults: dict[str, Column]) -> DataFrame:
    """The state of each key after all its patches: per field the last value given, else the default."""
    stamp = F.struct(*order)
    return events.groupBy(*keys).agg(*[F.coalesce(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), stamp)), d).alias(f) for f, d in defaults.items()])


def monotonic_time(events: DataFrame, key: str, order: list[str], at_ms: str, out: str = "at", **limits) -> DataFrame:
    """Times that rise by at least 1 ms within a key: t_i = max(given_i, t_(i-1) + 1), in closed form over a prefix. limits:
    those of Scan."""
    numbered = Scan(events, [key], order, **limits).add(_i=total(F.lit(1).cast("long")))
    return numbered.add(_lead=highest(F.col(at_ms) - F.col("_i"))).rows.withColumn(out, F.col("_lead") + F.col("_i")).drop("_i", "_lead")


def upsert_markers(events: DataFrame, key: str, order: list[str], label: str, dataset: str, deleted: str, longest: int, **limits) -> DataFrame:
    """Each write with `reason`: after_delete, other_dataset, too_long (unless the label stays as it was), or null, the
    trimmed label, and `created`, the first order value of the key's life. limits: those of Scan."""
    trimmed = F.trim(label)
    rows = Scan(events, [key], order, **limits).add(
        _gone=highest(F.col(deleted).cast("int"), before=True), _first=earliest(dataset), _last=previous(trimmed.alias("label")), created=earliest(order[0]),
    ).rows
    reason = (
        F.when(F.coalesce(F.col("_gone"), F.lit(0)) == 1, "after_delete").when(F.col(dataset) != F.col("_first"), "other_dataset")
        .when((F.length(trimmed) > longest) & ~F.coalesce(F.col("_last.label") == trimmed, F.lit(False)), "too_long")
    )
    return rows.withColumn("reason", reason).withColumn("label_out", trimmed).drop("_gone", "_first", "_last")


def soft_delete(records: DataFrame, requests: DataFrame, key: str, at: str, updated: str) -> DataFrame:
    """Records with `deleted_at` and `updated` set where asked: monotonic now. Unknown ids change nothing, nor do repeats."""
    asked = requests.groupBy(key).agg(F.min(at).alias("_at"))
    joined = records.join(asked, key, "left")
    now = F.when(F.col("_at").isNotNull(), F.greatest(F.col("_at"), F.col(updated) + 1))
    return joined.withColumn("deleted_at", now).withColumn(updated, F.coalesce(now, F.col(updated))).drop("_at")


def import_backup(existing: DataFrame, incoming: DataFrame, keys: list[str], at: str, deleted: str | None = None) -> DataFrame:
    """Existing and incoming merged: newer wins; on a tie the incoming wins only if it alone is a tombstone. `taken` tells
    whether the incoming row was imported (null if there was none)."""
    cols = [c for c in existing.columns if c not in keys]
    joined = existing.select(*keys, F.struct(*cols).alias("old")).join(incoming.select(*keys, F.struct(*cols).alias("new")), keys, "full")
    old, new = F.col("old"), F.col("new")
    tie = F.lit(False) if deleted is None else (new[at] == old[at]) & new[deleted] & ~old[deleted]
    taken = F.when(new.isNull(), F.lit(None)).otherwise(old.isNull() | (new[at] > old[at]) | tie)
    return joined.select(*keys, taken.alias("taken"), F.when(F.coalesce(taken, F.lit(False)), new).otherwise(old).alias("row")).select(*keys, "taken", "row.*")


def export_backup(records: DataFrame, bindings: DataFrame, dataset: str, scope: list[str]) -> DataFrame:
    """Records of the datasets in scope with `problem`: unbound, or null. Rows with a problem must stop the export."""
    bound = bindings.select(dataset).distinct().withColumn("_bound", F.lit(True))
    return records.where(F.col(dataset).isin(scope)).join(bound, dataset, "left").withColumn("problem", F.when(F.col("_bound").isNull(), "unbound")).drop("_bound")


def binding_state(wanted: DataFrame, bindings: DataFrame, records: DataFrame, dataset: str, snapshot: str) -> DataFrame:
    """Per wanted dataset: ready, conflict, rebind or bind."""
    have = records.groupBy(dataset).agg(F.count("*").alias("records"))
    bound = bindings.select(dataset, F.col(snapshot).alias("bound"))
    rows = wanted.select(dataset, snapshot).join(bound, dataset, "left").join(have, dataset, "left").withColumn("records", F.coalesce("records", F.lit(0)))
    state = (
        F.when(F.col("bound") == F.col(snapshot), "ready").when(F.col("bound").isNotNull() & (F.col("records") > 0), "conflict")
        .when(F.col("bound").isNotNull(), "rebind").when(F.col("records") > 0, "conflict").otherwise("bind")
    )
    return rows.withColumn("state", state)


def import_problems(incoming: DataFrame, known_places: DataFrame, datasets: DataFrame, dataset: str, place: str, snapshot: str) -> DataFrame:
    """Incoming rows that would stop the import, with the first reason: unknown_dataset, other_snapshot, unknown_place."""
    rows = incoming.join(datasets.select(dataset, F.col(snapshot).alias("_want")), dataset, "left")
    rows = rows.join(known_places.select(dataset, place).distinct().withColumn("_known", F.lit(True)), [dataset, place], "left")
    reason = F.when(F.col("_want").isNull(), "unknown_dataset").when(F.col("_want") != F.col(snapshot), "other_snapshot").when(F.col("_known").isNull(), "unknown_place")
    return rows.withColumn("reason", reason).where("reason is not null").drop("_want", "_known")


def visible_rows(records: DataFrame, deleted_at: str) -> DataFrame:
    return records.where(F.col(deleted_at).isNull())
