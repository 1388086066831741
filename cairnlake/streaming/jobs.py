"""Stream jobs. Each has a batch twin that gives the same rows once the stream has drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from cairnlake.operators.scan import Scan, latest


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def live_counts(df: DataFrame, key: str, generation: str | None = None, current=None) -> DataFrame:
    """Counts per key, re-emitted on each change; rows of other generations are ignored. Works on batches and streams."""
    rows = df if generation is None else df.where(F.col(generation) == current)
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def lww_merge(state: DataFrame | None, changes: DataFrame, keys: list[str], at: str, deleted: str, seq: str) -> DataFrame:
    """Last writer wins with tombstones kept: the newest time; on a tie a tombstone beats a row, then the greater sequence. The
    rule is associative and does not depend on order, so batches may be merged in any grouping."""
    from cairnlake.operators.merge import pick

    rows = changes if state is None else state.unionByName(changes)
    return pick(rows, keys, [F.col(at), F.col(deleted).cast("int"), F.col(seq)])


def _numbered(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers n of the finished folders name=n in a folder, in order."""
    jvm = spark.sparkContext._jvm
    out = jvm.org.apache.hadoop.fs.Path(folder)
    files = out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(out):
        return []
    found = [f.getPath() for f in files.listStatus(out) if f.getPath().getName().startswith(f"{name}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def lww_state(spark: SparkSession, folder: str, keys: list[str], at: str, deleted: str, seq: str, schema) -> DataFrame:
    """The state that lww_stream has written: its newest base, merged with the changes since."""
    bases = _numbered(spark, folder, "base")
    base = bases[-1] if bases else -1
    parts = [f"{folder}/base={base}"] * (base >= 0) + [f"{folder}/change={n}" for n in _numbered(spark, folder, "change") if n > base]
    rows = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    return lww_merge(None, rows, keys, at, deleted, seq)


def lww_stream(changes: DataFrame, keys: list[str], at: str, deleted: str, seq: str, folder: str, checkpoint: str, merge_every: int = 16) -> StreamingQuery:
    """Merges a stream of changes into a state table, see lww_state. A batch writes no more than its own changes, one row per
    key (folder/change=<batch>); every merge_every batches they are merged with the base before into a new one
    (folder/base=<batch>). Folders are overwritten by number, so a replayed batch gives the same rows again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        lww_merge(None, batch, keys, at, deleted, seq).write.mode("overwrite").parquet(f"{folder}/change={number}")
        if (number + 1) % merge_every == 0:
            state = lww_state(spark, folder, keys, at, deleted, seq, batch.schema)
            if number not in _numbered(spark, folder, "base"):
                state.write.mode("overwrite").parquet(f"{folder}/base={number}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def generation_guard(events: DataFrame, key: str, order: list[str], kind: str, generation: str, **limits) -> DataFrame:
    """Finished loads that count: a `finish` whose key was started in the same generation, which is that of the last start
    before, and has not failed since. The batch twin of the keyed state that a stream holds. limits: those of Scan."""
    of = lambda k: F.when(F.col(kind) == k, F.struct(*order, generation))
    rows = Scan(events, [key], order, **limits).add(_s=latest(of("start"), before=True), _f=latest(of("fail"), before=True)).rows
    at = lambda c: F.struct(*[F.col(f"{c}.{o}") for o in order])
    fine = (F.col("_s")[generation] == F.col(generation)) & (F.col("_f").isNull() | (at("_f") < at("_s")))
    return rows.where((F.col(kind) == "finish") & F.coalesce(fine, F.lit(False))).drop("_s", "_f")


def generation_guard_stream(events: DataFrame, key: str, order: str, kind: str, generation: str) -> DataFrame:
    """generation_guard over a stream (append mode) whose triggers come in order: each key keeps the order and generation of its
    newest start and the order of its newest failure, null before the first. All columns of events are returned.

    Inside a trigger rows may come in any order. A key's rows of a trigger are put in order by their numbers; only the `finish` rows
    are kept as they are, batch by batch, so that what a key holds follows its loads and not its other events' columns.
    """
    columns = [f.name for f in events.schema]

    def follow(_, frames, state):
        started, of, failed = state.get if state.exists else (None, None, None)
        steps, frames_kept = [], []
        for frame in frames:
            for i, (at, what, gen) in enumerate(zip(frame[order].tolist(), frame[kind].tolist(), frame[generation].tolist())):
                if what in ("start", "fail", "finish"):
                    steps.append((int(at), what, int(gen), len(frames_kept), i))
            finished = frame[frame[kind] == "finish"]
            frames_kept.append(finished)
        chosen: list[set] = [set() for _ in frames_kept]
        for at, what, gen, n, i in sorted(steps):
            if what == "start":
                started, of = at, gen
            elif what == "fail":
                failed = at
            elif started is not None and of == gen and (failed is None or failed < started):
                chosen[n].add(i)
        state.update((started, of, failed))
        for frame, kept in zip(frames_kept, chosen):
            if kept:
                yield frame[[i in kept for i in frame.index]][columns]

    state = "started long, of long, failed long"
    return events.groupBy(key).applyInPandasWithState(follow, events.schema, state, "append", GroupStateTimeout.NoTimeout)


class CommitLog:
    """Output by batch number, and a log that readers follow.

    A batch is written to folder/batch=<n> and then committed by creating folder/_commits/<n>, which exists once or not at all.
    A batch that is written but not committed (the job died between both) is not read, and its replay overwrites it; a batch
    that is committed is not written again. So a replay adds nothing twice, whenever the job died.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The committed batches in order."""
        log = self._path(f"{self.folder}/_commits")
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(log)) if self._files.exists(log) else []

    def write(self, rows: DataFrame, number: int, commit: bool = True) -> bool:
        """Writes and commits a batch; false if it was committed before."""
        mark = self._path(f"{self.folder}/_commits/{number}")
        if self._files.exists(mark):
            return False
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        if commit:
            self._files.create(mark, False).close()
        return True

    def read(self, schema) -> DataFrame:
        """The rows of committed batches, with the number of each in `batch`."""
        parts = [f"{self.folder}/batch={n}" for n in self.numbers()]
        rows = self.spark.read.schema(schema).option("basePath", self.folder).parquet(*parts) if parts else self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
        return rows.withColumn("batch", F.col("batch").cast("long"))

    def named(self, name: str, text: str) -> str:
        """A small text under a name: the one that is stored, or else the given one, which is stored now."""
        path = self._path(f"{self.folder}/_{name}")
        if not self._files.exists(path):
            out = self._files.create(path, False)
            out.write(bytearray(text.encode("utf-8")))
            out.close()
            return text
        held = self._files.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
        finally:
            held.close()


def resume_incremental(stream: DataFrame, key: list[str], plan_id: str, folder: str, checkpoint: str, done: DataFrame | None = None) -> StreamingQuery:
    """Processes what is not finished yet: the stored plan's identity is checked first; keys of `done`, and keys committed by
    earlier batches, are skipped; and the stream's checkpoint remembers the files read. Results are read by
    CommitLog(spark, folder).read(schema); a batch that is replayed, whatever the moment of death, is there once."""
    log = CommitLog(stream.sparkSession, folder)
    if (stored := log.named("plan", plan_id)) != plan_id:
        raise ValueError(f"the stored plan {stored} is not {plan_id}")
    schema = stream.schema

    def batch(rows: DataFrame, number: int) -> None:
        if number in log.numbers():
            return
        before = log.read(schema).where(F.col("batch") < number).select(*key)
        before = before if done is None else before.unionByName(done.select(*key))
        log.write(rows.dropDuplicates(key).join(before.distinct(), key, "left_anti").select(*rows.columns), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_counts_stream(stream: DataFrame, key: str, folder: str, checkpoint: str, generation: str | None = None, current=None) -> StreamingQuery:
    """live_counts over a stream in update mode: a trigger commits the keys whose count changed, and no others; see counts_now."""
    log = CommitLog(stream.sparkSession, folder)
    counts = live_counts(stream, key, generation, current)
    return counts.writeStream.foreachBatch(lambda rows, n: log.write(rows, n)).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def counts_now(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Each key's newest count among those that live_counts_stream has committed."""
    rows = CommitLog(spark, folder).read(schema)
    return rows.groupBy(*[c for c in rows.columns if c not in ("n", "batch")]).agg(F.max_by("n", "batch").alias("n"))


def dedupe_stream(stream: DataFrame, keys: list[str], at: str, wait: str) -> DataFrame:
    """A retried key counts once; the watermark bounds what is remembered."""
    return stream.withWatermark(at, wait).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, spark: SparkSession, mode: str, folder: str) -> DataFrame:
    """Runs a stream over all that is there and returns the result as a table of Parquet files: append mode as they come; in
    complete mode each batch writes its own version with overwrite, and the last one is read. No rows reach the driver."""
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    if mode != "complete":
        raise ValueError(f"no result of a stream in {mode} mode")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/version={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/log").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    versions = _numbered(spark, f"{folder}/out", "version")
    if not versions:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/version={versions[-1]}")
