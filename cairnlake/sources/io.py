"""Reading and writing files: framed records, strict JSON lines, inventories, immutable publications."""

from __future__ import annotations

import hashlib
import json
import struct
from functools import reduce
from io import BufferedReader

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HEADER, CHILD = "<4sIII", "<4sI"
HEADER_SIZE, CHILD_SIZE = 16, 8
FILLER = "fill"  # tag of the empty records that end a block; records of other kinds have tags of their own
RECORD = "path string, offset long, tag string, flags long, payload binary, error string"


def _frames(path: str, data: bytes):
    at = 0
    while at < len(data):
        if at + HEADER_SIZE > len(data):
            yield path, at, None, None, None, "truncated header"
            return
        tag, size, _, flags = struct.unpack_from(HEADER, data, at)
        end = at + HEADER_SIZE + size
        if end > len(data):
            yield path, at, tag.decode("latin-1"), flags, None, "payload passes the end"
            return
        yield path, at, tag.decode("latin-1"), flags, data[at + HEADER_SIZE : end], None
        at = end


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*rows)] or [[]] * 6
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "offset", "tag", "flags", "payload", "error"])


def _bounded(rows, size, batch_bytes: int):
    """Lists of consecutive rows whose sizes reach batch_bytes together, so that a task never holds all rows of a file."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += size(row)
        if held >= batch_bytes:
            yield part
            part, held = [], 0
    if part:
        yield part


def _opened(path: str, buffer: int):
    """A file by the name that Spark gives it, for reading at any place."""
    from pyarrow import fs

    if path.startswith("file:"):
        store, name = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    else:
        store, name = fs.FileSystem.from_uri(path)
    return BufferedReader(store.open_input_file(name), buffer)


def record_ranges(spark: SparkSession, paths: str | list[str], range_bytes: int = 64 << 20) -> DataFrame:
    """path, length, from_offset, to_offset: ranges of whole records that cover each file, of about range_bytes (a longer record
    is a range of its own). Only headers are read; a range whose records break a bound is the last of its file."""

    def walk(batches):
        for b in batches:
            for path, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, start, at = [], 0, 0
                with _opened(path, 1 << 16) as f:
                    while at < length:
                        f.seek(at)
                        head = f.read(HEADER_SIZE)
                        end = at + HEADER_SIZE + struct.unpack(HEADER, head)[1] if len(head) == HEADER_SIZE else length + 1
                        if end > length:
                            break
                        if end - start > range_bytes and at > start:
                            found.append((start, at))
                            start = at
                        at = end
                if start < length:
                    found.append((start, length))
                for i in range(0, len(found), 10_000):
                    starts, ends = zip(*found[i : i + 10_000])
                    same = [pa.array([x] * len(starts), t) for x, t in ((path, pa.string()), (length, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["path", "length", "from_offset", "to_offset"])

    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    return files.mapInArrow(walk, "path string, length long, from_offset long, to_offset long")


def scan_large_record_log(spark: SparkSession, paths: str | list[str], range_bytes: int = 64 << 20, batch_bytes: int = 4 << 20) -> DataFrame:
    """The rows of scan_record_log from files of any length: a first pass over headers cuts them into ranges, which are dealt
    over the cluster and read batch_bytes at a time, so that a task holds a batch or one record. A lost range is read again by
    itself. The files must be in a store that pyarrow opens too (local or shared folders, HDFS, S3, GCS)."""

    def read(batches):
        for b in batches:
            for path, length, at, end in zip(*[c.to_pylist() for c in b.columns]):
                rows, held = [], 0
                with _opened(path, 1 << 20) as f:
                    f.seek(at)
                    while at < end:
                        head, payload, error = f.read(HEADER_SIZE), None, None
                        if len(head) < HEADER_SIZE:
                            rows.append((path, at, None, None, None, "truncated header"))
                            break
                        tag, size, _, flags = struct.unpack(HEADER, head)
                        if at + HEADER_SIZE + size > length:
                            error = "payload passes the end"
                        else:
                            payload = f.read(size)
                        rows.append((path, at, tag.decode("latin-1"), flags, payload, error))
                        if error:
                            break
                        at += HEADER_SIZE + size
                        held += HEADER_SIZE + size
                        if held >= batch_bytes:
                            yield _records(rows)
                            rows, held = [], 0
                if rows:
                    yield _records(rows)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = record_ranges(spark, paths, range_bytes).repartition(tasks, "path", "from_offset")
    return ranges.mapInArrow(read, RECORD)


def write_record_log(frames: DataFrame, path: str, block_bytes: int = 1 << 20, blocks_per_file: int = 16) -> None:
    """Writes framed records (one binary column) to files under path, many for each task, so that their number follows the table
    and none grows beyond blocks_per_file blocks, or records that are larger than one. Spark's text writer puts the bytes down
    as they are, in any store that Spark writes to; the line's end that it needs is an empty FILLER record after each block."""

    def work(batches):
        held, size = [], 0
        for b in batches:
            for frame in b.column(0).to_pylist():
                if held and size + len(frame) > block_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["block"])
                    held, size = [], 0
                held.append(frame)
                size += len(frame)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["block"])

    filler = struct.pack(HEADER, FILLER.encode(), 0, 0, 0).decode()
    blocks = frames.mapInArrow(work, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.option("maxRecordsPerFile", blocks_per_file).text(path, lineSep=filler)


def scan_record_log(spark: SparkSession, paths: str | list[str], batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per framed record of every file: 16-byte header (tag, size, unused, flags), payload, offset. What breaks a
    bound becomes a row with an error and ends its file. A file is the unit of work and must fit a task (scan_large_record_log
    splits files); its records leave the task about batch_bytes at a time, headers included."""
    size = lambda row: HEADER_SIZE + len(row[4] or b"")

    def work(batches):
        for b in batches:
            for path, data in zip(b.column(0), b.column(1)):
                for rows in _bounded(_frames(path.as_py(), data.as_py()), size, batch_bytes):
                    yield _records(rows)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(work, RECORD)


def explode_subrecords(records: DataFrame, batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per child (8-byte header: tag, size) of each record, in order, with its index; bad bounds become an error row.
    Children leave the task about batch_bytes at a time, headers included."""

    def children(data: bytes):
        at, i = 0, 0
        while at < len(data):
            if at + CHILD_SIZE > len(data):
                yield i, None, None, "truncated header"
                return
            tag, size = struct.unpack_from(CHILD, data, at)
            at += CHILD_SIZE
            if at + size > len(data):
                yield i, tag.decode("latin-1"), None, "payload passes the end"
                return
            yield i, tag.decode("latin-1"), data[at : at + size], None
            at, i = at + size, i + 1

    def rows(batch):
        for path, offset, data in zip(*[batch.column(i) for i in range(3)]):
            for child in children(data.as_py() or b""):
                yield path.as_py(), offset.as_py(), *child

    size = lambda row: CHILD_SIZE + len(row[4] or b"")
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.string()]

    def work(batches):
        for b in batches:
            for part in _bounded(rows(b), size, batch_bytes):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], ["path", "offset", "idx", "tag", "value", "error"])

    return records.where("error is null").select("path", "offset", "payload").mapInArrow(work, "path string, offset long, idx int, tag string, value binary, error string")


def _line_problem(line: str, canonical: bool) -> str | None:
    if not line.strip():
        return "blank"
    try:
        value = json.loads(line, object_pairs_hook=_no_duplicates, parse_constant=_no_constant)
    except ValueError as e:
        return str(e) if str(e) in ("duplicate key", "not a number") else "not JSON"
    if not isinstance(value, dict):
        return "not an object"
    if canonical and json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")) != line:
        return "not canonical"
    return None


def _no_duplicates(pairs):
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("duplicate key")
    return dict(pairs)


def _no_constant(name):
    raise ValueError("not a number")


def read_strict_ndjson(spark: SparkSession, path: str, schema: StructType | str, canonical: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, problems): every line must be an object without duplicate keys and NaN, and be canonical. Lines that are not
    become problems with their file and reason."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    @F.pandas_udf("string")
    def problem(values):
        return values.map(lambda v: _line_problem(v, canonical))

    checked = lines.withColumn("problem", problem("value"))
    return checked.where("problem is null").select(F.from_json("value", schema).alias("r")).select("r.*"), checked.where("problem is not null")


def write_canonical_ndjson(df: DataFrame, order: list[str], path: str) -> None:
    """Sorted rows, keys in order of name, one object a line."""
    df.orderBy(*order).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def file_inventory(spark: SparkSession, root: str, noise: tuple[str, ...] = ("_SUCCESS", ".DS_Store")) -> DataFrame:
    """path, bytes and SHA-256 of every file under root, noise and empty files (which Spark's reader skips) left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.where(~name.isin(*noise) & ~name.startswith("._"))
    return kept.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def large_file_inventory(spark: SparkSession, root: str, noise: tuple[str, ...] = ("_SUCCESS", ".DS_Store"), chunk_bytes: int = 8 << 20) -> DataFrame:
    """The rows of file_inventory from files of any length, read chunk_bytes at a time; see scan_large_record_log for stores."""

    def work(batches):
        for b in batches:
            digests = []
            for path in b.column(0).to_pylist():
                digest = hashlib.sha256()
                with _opened(path, chunk_bytes) as f:
                    while chunk := f.read(chunk_bytes):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.string())], ["path", "bytes", "sha256"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.where(~name.isin(*noise) & ~name.startswith("._")).select("path", F.col("length").alias("bytes"))
    return kept.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(work, "path string, bytes long, sha256 string")


def artifact_integrity(inventory: DataFrame, descriptors: DataFrame, path: str = "path") -> DataFrame:
    """Descriptors whose file is missing, or whose bytes or digest differ."""
    d = descriptors.select(path, F.col("bytes").alias("_b"), F.col("sha256").alias("_s")).join(inventory, path, "left")
    rule = F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") != F.col("_b"), "bytes").when(F.col("sha256") != F.col("_s"), "sha256")
    return d.withColumn("rule", rule).where("rule is not null").select(path, "rule")


def publish_immutable(df: DataFrame, root: str) -> tuple[str, bool]:
    """Writes df to root/<digest of its rows>; what is already there must be the same and is left alone. Returns the folder and
    whether it was written now."""
    from cairnlake.operators.quality import set_digest

    spark = df.sparkSession
    digest = set_digest(df).first().digest
    target = f"{root}/{digest}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target + "/_SUCCESS")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        if set_digest(spark.read.parquet(target)).first().digest != digest:
            raise ValueError(f"{target} holds other rows than its name says")
        return target, False
    df.write.mode("errorifexists").parquet(target)
    return target, True


def load_many(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, issues) of JSON manifests, one a line: a line that does not fit the schema is an issue. The caller treats no good row as an
    error."""
    full = StructType(schema.fields).add("_corrupt_record", "string")
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    from cairnlake.plans.checkpoints import cut

    rows = cut(rows)
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), rows.where("_corrupt_record is not null").select("_corrupt_record")


def parse_log_markers(lines: DataFrame, line: str, pattern: str, names: list[str]) -> DataFrame:
    """One row per match in a line, one column per group of the pattern (all groups are named in order)."""
    found = [F.regexp_extract_all(line, F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(names, 1)]
    rows = lines.select(*[c for c in lines.columns if c != line], *found)
    return rows.select(*[c for c in lines.columns if c != line], F.posexplode(F.arrays_zip(*names)).alias("match", "_m")).select(*[c for c in lines.columns if c != line], "match", *[f"_m.{n}" for n in names])


def six_digits(c: Column) -> Column:
    """A number rounded to six significant digits, as a log writes it by default."""
    return F.format_string("%.5e", c.cast("double")).cast("double")


def check_log_markers(found: DataFrame, plan: DataFrame, group: str, keys: list[str], numbers: list[str]) -> DataFrame:
    """Per group of the plan whether the markers found in its log are those planned: how many are planned and found, missing,
    unplanned and repeated ones, markers of which a number is not the planned one rounded to six digits, and the largest rounding
    of the others. found: group, keys and the texts of numbers; plan: group, keys (one row each) and the expected numbers."""
    own = [group, *keys]
    said = found.groupBy(*own).agg(F.count("*").alias("_times"), *[F.first(n).try_cast("double").alias(f"_{n}") for n in numbers])
    rows = plan.select(*own, *numbers, F.lit(True).alias("_planned")).join(said, own, "full")
    same = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_{n}") == six_digits(F.col(n)), F.lit(False)) for n in numbers])
    both = F.col("_planned").isNotNull() & F.col("_times").isNotNull()
    off = F.greatest(*[F.abs(F.col(f"_{n}") - F.col(n)) for n in numbers]) if len(numbers) > 1 else F.abs(F.col(f"_{numbers[0]}") - F.col(numbers[0]))
    return rows.groupBy(group).agg(
        F.count_if("_planned").alias("planned"), F.coalesce(F.sum("_times"), F.lit(0)).alias("found"), F.count_if(F.col("_times").isNull()).alias("missing"),
        F.count_if(F.col("_planned").isNull()).alias("unplanned"), F.count_if(F.col("_times") > 1).alias("repeated"),
        F.count_if(both & ~same).alias("wrong"), F.max(F.when(both & same, off)).alias("rounding"),
    )
