"""Folders that several jobs share: lines that are there once their job commits, objects by key, pages of rows.

Four data sources in Python run on Spark's write and read protocols. Every task of a
write stages files of its own below the folder and tells the driver their names; the
driver moves them into place if all tasks are done, and deletes what is staged if one
fails. What a task that was still running then leaves behind is in the staging folder,
which no reader looks into, until ``clear_staging``. Reading is planned from names and manifests and runs in tasks. Folders are paths or
URIs that driver and executors both reach.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from docketry.operators.governance import redact_record
from docketry.runtime import checkpoint, fresh, partitions

STAGING, COMMITS = "_staging", "_commits"
#: Levels of log lines, from the least.
LEVELS = ("debug", "info", "warn", "error")
#: Rows of a page.
PAGE = 200
#: Folders that are dealt to the tasks which read objects, if there are so many, and tasks at most.
FOLDERS, SHARES = 16, 256
_PART_BITS = 33  # monotonically_increasing_id has the partition above these bits


def folder(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", re.sub(r"^s3a:", "s3:", root.rstrip("/"))))


def _names(where: fs.FileSystem, path: str, recursive: bool = False) -> list[fs.FileInfo]:
    found = where.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=recursive))
    return sorted((i for i in found if i.type == fs.FileType.File), key=lambda i: i.path)


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: (name in the staging folder, final name, rows) of each file."""

    files: list[tuple[str, str, int]]


class StagedWriter(DataSourceArrowWriter):
    """Tasks stage files; commit moves them, abort deletes them."""

    def __init__(self, root: str, overwrite: bool = False):
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex

    def stage(self, where: fs.FileSystem, base: str, task: str, batches: Iterator[pa.RecordBatch], staged: list[tuple[str, str, int]]) -> None:
        raise NotImplementedError

    def publish(self, where: fs.FileSystem, path: str, files: list[tuple[str, str, int]]) -> None:
        """After the files are in place."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        where, path = folder(self.root)
        context = TaskContext.get()
        task = f"{context.partitionId():05d}-{context.taskAttemptId()}"
        staged: list[tuple[str, str, int]] = []
        try:
            self.stage(where, f"{path}/{STAGING}/{self.job}/{task}", task, iterator, staged)
        except BaseException:
            if where.get_file_info(f"{path}/{STAGING}/{self.job}/{task}").type != fs.FileType.NotFound:
                where.delete_dir(f"{path}/{STAGING}/{self.job}/{task}")
            raise
        return Staged(staged)

    def commit(self, messages: list[Staged | None]) -> None:
        where, path = folder(self.root)
        files = [f for m in messages if m for f in m.files]
        for made in {f"{path}/{final}".rpartition("/")[0] for _, final, _ in files}:
            where.create_dir(made, recursive=True)
        for staged, final, _ in files:
            where.move(staged, f"{path}/{final}")
        self.publish(where, path, files)
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        where, path = folder(self.root)
        if where.get_file_info(f"{path}/{STAGING}/{self.job}").type != fs.FileType.NotFound:
            where.delete_dir(f"{path}/{STAGING}/{self.job}")


class LinesWriter(StagedWriter):
    """One file of lines for each task; a manifest makes all files of a write visible at once."""

    def stage(self, where, base, task, batches, staged):
        rows, out = 0, None
        try:
            for batch in batches:
                if batch.num_rows and out is None:
                    where.create_dir(base, recursive=True)
                    out = where.open_output_stream(f"{base}/lines")
                for line in batch.column(0).to_pylist():
                    if line is None or "\n" in line:
                        raise ValueError("a line must be a text without line breaks")
                    out.write(line.encode() + b"\n")
                    rows += 1
        finally:
            if out is not None:
                out.close()
        if rows:
            staged.append((f"{base}/lines", f"{self.job}-{task}.jsonl", rows))

    def publish(self, where, path, files):
        where.create_dir(f"{path}/{COMMITS}", recursive=True)
        before = _names(where, f"{path}/{COMMITS}") if self.overwrite else []
        with where.open_output_stream(f"{path}/{COMMITS}/.{self.job}") as out:
            out.write(json.dumps([[final, rows] for _, final, rows in files]).encode())
        where.move(f"{path}/{COMMITS}/.{self.job}", f"{path}/{COMMITS}/{self.job}.json")
        for info in before:
            where.delete_file(info.path)


@dataclass
class Piece(InputPartition):
    """A file to read: its name, how many rows it has, and what comes before it."""

    name: str
    rows: int
    offset: int = 0


class LinesReader(DataSourceReader):
    """Files of committed writes, one partition each."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> Sequence[Piece]:
        where, path = folder(self.root)
        found = []
        for info in _names(where, f"{path}/{COMMITS}"):
            if info.path.endswith(".json"):
                with where.open_input_stream(info.path) as f:
                    found += [Piece(name, rows) for name, rows in json.loads(f.read())]
        return found or [Piece("", 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        where, path = folder(self.root)
        with where.open_input_stream(f"{path}/{partition.name}") as f:
            left = b""
            while chunk := f.read(1 << 22):
                lines = (left + chunk).split(b"\n")
                left = lines.pop()
                yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in lines], pa.string())], ["value"])


class CommittedLines(DataSource):
    """Lines (value string) in a folder; option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "committed_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options["path"], overwrite)


class ObjectWriter(StagedWriter):
    """One file for each row, named by its key; a key that is there is replaced."""

    def stage(self, where, base, task, batches, staged):
        where.create_dir(base, recursive=True)
        for batch in batches:
            for key, content in zip(batch.column(0), batch.column(1)):
                name = key.as_py()
                if not name or content.as_py() is None or any(p in ("", ".", "..", STAGING, COMMITS) for p in name.split("/")):
                    raise ValueError(f"no key or content of an object: {name!r}")
                with where.open_output_stream(f"{base}/{len(staged)}") as out:
                    out.write(content.as_buffer())
                staged.append((f"{base}/{len(staged)}", name, 1))


class Objects(DataSource):
    """A sink of objects (key string, content binary) in a folder; option ``path``. They are read as files."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def writer(self, schema, overwrite: bool) -> ObjectWriter:
        return ObjectWriter(self.options["path"], overwrite)


@dataclass
class Share(InputPartition):
    """What one task reads: files, and folders with all that is below them."""

    files: list[str]
    folders: list[str]


class ObjectsReader(DataSourceReader):
    """Objects below a folder. Planning goes down only until there are FOLDERS folders; tasks list what is below these."""

    def __init__(self, root: str, pattern: str):
        self.root, self.pattern = root, pattern

    def partitions(self) -> Sequence[Share]:
        where, path = folder(self.root)
        files, level = [], [path]
        while level and len(level) < FOLDERS:
            below = []
            for base in level:
                for i in where.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                    if i.type == fs.FileType.Directory and i.base_name not in (STAGING, COMMITS):
                        below.append(i.path)
                    elif i.type == fs.FileType.File:
                        files.append(i.path)
            level = below
        n = min(SHARES, max(1, len(level), len(files)))
        return [Share(sorted(files)[k::n], sorted(level)[k::n]) for k in range(n)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        where, path = folder(self.root)
        rows: list[tuple[str, int, bytes]] = []
        held = 0
        for name in (*partition.files, *(i.path for base in partition.folders for i in _names(where, base, recursive=True))):
            if not fnmatchcase(name.rpartition("/")[2], self.pattern):
                continue
            with where.open_input_stream(name) as f:
                content = f.read()
            rows.append((name[len(path) :].lstrip("/"), len(content), content))
            held += len(content)
            if len(rows) >= 1 << 10 or held >= 1 << 24:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], ["key", "length", "content"])


class StoredObjects(DataSource):
    """Objects (key string, length long, content binary) of a folder; options ``path`` and ``pattern``, of their last names."""

    @classmethod
    def name(cls) -> str:
        return "stored_objects"

    def schema(self) -> str:
        return "key string, length long, content binary"

    def reader(self, schema) -> ObjectsReader:
        return ObjectsReader(self.options["path"], self.options.get("pattern", "*"))


class PagesReader(DataSourceReader):
    """Pages ``offset-rows.json`` in order of offset, up to the first that is missing, empty or short."""

    def __init__(self, root: str, size: int, limit: int | None):
        self.root, self.size, self.limit = root, size, limit

    def partitions(self) -> Sequence[Piece]:
        where, path = folder(self.root)
        pages: dict[int, Piece] = {}
        for info in _names(where, path):
            if m := re.fullmatch(r"(\d+)-(\d+)\.json", info.base_name):
                pages[int(m[1])] = Piece(info.base_name, int(m[2]), int(m[1]))
        planned, offset = [], 0
        while (page := pages.get(offset)) and page.rows and (self.limit is None or offset < self.limit):
            planned.append(page)
            if page.rows < self.size:
                break
            offset += self.size
        return planned or [Piece("", 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        where, path = folder(self.root)
        with where.open_input_stream(f"{path}/{partition.name}") as f:
            rows = json.loads(f.read())
        if self.limit is not None:
            rows = rows[: self.limit - partition.offset]
        places = pa.array(range(partition.offset, partition.offset + len(rows)), pa.int64())
        yield pa.RecordBatch.from_arrays([places, pa.array([json.dumps(r, ensure_ascii=False) for r in rows], pa.string())], ["place", "row"])


class StoredPages(DataSource):
    """Rows (place long, row string) of stored pages of a paged interface; options ``path``, ``size`` and ``limit``."""

    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return "place long, row string"

    def reader(self, schema) -> PagesReader:
        limit = self.options.get("limit")
        return PagesReader(self.options["path"], int(self.options.get("size", PAGE)), None if limit is None else int(limit))


def register(spark: SparkSession) -> None:
    for source in (CommittedLines, Objects, StoredObjects, StoredPages):
        spark.dataSource.register(source)


def clear_staging(path: str, hours: float = 24) -> int:
    """Delete what writes that failed have left staged, if it is older than the longest write may take; the number of writes."""
    where, base = folder(path)
    old = datetime.now(UTC) - timedelta(hours=hours)
    staged = where.get_file_info(fs.FileSelector(f"{base}/{STAGING}", allow_not_found=True))
    gone = [i for i in staged if i.type == fs.FileType.Directory and i.mtime <= old]
    for info in gone:
        where.delete_dir(info.path)
    return len(gone)


def append_lines(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """Add lines (one text column) to a folder: all of them, or none if a task fails. Nulls and line breaks are errors."""
    register(lines.sparkSession)
    lines.write.format("committed_lines").mode("overwrite" if overwrite else "append").option("path", path).save()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of all committed lines of a folder, none if there is no such folder."""
    register(spark)
    return spark.read.format("committed_lines").option("path", path).load()


def append_rows(rows: DataFrame, path: str) -> None:
    """Add rows to a folder, as JSON lines in which nulls stay."""
    append_lines(rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")), path)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a folder of append_rows."""
    return read_lines(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")


def insert_returning(rows: DataFrame, path: str, *natural: str, id_col: str = "id") -> DataFrame:
    """Append rows with a key made from their natural key, and give (id, natural key) of each.

    The key is half a SHA-256, in hexadecimal, of the natural key's values as a JSON list,
    so it is known before the write and the same when a job runs again.
    """
    key = F.substring(F.sha2(F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in natural])), 256), 1, 32)
    keyed = rows.withColumn(id_col, key)
    append_rows(keyed, path)
    return keyed.select(id_col, *natural)


def log_lines(rows: DataFrame, minimum: str = "info", level: str = "level", at: str = "at", message: str = "msg") -> DataFrame:
    """(value): a JSON line for each row of at least a level: level, at, msg and all other columns, everything redacted.

    Rows of an unknown or null level are left out. Nulls stay in the line.
    """
    shown = redact_record(rows.where(F.col(level).isin(*LEVELS[LEVELS.index(minimum) :])))
    others = [F.col(f"`{c}`") for c in rows.columns if c not in (level, at, message)]
    moment = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at")
    return shown.select(F.to_json(F.struct(F.col(level).alias("level"), moment, F.col(message).alias("msg"), *others), {"ignoreNullFields": "false"}).alias("value"))


def put_objects(objects: DataFrame, path: str) -> None:
    """Store (key, content) as files of a folder: all, or none if a task fails. The driver moves one file for each object."""
    register(objects.sparkSession)
    objects.select(F.col("key").cast("string"), F.col("content").cast("binary")).write.format("objects").mode("append").option("path", path).save()


def read_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(key, length, content) of a folder's objects whose last names fit a pattern. The driver sees folders, not objects."""
    register(spark)
    return spark.read.format("stored_objects").options(path=path, pattern=pattern).load()


def delete_prefix(path: str, prefix: str) -> int:
    """Delete the objects whose keys start with a prefix of whole folders, and say how many there were."""
    where, base = folder(path)
    gone = len(_names(where, f"{base}/{prefix.strip('/')}", recursive=True))
    if gone:
        where.delete_dir(f"{base}/{prefix.strip('/')}")
    return gone


def land_pages(rows: DataFrame, path: str, *order: str, size: int = PAGE) -> None:
    """Store rows as pages of JSON lists, as a paged interface gives them in an order.

    Rows are numbered by ranges of the order: the driver sees a count for each range.
    """
    pos, json_ = fresh(rows.columns, "_pos"), F.to_json(F.struct(*rows.columns))
    sorted_ = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = checkpoint(sorted_.select(F.monotonically_increasing_id().alias(pos), json_.alias("row")))
    part = F.shiftright(pos, _PART_BITS)
    before, total = {}, 0
    for r in sorted(placed.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):
        before[r["part"]], total = total, total + r["count"]
    if not before:
        return
    base = F.get(F.lit([before.get(p, 0) for p in range(max(before) + 1)]), part.cast("int"))
    place = base + F.col(pos).bitwiseAND((1 << _PART_BITS) - 1)
    pages = placed.select(place.alias("place"), "row").groupBy(F.floor(F.col("place") / size).alias("page"))
    pages = pages.agg(F.array_sort(F.collect_list(F.struct("place", "row"))).alias("rows"))
    key = F.format_string("%010d-%d.json", F.col("page") * size, F.size("rows"))
    put_objects(pages.select(key.alias("key"), F.concat(F.lit("["), F.array_join("rows.row", ","), F.lit("]")).alias("content")), path)


def read_pages(spark: SparkSession, path: str, size: int = PAGE, limit: int | None = None) -> DataFrame:
    """(place, row as JSON) of stored pages, up to the first missing, empty or short one, and up to limit rows."""
    register(spark)
    options = {"path": path, "size": str(size)} | ({} if limit is None else {"limit": str(limit)})
    return spark.read.format("stored_pages").options(**options).load()
