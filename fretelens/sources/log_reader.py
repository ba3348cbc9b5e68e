"""Splitting reader for service logs (A3), batch and streaming.

A record starts at a header line and holds every line up to the next header,
so a traceback belongs to the record above it wherever a split falls.  A split
[start, end) yields the records whose header starts inside it: it looks for
its first header from ``start`` on and reads past ``end`` until the record it
has open is complete.  Nothing is stitched afterwards, no file is read whole,
and a task's memory is one record plus one chunk.  A task takes many splits,
so that their number costs no tasks; splits of one file that follow each other
in a task are one run, whose records are counted on.

Files are opened through ``pyarrow.fs`` (local and shared folders, HDFS and
the object stores it knows).
"""

from __future__ import annotations

import fnmatch
import os
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# the reader runs in tasks, which need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEVELS = "DEBUG|INFO|WARNING|ERROR|CRITICAL"
HEADER = rf"^(\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}},\d{{3}}) - (\S+) - ({LEVELS}) - "
_HEADER = re.compile(HEADER.encode(), re.MULTILINE)
_CHUNK, _HEADER_BYTES, _BATCH = 1 << 20, 4096, 4096
SPLIT_BYTES = 64 << 20
SCHEMA = "file string, split long, n long, pos long, record string"
_ARROW = pa.schema([("file", pa.string()), ("split", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("record", pa.string())])


#: What opening a file counts when splits are dealt into tasks.
_OPEN_BYTES = 16 << 10


@dataclass
class Range(InputPartition):
    """Records whose header starts in [start, end) of a file."""

    file: str
    start: int
    end: int


@dataclass
class Task(InputPartition):
    """Runs (file, start, end, last) of splits that one task reads; ``last`` is the last run of its file."""

    runs: list[tuple[str, int, int, bool]]
    step: int


def log_files(path: str) -> list[tuple[str, int, int]]:
    """(file, bytes, time of change) of a file, a folder's files, or a glob over folders and names."""
    store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))
    fixed = root if not any(c in root for c in "*?[") else re.split(r"[*?\[]", root)[0].rsplit("/", 1)[0]
    info = store.get_file_info(fixed)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(fixed, recursive=fixed != root))
    named = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    if fixed != root:
        named = [f for f in named if fnmatch.fnmatch(f.path, root)]
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted((scheme + f.path, f.size, f.mtime_ns or 0) for f in named)


def _open(file: str):
    store, at = fs.FileSystem.from_uri(file) if "://" in file else (fs.LocalFileSystem(), file)
    return store.open_input_file(at)


def ranges(file: str, start: int, end: int, step: int) -> list[Range]:
    return [Range(file, a, min(a + step, end)) for a in range(start, end, step)]


def dealt(files: list[tuple[str, int]], step: int, tasks: int) -> list[Task]:
    """The splits of all files, in order, dealt into ``tasks`` tasks; more if a task had over ``SPLIT_BYTES``."""
    most = min(SPLIT_BYTES, max(step, -(-sum(size + _OPEN_BYTES for _, size in files) // max(1, tasks))))
    out: list[Task] = []
    room = 0
    for file, size in files:
        at = 0
        while at < size:
            # a file that fits is not cut, so that its records need no counts from elsewhere
            if room < min(most, size - at + _OPEN_BYTES):
                out.append(Task([], step))
                room = most
            end = size if size - at <= room else at + max(1, room // step) * step
            end = min(size, end)
            out[-1].runs.append((file, at, end, end == size))
            room -= end - at + _OPEN_BYTES
            at = end
    return out


def records(part: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records that start in the range."""
    with _open(part.file) as f:
        base = max(0, part.start - 1)    # one byte before tells whether a line starts here
        f.seek(base)
        buffer, scan, current, ended = b"", 0, None, False
        while not ended:
            chunk = f.read(_CHUNK)
            ended = not chunk
            buffer += chunk
            # only whole lines are searched, so that no header is cut
            cut = len(buffer) if ended else buffer.rfind(b"\n") + 1
            for m in _HEADER.finditer(buffer, scan, cut):
                at = base + m.start()
                if at < part.start:
                    continue
                if current is not None:
                    yield current, buffer[current - base : m.start()]
                if at >= part.end:
                    return
                current = at
            if current is None and base + cut >= part.end:
                return
            keep = current - base if current is not None else max(0, cut - 1)
            buffer, base, scan = buffer[keep:], base + keep, max(0, cut - keep)
        if current is not None:
            yield current, buffer[current - base :]


def _batch(*columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW)], schema=_ARROW)


def read_range(part: Range, first: int = 0, run: int | None = None) -> Iterator[pa.RecordBatch]:
    """The records of a split, numbered from ``first`` on; ``run`` is where its run starts."""
    at, said = [], []
    run = part.start if run is None else run

    def full() -> pa.RecordBatch:
        n = len(at)
        return _batch([part.file] * n, [run] * n, list(range(first, first + n)), at, said)
    for place, record in records(part):
        at.append(place)
        said.append(record.decode("utf-8", "replace"))
        if len(at) == _BATCH:
            yield full()
            first, at, said = first + len(at), [], []
    if at:
        yield full()


def read_task(task: Task) -> Iterator[pa.RecordBatch]:
    for file, start, end, _ in task.runs:
        n = 0
        for part in ranges(file, start, end, task.step):
            for b in read_range(part, n, start):
                n += b.num_rows
                yield b


def count_task(task: Task) -> Iterator[pa.RecordBatch]:
    """A row for each run that another one of its file follows: where that starts, and how many records this one has."""
    for file, start, end, last in task.runs:
        if not last:
            yield _batch([file], [end], [sum(1 for part in ranges(file, start, end, task.step) for _ in records(part))], [None], [None])


def last_header(file: str, size: int) -> int:
    """Where the last record of a file that still grows starts (0 if none does)."""
    with _open(file) as f:
        high = size
        while high > 0:
            low = max(0, high - _CHUNK)
            f.seek(max(0, low - 1))
            data = f.read(min(size, high + _HEADER_BYTES) - max(0, low - 1))
            found = [max(0, low - 1) + m.start() for m in _HEADER.finditer(data)]
            found = [x for x in found if x >= low]
            if found:
                return found[-1]
            high = low
    return 0


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.tasks = int(options.get("tasks", 1))
        self.counts = str(options.get("counts", "false")).lower() == "true"

    def partitions(self):
        tasks = dealt([(file, size) for file, size, _ in log_files(self.path)], self.step, self.tasks)
        if self.counts:
            tasks = [t for t in tasks if not all(last for *_, last in t.runs)]
        return tasks or [Task([], self.step)]

    def read(self, partition):
        return count_task(partition) if self.counts else read_task(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are bytes by file.  The file changed last may still grow, so its
    last record waits for the next header (or for ``closed`` to be set)."""

    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.closed = str(options.get("closed", "false")).lower() == "true"

    def initialOffset(self):
        return {"ends": {}}

    def latestOffset(self):
        files = log_files(self.path)
        newest = max((t for _, _, t in files), default=0)
        return {"ends": {f: size if self.closed or t < newest else last_header(f, size) for f, size, t in files}}

    def partitions(self, start, end):
        return [r for f, z in sorted(end["ends"].items()) for r in ranges(f, start["ends"].get(f, 0), z, self.step)]

    def read(self, partition):
        return read_range(partition)


class ServiceLog(DataSource):
    """Options: ``path`` (file, folder or glob), ``splitBytes``, for batches ``tasks`` and ``counts``
    (of runs instead of records), for streams ``closed``."""

    @classmethod
    def name(cls):
        return "service_log"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def parsed(record: Column) -> dict[str, Column]:
    """ts, logger, level and message of a record's text, which starts with a header; blank lines fall away."""
    blank = record.contains("\r") | record.contains("\n\n")
    text = F.rtrim(F.when(blank, F.regexp_replace(record, r"(\r?\n)+", "\n")).otherwise(record), F.lit("\n"))
    # a logger has no blank in it, so each part of the header ends at the next dash
    after = lambda x, part: F.substr(x, F.length(part) + F.lit(len(" - ") + 1))
    stamp, rest = F.substring(text, 1, 23), F.substr(text, F.lit(23 + len(" - ") + 1))
    logger = F.substring_index(rest, " - ", 1)
    level = F.substring_index(after(rest, logger), " - ", 1)
    return {"ts": F.to_timestamp(stamp, "yyyy-MM-dd HH:mm:ss,SSS"), "logger": logger, "level": level,
            "message": after(after(rest, logger), level)}


def _source(spark: SparkSession, path: str, split_bytes: int):
    spark.dataSource.register(ServiceLog)
    return {"path": path, "splitBytes": str(split_bytes)}


def scan_logs(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A3: (file, record_no, ts, logger, level, message) from log files of any size.

    Records are numbered in their run; what the runs before it in its file hold
    is counted apart, one row for each run that another follows, at most about one a task."""
    tasks = str(4 * spark.sparkContext.defaultParallelism)
    source = spark.read.format("service_log").options(**_source(spark, path, split_bytes), tasks=tasks)
    raw = source.load()
    before = Window.partitionBy("file").orderBy("split")
    counts = source.option("counts", "true").load()
    offsets = counts.select("file", "split", F.sum("n").over(before).alias("_before"))
    rows = raw.join(F.broadcast(offsets), ["file", "split"], "left")
    return rows.select("file", (F.coalesce("_before", F.lit(0)) + F.col("n") + 1).alias("record_no"), *[c.alias(k) for k, c in parsed(F.col("record")).items()])


def stream_logs(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, closed: bool = False) -> DataFrame:
    """The same records as a stream (file, pos, ts, logger, level, message); ``pos`` is the header's offset.

    Files must keep their names while the stream runs."""
    options = _source(spark, path, split_bytes) | {"closed": str(closed).lower()}
    raw = spark.readStream.format("service_log").options(**options).load()
    return raw.select("file", "pos", *[c.alias(k) for k, c in parsed(F.col("record")).items()])
