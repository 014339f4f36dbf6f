"""Files as a table of paths: listed, hashed and read in tasks, never through the driver.

``list_files`` walks folders in rounds. A task lists its folders and theirs, up to
a number of entries, and hands what is left to the next round, where it is
dealt out anew: a small folder takes one round, a folder of millions of folders
all tasks. Names are taken as they are, so ``_draft.md``, ``.note.txt`` and
``a[1].txt`` are files like any other (Spark's own file source hides the first
two and reads the third as a pattern).

``read_files`` and ``hash_files`` open the paths of a table where its rows
lie, and ``write_files`` writes them there. A path that cannot be opened is a row with an error, not a failed job.

Local paths and whatever ``pyarrow.fs`` knows by its URI (``hdfs://``, ``s3://``, ``gs://``,
``abfss://``) can be opened; only local ones are covered by tests.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import re
import uuid
from collections import deque
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.session import cut_lineage

LISTING_SCHEMA = "path string, modificationTime timestamp, length bigint"
CONTENT_SCHEMA = LISTING_SCHEMA + ", content binary, read_error string"
#: Entries that a task lists before it hands the rest of its folders on.
ENTRIES = 20_000
#: Bytes of files that a task reads on average, and that it sends to the JVM at a time.
TASK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: What a row of Spark can hold; larger files are errors.
MOST_BYTES = (1 << 31) - (1 << 20)

_URI = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)(/.*)?\Z", re.S)
_OPEN: dict = {}


def plain_path(root) -> str:
    """An absolute local path without a scheme, or a URI as it is."""
    root = str(root)
    if root.startswith("file:"):
        root = re.sub(r"\Afile:(//[^/]*(?=/))?", "", root)
    m = _URI.match(root)
    return root.rstrip("/") if m else os.path.abspath(os.path.expanduser(root))


def filesystem(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path in it, what stands before paths of it)."""
    m = _URI.match(path)
    if not m:
        if "" not in _OPEN:
            _OPEN[""] = pafs.LocalFileSystem()
        return _OPEN[""], path, ""
    head = f"{m[1]}://{m[2]}"
    if head not in _OPEN:
        _OPEN[head] = pafs.FileSystem.from_uri(head + "/")
    system, base = _OPEN[head]
    base = base.rstrip("/")  # the bucket, where the scheme has such
    return system, base + (m[3] or "/"), head[:len(head) - len(base)] if base and head.endswith(base) else head


def _row(info: pafs.FileInfo, head: str) -> tuple:
    when = info.mtime_ns
    at = None if when is None else dt.datetime.fromtimestamp(0, dt.timezone.utc) + dt.timedelta(microseconds=when // 1000)
    return head + info.path, at, info.size, False


def _walk(folders: Sequence[str], recursive: bool, entries: int) -> Iterator[tuple]:
    """(path, time, length, is it a folder to go on with) below ``folders``."""
    waiting, seen = deque(folders), 0
    while waiting:
        folder = waiting.popleft()
        if seen >= entries:
            yield folder, None, None, True
            continue
        system, path, head = filesystem(folder)
        for info in system.get_file_info(pafs.FileSelector(path, recursive=False, allow_not_found=True)):
            seen += 1
            if info.type == pafs.FileType.File:
                yield _row(info, head)
            elif info.type == pafs.FileType.Directory and recursive and not (not head and os.path.islink(info.path)):
                waiting.append(head + info.path)  # a linked folder is not followed: it may lead back


_WALKED = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("is_folder", pa.bool_())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    some: list = []
    for r in rows:
        some.append(r)
        if len(some) >= size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in some], schema)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in some], schema)


def list_files(spark: SparkSession, roots: Sequence[str], recursive: bool = True, entries: int = ENTRIES) -> DataFrame:
    """S1 without content: ``path, modificationTime, length`` of every file under the roots.

    A root may be a file or a folder; a missing one yields nothing; a file reached
    by two roots appears twice. The result is a checkpointed table."""
    paths = [plain_path(r) for r in roots]
    files, folders = [], []
    for p in paths:
        system, path, head = filesystem(p)
        info = system.get_file_info(path)
        if info.type == pafs.FileType.File:
            files.append(_row(info, head)[:3])
        elif info.type == pafs.FileType.Directory:
            folders.append((p,))
    found = spark.createDataFrame(files, LISTING_SCHEMA)
    here = spark.createDataFrame(folders, "path string").repartition(max(1, len(folders)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [p for b in batches for p in b.column(0).to_pylist()]
        yield from _batches(_walk(own, recursive, entries), _WALKED)

    while folders:
        walked = cut_lineage(here.mapInArrow(run, LISTING_SCHEMA + ", is_folder boolean"))
        found = found.unionByName(walked.where("not is_folder").drop("is_folder"))
        left = walked.where("is_folder").select("path")
        n = left.count()
        if not n:
            break
        here = left.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))
    return found


def _dealt(paths: DataFrame) -> DataFrame:
    """The paths dealt out so that a task has some 64 MB of files, and every core a task. Two numbers reach the driver."""
    n = paths.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size")).first()
    tasks = max(math.ceil((n["size"] or 0) / TASK_BYTES), min(n["n"], 2 * paths.sparkSession.sparkContext.defaultParallelism))
    return paths.repartition(max(1, tasks))


def read_files(paths: DataFrame) -> DataFrame:
    """``path, modificationTime, length, content, read_error`` for the rows of a listing.

    The files are opened by the tasks that hold their rows, one at a time. One that cannot be
    read, or that no row can hold, has no content and the error's text."""
    def one(path: str, length: int) -> tuple[bytes | None, str | None]:
        try:
            if length is not None and length > MOST_BYTES:
                return None, f"OverflowError: {length} bytes"
            system, at, _ = filesystem(path)
            with system.open_input_stream(at) as f:
                return f.read(), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents, errors, size, first = [], [], 0, 0
            for i in range(b.num_rows):
                content, error = one(b.column(0)[i].as_py(), b.column(2)[i].as_py())
                contents.append(content)
                errors.append(error)
                size += len(content or b"")
                if size >= BATCH_BYTES or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*[b.column(c).slice(first, i + 1 - first) for c in range(3)], pa.array(contents, pa.binary()),
                                                      pa.array(errors, pa.string())], names=[*b.schema.names, "content", "read_error"])
                    contents, errors, size, first = [], [], 0, i + 1

    return _dealt(paths.select("path", "modificationTime", "length")).mapInArrow(run, CONTENT_SCHEMA)


def write_files(rows: DataFrame, root: str) -> int:
    """Write the rows' ``content`` (binary) to their ``path`` below ``root``, and return the number of files.

    Rows of one path make one file, in the order of their content. The tasks write the files, so the driver holds
    no path. A file is written beside ``root`` and moved there whole, so a task that runs twice leaves no part of one."""
    spark = rows.sparkSession
    root = plain_path(root)
    beside = f"{root}_{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base, _ = filesystem(root)
        _, aside, _ = filesystem(f"{beside}/{uuid.uuid4().hex}")
        system.create_dir(aside, recursive=True)
        made, files = set(), 0
        parts = ((b.column(0)[i].as_py(), b.column(1)[i].as_buffer()) for b in batches for i in range(b.num_rows))
        for path, some in groupby(parts, key=lambda x: x[0]):
            with system.open_output_stream(f"{aside}/file") as f:
                for _, content in some:
                    f.write(content)
            folder = os.path.dirname(f"{base}/{path}")
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            system.move(f"{aside}/file", f"{base}/{path}")
            files += 1
        system.delete_dir(aside)
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    n = rows.count()
    tasks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(n / ENTRIES))
    rows = rows.select("path", F.col("content").cast("binary").alias("content")).repartition(tasks, "path").sortWithinPartitions("path", "content")
    files = rows.mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0
    system, at, _ = filesystem(beside)
    if system.get_file_info(at).type == pafs.FileType.Directory:
        system.delete_dir(at)
    return files


def hash_files(paths: DataFrame) -> DataFrame:
    """``path, sha256`` for the rows of a listing: hex digest of the bytes, read a MB at a time;
    null where a file cannot be read."""
    def digest(path: str) -> str | None:
        try:
            system, at, _ = filesystem(path)
            h = hashlib.sha256()
            with system.open_input_stream(at) as f:
                while block := f.read(1 << 20):
                    h.update(block)
            return h.hexdigest()
        except Exception:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(p) for p in b.column(0).to_pylist()], pa.string())], names=["path", "sha256"])

    return _dealt(paths.select("path", "length")).select("path").mapInArrow(run, "path string, sha256 string")
