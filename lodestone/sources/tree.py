"""The files below a root, walked and read by tasks on any file system that Arrow opens.

Ignored folders are never entered and ignored files never opened. What cannot be listed or read is a row with an error, and bytes
that are not UTF-8 are replaced, which its row tells. The driver walks until it knows some hundred folders; tasks walk what is
below these, and other tasks read the files, so neither a wide nor a deep tree passes through one of them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Folders that the driver walks itself at most; tasks for each core; bytes and rows of a batch of texts.
FOLDERS, TASKS, BATCH_BYTES, BATCH_ROWS = 256, 4, 16 << 20, 1_000
Rule = tuple[str, bool, bool]
LISTED = "rel_path string, size long, mtime timestamp, error string"
_LISTED = pa.schema([("rel_path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("error", pa.string())])
READ = "rel_path string, size long, mtime timestamp, malformed boolean, text string, error string"
_READ = pa.schema([_LISTED.field(0), _LISTED.field(1), _LISTED.field(2), ("malformed", pa.bool_()), ("text", pa.string()), ("error", pa.string())])


def opened(root: str) -> tuple[arrow_fs.FileSystem, str] | None:
    """(file system, path of root in it), or None if Arrow has none for its scheme."""
    try:
        fs, path = arrow_fs.FileSystem.from_uri(root) if re.match(r"[a-z][a-z0-9+.-]*:", root, re.I) else (arrow_fs.LocalFileSystem(), os.path.abspath(root))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    return fs, path.rstrip("/")


def matcher(rules: list[Rule]):
    """Whether the last rule that matches ignores a path; rules: (pattern, whether it is tried on the path only, whether it takes back)."""
    compiled = [(re.compile(p), only, back) for p, only, back in rules]

    def ignores(rel: str) -> bool:
        out, name = False, rel.rsplit("/", 1)[-1]
        for pattern, only, back in compiled:
            if pattern.search(rel) or not only and pattern.search(name):
                out = not back
        return out

    return ignores


def _entries(fs: arrow_fs.FileSystem, top: str, rel: str, ignores) -> Iterator[tuple[str, bool, int, int, str | None]]:
    """(rel_path, whether a folder, size, mtime in microseconds, error) of what lies in a folder and is not ignored."""
    try:
        found = fs.get_file_info(arrow_fs.FileSelector(f"{top}/{rel}" if rel else top))
    except (OSError, pa.ArrowException) as e:
        yield rel, False, 0, 0, f"unreadable folder: {type(e).__name__}"
        return
    local = isinstance(fs, arrow_fs.LocalFileSystem)
    for f in sorted(found, key=lambda f: f.path):
        path = f"{rel}/{f.base_name}" if rel else f.base_name
        if ignores(path) or f.type == arrow_fs.FileType.NotFound:
            continue
        folder = f.type == arrow_fs.FileType.Directory
        if local and os.path.islink(f.path):
            to = os.path.realpath(f.path)
            if not f"{to}/".startswith(os.path.realpath(top) + "/"):
                yield path, False, 0, 0, "a link out of the root"
                continue
            if folder:  # its files are met where they are
                continue
        if folder or f.type == arrow_fs.FileType.File:
            yield path, folder, f.size or 0, (f.mtime_ns or 0) // 1000, None


def _walk(fs: arrow_fs.FileSystem, top: str, starts: list[str], ignores) -> Iterator[tuple[str, int, int, str | None]]:
    todo = list(reversed(starts))
    while todo:
        below = []
        for path, folder, size, mtime, error in _entries(fs, top, todo.pop(), ignores):
            if folder:
                below.append(path)
            else:
                yield path, size, mtime, error
        todo += reversed(below)


def _table(rows: list[tuple[str, int, int, str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _LISTED, strict=True)], schema=_LISTED)


def listing(spark: SparkSession, root: str, rules: list[Rule]) -> DataFrame:
    """rel_path, size, mtime, error of the files below root that the rules leave; no file is opened."""
    fs, top = opened(root)
    if fs.get_file_info(top).type != arrow_fs.FileType.Directory:
        raise FileNotFoundError(f"{root} is no folder")
    ignores, here, todo, walked = matcher(rules), [], [""], 0
    while todo and walked < FOLDERS:
        walked += 1
        for path, folder, size, mtime, error in _entries(fs, top, todo.pop(0), ignores):
            if folder:
                todo.append(path)
            else:
                here.append((path, size, mtime, error))
                if len(here) > 100 * FOLDERS:
                    walked = FOLDERS
    near = spark.createDataFrame(pa.Table.from_batches([_table(here)] if here else [], _LISTED), LISTED)
    if not todo:
        return near
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ignores = opened(root)[0], matcher(rules)
        rows: list = []
        for b in batches:
            for row in _walk(own, top, b.column("folder").to_pylist(), ignores):
                rows.append(row)
                if len(rows) >= 10_000:
                    yield _table(rows)
                    rows = []
        if rows:
            yield _table(rows)

    folders = spark.createDataFrame([(p,) for p in todo], "folder string").repartition(min(len(todo), TASKS * spark.sparkContext.defaultParallelism), "folder")
    return near.unionByName(folders.mapInArrow(run, LISTED))


def listed(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """listing() of a few paths below root: those that are files."""
    fs, top = opened(root)
    found = fs.get_file_info([f"{top}/{p}" for p in dict.fromkeys(paths)])
    rows = [(f.path[len(top) + 1 :], f.size, f.mtime_ns // 1000, None) for f in found if f.type == arrow_fs.FileType.File]
    return spark.createDataFrame(pa.Table.from_batches([_table(rows)] if rows else [], _LISTED), LISTED)


def read(files: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """rel_path, size, mtime, malformed, text, error of listed files. An unreadable file has an error and no text."""
    spark = files.sparkSession
    ship(spark)
    top = opened(root)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = opened(root)[0]
        rows, held = [], 0
        for b in batches:
            for r in b.to_pylist():
                text, malformed, error = None, False, r["error"]
                if error is None:
                    try:
                        with fs.open_input_stream(f"{top}/{r['rel_path']}") as f:
                            data = f.read()
                        try:
                            text = data.decode()
                        except UnicodeDecodeError:
                            text, malformed = data.decode(errors="replace"), True
                        held += len(data)
                    except (OSError, pa.ArrowException) as e:
                        error = f"unreadable: {type(e).__name__}"
                rows.append({"rel_path": r["rel_path"], "size": r["size"], "mtime": r["mtime"], "malformed": malformed, "text": text, "error": error})
                if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, _READ)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _READ)

    return files.select("rel_path", "size", "mtime", "error").repartition(tasks or TASKS * spark.sparkContext.defaultParallelism).mapInArrow(run, READ)
