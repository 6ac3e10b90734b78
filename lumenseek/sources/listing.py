"""Folder scans that run in the tasks: every file with its size, empty and unreadable ones included.

Spark's own file sources list on the driver and leave out zero-byte files. Here
a folder is a row: tasks list the folders of one level, the folders they find
are the rows of the next level, and each level is written to the shared folder
before the next one starts, so a lost executor repeats its own folders only.
Folders whose files are all excluded are not entered. Links are not followed.

The root must be a folder that all executors mount under the same path; other
stores go through ``files.list_files``.
"""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenseek.config import Settings
from lumenseek.functions import paths as p
from lumenseek.session import shared_folder, ship_package

#: Folders that one task lists on average, rows of an Arrow batch, bytes of file contents in one.
FOLDERS_PER_TASK, ROWS_PER_BATCH, BYTES_PER_BATCH = 200, 10_000, 8 << 20
FILE, FOLDER = "file", "folder"
_ENTRY = "path string, kind string, size bigint"


def local_path(root: str) -> str | None:
    """The path of a root that tasks can open, else None."""
    url = urlparse(root)
    if url.scheme not in ("", "file"):
        return None
    return os.path.normpath(unquote(url.path) if url.scheme else root)


def _entries(batches):
    """Files and folders in the folders of a batch; what can't be read has no size."""
    def found(folder: str):
        try:
            with os.scandir(folder) as entries:
                for entry in entries:
                    if entry.is_symlink():
                        continue
                    if entry.is_dir(follow_symlinks=False):
                        yield entry.path, FOLDER, None
                    elif entry.is_file(follow_symlinks=False):
                        yield entry.path, FILE, _size(entry)
        except OSError:
            yield folder, FILE, None

    for batch in batches:
        rows = []
        for folder in batch.column(0).to_pylist():
            for row in found(folder):
                rows.append(row)
                if len(rows) >= ROWS_PER_BATCH:
                    yield _as_batch(rows)
                    rows = []
        yield _as_batch(rows)


def _size(entry) -> int | None:
    try:
        return entry.stat(follow_symlinks=False).st_size if os.access(entry.path, os.R_OK) else None
    except OSError:
        return None


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())],
        ["path", "kind", "size"])


def _entered(path: Column, root: str, globs: tuple[str, ...]) -> Column:
    """Folders that may hold a wanted file: no dot-folders, none that the globs exclude at any depth."""
    below = p.relative_path(path, root)
    inside, deeper = F.concat(below, F.lit("/\x01")), F.concat(below, F.lit("/\x01/\x01"))
    return ~below.rlike(r"(^|/)\.") & ~(p.is_excluded(inside, globs, strict=True) & p.is_excluded(deeper, globs, strict=True))


def scan_folder(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
    """``file_path`` and ``size`` of the wanted files below ``root``; size is null where a file or folder can't be read.

    A folder that can't be listed counts as one such file. A root that does not exist is an error.
    """
    top = local_path(root)
    if top is None:
        raise ValueError(f"{root} is not a folder that tasks can list")
    if not os.path.isdir(top):
        raise FileNotFoundError(root)
    ship_package(spark)
    out = shared_folder(spark, "listing")
    level, depth = spark.createDataFrame([(top,)], "path string"), 0
    while True:
        level.mapInArrow(_entries, _ENTRY).write.parquet(f"{out}/depth={depth}")
        found = spark.read.schema(_ENTRY).parquet(f"{out}/depth={depth}").where(F.col("kind") == FOLDER)
        level = found.where(_entered(F.col("path"), top, settings.exclude_patterns)).select("path")
        folders = level.count()
        if not folders:
            break
        tasks = max(-(-folders // FOLDERS_PER_TASK), min(folders, spark.sparkContext.defaultParallelism))
        level, depth = level.repartition(tasks, "path"), depth + 1
    listed = spark.read.schema(_ENTRY).parquet(f"{out}/depth=*").where(F.col("kind") == FILE)
    below = p.relative_path(F.col("path"), top)
    wanted = (p.is_supported(F.col("path"), settings.supported_languages) & ~below.rlike(r"(^|/)\.")
              & ~p.is_excluded(below, settings.exclude_patterns, strict=True))
    # A folder among the files is one that could not be listed.
    no_folder = F.col("size").isNull() & (p.extension(F.col("path")) == "")
    return listed.where(wanted | no_folder).select(F.col("path").alias("file_path"), "size")


def needs_reading(files: DataFrame) -> bool:
    """Whether files come from ``scan_folder``, without contents or texts."""
    return not {"content", "text"} & set(files.columns)


def with_contents(files: DataFrame) -> DataFrame:
    """Adds ``content``, read in the tasks; null for a file that can't be read any more."""
    ship_package(files.sparkSession)

    def read(batches):
        for batch in batches:
            start, contents, size = 0, [], 0
            paths = batch.column("file_path").to_pylist()
            for at, path in enumerate(paths):
                try:
                    with open(path, "rb") as f:
                        contents.append(f.read())
                except OSError:
                    contents.append(None)
                size += len(contents[-1] or b"")
                if size >= BYTES_PER_BATCH or at + 1 == len(paths):
                    part = batch.slice(start, len(contents))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], [*part.schema.names, "content"])
                    start, contents, size = at + 1, [], 0

    ddl = ", ".join(f"`{name}` {kind}" for name, kind in files.dtypes)
    return files.mapInArrow(read, f"{ddl}, content binary")


def unreadable(files: DataFrame) -> DataFrame:
    """``file_path`` of the files that can't be opened."""
    ship_package(files.sparkSession)

    def closed(batches):
        for batch in batches:
            bad = []
            for path in batch.column(0).to_pylist():
                try:
                    open(path, "rb").close()
                except OSError:
                    bad.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["file_path"])

    return files.select("file_path").mapInArrow(closed, "file_path string")
