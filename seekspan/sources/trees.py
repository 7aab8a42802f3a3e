"""Source trees listed and read by the tasks (S1): directories are a DataFrame that grows level by level."""

from __future__ import annotations

import math
import os
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspan.session import materialize, small_batches

# Bytes of files that one task reads, and bytes of a batch handed to Spark.
TASK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
# Entries of a folder that are handed to Spark together.
LISTED_ROWS = 10_000

_FOLDER = "repo_id string, project_name string, root string, folder string"
_LISTED = "repo_id string, project_name string, root string, kind string, path string, size bigint, mtime timestamp, error string"
_READ = "repo_id string, project_name string, file_path string, mtime timestamp, size bigint, raw binary, error string"
FILE, FOLDER, ERROR = "file", "folder", "error"


def opened(uri: str) -> tuple[arrow_fs.FileSystem | None, str]:
    """The file system of a path and the path in it; none for files that are mounted on all machines."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return None, parts.path if parts.scheme else uri
    return arrow_fs.FileSystem.from_uri(uri)


def entries(folder: str) -> Iterator[tuple[str, str, int, datetime | None]]:
    """(kind, name, size, time) of what lies in a folder; links to folders are not followed."""
    system, path = opened(folder)
    if system is None:
        with os.scandir(path) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield FOLDER, e.name, 0, None
                elif e.is_file():
                    stat = e.stat()
                    yield FILE, e.name, stat.st_size, datetime.fromtimestamp(stat.st_mtime, tz=timezone.utc)
        return
    for info in system.get_file_info(arrow_fs.FileSelector(path)):
        kind = FOLDER if info.type == arrow_fs.FileType.Directory else FILE
        yield kind, info.base_name, info.size or 0, info.mtime


def content(path: str) -> bytes:
    system, inside = opened(path)
    if system is None:
        with open(inside, "rb") as f:
            return f.read()
    with system.open_input_stream(inside) as f:
        return f.read()


def write_file(path: str, data: bytes) -> None:
    """Write a file and the folders above it, on whatever file system the path names."""
    system, inside = opened(path)
    if system is None:
        system = arrow_fs.LocalFileSystem()
    system.create_dir(os.path.dirname(inside), recursive=True)
    with system.open_output_stream(inside) as f:
        f.write(data)


def _schema(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "timestamp": pa.timestamp("us", tz="UTC"), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in text.split(", "))])


def list_trees(spark: SparkSession, repos: Iterable[tuple[str, str, str]], extensions: tuple[str, ...], skipped: frozenset[str]) -> DataFrame:
    """Files below the roots (repo_id, project_name, root), and folders that could not be listed (kind "error").

    Folders of one level are dealt out to all tasks and listed there; what they hold is stored, and its folders are the next
    level, so a deep or wide branch is nobody's task alone, and the driver lists nothing. Skipped and hidden folders are
    not entered.
    """
    schema = _schema(_LISTED)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                head = [row["repo_id"], row["project_name"], row["root"]]
                out = []

                def listed() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)  # noqa: B023

                try:
                    for kind, name, size, mtime in entries(row["folder"]):
                        path = f"{row['folder'].rstrip('/')}/{name}"
                        if kind == FOLDER and name not in skipped and not name.startswith("."):
                            out.append([*head, FOLDER, path, 0, None, None])
                        elif kind == FILE and name.endswith(extensions):
                            out.append([*head, FILE, path, size, mtime, None])
                        if len(out) >= LISTED_ROWS:
                            yield listed()
                            out = []
                except (OSError, pa.ArrowException) as e:
                    out.append([*head, ERROR, row["folder"], 0, None, f"{type(e).__name__}: {e}"])
                if out:
                    yield listed()

    tasks = spark.sparkContext.defaultParallelism
    folders = spark.createDataFrame([(r, p, root, root) for r, p, root in repos], _FOLDER)
    levels = []
    while True:
        level = materialize(folders.repartition(tasks, "repo_id", "folder").mapInArrow(run, _LISTED), "folders")
        levels.append(level.filter(F.col("kind") != FOLDER))
        folders = level.filter(F.col("kind") == FOLDER).select("repo_id", "project_name", "root", F.col("path").alias("folder"))
        if folders.isEmpty():
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def read_files(listed: DataFrame) -> DataFrame:
    """The listed files with their content as `raw`, about TASK_BYTES for each task; a file or folder that cannot be read is a
    row with an `error` and no content."""
    schema = _schema(_READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                raw, error = None, row["error"]
                if error is None:
                    try:
                        raw = content(row["path"])
                    except (OSError, pa.ArrowException) as e:
                        error = f"{type(e).__name__}: {e}"
                name = row["path"][len(row["root"].rstrip("/")) + 1 :]
                rows.append([row["repo_id"], row["project_name"], name, row["mtime"], None if raw is None else len(raw), raw, error])
                held += len(raw or b"")
                if held >= BATCH_BYTES or len(rows) >= 10_000:
                    yield batch_of()
                    rows, held = [], 0
        if rows:
            yield batch_of()

    small_batches(listed.sparkSession)
    total = listed.agg(F.sum("size")).first()[0] or 0
    tasks = max(listed.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TASK_BYTES))
    return listed.repartition(tasks, "repo_id", "path").mapInArrow(run, _READ)
