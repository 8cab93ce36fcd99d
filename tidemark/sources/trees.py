"""Content of a file tree: read for the rows that need it, and written from a table."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

# ship the worker functions with the job, so executors need no installed copy of this package
register_pickle_by_value(sys.modules[__name__])

#: content that a Python worker is sent, or sends on, at once, but for a single larger file; it holds a few copies
BATCH_BYTES = 4 << 20
_SESSION_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _plain(root: str) -> str:
    return root.removeprefix("file:") if "://" not in root else root


def _inside(path: str | None) -> bool:
    """Does a relative path stay below its root?"""
    return bool(path) and not path.startswith("/") and ".." not in path.split("/")


class _Files:
    """Files below a root on the executor: a local (mounted) folder or any file system that Arrow knows by its URI."""

    def __init__(self, root: str) -> None:
        self.local = "://" not in root
        if self.local:
            self.base = root
        else:
            from pyarrow import fs

            self.store, self.base = fs.FileSystem.from_uri(root)
            self.base = self.base.rstrip("/")

    def read(self, path: str) -> bytes | None:
        """The whole file, or None if there is none that can be read."""
        full = f"{self.base}/{path}"
        try:
            if self.local:
                with open(full, "rb") as file:
                    return file.read()
            with self.store.open_input_stream(full, compression=None) as file:
                return file.read()
        except OSError:
            return None

    def write(self, path: str, content: bytes, mtime_us: int | None, mode: int | None) -> None:
        """Written aside and moved into place, so a repeated task leaves whole files only."""
        full = f"{self.base}/{path}"
        folder, _, name = full.rpartition("/")
        aside = f"{folder}/.{name[:100]}.{uuid.uuid4().hex}"
        if not self.local:
            self.store.create_dir(folder, recursive=True)
            with self.store.open_output_stream(aside) as out:
                out.write(content)
            self.store.move(aside, full)
            return
        os.makedirs(folder, exist_ok=True)
        with open(aside, "wb") as out:
            out.write(content)
        if mode is not None:
            os.chmod(aside, mode)
        if mtime_us is not None:
            os.utime(aside, ns=(mtime_us * 1000, mtime_us * 1000))
        os.replace(aside, full)


@dataclass(frozen=True)
class TreeContent:
    """The files below ``root`` as the content of a run, by their relative paths.

    Only files of rows that need work are opened, by the task that has the row: nothing is joined or shuffled. A
    file that is gone or cannot be read, and a path that would leave the root, has no content.
    """

    root: str

    def load(self, work: DataFrame, tasks: int | None = None) -> DataFrame:
        """The work rows whose file is there, with its ``content``."""
        root, dealt = _plain(self.root), work if tasks is None else work.repartition(tasks, "rel_path")
        kept = [name for name in work.columns if name != "content"]
        schema = StructType([*(work.schema[name] for name in kept), StructField("content", BinaryType())])

        return dealt.select(*kept).mapInArrow(lambda batches: _read_batches(root, batches), schema)


def _read_batches(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose file is there with its content, at most ``BATCH_BYTES`` and one file at once."""
    files = _Files(root)

    def joined(batch: pa.RecordBatch, at: list[int], contents: list[bytes]) -> pa.RecordBatch:
        rows = batch.take(pa.array(at, pa.int64()))
        whole = pa.array(contents, pa.binary())
        contents.clear()  # not held beside their copy while the batch is sent
        return pa.RecordBatch.from_arrays([*rows.columns, whole], names=[*batch.schema.names, "content"])

    for batch in batches:
        at, contents, held = [], [], 0
        for n, path in enumerate(batch.column("rel_path").to_pylist()):
            content = files.read(path) if _inside(path) else None
            if content is not None:
                at.append(n)
                contents.append(content)
                held += len(content)
                del content
            if held >= BATCH_BYTES:
                yield joined(batch, at, contents)
                pa.default_memory_pool().release_unused()
                at, held = [], 0
        if at:
            yield joined(batch, at, contents)


def _bound_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of ``BATCH_BYTES``: Spark's own bounds are 10,000 rows and 64 MiB."""
    now = spark.conf.get(_SESSION_BYTES).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(_SESSION_BYTES, str(BATCH_BYTES))


def write_tree(df: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """Write ``df(rel_path, content[, mtime, mode])`` as files below ``root``; returns what was written.

    The result, ``rel_path`` and ``status`` (``ok`` or ``outside`` for a path that would leave the root), has to be
    read for the files to be written; reading it again writes them again. Times and modes are set in local (mounted)
    trees only. Of a path that is repeated any of its contents remains. The session then sends rows to Python
    workers in batches of ``BATCH_BYTES`` (one row at least), whatever the input; a lower bound of its own stays.
    """
    plain = _plain(root)
    columns = ["rel_path", F.col("content").cast("binary").alias("content")]
    columns.append((F.unix_micros("mtime") if "mtime" in df.columns else F.lit(None).cast("bigint")).alias("mtime_us"))
    columns.append((F.col("mode") if "mode" in df.columns else F.lit(None)).cast("int").alias("mode"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(plain)
        for batch in batches:
            paths, status = batch.column("rel_path").to_pylist(), []
            for n, path in enumerate(paths):
                row: Any = [batch.column(name)[n].as_py() for name in ("content", "mtime_us", "mode")]
                if _inside(path):
                    files.write(path, row[0] or b"", row[1], row[2])
                status.append("ok" if _inside(path) else "outside")
            del batch  # its content is not held while the next one is received
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(status)], names=["rel_path", "status"])

    _bound_batches(df.sparkSession)
    rows = df.select(*columns)
    rows = rows if tasks is None else rows.repartition(tasks, "rel_path")
    return rows.mapInArrow(write, "rel_path string, status string")
