"""Listing a file tree on the executors."""

from __future__ import annotations

import os
import stat
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.manifests import manifest_from
from tidemark.sources.scratch import scratch_dir

# ship the worker functions with the job, so executors need no installed copy of this package
register_pickle_by_value(sys.modules[__name__])

_LISTING_SCHEMA = "rel_path string, kind string, mtime_us bigint, size bigint, mode int, above string"
_LISTING_BATCH = 10_000
ITEMS_PER_TASK = 500
#: entries of one directory that the task which lists it looks at; it passes the others on by their names
LOOKED_AT = 20_000


def _list_items(root: str, follow: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is in each directory, and what each name passed on is; an unreadable directory fails the task."""
    for batch in batches:
        rows: list[tuple] = []
        for path, kind, above in zip(batch["rel_path"], batch["kind"], batch["above"]):
            found = _entries(root, path, above, follow) if kind == "dir" else [_looked_at(root, path, above, follow)]
            for row in found:
                if row is not None:
                    rows.append(row)
                if len(rows) == _LISTING_BATCH:
                    yield _listing(rows)
                    rows = []
        if rows:
            yield _listing(rows)


def _listing(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["rel_path", "kind", "mtime_us", "size", "mode", "above"])
    return frame.astype({"mode": "Int32"})


def _entries(root: str, directory: str, above: str, follow: bool) -> Iterator[tuple | None]:
    prefix = directory + "/" if directory else ""
    if "://" in root:
        from pyarrow import fs

        filesystem, base = fs.FileSystem.from_uri(root)
        for info in filesystem.get_file_info(fs.FileSelector(base.rstrip("/") + "/" + directory)):
            kind = "dir" if info.type == fs.FileType.Directory else "file"
            yield prefix + info.base_name, kind, (info.mtime_ns or 0) // 1000, info.size or 0, None, ""
        return
    folder = os.path.join(root, directory)
    own = os.stat(folder)
    # the device and inode of every directory on the way here: a link to one of them would go round in circles
    above = f"{above} {own.st_dev}:{own.st_ino}"
    with os.scandir(folder) as entries:
        for n, entry in enumerate(entries):
            if n < LOOKED_AT:
                yield _looked_at(root, prefix + entry.name, above, follow)
            else:
                yield prefix + entry.name, "name", 0, 0, None, above


def _looked_at(root: str, path: str, above: str, follow: bool) -> tuple | None:
    """One entry: a file, a directory, or a link that is not followed, which says why; None if it is gone."""
    full = os.path.join(root, path)
    try:
        found = os.lstat(full)
    except FileNotFoundError:
        return None
    kind = "dir" if stat.S_ISDIR(found.st_mode) else "file"
    if stat.S_ISLNK(found.st_mode):
        try:
            there = os.stat(full)
        except OSError:
            kind = "link to nothing"
        else:
            if stat.S_ISDIR(there.st_mode):
                circle = f"{there.st_dev}:{there.st_ino}" in above.split(" ")
                kind = "link to a directory above" if circle else "dir" if follow else "link to a directory"
            size = there.st_size
            # the time is the link's own: it changes when the link is changed
            return path, kind, found.st_mtime_ns // 1000, 0 if kind != "file" else size, there.st_mode & 0o7777, above
    return path, kind, found.st_mtime_ns // 1000, found.st_size, found.st_mode & 0o7777, above


@dataclass(frozen=True)
class Tree:
    """What is below a root: ``files`` (a manifest), ``dirs`` (path) and links not followed, ``skipped`` (path, reason)."""

    files: DataFrame
    dirs: DataFrame
    skipped: DataFrame


def list_tree(spark: SparkSession, root: str, scratch: str | None = None, follow_links: bool = True) -> Tree:
    """Everything below ``root``, listed by the executors.

    Directories are listed one level at a time, spread over the tasks; each level is a written table,
    so a lost executor costs one listing again. A directory with very many entries is read by one task, which
    looks at the first ``LOOKED_AT`` itself and passes the names of the others on to the tasks of the next
    round. Dot files and empty directories are included. A link to a file counts as that file with the link's
    own time. A link to a directory is followed, unless it leads back to a directory above it, to nothing, or
    ``follow_links`` is off: then it is a row of ``skipped``.
    """
    root = root.removeprefix("file:") if "://" not in root else root
    scratch = scratch or scratch_dir(spark, "listing")
    pending = spark.createDataFrame([("", "dir", "")], "rel_path string, kind string, above string")
    levels: list[DataFrame] = []
    while True:
        level_path = f"{scratch}/level={len(levels)}"
        listed = pending.mapInPandas(lambda batches: _list_items(root, follow_links, batches), _LISTING_SCHEMA)
        listed.write.parquet(level_path)
        level = spark.read.schema(_LISTING_SCHEMA).parquet(level_path)
        levels.append(level)
        pending = level.filter("kind in ('dir', 'name')").select("rel_path", "kind", "above")
        count = pending.count()
        if count == 0:
            break
        # a fixed number of tasks: the rows are tiny, the listings are not
        tasks = max(spark.sparkContext.defaultParallelism, count // ITEMS_PER_TASK)
        pending = pending.repartition(tasks, "rel_path")
    found = reduce(DataFrame.unionByName, levels)
    files = manifest_from(found.filter("kind = 'file'"), "rel_path", F.timestamp_micros("mtime_us"), "size", "mode")
    path = F.col("rel_path").alias("path")
    skipped = found.filter("kind like 'link %'").select(path, F.col("kind").alias("reason"))
    return Tree(files, found.filter("kind = 'dir'").select(path), skipped)


def scan_tree(spark: SparkSession, root: str, scratch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(manifest, dirs)`` of everything below ``root``; see ``list_tree``. ``dirs`` does not contain the root."""
    tree = list_tree(spark, root, scratch)
    return tree.files, tree.dirs
