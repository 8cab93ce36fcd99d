"""Directories with nothing below them, found by one sweep over paths in path order.

In path order everything below a directory follows it without a gap, so a directory is a range of paths. Ranges of
paths are dealt to tasks and swept one path at a time with the chain of open directories; what crosses the edge of a
task is that chain and the directories above the task's first kept path, a path's depth in rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import path_order

# ship the worker functions with the job, so executors need no installed copy of this package
register_pickle_by_value(sys.modules[__name__])

_SWEPT = pa.schema([("path", pa.string()), ("occupied", pa.bool_())])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, kept) in path order become (path, occupied) of directories that are empty here or may go on.

    The chain of open directories is all that is held; a closed one is given back at once if it was empty.
    """
    chain: list[list] = []  # [path, path + "/", occupied]
    first = None
    for batch in batches:
        empty = []
        for path, kept in zip(batch.column("path").to_pylist(), batch.column("kept").to_pylist()):
            while chain and not (path == chain[-1][0] or path.startswith(chain[-1][1])):
                _close(chain, empty)
            if not kept:
                if not chain or chain[-1][0] != path:
                    chain.append([path, path + "/", False])
                continue
            if first is None:
                first = path
                above = [path[:n] for n, c in enumerate(path) if c == "/"]
                yield _rows([*above, path], True)
            if chain:
                chain[-1][2] = True
        if empty:
            yield _rows(empty, False)
    # the chain may go on in the next task: it is empty as far as this one can tell
    empty = []
    while chain:
        _close(chain, empty)
    if empty:
        yield _rows(empty, False)


def _close(chain: list[list], empty: list[str]) -> None:
    path, _, occupied = chain.pop()
    if not occupied:
        empty.append(path)
    elif chain:
        chain[-1][2] = True


def _rows(paths: list[str], occupied: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": paths, "occupied": [occupied] * len(paths)}, schema=_SWEPT)


def unoccupied(dirs: DataFrame, kept: DataFrame) -> DataFrame:
    """The distinct ``path`` of ``dirs`` that are neither in ``kept`` nor above one of its paths.

    Shuffles the distinct paths of both, however deep they are, and the empty directories once more. NULL paths are
    left out; an empty path is a directory like any other.
    """
    rows = dirs.select("path", F.lit(False).alias("kept")).unionByName(kept.select("path", F.lit(True).alias("kept")))
    # distinct before the ranges are dealt: a path that repeats can't be split between tasks
    distinct = rows.filter("path is not null").distinct().withColumn("_order", path_order("path"))
    ordered = distinct.repartitionByRange("_order").sortWithinPartitions("_order", "kept").select("path", "kept")
    swept = ordered.mapInArrow(_sweep, "path string, occupied boolean")
    return swept.groupBy("path").agg(F.max("occupied").alias("occupied")).filter("not occupied").select("path")
