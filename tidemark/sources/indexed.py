"""Content in key-sorted files, with an index that says which of them may hold a key."""

from __future__ import annotations

import json
import math
import sys
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.commits import CommitLog

register_pickle_by_value(sys.modules[__name__])

#: Content of one file, about, and rows at most: the keys of a file are indexed in one task
FILE_BYTES, FILE_ROWS = 128 << 20, 500_000
#: A Bloom filter has at least so many bits a key, and tests so many of them: about one wrong file in 100
BITS, PROBES = 10, 5
#: Above this share of the files all of them are read, which needs no list
MOST = 0.5


class RepeatedKeyError(ValueError):
    """Content with several rows of one path."""


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key in a filter of ``bits`` (a power of two): double hashing of one 64-bit hash."""
    values = hashes.astype(np.int64).view(np.uint64)
    step = (values >> np.uint64(32)) | np.uint64(1)
    return ((values[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _filter(hashes: np.ndarray) -> bytes:
    bits = max(64, 1 << math.ceil(math.log2(max(1, BITS * len(hashes)))))
    marks = np.zeros(bits, bool)
    marks[_places(hashes, bits)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def _passes(hashes: np.ndarray, raw: bytes) -> np.ndarray:
    filled = np.frombuffer(raw, np.uint8)
    at = _places(hashes, 8 * len(filled))
    return ((filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)


def _describe(key: tuple, rows: pa.Table) -> pa.Table:
    """One index row for a file: its key range, its rows, whether a key is repeated, and the filter of its keys."""
    paths = rows.column("rel_path").to_pylist()
    known = [path for path in paths if path is not None]
    hashes = rows.column("hash").to_numpy()
    out = {
        "file": [key[0].as_py()],
        "low": [min(known, key=str.encode, default=None)],
        "high": [max(known, key=str.encode, default=None)],
        "rows": [len(paths)],
        "repeated": [len(set(known)) < len(known)],
        "filter": [_filter(hashes)],
    }
    return pa.Table.from_pydict(out, schema=_INDEX_ARROW)


_INDEX = "file string, low string, high string, rows bigint, repeated boolean, filter binary"
_INDEX_ARROW = pa.schema(
    [("file", pa.string()), ("low", pa.string()), ("high", pa.string()), ("rows", pa.int64()), ("repeated", pa.bool_()), ("filter", pa.binary())]
)


class IndexedContent:
    """A content table ``(rel_path, content)`` that is read where it has to be.

    ``add`` writes a generation: rows sorted by path, in files of bounded size, and an index of a row for each
    file, with its key range and a Bloom filter of its keys. A run passes this object as its payload. A work list
    of bounded size is then turned into the list of files that may hold its keys, by the index alone, and no other
    file is opened. In a newer generation a path replaces that of an older one.
    """

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark = spark
        self.base = base.rstrip("/")
        self.log = CommitLog(spark, base)

    def _path(self, what: str, entry: dict) -> str:
        return f"{self.base}/{what}/version={entry['version']}/run={entry['run']}"

    def add(self, df: DataFrame, total_bytes: int | None = None, file_bytes: int = FILE_BYTES) -> int:
        """Write and publish ``df(rel_path, content)`` as the next generation; returns its number.

        ``total_bytes`` is the size of the content, if known; otherwise it is summed up first. Rows without a path
        belong to nothing and are left out. A path that is repeated within ``df`` is an error, and nothing is
        published then.
        """
        rows = df.select("rel_path", "content").where("rel_path is not null")
        if total_bytes is None:
            total_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
        entry = {"version": self.log.next_version(), "run": uuid.uuid4().hex}
        data, index = self._path("data", entry), self._path("index", entry)
        files = max(1, math.ceil(total_bytes / file_bytes))
        dealt = rows.repartitionByRange(files, "rel_path").sortWithinPartitions("rel_path")
        dealt.write.option("maxRecordsPerFile", FILE_ROWS).parquet(data)
        keys = self.spark.read.schema(rows.schema).parquet(data)
        keys = keys.select(F.col("_metadata.file_name").alias("file"), "rel_path", F.xxhash64("rel_path").alias("hash"))
        keys.groupBy("file").applyInArrow(_describe, _INDEX).write.parquet(index)
        found = self.spark.read.schema(_INDEX).parquet(index)
        # equal paths are in one range, so they are in one file or at the ends of two that follow each other
        shared = found.groupBy("low").agg(F.count("*").alias("n")).where("n > 1")
        crossing = found.select(F.col("high").alias("low"), F.col("file").alias("other")).join(found.select("low", "file"), "low").where("file <> other")
        if not (found.where("repeated").isEmpty() and shared.isEmpty() and crossing.isEmpty()):
            raise RepeatedKeyError("a path has more than one content")
        listed = found.agg(F.count("*")).first()[0]
        self.log.append(entry["version"], run=entry["run"], files=listed, schema=rows.schema.json())
        return entry["version"]

    def generations(self) -> list[dict]:
        return self.log.entries()

    @staticmethod
    def _schema(entry: dict) -> StructType:
        return StructType.fromJson(json.loads(entry["schema"]))

    def _rows(self, entry: dict, files: list[str] | None = None) -> DataFrame:
        data = self._path("data", entry)
        paths = [data] if files is None else [f"{data}/{name}" for name in files]
        read = self.spark.read.schema(self._schema(entry))
        rows = read.parquet(*paths) if paths else self.spark.createDataFrame([], self._schema(entry))
        return rows.withColumn("_generation", F.lit(entry["version"]))

    def files_for(self, work: DataFrame) -> list[tuple[dict, list[str]]]:
        """For each generation, the files that may hold a path of ``work``, whose paths have to fit on the driver."""
        listed = work.select("rel_path").where("rel_path is not null").distinct().withColumn("hash", F.xxhash64("rel_path")).toArrow()
        order = sorted(zip((p.encode() for p in listed.column("rel_path").to_pylist()), listed.column("hash").to_pylist()))
        told = self.spark.sparkContext.broadcast(([p for p, _ in order], np.array([h for _, h in order], np.int64)))

        def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            paths, hashes = told.value
            for batch in batches:
                names = []
                for file, low, high, raw in zip(*(batch.column(c).to_pylist() for c in ("file", "low", "high", "filter"))):
                    if low is not None:
                        a, b = bisect_left(paths, low.encode()), bisect_right(paths, high.encode())
                        if a < b and _passes(hashes[a:b], raw).any():
                            names.append(file)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

        out = []
        for entry in self.generations():
            index = self.spark.read.schema(_INDEX).parquet(self._path("index", entry))
            chosen = index.select("file", "low", "high", "filter").mapInArrow(candidates, "file string")
            out.append((entry, sorted(row.file for row in chosen.collect())))
        return out

    def frame(self) -> DataFrame:
        """All content: of each path that of the newest generation."""
        return self._newest([self._rows(entry) for entry in self.generations()])

    def narrowed(self, work: DataFrame) -> DataFrame:
        """The content of the files that may hold a path of ``work``; each path's newest, if it is one of ``work``."""
        parts = []
        for entry, files in self.files_for(work):
            if files:
                parts.append(self._rows(entry, None if len(files) > MOST * entry["files"] and len(files) > 32 else files))
        return self._newest(parts)

    def _newest(self, parts: list[DataFrame]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], "rel_path string, content binary")
        if len(parts) == 1:
            return parts[0].drop("_generation")
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        # only paths are compared; what they say is replaced is a list of paths, and content is not shuffled for a short one
        last = union.groupBy("rel_path").agg(F.max("_generation").alias("last"), F.count("*").alias("n")).where("n > 1")
        old = union.select("rel_path", "_generation").join(last, "rel_path").where("_generation < last")
        return union.join(old.select("rel_path", "_generation"), ["rel_path", "_generation"], "left_anti").drop("_generation")
