"""Helpers of the operators in this folder: Arrow text slices, ragged arrays, scratch tables, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import scratch_dir

#: Bytes of text that one step of a task works on; bounds the arrays that grow with the text.
SLICE_BYTES = 2 << 20
#: Bytes of rows that a Python worker is sent at once.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Returns df; its session then sends whole texts to Python workers in batches of ``BATCH_BYTES`` (one row at least).

    Spark's own bounds are 10,000 rows and 64 MiB, of which the executor and each worker hold copies. A lower
    bound of the session stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, column: str = "text"):
    """Cuts batches into runs of rows with at most ``limit`` bytes of text (one row at least).

    Yields (rows, data, offsets): the UTF-8 bytes of all texts and where each begins. NULL counts as empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        buffer = whole.buffers()[2]
        data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to
        del whole, data, batch
        pa.default_memory_pool().release_unused()


def gather_ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of values[starts[i] : starts[i] + lengths[i]]."""
    total = int(lengths.sum(dtype=np.int64))
    kind = np.int32 if total < 1 << 31 and len(values) < 1 << 31 else np.int64
    before = np.cumsum(lengths, dtype=kind) - lengths.astype(kind)
    return values[np.repeat(starts.astype(kind) - before, lengths) + np.arange(total, dtype=kind)]


def binary_views(array: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Bytes and offsets of a large_binary array without nulls."""
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    buffer = array.buffers()[2]
    return memoryview(buffer) if buffer is not None else memoryview(b""), offsets


def scratch_table(df: DataFrame, label: str) -> DataFrame:
    """Writes df below ``spark.checkpoint.dir`` and reads it back: what follows doesn't depend on any executor."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_pair_blocks(rows: DataFrame, key: str, unit: str, size: Column, block: int) -> DataFrame:
    """Deals the rows of each key into pairs of blocks (bi <= bj), so that no task holds a large group.

    A key of up to ``block`` rows is one pair (0, 0). A larger one is cut into size / block parts by a hash of
    ``unit``, and a row goes to every pair with its part: any two rows of a key meet in some pair.
    """
    parts = F.ceil(size / block).cast("int")
    own = F.pmod(F.xxhash64(unit), parts).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")}).drop("other")


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Regroups a partition sorted by ``keys`` (integers): yields tables of whole groups with their first rows."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        starts = _starts(table, keys)
        if starts[-1]:
            yield table.slice(0, starts[-1]), starts[:-1]
        held = table.slice(starts[-1])
    if held is not None:
        yield held, np.zeros(1, np.int64)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        column = table.column(key).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(id, root) of every id in the edges (a, b): root is the smallest id that links lead to.

    Alternates the two star operations of the public large-star/small-star method until nothing changes. Each
    is one aggregate and one join; every round is a table in the shared folder. Any number of links of one id
    is combined before it is shuffled, and joins by a hot id are split by adaptive execution.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = scratch_table(pairs, label)
    seen = _mark(pairs)
    while seen[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(smallest, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .where("u <> v")
            .distinct()
        )
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(smallest, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        pairs = scratch_table(small, label)
        now = _mark(pairs)
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def _mark(pairs: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(pairs.agg(F.count("*"), F.sum(mixed)).first())


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_part))
