"""Packing documents into sequences of bounded length by best-two-fit (operator 3).

How well pieces fit depends on their lengths alone, and there are at most ``capacity`` lengths. So the plan is
made from a histogram: it says how many bins of which pattern of lengths to fill. Pieces then find their place
by their rank among the pieces of their length, which Spark computes in parallel.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import word_bpe
from tidemark.llm.common import parts_for, scratch_table, small_batches, text_slices

#: Bytes of text encoded at once: large, since each distinct chunk of it is looked up once.
ENCODE_BYTES = 4 << 20
#: Pieces of one length that are ranked together in one task.
RANKED = 200_000


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, times in a bin), ...] with the number of bins filled so. counts[n]: pieces of length n.

    A bin is filled greedily with the longest pieces that fit. Then, while it has a gap, its smallest piece
    gives way to the two unpacked pieces that fill the gap and its place best. The bin is repeated as often as
    the counts allow, so the work depends on the number of lengths and not on the number of pieces.
    """
    left = counts.astype(np.int64).copy()
    plan = []
    while left.any():
        items: list[int] = []
        free = capacity
        while free:
            fits = np.flatnonzero(left[: free + 1])
            if not len(fits):
                break
            items.append(int(fits[-1]))
            left[items[-1]] -= 1
            free -= items[-1]
        while free:
            smallest = min(items)
            pair = _best_pair(left, free + smallest)
            if pair is None or sum(pair) <= smallest:
                break
            items.remove(smallest)
            left[smallest] += 1
            for length in pair:
                items.append(length)
                left[length] -= 1
            free += smallest - sum(pair)
        pattern = sorted(Counter(items).items(), reverse=True)
        more = min(int(left[length]) // times for length, times in pattern)
        for length, times in pattern:
            left[length] -= more * times
        plan.append((pattern, 1 + more))
    return plan


def _best_pair(left: np.ndarray, gap: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum up to gap."""
    lengths = np.flatnonzero(left[:gap])
    if not len(lengths):
        return None
    partner = np.searchsorted(lengths, gap - lengths, "right") - 1
    alone = (partner >= 0) & (lengths[partner] == lengths) & (left[lengths] < 2)
    partner = partner - alone
    ok = partner >= 0
    if not ok.any():
        return None
    first, second = lengths[ok], lengths[partner[ok]]
    best = int(np.argmax(first + second))
    return int(first[best]), int(second[best])


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids and end_id, cut only where longer than capacity."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe.coder(tokenizer)
        for rows, data, offsets in text_slices(batches, ENCODE_BYTES):
            ids, at = bpe.encode(data, offsets)
            ids = np.insert(ids, at[1:], end_id).astype("<u4")
            at = at + np.arange(len(at))
            cuts = -(-np.diff(at) // capacity)
            row = np.repeat(np.arange(len(cuts)), cuts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(np.diff(at)[row] - start, capacity)
            begin = at[row] + start
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            out = [rows.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "piece", "start", "length", "ids_crc32"])

    narrow = small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds ``sequence_id`` (from 0) and ``offset`` to rows with a ``length`` of 1 to capacity.

    ``cut`` is read several times: pass a table. Rows of one length, however many, are ranked in buckets of a
    hash of ``order``; repeated rows get places of their own. To the driver goes the histogram, at most
    ``capacity`` rows; to the tasks the plan, at most a few rows for each length.
    """
    sizes = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in sizes.items():
        counts[length] = n
    slots, base, taken = [], 0, Counter()
    for pattern, bins in best_two_fit(counts, capacity):
        at = 0
        for length, times in pattern:
            slots.append((length, taken[length], times, base, at))
            taken[length] += times * bins
            at += times * length
        base += bins
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5)
    search = table[:, 0] << 48 | table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        slot = table[np.searchsorted(search, length << 48 | rank, "right") - 1]
        n = rank - slot[:, 1]
        return pd.DataFrame({"sequence_id": slot[:, 3] + n // slot[:, 2], "offset": slot[:, 4] + n % slot[:, 2] * length})

    buckets = parts_for(max(sizes.values(), default=0), RANKED, least=64)
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    per = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1)
    joined = ranked.join(per.select("length", "_bucket", before.alias("_before")), ["length", "_bucket"])
    placed = joined.withColumn("_at", place("length", F.col("_before") + F.col("_rank")))
    return placed.select(*cut.columns, "_at.sequence_id", "_at.offset")


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of each document with its place: (id, piece, start, length, ids_crc32, sequence_id, offset).

    A NULL or empty text is its end id alone. Repeated rows and repeated or NULL ids are packed each for itself.
    Other columns are left out. An empty table gives no rows.
    """
    cut = scratch_table(pieces(df, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    return pack(cut, capacity, (id_col, "piece"))
