"""SimHash fingerprints of word shingles and groups of near fingerprints (operator 4).

Fingerprints within a few bits agree in some choice of blocks of their bits, so comparing those that share the
bits of one choice loses no pair. Comparison is bit-sliced: a batch keeps 64 vertical planes, one bit of every
fingerprint in each, and one step compares all fingerprints with those a fixed distance further on. Differing
bits are added by carry-save counters on whole words, and words in which every fingerprint is beyond the radius
are abandoned before all planes are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, scratch_table, small_batches, text_slices, whole_runs, with_pair_blocks

#: Fingerprints of one choice of bits that are compared in one task; larger groups are dealt as pairs of blocks.
GROUP = 2048
#: Planes added between two looks at what can be abandoned.
STRIDE = 8
#: Bytes of text whose shingles are hashed at once.
HASHED_BYTES = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, width: int, seed: int = 42) -> np.ndarray:
    """The unsigned fingerprints of texts that begin at ``offsets`` of ``data``."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(data):
        return out
    text = LOWER[data]
    white = WHITE[text]
    edge = np.zeros(len(text) + 1, bool)  # texts begin here
    edge[offsets] = True
    begins = np.flatnonzero(~white & (np.append(True, white[:-1]) | edge[:-1]))
    ends = np.flatnonzero(~white & (np.append(white[1:], True) | edge[1:])) + 1
    if not len(begins):
        return out
    # the words, one space after each: a shingle is a slice of this
    lengths = ends - begins
    place = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(place[-1], 32, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[place[1:] - 1] = False
    covered = np.zeros(len(text) + 1, np.int8)
    covered[begins] += 1
    covered[ends] -= 1
    joined[inside] = text[np.cumsum(covered[:-1], dtype=np.int8) > 0]
    first = np.searchsorted(begins, offsets)  # the words of text n: first[n] to first[n + 1]
    words = np.diff(first)
    shingles = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(len(words)), shingles)
    start = first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    stop = np.minimum(start + width, first[1:][owner])
    raw, hashed = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((hashed(raw[a:b], seed) for a, b in zip(place[start].tolist(), (place[stop] - 1).tolist())), np.uint64, len(start))
    some = np.flatnonzero(shingles)
    at = (np.cumsum(shingles) - shingles)[some]
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    most = 2 * counts > shingles[some][:, None]
    out[some] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, bits): the fingerprint of every whole text as a signed long. No words (NULL, empty, white space): 0."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, HASHED_BYTES):
            bits = fingerprints_of(data, offsets, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(bits)], names=[id_col, "bits"])

    narrow = small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, bits long")


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 rows: bit b of every value, 64 values in a word."""
    lanes = np.zeros(-(-len(values) // 64) * 64, "<u8")
    lanes[: len(values)] = values
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, by: int, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Which of the given lanes differ in at most ``radius`` bits from the lane ``by`` further on."""
    marks = np.zeros(planes.shape[1] * 64, bool)
    marks[lanes] = True
    valid = np.packbits(marks, bitorder="little").view("<u8")
    live = np.flatnonzero(valid)
    whole, part = divmod(by, 64)
    padded = planes.shape[1]
    digits = max(1, radius.bit_length())
    counters = np.zeros((digits, len(live)), np.uint64)
    over = np.zeros(len(live), np.uint64)
    for first in range(0, 64, STRIDE):
        near = planes[first : first + STRIDE, live]
        low, high = live + whole, live + whole + 1
        far = np.where(low < padded, planes[first : first + STRIDE].take(np.minimum(low, padded - 1), 1), 0) >> np.uint64(part)
        if part:
            far |= np.where(high < padded, planes[first : first + STRIDE].take(np.minimum(high, padded - 1), 1), 0) << np.uint64(64 - part)
        for carry in near ^ far:
            for digit in counters:
                digit[:], carry = digit ^ carry, digit & carry
            over |= carry
        if radius + 1 < 1 << digits:  # the counters may hold more than the radius
            over |= _more(counters, radius)
        alive = (valid[live] & ~over) != 0
        if not alive.all():
            live, counters, over = live[alive], counters[:, alive], over[alive]
            if not len(live):
                break
    found = np.zeros(padded, "<u8")
    found[live] = valid[live] & ~over
    return np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))


def _more(counters: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above radius, from the highest digit down."""
    above, equal = np.zeros(counters.shape[1], np.uint64), ~np.zeros(counters.shape[1], np.uint64)
    for n in range(len(counters) - 1, -1, -1):
        if radius >> n & 1:
            equal &= counters[n]
        else:
            above |= equal & counters[n]
            equal &= ~counters[n]
    return above


def links_of(values: np.ndarray, starts: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is near within each run: as pairs of positions, at most one less than the rows."""
    sizes = np.diff(np.append(starts, len(values)))
    order = np.argsort(-sizes, kind="stable")  # long runs first: their lanes fill whole words
    lane = np.repeat(starts[order], sizes[order]) + np.arange(len(values)) - np.repeat(np.cumsum(sizes[order]) - sizes[order], sizes[order])
    rest = np.repeat(sizes[order], sizes[order]) - (lane - np.repeat(starts[order], sizes[order]))  # rows from here to the run's end
    planes = planes_of(values[lane])
    root = np.arange(len(values))
    links = []

    def find(n: int) -> int:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for by in range(1, int(sizes.max(initial=0))):
        lanes = np.flatnonzero(rest > by)
        for a in within(planes, by, lanes, radius).tolist():
            x, y = find(a), find(a + by)
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((int(lane[a]), int(lane[a + by])))
    return links


def near_links(distinct: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(a, b): links between different fingerprints (column ``bits``) whose paths join all within ``radius`` bits.

    Of ``blocks`` blocks of bits, ``blocks - radius`` agree for any pair within the radius; one key for each
    choice of so many. A key with many fingerprints is dealt to tasks as pairs of blocks.
    """
    if blocks <= radius:
        raise ValueError("more blocks than differing bits are needed")
    edges = [round(64 * n / blocks) for n in range(blocks + 1)]
    masks = [sum(((1 << edges[n + 1]) - (1 << edges[n])) for n in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("bits", F.posexplode(F.array(*(F.col("bits").bitwiseAND(F.lit(m)) for m in signed))).alias("choice", "part"))
    keyed = keyed.select("bits", F.xxhash64("choice", "part").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    dealt = with_pair_blocks(keyed.join(sizes, "key"), "key", "bits", F.col("size"), GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, ["key", "bi", "bj"]):
            bits = table.column("bits").to_numpy()
            links = links_of(bits.view(np.uint64), starts, radius)
            if links:
                a, b = bits[np.array(links)].T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    ordered = dealt.select("key", "bi", "bj", "bits").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return ordered.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(id, fingerprint, component_id): 16 hex digits, and the smallest id that links lead to.

    Equal fingerprints are one node, however many rows have them. Texts without words have fingerprint 0 and
    link like any other. Repeated rows stay; NULL ids belong to the group of their fingerprint and never name
    one, unless there is no other. Other columns are left out.
    """
    marked = scratch_table(fingerprints(df, id_col, text_col, width), "fingerprints")
    nodes = scratch_table(marked.groupBy("bits").agg(F.min(id_col).alias("first")), "nodes")
    roots = scratch_table(components(near_links(nodes.select("bits"), radius)), "roots")
    named = nodes.join(roots.withColumnRenamed("id", "bits"), "bits")
    names = named.groupBy("root").agg(F.min("first").alias("component"))
    of_node = named.join(names, "root").select("bits", "component")
    of_all = nodes.join(of_node, "bits", "left").select("bits", F.coalesce("component", "first").alias("component_id"))
    # a table, so that both sides of the last join are plain and a hot fingerprint's rows can be split
    of_all = scratch_table(of_all, "named")
    printed = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return marked.join(of_all, "bits").select(id_col, printed.alias("fingerprint"), "component_id")
