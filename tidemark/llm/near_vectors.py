"""Near-duplicate vectors by lattice hashing (operator 7).

In each table eight random projections of a vector are decoded to the nearest point of the lattice E8, whose
cells are close to round. A vector lives in its cell and visits the neighbouring cells that it is closest to;
pairs that meet in a cell are compared by their cosine. A pair is counted where it meets first, so what a task
gives back is a count and a link for each vector, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, scratch_table, whole_runs, with_pair_blocks
from tidemark.llm.vectors import by_length, cosines, matrix, usable

TABLES, PROBES, SCALE, SEED = 4, 6, 1.6, 20240
KEYS = 1 + PROBES  # of a table: the cell of a vector, then those that it visits
#: Rows of one cell that are compared in one task; larger cells are dealt as pairs of blocks.
CELL = 1024
#: Groups up to this size are compared all at once, row by row.
SMALL = 24


@lru_cache(1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            whole.append([a if k == i else b if k == j else 0.0 for k in range(8)])
    halves = [signs for signs in product((0.5, -0.5), repeat=8) if sum(s < 0 for s in signs) % 2 == 0]
    return np.array([*whole, *halves])


def nearest_point(points: np.ndarray) -> np.ndarray:
    """The nearest lattice point: E8 is the integers of even sum, and those moved by a half."""

    def even(x: np.ndarray) -> np.ndarray:
        rounded = np.rint(x)
        odd = np.flatnonzero(rounded.sum(1) % 2 != 0)
        off = x[odd] - rounded[odd]
        worst = np.abs(off).argmax(1)
        rounded[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        return rounded

    whole, half = even(points), even(points - 0.5) + 0.5
    closer = ((points - half) ** 2).sum(1) < ((points - whole) ** 2).sum(1)
    return np.where(closer[:, None], half, whole)


@lru_cache(8)
def projections(length: int) -> np.ndarray:
    return np.random.default_rng([SEED, length]).normal(size=(TABLES, length, 8)) / SCALE


def cells_of(unit: np.ndarray, group: np.ndarray) -> np.ndarray:
    """TABLES * KEYS hashes of (group, table, cell) for each vector."""
    out = np.empty((len(unit), TABLES, KEYS), np.uint64)
    around = shortest()
    for table, projection in enumerate(projections(unit.shape[1])):
        points = np.stack([(unit * column).sum(1) for column in projection.T], 1)
        own = nearest_point(points)
        # |p - (own + r)| is smallest where (p - own) r is largest, since all r are equally long
        best = np.argsort(-((points - own) @ around.T), axis=1, kind="stable")[:, :PROBES]
        for k in range(KEYS):
            cell = own if k == 0 else own + around[best[:, k - 1]]
            out[:, table, k] = _hash(group, table, np.rint(2 * cell).astype(np.int64))
    return out.reshape(len(unit), -1)


def _hash(group: np.ndarray, table: int, cell: np.ndarray) -> np.ndarray:
    mixed = group.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (table + 1) % (1 << 64))
    for column in cell.T:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of rows of cells (n, TABLES, KEYS): the first of the cells in which they meet, by table and hash."""
    none = np.uint64((1 << 64) - 1)
    first = np.full(len(a), none)
    for table in range(TABLES - 1, -1, -1):
        home_a, home_b = a[:, table, :1], b[:, table, :1]
        at_a = np.where((b[:, table] == home_a).any(1), home_a[:, 0], none)
        at_b = np.where((a[:, table] == home_b).any(1), home_b[:, 0], none)
        here = np.minimum(at_a, at_b)
        first = np.where(here != none, here, first)
    return first


def _pairs(starts: np.ndarray, total: int, unit: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within runs whose cosine reaches the threshold."""
    sizes = np.diff(np.append(starts, total))
    small = np.flatnonzero(sizes <= SMALL)
    rest = np.zeros(total, np.int64)
    for run in small:
        rest[starts[run] : starts[run] + sizes[run]] = np.arange(sizes[run] - 1, -1, -1)
    for by in range(1, int(sizes[small].max(initial=1))):
        a = np.flatnonzero(rest >= by)
        near = cosines(unit[a], unit[a + by]) >= threshold
        yield a[near], a[near] + by
    for run in np.flatnonzero(sizes > SMALL):
        own = unit[starts[run] : starts[run] + sizes[run]]
        for low in range(0, len(own), CELL):
            a, b = np.nonzero(own[low : low + CELL] @ own.T >= threshold - 1e-9)
            a += low
            a, b = a[a < b], b[a < b]
            near = cosines(own[a], own[b]) >= threshold
            yield starts[run] + a[near], starts[run] + b[near]


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for table, starts in whole_runs(batches, ["key", "bi", "bj"]):
        node, key, home, own, copies = (table.column(c).to_numpy() for c in ("node", "key", "home", "own", "copies"))
        split = table.column("bi").to_numpy() != table.column("bj").to_numpy()
        cells = table.column("cells").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, TABLES, KEYS)
        root, links = np.arange(table.num_rows), np.zeros(table.num_rows, np.int64)
        column = table.column("vec").combine_chunks()
        lengths = column.value_lengths().to_numpy()
        # a cell holds vectors of one length, as its hash includes it
        for length in np.unique(lengths[starts]):
            rows = np.flatnonzero(lengths == length)
            unit = matrix(column, rows)
            at = np.searchsorted(rows, starts[lengths[starts] == length])
            for a, b in _pairs(at, len(rows), unit, threshold):
                a, b = rows[a], rows[b]
                fits = (home[a] | home[b]) & (~split[a] | (own[a] != own[b]))
                a, b = a[fits], b[fits]
                fits = _meet(cells[a], cells[b]) == key[a].view(np.uint64)
                a, b = a[fits], b[fits]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                _join(root, a, b)
        found = np.flatnonzero(links)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(links[found]), pa.array(node[root[found]])], names=["node", "links", "root"])


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[i] and b[i]; every position points at its root afterwards."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links to rows of the same label with cosine >= threshold.

    Rows with equal label and vector are one node with a number of copies. Vectors that are NULL, zero or hold
    NULL or non-finite components, and rows with a NULL label, link with nothing; so do vectors of different
    lengths. Repeated rows stay and link with each other. A pair at the threshold is found with a probability of
    about 0.998, a closer one with more.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    ok = usable("vec") & F.col("label").isNotNull()
    # -0.0 and 0.0 are equal as group keys only after this
    valid = rows.where(ok).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0).cast(df.schema[vec_col].dataType.elementType)))
    nodes = valid.groupBy("label", "vec").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    nodes = nodes.withColumns({"node": F.monotonically_increasing_id(), "grp": F.xxhash64("label", F.size("vec"))})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.empty((batch.num_rows, TABLES * KEYS), np.uint64)
            group = batch.column("grp").to_numpy().view(np.uint64)
            for _, at in by_length(batch.column("vec")):
                cells[at] = cells_of(matrix(batch.column("vec"), at), group[at])
            offsets = pa.array(np.arange(0, cells.size + 1, TABLES * KEYS), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(cells.view(np.int64).ravel()))], names=[*batch.schema.names, "cells"])

    schema = nodes.withColumn("cells", F.array(F.lit(0).cast("long"))).schema
    nodes = scratch_table(nodes.mapInArrow(index, schema), "vectors")

    entries = nodes.select("node", F.posexplode("cells").alias("n", "key")).select("node", "key", (F.col("n") % KEYS == 0).alias("home"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("size"), F.count_if("home").alias("homes")).where("homes > 0 and size > 1")
    live = with_pair_blocks(entries.join(sizes.select("key", "size"), "key"), "key", "node", F.col("size"), CELL)
    placed = live.select("key", "bi", "bj", "own", "home", "node").join(nodes.select("node", "vec", "copies", "cells"), "node")
    ordered = placed.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    found = scratch_table(ordered.mapInArrow(lambda batches: _compare(batches, threshold), "node long, links long, root long"), "links")

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = named.join(smallest, "root").join(counts, "node", "left")
    facts = facts.select("label", "vec", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = valid.join(facts, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
