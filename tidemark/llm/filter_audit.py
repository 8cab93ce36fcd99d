"""How filters interact: what every order of them keeps, removes and costs, by a Gray-code walk (operator 12).

All an order of filters can do follows from how many documents fail each set of them: 2^n mask cells for n
filters. A walk through the subsets in Gray-code order toggles one filter at a time. Every cell counts its
active failures; when that counter leaves or reaches zero, the cell's documents leave or join the survivors.
The survivors of each subset are stored, and a step of any order is the difference of two of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import scratch_table

#: More filters would mean more than 40,320 orders for each part.
MAX_FILTERS = 8


def survivors_of(cells: np.ndarray) -> np.ndarray:
    """What is left under each subset of filters. cells: (parts, 2^n, measures), by the mask of failed filters."""
    size = cells.shape[1]
    out = np.empty_like(cells)
    masks = np.arange(size)
    failing = np.zeros(size, np.int64)
    running = cells.sum(1)
    out[:, 0] = running
    subset = 0
    for n in range(1, size):
        toggled = n & -n  # the bit in which the Gray codes of n - 1 and n differ
        subset ^= toggled
        touched = (masks & toggled) != 0
        if subset & toggled:
            gone = touched & (failing == 0)
            failing[touched] += 1
            running = running - cells[:, gone].sum(1)
        else:
            failing[touched] -= 1
            back = touched & (failing == 0)
            running = running + cells[:, back].sum(1)
        out[:, subset] = running
    return out


def steps_of(names: tuple[str, ...]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """For each step of each order: the order's name, the step from 1, the subset before it, and its filter."""
    orders, step, before, own = [], [], [], []
    for order in permutations(range(len(names))):
        active = 0
        for at, f in enumerate(order):
            orders.append("".join(names[n] for n in order))
            step.append(at + 1)
            before.append(active)
            own.append(f)
            active |= 1 << f
    return orders, np.array(step, np.int32), np.array(before), np.array(own)


def audit(df: DataFrame, failures: Mapping[str, str], part_col: str, measures: tuple[str, ...] = ()) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included.

    ``failures`` names a boolean column of df for each filter, true where a row fails it (NULL: it doesn't);
    ``measures`` are numeric 0/1 columns whose removed sum each step reports as ``<measure>_lost``. Columns:
    part, filter_order, step, kept, removed, redundant (fails, but was removed before), unique_fails (fails
    nothing else), ``<measure>_lost`` and shapley (removed by the filter at any step, over all orders). A NULL
    part is the empty string. Rows are combined to at most 2^n cells a part before they are shuffled, so a
    part may hold any share of all rows; repeated rows count each. An empty table gives no rows.
    """
    names = tuple(failures)
    if not 1 <= len(names) <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters, not {len(names)}")
    size, width = 1 << len(names), 1 + len(measures)
    bits = [F.coalesce(F.col(column), F.lit(False)).cast("int") * (1 << n) for n, column in enumerate(failures.values())]
    mask = sum(bits[1:], bits[0])
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    sums = [F.coalesce(F.sum(F.col(m).cast("long")), F.lit(0)).alias(f"m{n}") for n, m in enumerate(measures)]
    cells = df.groupBy(part.alias("part"), mask.alias("mask")).agg(F.count("*").alias("n"), *sums)
    # at most 2^n cells of a part in one row
    kept = F.collect_list(F.struct("mask", "n", *(f"m{n}" for n in range(len(measures)))))
    orders, step, before, own = steps_of(names)
    lost = [f"{m}_lost" for m in measures]
    # every order in which f comes right after the subset s: |s|! (n - 1 - |s|)!
    sizes = np.bitwise_count(np.arange(size)).astype(int).tolist()
    weight = np.array([factorial(s) * factorial(max(0, len(names) - 1 - s)) for s in sizes], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                some = batch.slice(low, 64)
                column = some.column("cells")
                flat = column.flatten()
                row = np.repeat(np.arange(some.num_rows), column.value_lengths().to_numpy())
                cell = np.zeros((some.num_rows, size, width), np.int64)
                fields = [flat.field(n).to_numpy() for n in range(1, 1 + width)]
                cell[row, flat.field(0).to_numpy()] = np.stack(fields, 1)
                left = survivors_of(cell)
                documents = left[:, :, 0]
                total, everything = documents[:, :1], size - 1
                # those who fail f are gone once f is the only one active
                fails = total - documents[:, 1 << np.arange(len(names))]
                alone = documents[:, everything ^ (1 << np.arange(len(names)))] - documents[:, [everything]]
                shapley = np.zeros_like(fails)
                for f in range(len(names)):
                    without = np.flatnonzero(np.arange(size) & (1 << f) == 0)
                    shapley[:, f] = ((documents[:, without] - documents[:, without | (1 << f)]) * weight[without]).sum(1)
                after = before | (1 << own)
                gone = left[:, before] - left[:, after]
                many = some.num_rows
                out = {
                    "part": some.column("part").take(pa.array(np.repeat(np.arange(many), len(step)))),
                    "filter_order": pa.array(orders * many),
                    "step": pa.array(np.tile(step, many)),
                    "kept": documents[:, after],
                    "removed": gone[:, :, 0],
                    "redundant": fails[:, own] - gone[:, :, 0],
                    "unique_fails": alone[:, own],
                    **{name: gone[:, :, n + 1] for n, name in enumerate(lost)},
                    "shapley": shapley[:, own],
                }
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v.ravel()) for k, v in out.items()})

    counts = ["kept", "removed", "redundant", "unique_fails", *lost, "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"`{c}` long" for c in counts)
    return cells.groupBy("part").agg(kept.alias("cells")).mapInArrow(run, schema)


def text_failures(text: Column) -> dict[str, Column]:
    """The four filters that look at one text: A few words, B few distinct ones, C capitals, D markup characters."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters over documents (doc_id, text, source), with labels (doc_id, quality, toxic).

    A to D: ``text_failures``; E: the same text as a row with a smaller doc_id, in whatever part. A NULL text is
    empty. A NULL doc_id is smaller than none and has no labels, so it passes E and makes nobody fail it. A
    document is good or toxic if any of its labels says so; repeated documents count each.

    Texts are read once, into a narrow table. Copies find the smallest id of their text by a partial aggregate,
    and meet it by id and text together, which no group of copies makes a hot key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    flags = text_failures(text)
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        *(flag.alias(name) for name, flag in flags.items()),
    )
    narrow = scratch_table(narrow, "failures")
    first = narrow.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))))
    rows = narrow.join(first.withColumn("first", F.lit(True)), ["doc_id", "digest"], "left").join(said, "doc_id", "left")
    rows = rows.withColumn("E", F.col("doc_id").isNotNull() & F.col("first").isNull())
    return audit(rows, {name: name for name in "ABCDE"}, "part", ("good", "toxic"))
