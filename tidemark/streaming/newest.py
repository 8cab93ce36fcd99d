"""The newest change of every path of a feed, kept as keyed state of the stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# ship the worker functions with the job, so executors need no installed copy of this package
register_pickle_by_value(sys.modules[__name__])

#: the state store that keyed state of this kind needs
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ORDER = ("_time", "_tie")


class Newest(StatefulProcessor):
    """Holds (time, tie) of the newest change of a path and passes on a change that is above it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "time long, tie long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        best = max(rows, key=lambda row: (row["_time"], row["_tie"]))
        order = (best["_time"], best["_tie"])
        known = self.newest.get()
        if known is None or order > tuple(known):
            self.newest.update(order)
            yield best

    def close(self) -> None:
        pass


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest row of each path within a batch, so that a path with very many changes is small when it is shuffled."""
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).sort_by([(name, "ascending") for name in ("rel_path", *_ORDER)])
        path = table.column("rel_path").combine_chunks()
        # a NULL path equals NULL paths only; where it is next to another the comparison is NULL as well
        last = pc.coalesce(pc.not_equal(path[:-1], path[1:]), pc.not_equal(pc.is_null(path[:-1]), pc.is_null(path[1:])))
        yield from table.filter(pa.concat_arrays([last, pa.array([True])])).to_batches()


def newest_changes(feed: DataFrame) -> DataFrame:
    """The changes of a streaming manifest that are newer than all changes of their path before them.

    Changes are ordered by time and, at the same time, by a hash of their other columns; a change without a time
    comes before all others. A batch yields one row per path at most, reads and writes the state of the paths it
    names and of no others, and repeats of a change yield nothing. So whatever the order and the batches in which
    changes arrive, the last row that a path yields is the same.
    """
    carried = [name for name in feed.columns if name not in ("rel_path", "mtime")]
    tie = F.xxhash64(*carried) if carried else F.lit(0).cast("bigint")
    # times travel as numbers: no time zone of a Python worker can shift them
    time = F.coalesce(F.unix_micros("mtime"), F.lit(-(1 << 63)).cast("bigint"))
    ordered = feed.select("rel_path", *carried, time.alias("_time"), tie.alias("_tie"))
    folded = ordered.mapInArrow(_fold, ordered.schema)
    newest = folded.groupBy("rel_path").transformWithState(Newest(), ordered.schema, "Update", "None")
    known = F.when(F.col("_time") != F.lit(-(1 << 63)).cast("bigint"), F.timestamp_micros("_time"))
    return newest.withColumn("mtime", known).select(feed.columns)
