"""Content, read only for the rows that need work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.indexed import IndexedContent
from tidemark.sources.trees import TreeContent

#: where content comes from: a table by path, an indexed one, or the files of a tree
Payload = DataFrame | IndexedContent | TreeContent

#: work lists whose keys take up to this many bytes are broadcast to the content scan
MAX_BROADCAST_KEY_BYTES = 16 << 20


def repeated_content(payload: Payload, work: DataFrame, key_bytes: int | None = None) -> DataFrame:
    """Paths of the work list with several rows of content. Only paths are read; indexed content and trees have none."""
    if not isinstance(payload, DataFrame):
        return work.select("rel_path").limit(0)
    keys = work.select("rel_path")
    if key_bytes is not None and key_bytes <= MAX_BROADCAST_KEY_BYTES:
        keys = F.broadcast(keys)
    met = payload.select("rel_path").join(keys, "rel_path", "left_semi")
    return met.groupBy("rel_path").agg(F.count("*").alias("n")).where("n > 1").select("rel_path")


def load_payload(payload: Payload, work: DataFrame, key_bytes: int | None = None, tasks: int | None = None) -> DataFrame:
    """Work rows with their ``content``; work without content (a source that is gone) gets no row.

    ``key_bytes`` is the measured size of the work list. A small list is broadcast, so the content is
    filtered where it is read and never shuffled. A longer one is joined by key. If ``tasks`` is given, it
    sets the number of partitions, and the work rows of a partition have to fit into memory: content is
    then looked up in them without being sorted. Content stored bucketed by ``rel_path`` stays in place
    when ``tasks`` is left out. Of indexed content, a small list opens only the files that may hold its paths.
    Files of a tree are opened by the tasks that have the work rows.
    """
    if isinstance(payload, TreeContent):
        return payload.load(work, tasks)
    if isinstance(payload, IndexedContent):
        few = key_bytes is not None and key_bytes <= MAX_BROADCAST_KEY_BYTES
        payload = payload.narrowed(work) if few else payload.frame()
    if key_bytes is not None and key_bytes <= MAX_BROADCAST_KEY_BYTES:
        work = F.broadcast(work)
    elif tasks is not None:
        work = work.repartition(tasks, "rel_path").hint("shuffle_hash")
    return work.join(payload.select("rel_path", "content"), "rel_path")
