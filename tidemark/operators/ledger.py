"""Outputs that commands have finished, recorded beside a run: what repeats a task takes them over."""

from __future__ import annotations

import hashlib
import sys
import time
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.cloudpickle import register_pickle_by_value

# ship the worker functions with the job, so executors need no installed copy of this package
register_pickle_by_value(sys.modules[__name__])

#: outputs that a task holds back at most before it writes them as one segment
SEGMENT_BYTES = 8 << 20


def digest(argv: list[str], source: str, target: str, content: bytes) -> bytes:
    """What a command's output depends on."""
    known = hashlib.sha256()
    for part in (*(word.encode("utf-8", errors="surrogatepass") for word in argv), source.encode(), target.encode(), content):
        known.update(len(part).to_bytes(8, "little"))
        known.update(part)
    return known.digest()


class Ledger:
    """The outputs recorded for one partition, as Parquet segments ``(item, rel_path, content)`` in a folder of its own.

    A segment is written aside and moved, so there are whole ones only; two attempts of a task write different
    ones. Segments are found by the number of the partition, and what they hold counts only for an item of the same
    digest: if rows are dealt differently, work is repeated, but never mixed up. Only keys are held in memory, and the
    outputs of the segment read last.
    """

    def __init__(self, root: str, partition: int, seconds: float) -> None:
        self.store, base = fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)
        self.folder, self.seconds = f"{base.rstrip('/')}/part-{partition:06d}", seconds
        self.known: dict[bytes, str] = {}
        self.read: tuple[str, dict[bytes, bytes]] = ("", {})
        self.pending: list[tuple[bytes, str, bytes]] = []
        self.held, self.since = 0, time.monotonic()
        for info in self.store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if info.path.endswith(".parquet"):
                self.known |= dict.fromkeys(self._columns(info.path, "item").get("item", ()), info.path)

    def _columns(self, path: str, *names: str) -> dict[str, list]:
        try:
            with self.store.open_input_file(path) as file:
                return pq.ParquetFile(file).read(columns=list(names)).to_pydict()
        except OSError:
            return {}  # another run has published and cleared up

    def get(self, item: bytes) -> bytes | None:
        """The output recorded for an item, if there is one."""
        path = self.known.get(item)
        if path is None:
            return None
        if self.read[0] != path:
            columns = self._columns(path, "item", "content")
            self.read = path, dict(zip(columns.get("item", ()), columns.get("content", ()), strict=True))
        return self.read[1].get(item)

    def add(self, item: bytes, rel_path: str, output: bytes) -> None:
        """Keep an output; it is written with others once they are many or old enough."""
        self.pending.append((item, rel_path, output))
        self.held += len(output)
        if self.held >= SEGMENT_BYTES or time.monotonic() - self.since >= self.seconds:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            columns = [pa.array(column, kind) for column, kind in zip(zip(*self.pending), (pa.binary(), pa.string(), pa.large_binary()), strict=True)]
            self.store.create_dir(self.folder, recursive=True)
            name = f"{self.folder}/{uuid.uuid4().hex}"
            with self.store.open_output_stream(f"{name}.part") as out:
                pq.write_table(pa.Table.from_arrays(columns, names=["item", "rel_path", "content"]), out)
            self.store.move(f"{name}.part", f"{name}.parquet")
        self.pending, self.held, self.since = [], 0, time.monotonic()
