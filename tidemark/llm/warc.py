"""WARC records in seekable Zstandard bundles (operator 10).

A bundle is a file of independent frames, each with whole records, and a footer of two skippable frames: an
index that maps record ids to frame, offset in the frame and length, and the seek table of the public seekable
format with the compressed and plain size of every frame. Any reader of Zstandard reads the records straight
through; one record takes the footer and one frame.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.token_files import files_apart, put_file

#: Plain bytes of a frame and of a bundle, reached before a new one begins (a longer record has its own frame).
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
LEVEL = 3
#: Payloads from this size on are written once and revisited.
REVISIT_BYTES = 1000
SKIPPABLE, SEEK_MAGIC, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, b"TMINDEX1"


def record_bytes(number: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; its length and digest are in the header."""
    content = b"" if revisit else payload
    target = "".join(c for c in url or "about:blank" if c.isprintable() and not c.isspace())
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if number is None else number}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(content)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


class Bundle:
    """Collects records into frames; ``close`` gives the parts of the file."""

    def __init__(self):
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[int | None, int, int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.plain = 0

    def add(self, number: int | None, record: bytes) -> None:
        if self.open and self.open_bytes + len(record) > FRAME_BYTES:
            self._end_frame()
        self.index.append((number, len(self.sizes), self.open_bytes, len(record)))
        self.open.append(record)
        self.open_bytes += len(record)
        self.plain += len(record)

    def _end_frame(self) -> None:
        packed = self.compressor.compress(b"".join(self.open))
        self.parts.append(packed)
        self.sizes.append((len(packed), self.open_bytes))
        self.open, self.open_bytes = [], 0

    def close(self) -> list[bytes]:
        if self.open:
            self._end_frame()
        index = INDEX_MAGIC + self.compressor.compress(json.dumps(self.index).encode())
        table = b"".join(struct.pack("<II", *size) for size in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC)
        return [*self.parts, *(struct.pack("<II", SKIPPABLE, len(part)) + part for part in (index, table))]


class BundleReader:
    """Reads records of one bundle by id, or frame after frame."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 9)
        frames, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError("not a seekable bundle")
        table = size - 9 - 8 * frames
        file.seek(table)
        self.sizes = list(struct.iter_unpack("<II", file.read(8 * frames)))
        self.at = [0]
        for packed, _ in self.sizes:
            self.at.append(self.at[-1] + packed)
        file.seek(self.at[-1])
        _, length = struct.unpack("<II", file.read(8))
        raw = file.read(length)
        if raw[:8] != INDEX_MAGIC:
            raise ValueError("no record index")
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(raw[8:]))

    def frame(self, n: int) -> bytes:
        self.file.seek(self.at[n])
        return zstandard.ZstdDecompressor().decompress(self.file.read(self.sizes[n][0]), max_output_size=self.sizes[n][1])

    def record(self, number: int) -> tuple[dict[str, str], bytes]:
        """The record of an id, from one frame."""
        _, frame, at, length = next(entry for entry in self.index if entry[0] == number)
        return parsed(self.frame(frame)[at : at + length])

    def records(self) -> Iterator[tuple[int | None, dict[str, str], bytes]]:
        held, plain = -1, b""
        for number, frame, at, length in self.index:
            if frame != held:
                held, plain = frame, self.frame(frame)
            yield number, *parsed(plain[at : at + length])


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def with_originals(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Adds digest, size and original: the id that a revisit refers to, else NULL.

    Digests alone are grouped (partial counts first) and only those of several pages are joined back, so a
    payload of very many pages is no hot group; their rows are split by adaptive execution.
    """
    digest = pages.withColumns({"_digest": F.sha1(F.coalesce(F.col(payload_col), F.lit(""))), "_size": F.coalesce(F.octet_length(payload_col), F.lit(0)).cast("long")})
    large = digest.where(F.col("_size") >= REVISIT_BYTES)
    groups = large.groupBy("_digest", "_size").agg(F.max(id_col).alias("_first"), F.count("*").alias("_n"))
    joined = digest.join(groups.where("_n > 1").drop("_n"), ["_digest", "_size"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col(id_col))
    return joined.withColumn("_original", F.when(revisit, F.col("_first"))).drop("_first")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes a record per row into bundles below path; the list of bundles is a table at path/manifest.

    Of rows with equal payloads of at least ``REVISIT_BYTES`` the largest id is the response and the others
    revisit it; repeated rows of that id are all responses, and a NULL id counts as smaller than any other
    (all NULL: all responses). A NULL payload is empty, a NULL url about:blank.
    """
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = with_originals(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload")), "id", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        bundle, number = Bundle(), 0

        def flush() -> pa.RecordBatch:
            name = f"pages-{part:06d}-{number:06d}.warc.zst"
            put_file(f"{path}/{name}", bundle.close())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(bundle.index)])], names=["name", "n_records"])

        for batch in batches:
            for n in range(batch.num_rows):
                page, url, payload, digest, original = (batch.column(c)[n].as_py() for c in ("id", "url", "payload", "_digest", "_original"))
                bundle.add(page, record_bytes(page, url, (payload or "").encode(), digest, original, original is not None, date))
                if bundle.plain >= BUNDLE_BYTES:
                    yield flush()
                    bundle, number = Bundle(), number + 1
        if bundle.index:
            yield flush()

    rows.mapInArrow(run, "name string, n_records long").write.parquet(f"{path}/manifest")


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of all bundles: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest and size of a response are computed from its payload; a revisit has them in its header.
    ``with_payload`` adds the payload of responses (NULL for revisits).
    """
    bundles = spark.read.parquet(f"{path}/manifest").select("name")
    listed = bundles.repartition(files_apart(bundles))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"][: int(with_payload)]]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def number(urn: str | None) -> int | None:
        return int(urn[10:-1]) if urn and len(urn) > 11 else None

    def rows_of(file) -> Iterator[tuple]:
        for _, fields, payload in BundleReader(file).records():
            kind = fields["WARC-Type"]
            if kind == "response":
                size, digest = len(payload), hashlib.sha1(payload).hexdigest()
            else:
                size, digest, payload = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), None
            yield number(fields["WARC-Record-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To")), payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = fs.FileSystem.from_uri(path)
        for name in (n for b in batches for n in b.column("name").to_pylist()):
            with store.open_input_file(f"{inner}/{name}") as file:
                held, size = [], 0
                for row in rows_of(file):
                    held.append(row[: len(names)])
                    size += len(row[5] or b"") * with_payload + 100
                    if size >= FRAME_BYTES:
                        yield _batch(held, names, kinds)
                        held, size = [], 0
                if held:
                    yield _batch(held, names, kinds)

    return listed.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)
