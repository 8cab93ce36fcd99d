"""Token ids in files of directly addressable codes (operator 6).

An id is split into chunks of fixed widths, one level each. A level holds the chunks of the ids that reach it,
a bitmap saying which of them go on, and a directory of the ones before every block of the bitmap. The place
of an id in the next level is the rank of its bit, so any id is read from a few addresses, without decoding
what stands before it.

A shard is: magic, length of the header, header (JSON: sections with type and count), sections. Its document
index holds ids and starts. Shards follow each other in the order of document ids.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import word_bpe
from tidemark.llm.common import binary_views, small_batches, text_slices
from tidemark.llm.packing import ENCODE_BYTES

MAGIC = b"TMDAC001"
WIDTHS = (8, 8, 16)
KINDS = {8: np.dtype("<u1"), 16: np.dtype("<u2")}
#: Words of 64 bits that one entry of a rank directory covers.
BLOCK = 8
#: Ids of one shard (more only if a single document has more).
SHARD_TOKENS = 4 << 20
#: Ids that a reader takes at once.
READ_TOKENS = 1 << 20


class Codes:
    """Ids as levels of chunks; ``get`` reads any of them."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def build(cls, ids: np.ndarray) -> Codes:
        levels, rest = [], ids.astype(np.uint32)
        for width in WIDTHS:
            chunks = (rest & np.uint32((1 << width) - 1)).astype(KINDS[width])
            rest = rest >> np.uint32(width)
            more = rest != 0
            bits = np.packbits(more, bitorder="little")
            words = np.zeros(-(-len(more) // (64 * BLOCK)) * BLOCK, "<u8")
            words.view(np.uint8)[: len(bits)] = bits
            ones = np.bitwise_count(words).reshape(-1, BLOCK).sum(1, dtype=np.uint64)
            levels.append((chunks, words, (np.cumsum(ones) - ones).astype("<u8")))
            rest = rest[more]
            if not len(rest):
                break
        return cls(levels)

    def get(self, positions: np.ndarray) -> np.ndarray:
        out = np.zeros(len(positions), np.uint32)
        which, at, shift = slice(None), positions.astype(np.int64), 0
        for (chunks, words, directory), width in zip(self.levels, WIDTHS):
            out[which] |= chunks[at].astype(np.uint32) << np.uint32(shift)
            go = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
            which = np.flatnonzero(go) if isinstance(which, slice) else which[go]
            at, shift = self._rank(words, directory, at[go]), shift + width
        return out

    def run(self, start: int, stop: int) -> np.ndarray:
        """The ids of positions that follow each other: a slice of each level, which begins at a rank."""
        out = np.zeros(stop - start, np.uint32)
        which, shift = slice(None), 0
        for (chunks, words, directory), width in zip(self.levels, WIDTHS):
            out[which] |= chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            bits = np.unpackbits(words.view(np.uint8)[start >> 3 : (stop + 7) >> 3], bitorder="little")
            go = np.flatnonzero(bits[start & 7 :][: stop - start])
            if not len(go):
                break
            which = go if isinstance(which, slice) else which[go]
            start = int(self._rank(words, directory, np.array([start]))[0])
            stop, shift = start + len(go), shift + width
        return out

    @staticmethod
    def _rank(words: np.ndarray, directory: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The set bits before each position."""
        word = at >> 6
        first = word // BLOCK * BLOCK
        rank = directory[word // BLOCK].astype(np.int64)
        for n in range(BLOCK - 1):
            inside = first + n < word
            rank += np.where(inside, np.bitwise_count(words[np.minimum(first + n, word)]), 0)
        below = words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return rank + np.bitwise_count(below)


def shard_bytes(doc_ids: np.ndarray, known: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    sections = {"doc_id": doc_ids.astype("<i8"), "known": known.astype("<u1"), "start": starts.astype("<i8")}
    for n, level in enumerate(Codes.build(ids).levels):
        sections |= {f"{what}{n}": part for what, part in zip(("chunks", "bits", "ranks"), level)}
    header = json.dumps([[name, part.dtype.str, len(part)] for name, part in sections.items()]).encode()
    return [MAGIC, len(header).to_bytes(8, "little"), header, *(part.tobytes() for part in sections.values())]


class Shard:
    """One shard: ``doc_ids`` (None where NULL), ``starts`` and the ids of any document."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        at = 16 + int.from_bytes(raw[8:16], "little")
        parts = {}
        for name, kind, count in json.loads(raw[16:at]):
            parts[name] = np.frombuffer(raw, np.dtype(kind), count, at)
            at += parts[name].nbytes
        self.doc_ids, self.known, self.starts = parts["doc_id"], parts["known"], parts["start"]
        levels = sum(name.startswith("chunks") for name in parts)
        self.codes = Codes([tuple(parts[f"{what}{n}"] for what in ("chunks", "bits", "ranks")) for n in range(levels)])

    def ids(self, document: int) -> np.ndarray:
        return self.codes.run(int(self.starts[document]), int(self.starts[document + 1]))


def put_file(path: str, parts: list[bytes]) -> None:
    """Writes aside and moves into place, so a lost or repeated task leaves no half file."""
    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    aside = f"{inner}.{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as out:
        for part in parts:
            out.write(part)
    store.move(aside, inner)


def files_apart(manifest: DataFrame) -> int:
    """Tasks that read the files of a manifest: one each, up to some thousands. Given as a number, as adaptive
    execution would put the few bytes of their names into one task."""
    return max(1, min(manifest.count(), 8192))


def range_bounds(df: DataFrame, column: str, parts: int) -> np.ndarray:
    """Up to parts - 1 values that deal the rows out evenly by a long column, from a sketch of that column alone."""
    shares = [n / parts for n in range(1, parts)]
    if not shares:
        return np.zeros(0, np.int64)
    found = df.agg(F.percentile_approx(column, shares, max(10_000, 10 * parts)).alias("bounds")).first()["bounds"]
    return np.array(found or [], np.int64)


def write_tokens(df: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> None:
    """Encodes every whole text and writes shards below path, in ascending order of the document id.

    NULL ids come first; rows with equal ids are ordered by a hash of their text. A NULL or empty text has the
    end id alone. Texts are encoded where they are read, and the ids, which take less room, are shuffled once to
    ranges of document ids; a task cuts its range into shards of bounded size. The list of shards is a table at
    path/manifest, written by the same job.
    """
    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(narrow, "id", parts)
    kind = np.dtype("<u2") if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id or 0) <= 1 << 16 else np.dtype("<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe.coder(tokenizer)
        for rows, data, offsets in text_slices(batches, ENCODE_BYTES):
            ids, at = bpe.encode(data, offsets)
            if end_id is not None:
                ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
            column = rows.column("id")
            # equal ids meet in one range; what is before all bounds, NULL too, in the first
            part = np.searchsorted(bounds, column.fill_null(np.iinfo(np.int64).min).to_numpy(), "left")
            raw = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * kind.itemsize), pa.py_buffer(ids.astype(kind))])
            yield pa.RecordBatch.from_arrays([column, rows.column("tie"), pa.array(part, pa.int32()), raw.cast(pa.binary())], names=["id", "tie", "part", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        count = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal count, number
            lengths = np.concatenate([h[2] for h in held])
            starts = np.concatenate([[0], np.cumsum(lengths)])
            name = f"shard-{part:06d}-{number:06d}.dac"
            put_file(f"{path}/{name}", shard_bytes(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), starts, np.concatenate([h[3] for h in held])))
            row = [name, part, number, len(lengths), int(starts[-1])]
            held.clear()
            count, number = 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["name", "part", "number", "n_docs", "n_tokens"])

        for batch in batches:
            if not batch.num_rows:
                continue
            column, (view, offsets) = batch.column("id"), binary_views(batch.column("ids").cast(pa.large_binary()))
            offsets = offsets // kind.itemsize
            ids = np.frombuffer(view, kind)[offsets[0] : offsets[-1]] if len(view) else np.zeros(0, kind)
            held.append((column.fill_null(0).to_numpy(), ~column.is_null().to_numpy(zero_copy_only=False), np.diff(offsets), ids.copy()))
            count += len(ids)
            if count >= SHARD_TOKENS:
                yield flush()
        if held:
            yield flush()

    coded = small_batches(narrow).mapInArrow(encode, "id long, tie long, part int, ids binary")
    ordered = coded.repartitionById(parts, "part").sortWithinPartitions("id", "tie").select("id", "ids")
    ordered.mapInArrow(write, "name string, part long, number long, n_docs long, n_tokens long").write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """One row per document from the shards: doc_id, start (ids before it in all shards), n_tokens and outputs.

    Outputs: ``ids`` and ``ids_crc32`` (of the ids as little-endian unsigned 32-bit numbers).
    """
    shards = spark.read.parquet(f"{path}/manifest")
    # one row for each range, then the shards of a range
    ranges = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ranges = ranges.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("n_tokens")
    listed = shards.withColumn("inside", inside).join(ranges, "part").select("name", (F.col("before") + F.col("inside")).alias("base"))
    listed = listed.repartition(files_apart(shards))
    kinds = {"ids": "array<long>", "ids_crc32": "long"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = fs.FileSystem.from_uri(path)
        for name, before in (row for b in batches for row in zip(b.column("name").to_pylist(), b.column("base").to_pylist())):
            with store.open_input_file(f"{inner}/{name}") as file:
                shard = Shard(file.read())
            at = 0
            while at < len(shard.doc_ids):
                to = max(at + 1, int(np.searchsorted(shard.starts, shard.starts[at] + READ_TOKENS, "right")) - 1)
                starts = shard.starts[at : to + 1]
                ids = shard.codes.run(int(starts[0]), int(starts[-1])).astype("<u4")
                out = [pa.array(shard.doc_ids[at:to], mask=shard.known[at:to] == 0), pa.array(starts[:-1] + before), pa.array(np.diff(starts))]
                if "ids" in outputs:
                    out.append(pa.ListArray.from_arrays(pa.array(starts - starts[0], pa.int32()), pa.array(ids.astype(np.int64))))
                if "ids_crc32" in outputs:
                    view, cut = memoryview(ids.tobytes()), (4 * (starts - starts[0])).tolist()
                    out.append(pa.array([zlib.crc32(view[a:b]) for a, b in zip(cut, cut[1:])], pa.int64()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", *(name for name in kinds if name in outputs)])
                at = to

    return listed.mapInArrow(run, ", ".join(["doc_id long, start long, n_tokens long", *(f"{name} {kinds[name]}" for name in kinds if name in outputs)]))
