"""Byte-level BPE: exact encoding by a rank file, and decoding (operator 1).

Pre-tokenisation doesn't use regular expressions. Codepoints become classes, the classes drive a small
automaton whose states come from a scan of transition functions, and a table tells from the state where a
piece begins. The pieces are slices of the text; distinct ones are merged once and kept in a bounded cache.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import binary_views, gather_ragged, text_slices
from tidemark.llm.scan import TransitionScan

#: Pieces that one Python worker remembers; the cache starts anew beyond that.
CACHE_PIECES = 800_000
#: Longest piece merged by scanning all its pairs; longer ones use a heap.
SHORT_PIECE = 48

LETTER, NUMBER, OTHER, BLANK, SPACE, SHORT, LONG = range(7)  # SHORT, LONG: an apostrophe with 1 or 2 letters of a contraction
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_BLANK, AT_SPACE, ONE_LEFT, TWO_LEFT, ENDED = range(9)
#: Letters of contractions, as in the pattern of the public rank files.
SHORT_TAILS, LONG_TAILS = "stmd", ("re", "ve", "ll")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every codepoint."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, every):
            gap = 0x800 if run.start() >= 0xD800 else 0
            table[run.start() + gap : run.end() + gap] = kind
            if run.start() < 0xD800 < run.end():
                table[run.end() : run.end() + 0x800] = kind
    table[ord(" ")] = BLANK
    return table


@lru_cache(1)
def automaton() -> tuple[TransitionScan, np.ndarray]:
    """The scan, and where pieces begin: by state before and symbol 1 yes, 0 no, 2 only before the last space of a run."""
    states, symbols = 9, 7
    move = np.zeros((2 * symbols, states), np.uint8)
    to = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, BLANK: AT_BLANK, SPACE: AT_SPACE}
    for symbol in range(symbols):
        for state in range(states):
            if symbol in to:
                move[symbol, state] = to[symbol]
            else:  # a contraction begins only where a piece does
                inside = state in (IN_OTHERS, AT_BLANK)
                move[symbol, state] = IN_OTHERS if inside else ONE_LEFT if symbol == SHORT else TWO_LEFT
        if symbol == LETTER:
            move[symbol, TWO_LEFT], move[symbol, ONE_LEFT] = ONE_LEFT, ENDED
        move[symbols + symbol] = move[symbol, START]  # the first of a text forgets what came before
    begins = np.ones((states, symbols), np.uint8)
    begins[[IN_LETTERS, AT_BLANK, ONE_LEFT, TWO_LEFT], LETTER] = 0
    begins[[IN_NUMBERS, AT_BLANK], NUMBER] = 0
    for symbol in (OTHER, SHORT, LONG):
        begins[[IN_OTHERS, AT_BLANK], symbol] = 0
    for symbol in (BLANK, SPACE):
        begins[[AT_BLANK, AT_SPACE], symbol] = 2
    return TransitionScan(move), begins


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where pieces begin, for texts that begin at ``offsets`` of the UTF-8 bytes ``data``."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    byte_of = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(byte_of, offsets[:-1][np.diff(offsets) > 0])] = True
    first[n] = True
    symbols = classes()[points]
    follows = np.zeros(n, bool)  # the next codepoint is of the same text and no space
    follows[:-1] = ~first[1:n] & (symbols[1:] != BLANK) & (symbols[1:] != SPACE)
    ticks = np.flatnonzero(points == ord("'"))
    ticks = ticks[~first[ticks + 1]]
    short = ticks[np.isin(points[ticks + 1], [ord(c) for c in SHORT_TAILS])]
    ticks = ticks[~first[np.minimum(ticks + 2, n)]]
    pairs = points[ticks + 1].astype(np.uint64) << np.uint64(32) | points[ticks + 2]
    long = ticks[np.isin(pairs, np.array([ord(a) << 32 | ord(b) for a, b in LONG_TAILS], np.uint64))]
    symbols[short], symbols[long] = SHORT, LONG
    scan, begins = automaton()
    after = scan.states(symbols + np.uint8(7) * first[:n].astype(np.uint8))
    before = np.empty(n, np.uint8)
    before[0], before[1:] = START, after[:-1]
    what = begins.ravel().take(before.astype(np.uint16) * 7 + symbols)
    return byte_of[first[:n] | (what == 1) | ((what == 2) & follows)]


class ByteBpe:
    """Ids of a rank file's vocabulary for the bytes of texts, and back."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        by_rank = sorted(self.ranks.items(), key=lambda item: item[1])
        self.vocabulary = pa.array([piece for piece, _ in by_rank], pa.large_binary())
        self.decimals = pa.array([b" %d" % rank for _, rank in by_rank], pa.large_binary())
        self.place = np.zeros(by_rank[-1][1] + 1, np.int64)
        self.place[[rank for _, rank in by_rank]] = np.arange(len(by_rank))
        self.cache: dict[bytes, bytes] = {}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids begin."""
        starts = piece_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts, len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        known = [self._ids(piece) for piece in coded.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        codes = coded.indices.to_numpy()
        each = lengths[codes]
        ids = gather_ragged(np.frombuffer(b"".join(known), np.uint32), (np.cumsum(lengths) - lengths)[codes], each)
        total = np.concatenate([[0], np.cumsum(each)])
        return ids, total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of the ids, and where each id's bytes begin."""
        return binary_views(self.vocabulary.take(pa.array(self.place[ids])))

    def spelled(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The decimal numbers, each after a space."""
        return binary_views(self.decimals.take(pa.array(self.place[ids])))

    def _ids(self, piece: bytes) -> bytes:
        found = self.cache.get(piece)
        if found is None:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            rank = self.ranks.get(piece)
            ids = [rank] if rank is not None else self._merge(piece) if len(piece) <= SHORT_PIECE else self._merge_long(piece)
            found = array("I", ids).tobytes()
            if len(piece) <= 4 * SHORT_PIECE:
                self.cache[piece] = found
        return found

    def _merge(self, piece: bytes) -> list[int]:
        ranks, none = self.ranks, 1 << 40
        cuts = list(range(len(piece) + 1))
        pair = [ranks.get(piece[n : n + 2], none) for n in range(len(piece) - 1)]
        while pair:
            best = min(pair)
            if best == none:
                break
            n = pair.index(best)
            del cuts[n + 1], pair[n]
            if n < len(pair):
                pair[n] = ranks.get(piece[cuts[n] : cuts[n + 2]], none)
            if n:
                pair[n - 1] = ranks.get(piece[cuts[n - 1] : cuts[n + 1]], none)
        return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a linked list and a heap: n log n for a piece of any length."""
        ranks, n = self.ranks, len(piece)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n)), bytearray(b"\1") * n
        heap = [(ranks[p], i, i + 2) for i in range(n - 1) if (p := piece[i : i + 2]) in ranks]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            end = after[after[i]]
            rank = ranks.get(piece[i:end])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end))

        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue
            gone = after[i]
            alive[gone] = 0
            after[i] = end
            if end < n:
                before[end] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out


@lru_cache(2)
def coder(path: str) -> ByteBpe:
    return ByteBpe(path)


#: Columns that encode() can return, with their types.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "ends": "array<int>", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "ends")) -> DataFrame:
    """The ids of every whole text, in one pass without a shuffle.

    ``ids``; ``ends``, the byte offset at which each token's bytes end; ``ids_sha256`` of the decimal ids joined
    by spaces; ``decoded``, the bytes that the ids give back; ``decoded_sha256`` of them. A NULL or empty text
    has no ids. Other columns are left out, repeated rows stay, a NULL id is kept. Memory is bounded by a slice
    of texts (or the longest text) and the cache.
    """
    kinds = {id_col: df.schema[id_col].dataType.simpleString()} | {name: OUTPUTS[name] for name in outputs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for rows, data, offsets in text_slices(batches):
            ids, at = bpe.encode(data, offsets)
            out = {"n_tokens": lambda: pa.array(np.diff(at))}
            ranges = list(zip(at[:-1].tolist(), at[1:].tolist()))
            if "ids" in outputs:
                out["ids"] = lambda: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            if {"ends", "decoded", "decoded_sha256"} & set(outputs):
                back, ends = bpe.decode(ids)
                spans = [back[ends[a] : ends[b]] for a, b in ranges]
                begin = np.repeat(ends[at[:-1]], np.diff(at))
                out["ends"] = lambda: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((ends[1:] - begin).astype(np.int32)))
                out["decoded"] = lambda: pa.array([bytes(s) for s in spans], pa.binary())
                out["decoded_sha256"] = lambda: pa.array([hashlib.sha256(s).hexdigest() for s in spans], pa.string())
            if "ids_sha256" in outputs:
                text, place = bpe.spelled(ids)
                out["ids_sha256"] = lambda: pa.array([hashlib.sha256(text[min(place[a] + 1, place[b]) : place[b]]).hexdigest() for a, b in ranges], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column("id"), *(out[name]() for name in outputs)], names=list(kinds))

    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in kinds.items()))


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of every list of ids (``text``, bytes that aren't UTF-8 replaced); a NULL list gives NULL."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                texts.append(None if ids is None else bytes(bpe.decode(np.array(ids, np.int64))[0]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=[id_col, "text"])

    narrow = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, text string")
