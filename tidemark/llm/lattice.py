"""Likelihood of texts under all segmentations into subwords, and under word counts (operator 11).

The pieces of an existing vocabulary and the words of the learned texts are the arcs of a lattice over a word's
characters. The probability of a word is the sum over all its segmentations, found by a forward recursion in log
space; pieces don't cross white space.

Weights are learned. The arc of a whole word has the word's count less a discount (of absolute discounting). What
is discounted goes to pieces, which are weighted by expectation maximisation on the distinct learned words: from the
vocabulary's scores, ``ROUNDS`` rounds, each over all of them. A text is drawn from an urn that begins with ``URN``
words in proportion to their probabilities and to which each drawn word is returned twice; an end may follow each. With
fewer than ``LEAST`` distinct learned words, which say little about the vocabulary's tens of thousands of pieces, its
own weights are kept, and a text's probability is the product over its words and an end.

The recursion is linear in the values at the last few positions. So a very long word is cut into chunks that
run in lockstep from every unit vector, and the chunks' matrices are then applied in turn. How often pieces are
expected in it is found span by span from its end, with the values before each chunk kept.

Word counts come from the corpus and grow with it. Words in many documents are few, whatever the corpus: those
that more than one in ``HEAVY`` of all (document, word) pairs belong to. Their facts go to every task, and only
the other pairs are shuffled to meet the counts of their words, none of which is hot any more.
"""

from __future__ import annotations

import copy
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb

from tidemark.llm.common import scratch_table, small_batches, text_slices

MARK = "▁"
#: A piece of rank r (by its score) that is no log-probability weighs 1 / (r + SHIFT), after Zipf and Mandelbrot.
SHIFT = 2.7
#: Bytes of a word that is a key as it is; longer ones are keyed by their hash and are scored where they are read.
KEY_BYTES = 64
#: At most so many words are told to every task.
HEAVY = 1 << 16
#: Characters whose arcs are held at once, a chunk of a long word, and where a word counts as long.
SPAN, CHUNK, LONG = 1 << 15, 256, 512
END = ""
#: Spreads the keys of the trie over their hash table (2^64 over the golden ratio).
SPREAD = np.uint64(0x9E3779B97F4A7C15)
LN10 = float(np.log(10))
#: Occurrences that the vocabulary's own weights stand for beside the learned ones.
PRIOR = 256
#: Fewer distinct words than this aren't learned from; rounds over all of them; words in an urn.
LEAST, ROUNDS, URN = 256, 3, 1000.0
#: Without effect, for callers that set it: rounds were over a sample of about so many words.
SAMPLE = 1 << 16


class Lattice:
    """The pieces of a sentencepiece model as a trie with natural-log weights that add up to one with the end's."""

    def __init__(self, path: str):
        model = model_pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = model_pb.ModelProto.SentencePiece
        normal = [p for p in model.pieces if p.type == kinds.NORMAL]
        if model.trainer_spec.model_type == model_pb.TrainerSpec.UNIGRAM:
            weights = np.exp(np.array([p.score for p in normal], np.float64))
            rare, end = weights.min(), weights.max()
        else:  # scores are an order of the pieces
            order = np.argsort([-p.score for p in normal], kind="stable")
            rank = np.empty(len(normal))
            rank[order] = np.arange(len(normal))
            weights, rare, end = 1 / (rank + SHIFT), 1 / (len(normal) + SHIFT), 1 / SHIFT
        total = weights.sum() + 256 * rare + end
        self.byte, self.end = float(np.log(rare / total)), float(np.log(end / total))
        self.longest = max(len(p.piece) for p in normal)
        logs = np.log(weights / total)
        children: dict[int, int] = {}
        value = [-np.inf]
        for piece, weight in zip(normal, logs):
            node = 0
            for char in piece.piece:
                key = node << 21 | ord(char)
                node = children.get(key, 0)
                if not node:
                    node = children[key] = len(value)
                    value.append(-np.inf)
            value[node] = weight
        self.keys = np.array(sorted(children), np.int64)
        self.next = np.array([children[k] for k in self.keys.tolist()], np.int64)
        self.value = np.array(value)
        # a hash table of the keys: each is in the first free slot from its own on
        self.slot_bits = max(8, (4 * len(self.keys)).bit_length())
        self.slot_keys = np.full(1 << self.slot_bits, -1, np.int64)
        self.slot_next = np.zeros(1 << self.slot_bits, np.int64)
        keys, nodes, at = self.keys, self.next, self._slots(self.keys)
        while len(keys):
            free = self.slot_keys[at] < 0
            self.slot_keys[at[free]] = keys[free]
            here = self.slot_keys[at] == keys
            self.slot_next[at[here]] = nodes[here]
            keys, nodes, at = keys[~here], nodes[~here], (at[~here] + 1) % len(self.slot_keys)

    def weighted(self, counts: np.ndarray) -> Lattice:
        """The same pieces, weighted by how often they are expected, with ``PRIOR`` times the weights here added.

        ``counts`` has a place for each node, and for bytes that of the root. The end is told by no piece: the
        weights of pieces and bytes add up to one, and so do the probabilities of all words (at most).
        """
        other = copy.copy(self)
        with np.errstate(divide="ignore"):
            found = np.append(np.exp(self.value[1:]), 256 * np.exp(self.byte)) * PRIOR + np.append(counts[1:], counts[0])
            logs = np.log(found / found.sum())
        other.value, other.byte, other.end = np.append(-np.inf, logs[:-1]), float(logs[-1] - np.log(256)), -np.inf
        return other

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * SPREAD >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def _child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node after one more character; 0 where there is none."""
        key = node << 21 | char
        at = self._slots(key)
        met = self.slot_keys[at]
        out = np.where(met == key, self.slot_next[at], 0)
        left = np.flatnonzero((met != key) & (met >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) % len(self.slot_keys)
            met = self.slot_keys[at]
            here = met == key[left]
            out[left[here]] = self.slot_next[at[here]]
            on = ~here & (met >= 0)
            left, at = left[on], at[on]
        return out

    def arcs(self, points: np.ndarray, room: np.ndarray, place: np.ndarray | None = None, told: list | None = None, width: int = 0) -> np.ndarray:
        """[j, l - 1]: the weight of the piece of l characters that ends with character j, -inf where there is none.

        ``room`` is how many characters there are from each to its word's end. A character that is no piece is
        spelled in bytes. Character j is put in row ``place[j]``. ``told`` gets arcs (flat), their nodes and how often
        each counts: once, or the root as often as there are bytes. No piece is longer than ``width``, if that is given.
        """
        place = np.arange(len(points)) if place is None else place
        width = width or self.longest
        out = np.full((len(points), width), -np.inf)
        flat = out.reshape(-1)
        start = np.arange(len(points))
        node = np.zeros(len(points), np.int64)
        for length in range(1, width + 1):
            inside = room[start] >= length
            start, node = start[inside], node[inside]
            if not len(start):
                break
            node = self._child(node, points[start + length - 1])
            alive = node > 0
            start, node = start[alive], node[alive]
            weight, at = self.value[node], place[start + length - 1] * width + length - 1
            flat[at] = weight
            if told is not None:
                some = weight > -np.inf
                told.append((at[some], node[some], np.ones(int(some.sum()))))
        bare = np.flatnonzero(out[place, 0] == -np.inf)
        size = 1 + (points[bare] > 0x7F) + (points[bare] > 0x7FF) + (points[bare] > 0xFFFF)
        out[place[bare], 0] = size * self.byte
        if told is not None:
            told.append((place[bare] * width, np.zeros(len(bare), np.int64), size.astype(np.float64)))
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """The natural-log probability of each word, without what comes after it."""
        out = np.empty(len(words))
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        for n in np.flatnonzero(sizes > LONG).tolist():
            out[n] = self._long(words[n])
        for some in _batches(sizes):
            out[some] = self._short([words[n] for n in some.tolist()], sizes[some])
        return out

    def expected(self, words: list[str]) -> np.ndarray:
        """How often each node's piece occurs in the words' segmentations, by their probabilities; bytes at the root."""
        counts = np.zeros(len(self.value))
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        for n in np.flatnonzero(sizes > LONG).tolist():
            counts += self._long_expected(words[n])
        for some in _batches(sizes):
            counts += self._expected([words[n] for n in some.tolist()], sizes[some])
        return counts

    def _short(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """Words in descending length, one position of all of them at a time."""
        points, room = _spelled(words, sizes)
        place, steps = _by_position(sizes)
        forward = self._forward(self.arcs(points, room, place, width=min(self.longest, len(steps) - 1)), steps)
        return forward[np.arange(len(words)), forward.shape[1] - len(steps) + sizes]

    def _forward(self, arcs: np.ndarray, steps: np.ndarray, before: np.ndarray | None = None, shares: bool = False) -> np.ndarray:
        """[width - 1 + k]: of the first k characters of a word, or of a chunk with the values ``before`` it.

        ``arcs`` are by position. With ``shares`` they become the probability that each is the one that leads to its end.
        """
        width = arcs.shape[1]
        forward = np.full((steps[1], width + len(steps) - 1), -np.inf)
        if before is None:
            forward[:, width - 1] = 0.0
        else:
            forward[:, :width] = before[:, ::-1]
        for j, (low, high) in enumerate(zip(steps[:-1], steps[1:])):
            window = forward[: high - low, j : j + width][:, ::-1] + arcs[low:high]
            forward[: high - low, width + j] = total = _log_sum(window)
            if shares:
                np.exp(window - total[:, None], out=arcs[low:high])
        return forward

    def _expected(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """As ``_short``, then from the words' ends back."""
        points, room = _spelled(words, sizes)
        place, steps = _by_position(sizes)
        width = min(self.longest, len(steps) - 1)
        arcs = self.arcs(points, room, place, told := [], width)
        met = np.zeros_like(self._forward(arcs, steps, shares=True))
        # met[width - 1 + k]: the probability that a piece of the word ends with its first k characters
        met[np.arange(len(words)), width - 1 + sizes] = 1.0
        for j in range(len(steps) - 2, -1, -1):
            some, live = arcs[steps[j] : steps[j + 1]], steps[j + 1] - steps[j]
            some *= met[:live, width + j, None]
            met[:live, j : j + width] += some[:, ::-1]
        return self._counted(arcs, told)

    def _counted(self, arcs: np.ndarray, told: list) -> np.ndarray:
        """How often each node occurs, by the probabilities of arcs."""
        at, node, times = map(np.concatenate, zip(*told))
        return np.bincount(node, arcs.reshape(-1)[at] * times, len(self.value))

    def _long(self, word: str) -> float:
        return float(self._windows(_spelled_alone(word))[-1][0])

    def _windows(self, points: np.ndarray) -> list[np.ndarray]:
        """Forward values, the latest first, before each chunk of each span of a long word, and at its end."""
        window = np.full(self.longest, -np.inf)
        window[0] = 0.0
        windows = [window]
        for low in range(0, len(points), SPAN):
            arcs = self._span(points, low)
            chunks = len(arcs) // CHUNK
            if chunks:
                for step in self._matrices(arcs[: chunks * CHUNK].reshape(chunks, CHUNK, -1)):
                    window = _log_sum((window[:, None] + step).T)
                    windows.append(window)
            for arc in arcs[chunks * CHUNK :]:
                window = np.append(_log_sum((window + arc)[None])[0], window[:-1])
            if len(arcs) % CHUNK:
                windows.append(window)
        return windows

    def _span(self, points: np.ndarray, low: int, told: list | None = None) -> np.ndarray:
        """The arcs that end in a long word's span from ``low`` on; ``told`` as in ``arcs``."""
        begin = max(0, low - self.longest + 1)
        some = points[begin : low + SPAN]
        arcs = self.arcs(some, np.arange(len(some), 0, -1), told=told)[low - begin :]
        if told is not None:
            shift = (low - begin) * self.longest
            told[:] = [(at[at >= shift] - shift, node[at >= shift], times[at >= shift]) for at, node, times in told]
        return arcs

    def _long_expected(self, word: str) -> np.ndarray:
        """As ``_expected``, a span at a time from the last one back."""
        points = _spelled_alone(word)
        windows = self._windows(points)[:-1]
        counts = np.zeros(len(self.value))
        met = np.zeros(self.longest)  # of the span's last positions, by pieces that end beyond it
        met[-1] = 1.0
        for low in reversed(range(0, len(points), SPAN)):
            arcs = self._span(points, low, told := [])
            first = np.arange(0, len(arcs), CHUNK)
            place, steps = _by_position(np.minimum(first + CHUNK, len(arcs)) - first)
            windows, before = windows[: -len(first)], np.array(windows[-len(first) :])
            shares = np.empty_like(arcs)
            shares[place] = arcs
            self._forward(shares, steps, before, shares=True)
            arcs = shares[place]
            met = np.append(np.zeros(len(arcs)), met)
            for j in range(len(arcs) - 1, -1, -1):
                arcs[j] *= met[self.longest + j]
                met[j : j + self.longest] += arcs[j, ::-1]
            met = met[: self.longest]
            counts += self._counted(arcs, told)
        return counts

    def _matrices(self, arcs: np.ndarray) -> np.ndarray:
        """For each chunk [from, to]: the last values after it, from each unit vector of the last values before it."""
        size = self.longest
        state = np.full((len(arcs), size, size), -np.inf)
        state[:, np.arange(size), np.arange(size)] = 0.0
        for j in range(arcs.shape[1]):
            new = _log_sum(state + arcs[:, j][:, None, :])
            state = np.concatenate([new[:, :, None], state[:, :, :-1]], axis=2)
        return state


def _log_sum(values: np.ndarray) -> np.ndarray:
    """log of the sum of exp along the last axis."""
    most = values.max(-1)
    safe = np.where(most == -np.inf, 0.0, most)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(values - safe[..., None]).sum(-1)) + safe


def _spelled(words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of words behind their marks, and the characters left in each one's word."""
    points = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le"), "<u4").astype(np.int64)
    return points, np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))


def _by_position(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character goes if all first ones come first, then all second ones; and where each position begins.

    ``sizes`` descend.
    """
    live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0])), "right")  # longer than each position
    steps = np.append(0, np.cumsum(live))
    row = np.repeat(np.arange(len(sizes)), sizes)
    return steps[np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] + row, steps


def _spelled_alone(word: str) -> np.ndarray:
    return np.frombuffer((MARK + word).encode("utf-32-le"), "<u4").astype(np.int64)


def _batches(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Words that are not long, in descending length, about ``SPAN`` characters at once."""
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] <= LONG]
    at = 0
    while at < len(order):
        to = at + max(1, SPAN // int(sizes[order[at]]))
        yield order[at:to]
        at = to


@lru_cache(1)
def lattice_of(path: str) -> Lattice:
    return Lattice(path)


def held_out(id_col: str, folds: int = 10) -> Column:
    """Rows that nothing is learned from: the id's CRC-32 is divisible by ``folds``. A NULL id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, A-Z in lower case, and for every word its text and its place among them."""
    texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    some = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
    real = some[code] if len(code) else np.zeros(0, bool)
    return coded.dictionary, owner[real], code[real]


def _keys(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Keys of words, and which of them are long: their key is a space, which no word holds, and a hash."""
    lengthy = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) > KEY_BYTES)
    if len(lengthy):
        spelled = words.to_pylist()
        for n in lengthy.tolist():
            spelled[n] = " " + hashlib.sha256(spelled[n].encode()).hexdigest()
        words = pa.array(spelled, pa.large_string())
    return words, lengthy


def _pairs(owner: np.ndarray, code: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, times) of each word of each text, in the order of the texts."""
    pair, times = np.unique(owner.astype(np.int64) * max(many, 1) + code, return_counts=True)
    return pair // max(many, 1), pair % max(many, 1), times


def vocabulary(df: DataFrame, text_col: str, learned: Column) -> DataFrame:
    """(word, spelled, c, df): of each word its count in the learned rows and the rows it is in; a long one ``spelled``.

    Counts are combined within each slice of texts, then by a partial aggregate.
    """
    narrow = small_batches(df).select(F.col(text_col).cast("string").alias("text"), learned.alias("learned"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches):
            words, owner, code = words_of(data, offsets)
            keys, lengthy = _keys(words)
            text, word, times = _pairs(owner, code, len(words))
            learned = rows.column("learned").to_numpy(zero_copy_only=False).astype(bool)
            c = np.bincount(word, times * learned[text], len(words)).astype(np.int64)
            df = np.bincount(word, minlength=len(words))
            met = pa.array(np.flatnonzero(df))
            long = np.zeros(len(words), bool)
            long[lengthy] = True
            spelled = pc.if_else(pa.array(long), words, pa.scalar(None, words.type))
            columns = [keys.take(met).cast(pa.string()), spelled.take(met).cast(pa.string()), pa.array(c).take(met), pa.array(df).take(met)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "spelled", "c", "df"])

    counted = narrow.mapInArrow(count, "word string, spelled string, c long, df long")
    return counted.groupBy("word", "spelled").agg(F.sum("c").alias("c"), F.sum("df").alias("df"))


def learned_lattice(model: str, counts: np.ndarray | None) -> Lattice:
    return lattice_of(model) if counts is None else lattice_of(model).weighted(counts)


def learn_pieces(table: DataFrame, model: str, distinct: int) -> np.ndarray:
    """How often each piece is expected in the learned words of a ``vocabulary``, each taken once and whole.

    Every round is over all words, ``distinct`` of them. Tasks add up their words; what is sent to the driver has the
    vocabulary's size.
    """
    words = small_batches(table.where("c > 0").select(F.coalesce("spelled", "word").alias("word")))
    size = len(lattice_of(model).value)
    counts = None
    for _ in range(ROUNDS):
        told = table.sparkSession.sparkContext.broadcast(counts)

        def expect(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            lattice = learned_lattice(model, told.value)
            found = np.zeros(size + 1)  # the last one for the words
            for batch in batches:
                found[:size] += lattice.expected(batch.column("word").to_pylist())
                found[size] += batch.num_rows
            nodes = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(found[nodes])], names=["node", "n"])

        sums = words.mapInArrow(expect, "node long, n double").groupBy("node").agg(F.sum("n").alias("n")).toArrow()
        found = np.zeros(size + 1)
        found[sums.column("node").to_numpy()] = sums.column("n").to_numpy()
        counts, met = found[:size], int(found[size])
        if met != distinct:
            raise RuntimeError(f"pieces are learned from {met} of {distinct} words")
    return counts


def _log10_word(c: np.ndarray, spelled: np.ndarray, discount: float, n: int, spare: float) -> np.ndarray:
    """The log10 probability of words that occur ``c`` times and of their segmentations into pieces."""
    with np.errstate(divide="ignore"):
        whole = np.log10(np.maximum(c - discount, 0.0) / n)
    return np.logaddexp(whole * LN10, (spelled + np.log10(spare)) * LN10) / LN10


def score(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", learned: Column | None = None, add: float = 0.1) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``score``: the log10 probability of the text under all segmentations into learned words and the pieces of
    ``model``; ``base_score``: under single words with ``add`` added to their counts in the learned rows, an end
    included in either. A NULL or empty text is an end alone. Repeated rows are learned from and scored each for
    itself; other columns are left out. ``learned`` defaults to the rows that ``held_out`` doesn't name. An empty
    table gives no rows.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    learned = ~held_out(id_col) if learned is None else learned
    table = scratch_table(vocabulary(df, text_col, learned), "words")
    ends = df.agg(F.count("*").alias("rows"), F.count_if(learned).alias("learned")).first()
    sums = table.agg(
        F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum("df").alias("pairs"),
        F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"),
    ).first()
    total = (sums["n"] or 0) + ends["learned"]
    distinct = (sums["v"] or 0) + (ends["learned"] > 0)
    below = float(np.log10(total + add * (distinct + 1)))
    end = np.log10(ends["learned"] + add) - below

    fitted = (sums["v"] or 0) >= LEAST
    pieces = spark.sparkContext.broadcast(learn_pieces(table, model, sums["v"]) if fitted else None)
    if fitted:
        # every word that is met keeps a chance, also if no word or each occurs just once
        discount = min(max(sums["once"] / max(1, sums["once"] + 2 * sums["twice"]), 0.05), 0.95)
        spare = discount * sums["v"] / sums["n"]
        log10_end, log10_on = float(np.log10(ends["learned"] / total)), float(np.log10(sums["n"] / total))
    else:
        log10_end, log10_on = lattice_of(model).end / LN10, 0.0

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = learned_lattice(model, pieces.value)
        for batch in batches:
            words = batch.column("word").to_pylist()
            plain = np.array([not w.startswith(" ") for w in words], bool)
            log10 = np.zeros(len(words))
            log10[plain] = lattice.words([w for w in words if not w.startswith(" ")]) / LN10
            if fitted:
                log10 = _log10_word(batch.column("c").to_numpy(), log10, discount, sums["n"], spare)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(log10)], names=["word", "c", "log10"])

    def with_log10(words: DataFrame) -> DataFrame:
        """The log10 probability of each word; that of a long one follows from its spelling, where it is read."""
        return words.select("word", "c").mapInArrow(spell, "word string, c long, log10 double")

    # words of at least so many pairs: HEAVY of them at most
    often = max(2, -(-(sums["pairs"] or 0) // HEAVY))
    heavy = with_log10(table.where(F.col("df") >= often).where(~F.startswith("word", F.lit(" ")))).toArrow()
    told = spark.sparkContext.broadcast((pa.array(heavy.column("word").to_pylist(), pa.large_string()), heavy.column("c").to_numpy(), heavy.column("log10").to_numpy()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = learned_lattice(model, pieces.value)
        common, count, log10 = told.value
        count, log10 = np.append(count, 0), np.append(log10, 0.0)
        for rows, data, offsets in text_slices(batches):
            words, owner, code = words_of(data, offsets)
            keys, lengthy = _keys(words)
            text, word, times = _pairs(owner, code, len(words))
            many = len(offsets) - 1
            size = np.bincount(owner, minlength=many)
            place = pc.index_in(keys, value_set=common).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            own = np.full(len(words), np.nan)
            if len(lengthy):
                own[lengthy] = lattice.words(words.take(pa.array(lengthy)).to_pylist()) / LN10
            known = place[word] >= 0
            c = count[place[word]]
            if fitted:
                # of each of the pair's words, one after another
                pair = np.repeat(np.flatnonzero(known), times[known])
                before = np.arange(len(pair)) - np.repeat(np.cumsum(times[known]) - times[known], times[known])
                log10_first = log10[place[word[pair]]] + np.log10(URN)
                drawn = np.where(before == 0, log10_first, np.log10(10.0**log10_first + np.maximum(before, 1)))
                bits = np.bincount(text[pair], drawn, many) + size * log10_on
                bits -= (np.array([lgamma(URN + n) for n in size.tolist()]) - lgamma(URN)) / LN10
            else:
                bits = np.bincount(text, np.where(known, times * log10[place[word]], 0.0), many)
            rare = np.flatnonzero(~known)
            cuts = np.searchsorted(text[rare], np.arange(many + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays(
                [
                    keys.take(pa.array(word[rare])).cast(pa.string()),
                    pa.array(times[rare].astype(np.int64)),
                    pa.array(own[word[rare]], mask=np.isnan(own[word[rare]])),
                ],
                names=["word", "n", "own"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("id"),
                    rows.column("held_out"),
                    pa.array(size.astype(np.int64)),
                    pa.array(np.bincount(text, times * (known & (c > 0)), many).astype(np.int64)),
                    pa.array(np.bincount(text, np.where(known, times * np.log10(c + add), 0.0), many)),
                    pa.array(bits),
                    pa.ListArray.from_arrays(pa.array(cuts), pairs),
                ],
                names=["id", "held_out", "words", "known", "base", "bits", "rare"],
            )

    narrow = small_batches(df).select(F.col(id_col).alias("id"), (~learned).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, held_out boolean, words long, known long, base double, bits double, rare array<struct<word: string, n: long, own: double>>"
    docs = scratch_table(narrow.mapInArrow(read, schema).withColumn("row", F.monotonically_increasing_id()), "read")
    met = docs.select("row", F.explode("rare").alias("p")).select("row", "p.word", "p.n", "p.own").join(with_log10(table), "word")
    n, c = F.col("n"), F.col("c")
    if fitted:
        spelled = F.col("own") + F.lit(float(np.log10(spare)))
        seen = F.log10((c - F.lit(discount)) / F.lit(float(sums["n"])) + F.pow(F.lit(10.0), spelled))
        drawn = F.when(F.col("own").isNull(), F.col("log10")).when(c > 0, seen).otherwise(spelled)
        met = met.withColumn("log10", drawn + F.lit(float(np.log10(URN))))
        again = F.aggregate(F.sequence(F.lit(1).cast("long"), n - 1), F.lit(0.0), lambda sum, k: sum + F.log10(F.pow(F.lit(10.0), F.col("log10")) + k))
        met = met.withColumn("bits", F.when(n > 1, F.col("log10") + again).otherwise(F.col("log10")))
    else:
        met = met.withColumn("bits", n * F.coalesce("own", "log10"))
    met = met.groupBy("row").agg(
        F.sum(F.when(c > 0, n).otherwise(0)).alias("known2"),
        F.sum(n * F.log10(c + F.lit(add))).alias("base2"),
        F.sum("bits").alias("bits2"),
    )
    both = docs.drop("rare").join(met, "row", "left")

    def plus(a: str, b: str) -> Column:
        return F.col(a) + F.coalesce(F.col(b), F.lit(0).cast("double" if a != "known" else "long"))

    return both.select(
        F.col("id").alias(id_col),
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (plus("known", "known2") + (1 if ends["learned"] else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (plus("base", "base2") - F.col("words") * F.lit(below) + F.lit(float(end))).alias("base_score"),
        (plus("bits", "bits2") + F.lit(log10_end)).alias("score"),
    )
