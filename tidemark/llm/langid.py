"""Language of whole texts by interpolated Kneser-Ney models of characters, one for each language (operator 8).

A text becomes its letters in lower case with single spaces between words. Each language has a model of
``ORDER`` characters, fitted on labelled texts; the tables are arrays sorted by the hash of the characters, with
a column of probabilities for each language, so one search serves all models. The language with the lowest cross-entropy per
character wins. A second, disjoint part of the labelled texts calibrates the score and says how high a
cross-entropy of real texts gets; what lies far above that is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import LETTER, classes
from tidemark.llm.common import small_batches, text_slices

ORDER = 4
#: Labelled texts for each language that the models are fitted on, and that calibrate: an expected number, as
#: rows are taken by a hash of their id.
FIT_ROWS, CALIBRATION_ROWS = 3000, 1000
#: Bytes of text scored at once.
SCORED_BYTES = 1 << 20
#: Alphabet that the rest of a unigram model's probability is spread over.
ALPHABET = 1 << 12
#: Deviations above a language's usual cross-entropy from which a text is rejected.
REJECT_AT = 10.0
UNKNOWN = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _symbols() -> np.ndarray:
    """By codepoint: a 16-bit symbol of the lower-case letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint16)
    letters = np.flatnonzero(classes() == LETTER)
    lower = [ord(chr(c).lower()[0]) for c in letters.tolist()]
    table[letters] = [(c ^ (c >> 16) * 0x9E37) & 0xFFFF or 1 for c in lower]
    return table


def grams_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as numbers (16 bits a symbol), and where each text's begin; none without letters."""
    empty = np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if not len(data):
        return empty
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    symbols = _symbols()[points]
    letters = np.flatnonzero(symbols)
    if not len(letters):
        return empty
    first = np.searchsorted(lead[letters], offsets)  # the letters of text n: first[n] to first[n + 1]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    gap = np.ones(len(letters), bool)  # a space goes before this letter
    gap[1:] = (np.diff(letters) > 1) | (owner[1:] != owner[:-1])
    place = np.cumsum(gap) + np.arange(len(letters))
    total = int(place[-1]) + 1
    line = np.zeros(total + ORDER, np.uint64)
    line[place + ORDER - 1] = symbols[letters]
    # a text's symbols begin with the space before its first letter; what went before counts as spaces
    begins = np.where(first[:-1] < first[1:], place[np.minimum(first[:-1], len(place) - 1)] - 1, 0)
    starts = np.append(begins, total)
    starts[:-1][np.diff(first) == 0] = total
    starts = np.minimum.accumulate(starts[::-1])[::-1]
    since = np.arange(total) - np.repeat(starts[:-1], np.diff(starts))
    key = np.zeros(total, np.uint64)
    for back in range(ORDER - 1, -1, -1):
        part = line[ORDER - 1 - back : ORDER - 1 - back + total]
        key = key << np.uint64(16) | np.where(since >= back, part, 0)
    return key, starts


class SortedHash:
    """Distinct keys in the order of their hashes."""

    def __init__(self, keys: np.ndarray):
        hashes = keys * MIX  # one to one
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the sorted order, and whether each key is there."""
        hashes = keys * MIX
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(keys), bool)


@dataclass
class Models:
    """All languages' models, and the calibration."""

    languages: list[str]
    grams: list[SortedHash] = field(default_factory=list)  # by order, from 1
    logs: list[np.ndarray] = field(default_factory=list)  # log2 of the probability, a column for each language
    contexts: list[SortedHash] = field(default_factory=list)
    backoffs: list[np.ndarray] = field(default_factory=list)  # log2 of the weight of the next lower order
    unseen: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 0.05
    usual: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))
    short: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def bits(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log2 probability of each n-gram's last symbol in each language."""
        if order == 0:
            return np.broadcast_to(self.unseen, (len(keys), len(self.languages))).copy()
        at, there = self.grams[order - 1].find(keys)
        out = np.empty((len(keys), len(self.languages)))
        out[there] = self.logs[order - 1][at[there]]
        rest = keys[~there]
        if len(rest):
            lower = rest & np.uint64((1 << 16 * (order - 1)) - 1)
            value = self.bits(lower, order - 1)
            if order > 1:
                at, known = self.contexts[order - 1].find(rest >> np.uint64(16))
                value[known] += self.backoffs[order - 1][at[known]]
            out[~there] = value
        return out

    def entropies(self, keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text in each language, and the number of symbols."""
        sizes = np.diff(starts)
        out = np.zeros((len(sizes), len(self.languages)))
        some = np.flatnonzero(sizes)
        if len(some):
            codes, distinct = pd.factorize(keys)
            value = self.bits(distinct).astype(np.float32)
            for n in range(len(self.languages)):
                out[some, n] = np.add.reduceat(value[:, n][codes], starts[:-1][some], dtype=np.float64)
            out[some] /= -sizes[some, None]
        return out, sizes

    def decide(self, entropy: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, score and rejection of each text (a text without letters: rejected with score 0)."""
        best = entropy.argmin(1)
        lowest = entropy[np.arange(len(best)), best]
        score = 1 / np.exp(np.clip((lowest[:, None] - entropy) / self.temperature, -700, 0)).sum(1)
        deviation = np.sqrt(self.spread[best] ** 2 + self.short[best] ** 2 / np.maximum(sizes, 1))
        rejected = (sizes == 0) | (lowest > self.usual[best] + REJECT_AT * deviation)
        return best, np.where(sizes > 0, score, 0.0), rejected


def fit(counts: pd.DataFrame) -> Models:
    """The models from counts of n-grams of the full order: columns lang, gram (signed 64 bits), n."""
    models = Models(sorted(counts["lang"].unique()))
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for lang in models.languages:
        own = counts[counts["lang"] == lang]
        keys, n = own["gram"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy(np.float64)
        levels[ORDER - 1].append((keys, n))
        for order in range(ORDER - 1, 0, -1):  # lower orders count in how many ways a gram is preceded
            keys, kinds = np.unique(keys & np.uint64((1 << 16 * order) - 1), return_counts=True)
            levels[order - 1].append((keys, kinds.astype(np.float64)))
    below = None
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([keys for keys, _ in levels[order - 1]] or [np.zeros(0, np.uint64)]))
        context_of = union >> np.uint64(16)
        context, place = np.unique(context_of, return_inverse=True)
        table, weights = SortedHash(union), np.ones((len(context), len(models.languages)))
        chance = np.zeros((len(union), len(models.languages)))
        unseen = []
        for column, (keys, n) in enumerate(levels[order - 1]):
            at = np.searchsorted(union, keys)
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.95))
            total, kinds = np.zeros(len(context)), np.zeros(len(context))
            np.add.at(total, place[at], n)
            np.add.at(kinds, place[at], 1)
            seen = total > 0
            weights[seen, column] = discount * kinds[seen] / total[seen]
            chance[at, column] = (n - discount) / total[place[at]]
            lower = 1 / ALPHABET if order == 1 else below(union & np.uint64((1 << 16 * (order - 1)) - 1), column)
            chance[:, column] += weights[place, column] * lower
            if order == 1:
                unseen.append(weights[0, column] / ALPHABET if len(context) else 1 / ALPHABET)
        if order == 1:
            models.unseen = np.log2(np.array(unseen))
        models.grams.append(table)
        models.logs.append(np.log2(chance)[table.order])
        contexts = SortedHash(context)
        models.contexts.append(contexts)
        models.backoffs.append(np.log2(weights)[contexts.order])

        def below(keys: np.ndarray, column: int, union: np.ndarray = union, chance: np.ndarray = chance) -> np.ndarray:
            return chance[np.searchsorted(union, keys), column]

    return models


def calibrate(models: Models, seen: pd.DataFrame) -> None:
    """Sets score and rejection from texts of a part that wasn't fitted on: columns lang, size and entropies."""
    languages = len(models.languages)
    models.usual, models.spread, models.short = np.full(languages, 4.0), np.full(languages, 0.3), np.full(languages, 4.0)
    if not len(seen):
        return
    entropy = np.array(seen["entropies"].tolist()).reshape(len(seen), languages)
    truth = seen["lang"].map({lang: n for n, lang in enumerate(models.languages)}).to_numpy()
    sizes = seen["size"].to_numpy(np.float64)
    own = entropy[np.arange(len(truth)), truth]

    def surprise(temperature: float) -> float:
        scaled = -entropy / temperature
        top = scaled.max(1)
        return float((np.log(np.exp(scaled - top[:, None]).sum(1)) + top - scaled[np.arange(len(truth)), truth]).mean())

    models.temperature = min((0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8), key=surprise)
    for n in range(languages):
        mine = own[truth == n]
        if len(mine) >= 20:
            centre = np.median(mine)
            away = np.abs(mine - centre)
            models.usual[n] = centre
            # at least as wide as the calibration texts reach, but for one in a thousand
            models.spread[n] = max(1.4826 * float(np.median(away)), float(np.quantile(mine, 0.999) - centre) / 4, 0.25)
            models.short[n] = max(1.0, float(np.median(away * np.sqrt(sizes[truth == n]))))


def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models:
    """Models of the languages in lang_col, from rows that aren't held out and have text and language.

    Of them a part (crc32 leaves 0) is fitted on and the other calibrates, each up to an expected number of rows
    for each language. The driver gets the counts of distinct n-grams of those rows and their cross-entropies.
    """
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3
    usable = small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), fold.alias("fold")).where("fold <> 1 and text is not null and lang is not null")
    sizes = usable.groupBy("lang", "fold").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return Models([])
    ticket = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30))

    def sample(part: int, rows: int) -> DataFrame:
        picked = F.lit(False)
        for size in sizes:
            if size["fold"] == part:
                picked = picked | ((F.col("lang") == size["lang"]) & (ticket < int(min(1.0, rows / size["n"]) * (1 << 30))))
        return usable.where((F.col("fold") == part) & picked).select("text", "lang")

    if all(size["fold"] != 0 for size in sizes):  # so few rows that none is for fitting
        usable = usable.withColumn("fold", F.lit(0))
        sizes = [{"lang": s["lang"], "fold": 0, "n": s["n"]} for s in sizes]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, SCORED_BYTES):
            keys, starts = grams_of(data, offsets)
            lang, names = pd.factorize(rows.column("lang").to_numpy(zero_copy_only=False))
            owner = np.repeat(lang, np.diff(starts))
            for n, name in enumerate(names):
                grams, times = np.unique(keys[owner == n], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(times)], names=["lang", "gram", "n"])

    counted = sample(0, FIT_ROWS).mapInArrow(count, "lang string, gram long, n long")
    counts = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    if counts.empty:
        return Models([])
    models = fit(counts)
    known = set(models.languages)
    shared = df.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, SCORED_BYTES):
            entropy, size = shared.value.entropies(*grams_of(data, offsets))
            yield pa.RecordBatch.from_arrays([rows.column("lang"), pa.array(size), pa.array(list(entropy), pa.list_(pa.float64()))], names=["lang", "size", "entropies"])

    seen = sample(2, CALIBRATION_ROWS).mapInArrow(measure, "lang string, size long, entropies array<double>").where("size > 0")
    measured = seen.toArrow().to_pandas()
    shared.unpersist()
    calibrate(models, measured[measured["lang"].isin(known)])
    return models


def predict(df: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """All rows and columns with lang_pred, score (0 to 1) and rejected, from the whole text alone.

    ``lang_pred`` is ``und``, the score 0 and the row rejected if the text is NULL or has no letter, or nothing
    was learned. Columns of df that have these names, in any case, are replaced. Ties go to the language first by name.
    """
    if text_col.lower() in ("lang_pred", "score", "rejected"):
        raise ValueError(f"the text can't be in a column that is added: {text_col}")
    df = df.drop("lang_pred", "score", "rejected")
    shared = df.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows, data, offsets in text_slices(batches, SCORED_BYTES, text_col):
            keys, starts = grams_of(data, offsets)
            if own.languages:
                entropy, sizes = own.entropies(keys, starts)
                best, score, rejected = own.decide(entropy, sizes)
                names = [own.languages[b] if size else UNKNOWN for b, size in zip(best.tolist(), sizes.tolist())]
            else:
                names, score, rejected = [UNKNOWN] * len(rows), np.zeros(len(rows)), np.ones(len(rows), bool)
            out = [*rows.columns, pa.array(names, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(out, names=[*rows.schema.names, "lang_pred", "score", "rejected"])

    schema = df.selectExpr("*", "'' as lang_pred", "0d as score", "false as rejected").schema
    return small_batches(df).mapInArrow(run, schema)
