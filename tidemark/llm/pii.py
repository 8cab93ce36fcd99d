"""Personal data in whole texts (operator 2): patterns propose spans, checksums confirm, context adjusts the score.

Kinds email, ip, card and phone are matched leftmost and without overlap of their own kind; every match that
passes its check stays. The further kinds (iban by mod-97, ssn) count only from a score of ``THRESHOLD`` on.
Every pattern is tried from places found by a linear search, so that no text takes quadratic time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: Score of a match by its form and check alone, and what a context word nearby adds.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
NEARBY, BONUS, THRESHOLD = 40, 0.2, 0.5
CONTEXT = {
    "email": re.compile(r"mail|contact|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|adresse", re.I),
    "card": re.compile(r"card|visa|credit|carte|karte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
}
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match ends where its last run of digits does, and a run that fails at its first digit fails at all of them
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
DROP = str.maketrans("", "", " -().+")
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    ordered = [ord(c) - 48 for c in reversed(digits)]
    return (sum(ordered[::2]) + sum(DOUBLED[d] for d in ordered[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for match in DOMAIN.finditer(text):
        at = start = match.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            yield start, match.end()
            done = match.end()


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose check holds; a match that fails is dropped and its characters aren't tried again."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    for match in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in match[0].split(".")):
            yield "ip", *match.span()
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 12 and 12 <= len(digits := match[0].translate(DROP)) <= 19 and luhn(digits):
            yield "card", *match.span()
    if "+" in text:
        for match in PHONE.finditer(text):
            if 9 <= len(match[0].translate(DROP)) <= 15:
                yield "phone", *match.span()
    for match in IBAN.finditer(text):
        if 15 <= len(iban := match[0].replace(" ", "")) <= 34 and mod97(iban):
            yield "iban", *match.span()
    for match in SSN.finditer(text):
        yield "ssn", *match.span()


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, end exclusive, ordered by start and then kind."""
    found = []
    for kind, start, end in proposals(text):
        near = CONTEXT[kind].search(text[max(0, start - NEARBY) : start]) or CONTEXT[kind].search(text[end : end + NEARBY])
        score = SCORES[kind] + BONUS * bool(near)
        if kind in BASE or score >= THRESHOLD:
            found.append((kind, start, end, round(score, 2)))
    return sorted(found, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


def redacted(text: str) -> str:
    """The text with every span replaced by its kind; spans that overlap are one, named after the first."""
    out, at, covered = [], 0, -1
    for kind, start, end, _ in spans_of(text):
        if start >= covered:
            out += [text[at:start], f"[{kind.upper()}]"]
            covered = end
        covered = max(covered, end)
        at = covered
    return "".join(out) + text[at:] if out else text


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): the spans of every whole text; none for NULL or empty. Other columns are left out; rows stay."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [spans_of(text) if text else [] for text in batch.column("text").to_pylist()]
            offsets = pa.array([0, *_running(map(len, each))], pa.int32())
            columns = list(zip(*chain.from_iterable(each))) or [(), (), (), ()]
            parts = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.float64()))]
            spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, ["kind", "start", "end", "score"]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), spans], names=[id_col, "spans"])

    narrow = small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, spans {SPAN}")


def _running(sizes: Iterator[int]) -> Iterator[int]:
    total = 0
    for size in sizes:
        total += size
        yield total


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns; in the text each span gives way to its kind in brackets. NULL stays NULL."""

    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [redacted(text) if text else text for text in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.names[at], pa.array(clean, pa.string()))

    return small_batches(df).mapInArrow(run, df.schema)


def spelled(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
