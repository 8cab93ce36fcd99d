"""Glob patterns as column predicates.

``*`` and ``?`` also match ``/``; ``**/``, ``/**/`` and ``/**`` span directories; ``[a-z]``, ``[!a]``,
``{a,b}`` and backslash escapes are supported; a pattern has to match the whole path.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.paths import ColumnOrName, as_column

# ship the worker functions with the job, so executors need no installed copy of this package
register_pickle_by_value(sys.modules[__name__])

#: more patterns than this are not tested one by one
MANY = 64
#: lengths of prefixes and suffixes that are set tests on the JVM
MAX_LENGTHS = 32
#: characters of a literal that the index looks up
GRAM = 3

_TOKEN = re.compile(
    r"(?P<span>(?:(?<=/)|(?<=[{,])|^)\*\*(?:/|(?=[},])|\Z))"
    r"|(?P<stars>\*+)"
    r"|(?P<one>\?)"
    r"|\[(?P<negated>[!^]?)(?P<members>\]?[^\]]*)\]"
    r"|(?P<group>[{},])"
    r"|\\(?P<escaped>.)"
    r"|(?P<broken>[\[\\])"
    r"|(?P<literal>.)",
    re.DOTALL,
)
_WILD = re.compile(r"[*?\[\]{}\\]")


class GlobError(ValueError):
    """A glob pattern that cannot be compiled."""


def _class_regex(members: str, negated: bool, pattern: str) -> str:
    parts = []
    for low, high in re.findall(r"(.)(?:-(.))?", members, re.DOTALL):
        if high and high < low:
            raise GlobError(f"invalid range {low}-{high} in glob {pattern!r}")
        parts.append("\\" + low if not low.isalnum() else low)
        if high:
            parts.append("-" + ("\\" + high if not high.isalnum() else high))
    if not parts:
        raise GlobError(f"empty character class in glob {pattern!r}")
    return f"[{'^' if negated else ''}{''.join(parts)}]"


def glob_regex(pattern: str) -> str:
    """Unanchored regular expression for one glob."""
    # one list of finished alternatives plus the open one per nesting level
    levels: list[list[str]] = [[""]]
    for token in _TOKEN.finditer(pattern):
        kind, text = token.lastgroup, token.group()
        if kind == "span":
            piece = "(?:.*/)?" if text.endswith("/") else ".*"
        elif kind == "stars":
            piece = ".*"
        elif kind == "one":
            piece = "."
        elif kind == "members":
            piece = _class_regex(token["members"], bool(token["negated"]), pattern)
        elif kind == "escaped":
            piece = re.escape(token["escaped"])
        elif kind == "broken":
            raise GlobError(f"unclosed {text!r} in glob {pattern!r}")
        elif text == "{":
            levels.append([""])
            continue
        elif text == "," and len(levels) > 1:
            levels[-1].append("")
            continue
        elif text == "}":
            if len(levels) == 1:
                raise GlobError(f"unopened '}}' in glob {pattern!r}")
            choices = [choice for choice in levels.pop() if choice]
            piece = f"(?:{'|'.join(choices)})" if choices else ""
        else:
            piece = re.escape(text)
        levels[-1][-1] += piece
    if len(levels) > 1:
        raise GlobError(f"unclosed '{{' in glob {pattern!r}")
    return levels[0][0]


def compile_globs(patterns: Iterable[str], strict: bool = True) -> list[tuple[str, str]]:
    """``(pattern, regex)`` pairs; an invalid pattern raises, or is dropped when not ``strict``."""
    compiled = []
    for pattern in patterns:
        try:
            compiled.append((pattern, glob_regex(pattern)))
        except GlobError:
            if strict:
                raise
    return compiled


def glob_to_regex(patterns: Iterable[str], strict: bool = True) -> str | None:
    """One anchored regular expression for all patterns, or None when there are none."""
    regexes = [regex for _, regex in compile_globs(patterns, strict)]
    # \z, not $: the latter also accepts a trailing newline
    return rf"(?s)\A(?:{'|'.join(regexes)})\z" if regexes else None


def _sorted_out(compiled: list[tuple[str, str]]) -> tuple[dict[str, list[str]], list[tuple[str, str]]]:
    """Literals of the patterns that are an equality, prefix, suffix or substring test, and all other patterns."""
    plain: dict[str, list[str]] = {"any": [], "equal": [], "prefix": [], "suffix": [], "inside": []}
    others: list[tuple[str, str]] = []
    for pattern, regex in compiled:
        core = pattern.strip("*")
        open_start, open_end = pattern.startswith("*"), pattern.endswith("*")
        if _WILD.search(core) or (core and "**" in pattern):
            others.append((pattern, regex))
        elif not core and pattern:
            plain["any"].append(pattern)
        else:
            kind = {(False, False): "equal", (True, False): "suffix", (False, True): "prefix", (True, True): "inside"}
            plain[kind[open_start, open_end]].append(core)
    return plain, others


def required_literal(pattern: str) -> str:
    """The longest text that every match of a glob contains; empty if there is none."""
    runs, run, depth = [""], "", 0
    for token in _TOKEN.finditer(pattern):
        kind, text = token.lastgroup, token.group()
        depth += (kind == "group" and text == "{") - (kind == "group" and text == "}")
        if kind in ("literal", "escaped") and depth == 0:
            run += token["escaped"] if kind == "escaped" else text
        else:
            runs.append(run)
            run = ""
    return max([*runs, run], key=len)


class GlobIndex:
    """Many globs, of which a path is tested against those only whose literal it may contain.

    Equalities, prefixes and suffixes are sets, one for each length. Any other glob is listed under the rarest ``GRAM``
    characters of the text that its matches must contain, so a path looks up its own sequences of that length,
    however many globs there are. Globs without such a text are tried on every path, as one expression. An index
    is built once and shipped; an expression is compiled where it is first needed.
    """

    def __init__(self, compiled: list[tuple[str, str]]) -> None:
        plain, globs = _sorted_out(compiled)
        globs = globs + [(f"*{text}*", glob_regex(f"*{text}*")) for text in plain["inside"]]
        self.all = bool(plain["any"])
        self.equal = frozenset(plain["equal"])
        self.starts, self.ends = (
            {n: frozenset(t for t in plain[kind] if len(t) == n) for n in sorted(set(map(len, plain[kind])))} for kind in ("prefix", "suffix")
        )
        literals = [(required_literal(pattern), regex) for pattern, regex in globs]
        grams = [{text[n : n + GRAM] for n in range(len(text) - GRAM + 1)} for text, _ in literals]
        often: dict[str, int] = defaultdict(int)
        for own in grams:
            for gram in own:
                often[gram] += 1
        by_gram: dict[str, list[tuple[str, str]]] = defaultdict(list)
        always = []
        for (text, regex), own in zip(literals, grams):
            if own:
                by_gram[min(sorted(own), key=often.__getitem__)].append((text, regex))
            else:
                always.append(regex)
        self.by_gram = dict(by_gram)
        self.always = f"(?:{'|'.join(always)})" if always else None
        self.compiled: dict[str, re.Pattern] = {}

    def _tried(self, regex: str, path: str) -> bool:
        pattern = self.compiled.get(regex)
        if pattern is None:
            pattern = self.compiled[regex] = re.compile(regex, re.DOTALL)
        return pattern.fullmatch(path) is not None

    def matches(self, path: str) -> bool:
        if self.all or path in self.equal:
            return True
        for n, texts in self.starts.items():
            if path[:n] in texts:
                return True
        for n, texts in self.ends.items():
            if path[-n:] in texts:
                return True
        if self.always is not None and self._tried(self.always, path):
            return True
        by_gram = self.by_gram
        if by_gram:
            for n in range(len(path) - GRAM + 1):
                listed = by_gram.get(path[n : n + GRAM])
                if listed is not None:
                    for text, regex in listed:
                        if text in path and self._tried(regex, path):
                            return True
        return False


def _indexed(path: Column, compiled: list[tuple[str, str]]) -> Column:
    index = GlobIndex(compiled)

    @F.pandas_udf("boolean")
    def matched(paths: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else index.matches(p) for p in paths], dtype="boolean")

    return matched(path)


def _matches_many(path: Column, compiled: list[tuple[str, str]]) -> Column:
    """Sets only, as long as there are few lengths and nothing else: those stay on the JVM."""
    plain, others = _sorted_out(compiled)
    lengths = [(part, n) for part in ("prefix", "suffix") for n in sorted(set(map(len, plain[part])))]
    if others or plain["inside"] or len(lengths) > MAX_LENGTHS:
        return _indexed(path, compiled)
    tests: list[Column] = [path.isNotNull()] if plain["any"] else []
    if plain["equal"]:
        tests.append(path.isin(plain["equal"]))
    for part, n in lengths:
        tests.append(F.substr(path, F.lit(1 if part == "prefix" else -n), F.lit(n)).isin([t for t in plain[part] if len(t) == n]))
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def matches_glob(path: ColumnOrName, patterns: Iterable[str], strict: bool = True) -> Column:
    """Does ``path`` match any pattern?

    Patterns with stars at their ends only become equality, prefix, suffix or substring tests, which
    are cheaper per row than a regular expression and can reach the scan; all others are one expression. More
    than ``MANY`` patterns become set tests, one for each length of prefixes and suffixes, or, with other patterns
    among them, an index of their literals (see ``GlobIndex``), so the work for a path hardly grows with their number.
    """
    path = as_column(path)
    compiled = compile_globs(patterns, strict)
    if len(compiled) > MANY:
        return _matches_many(path, compiled)
    plain, others = _sorted_out(compiled)
    tests = [path.isNotNull() for _ in plain["any"]] + [path == core for core in plain["equal"]]
    tests += [path.startswith(core) for core in plain["prefix"]] + [path.endswith(core) for core in plain["suffix"]]
    tests += [path.contains(core) for core in plain["inside"]]
    if others:
        tests.append(path.rlike(rf"(?s)\A(?:{'|'.join(regex for _, regex in others)})\z"))
    return reduce(Column.__or__, tests) if tests else F.lit(False)
