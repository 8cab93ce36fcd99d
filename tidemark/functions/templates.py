"""Command templates: ``{name}`` placeholders, ``{{`` and ``}}`` for literal braces.

A template is cut into tokens once (on the small rule side of a join, where possible); rendering a row
then only maps tokens to text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.paths import ColumnOrName, as_column

#: names a command template may use
TEMPLATE_VARIABLES = ("input", "output", "stem", "ext")

# escaped brace | placeholder (up to the next closing brace) | stray brace | literal text
_TOKENS = r"([{][{]|[}][}]|[{][^}]*[}]|[{]|[}]|[^{}]+)"


def template_tokens(template: ColumnOrName) -> Column:
    return F.regexp_extract_all(as_column(template), F.lit(_TOKENS), F.lit(1))


def _is_placeholder(token: Column) -> Column:
    return (F.char_length(token) > 1) & token.startswith("{") & (token != "{{")


def _name(token: Column) -> Column:
    return F.substr(token, F.lit(2), F.char_length(token) - F.lit(2))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _unless_null_inside(parts: Column, use: Callable[[Column], Column]) -> Column:
    return _let(parts, lambda p: F.when(~F.exists(p, lambda part: part.isNull()), use(p)))


def render_tokens(tokens: ColumnOrName, variables: Column) -> Column:
    """Text of one tokenised template, or NULL if it has a stray brace or an unknown name."""

    def text(token: Column) -> Column:
        return (
            F.when(token == "{{", F.lit("{"))
            .when(token == "}}", F.lit("}"))
            .when(_is_placeholder(token), F.try_element_at(variables, _name(token)))
            .when(token.isin("{", "}"), F.lit(None))
            .otherwise(token)
        )

    return _unless_null_inside(F.transform(as_column(tokens), text), lambda parts: F.array_join(parts, ""))


def render_template(template: ColumnOrName, variables: Column) -> Column:
    """Every string of an array template with its placeholders filled in.

    NULL if any of the strings is malformed; ``template_error`` says what is wrong with it.
    """
    rendered = F.transform(as_column(template), lambda part: render_tokens(template_tokens(part), variables))
    return _unless_null_inside(rendered, lambda parts: parts)


def template_error(template: ColumnOrName, allowed: Iterable[str] = TEMPLATE_VARIABLES) -> Column:
    """First error of a template string as ``struct(code, pos, name)``, or NULL.

    ``code`` is ``unmatched_open``, ``unmatched_close`` or ``unknown_variable``; ``pos`` is the byte
    offset of the offending token.
    """
    names = list(allowed)

    def code(token: Column) -> Column:
        unknown = ~_name(token).isin(names) if names else F.lit(True)
        return (
            F.when(token == "{", F.lit("unmatched_open"))
            .when(token == "}", F.lit("unmatched_close"))
            .when(_is_placeholder(token) & unknown, F.lit("unknown_variable"))
        )

    def error(tokens: Column, first: Column) -> Column:
        bad = F.try_element_at(tokens, first)
        return F.when(
            first > 0,
            F.struct(
                code(bad).alias("code"),
                F.octet_length(F.array_join(F.slice(tokens, F.lit(1), first - F.lit(1)), "")).cast("int").alias("pos"),
                F.when(_is_placeholder(bad), _name(bad)).alias("name"),
            ),
        )

    def first_bad(tokens: Column) -> Column:
        """1-based position, 0 when all tokens are good."""
        flags = F.transform(tokens, lambda token: code(token).isNotNull())
        return F.coalesce(F.array_position(flags, F.lit(True)), F.lit(0)).cast("int")

    found = _let(template_tokens(template), lambda tokens: _let(first_bad(tokens), lambda first: error(tokens, first)))
    # text without braces needs no tokens
    return F.when(as_column(template).rlike("[{}]"), found)
