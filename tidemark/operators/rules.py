"""Rule tables: extension mappings and converters, their checks and their joins."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any
from weakref import WeakSet

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import file_ext, normalize_ext, target_path
from tidemark.functions.templates import TEMPLATE_VARIABLES, template_error

MAPPING_SCHEMA = pa.schema({"ext": pa.string(), "converter": pa.string(), "output_ext": pa.string()})
CONVERTER_SCHEMA = pa.schema({"name": pa.string(), "kind": pa.string(), "command": pa.list_(pa.string())})

#: rule tables up to this many rows are broadcast; larger ones are joined with a salted shuffle
MAX_BROADCAST_RULES = 10_000
#: slices a hot rule key is cut into by the salted join
RULE_SALTS = 32


class RuleError(ValueError):
    """The rule tables do not pass their checks."""


@dataclass(frozen=True, eq=False)
class Rules:
    """``mappings(ext, converter, output_ext)`` and ``converters(name, kind, command)``.

    ``bounded`` says whether both are known to be small enough to broadcast; None if that has to be
    measured.
    """

    mappings: DataFrame
    converters: DataFrame
    bounded: bool | None = None

    @staticmethod
    def of(
        spark: SparkSession,
        mappings: Iterable[tuple[str, str | None, str | None]] = (),
        converters: Iterable[tuple[str, str, list[str] | None]] = (),
    ) -> Rules:
        """Rule tables from rows. Being local relations, they are folded into the plans that use them."""

        mappings, converters = list(mappings), list(converters)

        def table(rows: list[tuple], schema: pa.Schema) -> DataFrame:
            return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, row, strict=True)) for row in rows], schema))

        bounded = max(len(mappings), len(converters)) <= MAX_BROADCAST_RULES
        return Rules(table(mappings, MAPPING_SCHEMA), table(converters, CONVERTER_SCHEMA), bounded)

    @staticmethod
    def from_config(spark: SparkSession, config: Mapping[str, Any]) -> Rules:
        """Rules of a parsed configuration: ``converters.<name>.command`` and
        ``mappings.<ext>.{converter, output_ext}``. All converters are commands."""
        return Rules.of(
            spark,
            [(ext, m.get("converter"), m.get("output_ext")) for ext, m in config.get("mappings", {}).items()],
            [(name, "command", c.get("command")) for name, c in config.get("converters", {}).items()],
        )


def normalized_mappings(mappings: DataFrame) -> DataFrame:
    """Lower-cased, dotted keys; a missing ``output_ext`` keeps the extension."""
    ext = normalize_ext("ext")
    return mappings.select(
        ext.alias("ext"), "converter", F.coalesce(normalize_ext("output_ext"), ext).alias("output_ext")
    )


# --- checks: each returns the violations as (rule, subject, code, message) ---------------------------


def _violations(df: DataFrame, rule: str, subject: str, code: str, message: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), F.col(subject).alias("subject"), F.lit(code).alias("code"), message.alias("message")
    )


def _commands(converters: DataFrame) -> DataFrame:
    """Converters that run a command; expressions and UDFs need none."""
    return converters.filter(F.coalesce("kind", F.lit("command")) == "command")


def missing_commands(converters: DataFrame) -> DataFrame:
    bad = _commands(converters).filter("command is null")
    return _violations(bad, "converter", "name", "missing_command", F.lit("no command given"))


def empty_commands(converters: DataFrame) -> DataFrame:
    bad = _commands(converters).filter(F.size("command") == 0)
    return _violations(bad, "converter", "name", "empty_command", F.lit("the command has no words"))


def invalid_templates(converters: DataFrame, allowed: Iterable[str] = TEMPLATE_VARIABLES) -> DataFrame:
    """First malformed word of each command."""
    words = _commands(converters).select("name", F.posexplode("command").alias("word", "template"))
    errors = words.withColumn("error", template_error("template", allowed)).filter("error is not null")
    first = errors.groupBy("name").agg(F.min(F.struct("word", "error", "template")).alias("first"))
    error = F.col("first.error")
    message = F.concat_ws(
        "", error["code"], F.lit(" at byte "), error["pos"].cast("string"), F.lit(" of "), F.col("first.template")
    )
    return _violations(first, "converter", "name", "invalid_template", message)


def missing_converters(mappings: DataFrame) -> DataFrame:
    bad = normalized_mappings(mappings).filter("converter is null")
    return _violations(bad, "mapping", "ext", "missing_converter", F.lit("no converter given"))


def undefined_converters(mappings: DataFrame, converters: DataFrame) -> DataFrame:
    named = normalized_mappings(mappings).filter("converter is not null").select("ext", "converter").distinct()
    defined = converters.select(F.col("name").alias("converter"))
    # anti-join the distinct names only: a name used by most mappings is one row here
    undefined = named.select("converter").distinct().join(defined, "converter", "left_anti")
    bad = join_rules(named, undefined, "converter", "inner", spread="ext")
    return _violations(
        bad, "mapping", "ext", "undefined_converter", F.concat(F.lit("undefined converter "), F.col("converter"))
    )


def duplicate_mappings(mappings: DataFrame) -> DataFrame:
    bad = normalized_mappings(mappings).groupBy("ext").agg(F.count("*").alias("n")).filter("n > 1")
    return _violations(
        bad, "mapping", "ext", "duplicate_mapping", F.concat(F.col("n").cast("string"), F.lit(" mappings for one key"))
    )


def duplicate_converters(converters: DataFrame) -> DataFrame:
    bad = converters.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")
    return _violations(
        bad,
        "converter",
        "name",
        "duplicate_converter",
        F.concat(F.col("n").cast("string"), F.lit(" converters of one name")),
    )


def rule_errors(rules: Rules) -> DataFrame:
    """All violations of both rule tables."""
    return (
        missing_commands(rules.converters)
        .unionByName(empty_commands(rules.converters))
        .unionByName(invalid_templates(rules.converters))
        .unionByName(duplicate_converters(rules.converters))
        .unionByName(missing_converters(rules.mappings))
        .unionByName(undefined_converters(rules.mappings, rules.converters))
        .unionByName(duplicate_mappings(rules.mappings))
    )


#: rule tables made of rows, which cannot change, need checking only once
_checked: WeakSet[Rules] = WeakSet()


def check_rules(rules: Rules) -> None:
    """Raise if there are violations; the message shows the first few."""
    if rules in _checked:
        return
    if rules.bounded:
        # few rows: in one partition none of the checks shuffles anything
        small = Rules(rules.mappings.coalesce(1), rules.converters.coalesce(1), True)
        shown = rule_errors(small).orderBy("rule", "subject", "code").limit(20).collect()
    else:
        shown = rule_errors(rules).orderBy("rule", "subject", "code").limit(20).collect()
    if shown:
        raise RuleError("; ".join(f"{e.rule} {e.subject}: {e.code}: {e.message}" for e in shown))
    if rules.bounded is not None:
        _checked.add(rules)


# --- joins -------------------------------------------------------------------------------------------


def join_rules(
    df: DataFrame, rules: DataFrame, key: str, how: str, spread: str = "rel_path", bounded: bool | None = None
) -> DataFrame:
    """Join a large frame to a rule table that has at most one row per ``key``.

    A rule table of proven (given or counted) size is broadcast. A larger one is repeated once per salt and joined on
    (key, salt), so that a key shared by most rows is still spread over many tasks.
    """
    if bounded is None:
        bounded = rules.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES
    if bounded:
        return df.join(F.broadcast(rules), key, how)
    salted = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(RULE_SALTS - 1))))
    salt = F.pmod(F.xxhash64(spread), F.lit(RULE_SALTS)).cast("int")
    return df.withColumn("_salt", salt).join(salted, [key, "_salt"], how).drop("_salt")


def map_paths(manifest: DataFrame, mappings: DataFrame, bounded: bool | None = None) -> DataFrame:
    """Add ``ext``, ``converter`` (NULL if unmapped) and ``target_path`` to manifest rows."""
    mapped = join_rules(
        manifest.withColumn("ext", file_ext("rel_path")), normalized_mappings(mappings), "ext", "left", bounded=bounded
    )
    return mapped.withColumn("target_path", target_path("rel_path", "ext", "output_ext")).drop("output_ext")


def with_converter(work: DataFrame, converters: DataFrame, bounded: bool | None = None) -> DataFrame:
    """Add the ``kind`` and ``command`` of each row's converter."""
    return join_rules(work, converters.withColumnRenamed("name", "converter"), "converter", "inner", bounded=bounded)
