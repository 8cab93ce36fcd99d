"""Turning source content into target content: expressions, Arrow UDFs and external commands."""

from __future__ import annotations

import subprocess
import sys
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark import TaskContext
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import file_stem, raw_ext
from tidemark.functions.templates import render_template
from tidemark.operators.ledger import Ledger, digest
from tidemark.operators.rules import Rules, with_converter

# ship the worker functions with the job, so executors need no installed copy of this package
register_pickle_by_value(sys.modules[__name__])

ITEM_COLUMNS = (
    "rel_path",
    "target_path",
    "action",
    "converter",
    "status",
    "exit_code",
    "message",
    "mtime",
    "mode",
    "size",
    "content",
)
OUTCOME_COLUMNS = ("rel_path", "target_path", "action", "converter", "status", "exit_code", "message", "mtime")

_WORKER_SCHEMA = (
    "rel_path string, target_path string, action string, converter string, mtime timestamp, mode int, "
    "content binary, exit_code int, message string"
)


@dataclass
class Converters:
    """The converters of a run, by name."""

    expressions: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    udfs: dict[str, Callable[[pd.Series], pd.Series]] = field(default_factory=dict)
    commands: dict[str, list[str]] = field(default_factory=dict)

    def register(self, name: str, fn: Callable[[Column], Column]) -> Converters:
        """A column expression over the content; stays on the JVM."""
        self.expressions[name] = fn
        return self

    def register_udf(self, name: str, fn: Callable[[pd.Series], pd.Series]) -> Converters:
        """A function from a Series of bytes to a Series of bytes, run on Arrow batches."""
        self.udfs[name] = fn
        return self

    def register_command(self, name: str, argv: list[str]) -> Converters:
        """A command template run once per item on the executors."""
        self.commands[name] = argv
        return self

    def rows(self) -> list[tuple[str, str, list[str] | None]]:
        return (
            [(name, "expression", None) for name in self.expressions]
            + [(name, "udf", None) for name in self.udfs]
            + [(name, "command", argv) for name, argv in self.commands.items()]
        )

    def rules(self, spark: SparkSession, mappings: Iterable[tuple[str, str | None, str | None]]) -> Rules:
        """Rule tables for these converters and ``(ext, converter, output_ext)`` mappings."""
        return Rules.of(spark, mappings, self.rows())


def _checked(items: DataFrame, allow_empty: bool) -> DataFrame:
    """Set ``status``, ``message`` and ``size`` from the produced ``content``; drop content of failures."""
    converted = F.col("action") == "convert"
    problem = F.when(F.col("message").isNotNull(), F.col("message")).when(F.col("content").isNull(), F.lit("no output"))
    if not allow_empty:
        problem = problem.when(converted & (F.octet_length("content") == 0), F.lit("empty output"))
    return (
        items.withColumn("message", problem)
        .withColumn("status", F.when(F.col("message").isNull(), "ok").otherwise("failed"))
        .withColumn("content", F.when(F.col("status") == "ok", F.col("content")))
        .withColumn("size", F.octet_length("content").cast("bigint"))
        .select(*ITEM_COLUMNS)
    )


def copy_through(items: DataFrame) -> DataFrame:
    """Items whose content is taken over as it is."""
    return items.filter("action = 'copy'").select(
        "*", F.lit(None).cast("int").alias("exit_code"), F.lit(None).cast("string").alias("message")
    )


def convert_expressions(items: DataFrame, expressions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Apply each row's column expression; rows to be copied keep their content."""
    content = F.when(F.col("action") == "copy", F.col("content"))
    for name, fn in expressions.items():
        content = content.when(F.col("converter") == name, fn(F.col("content")))
    return items.withColumn("content", content).select(
        "*", F.lit(None).cast("int").alias("exit_code"), F.lit(None).cast("string").alias("message")
    )


def _apply_udf(fn: Callable[[pd.Series], pd.Series], content: pd.Series) -> tuple[list, list]:
    """Outputs and messages of a batch; if the batch fails, of each row on its own."""
    try:
        outputs = list(fn(content))
        if len(outputs) != len(content):
            raise ValueError(f"{len(outputs)} outputs for {len(content)} items")
        for output in outputs:
            if output is not None and not isinstance(output, (bytes, bytearray, memoryview)):
                raise TypeError(f"output is {type(output).__name__}, not bytes")
        return outputs, [None] * len(content)
    except Exception as error:
        if len(content) == 1:
            return [None], [str(error) or type(error).__name__]
    outputs, messages = [], []
    for position in range(len(content)):
        output, message = _apply_udf(fn, content.iloc[position : position + 1])
        outputs += output
        messages += message
    return outputs, messages


def _run_command(argv: list[str] | None, source: str, target: str, content: bytes, timeout: float):
    """``(output, exit_code, message)`` of one command run in a folder of its own."""
    if argv is None:
        return None, None, "malformed command template"
    with tempfile.TemporaryDirectory() as folder:
        root = Path(folder)
        try:
            (root / "in").mkdir()
            (root / "out").mkdir()
            (root / source).write_bytes(content)
            done = subprocess.run(
                list(argv),
                cwd=root,
                stdin=subprocess.DEVNULL,
                stdout=subprocess.DEVNULL,
                stderr=subprocess.PIPE,
                timeout=timeout,
                check=False,
            )
        except subprocess.TimeoutExpired:
            return None, -1, f"timed out after {timeout:g} s"
        except (OSError, ValueError) as error:
            return None, None, f"not started: {error}"
        if done.returncode != 0:
            message = done.stderr.decode("utf-8", errors="replace").strip()
            # a command ended by a signal has no exit code
            return None, max(done.returncode, -1), message or "command failed"
        output = root / target
        return (output.read_bytes() if output.is_file() else b""), 0, None


def _recorded_command(ledger: Ledger, rel_path: str, argv: list[str] | None, source: str, target: str, content: bytes, timeout: float):
    """As ``_run_command``, but an item whose output is recorded isn't run again; failures aren't recorded."""
    if argv is None:
        return _run_command(argv, source, target, content, timeout)
    item = digest(list(argv), source, target, content)
    output = ledger.get(item)
    if output is not None:
        return output, 0, None
    output, code, message = _run_command(argv, source, target, content, timeout)
    if code == 0 and message is None:
        ledger.add(item, rel_path, output)
    return output, code, message


def _convert_batches(
    batches: Iterator[pd.DataFrame],
    udfs: dict[str, Callable[[pd.Series], pd.Series]],
    timeout: float,
    record: tuple[str, float] | None = None,
) -> Iterator[pd.DataFrame]:
    ledger = None
    if record is not None:
        task = TaskContext.get()
        ledger = Ledger(record[0], task.partitionId() if task else 0, record[1])
    try:
        yield from _converted(batches, udfs, timeout, ledger)
    finally:
        if ledger is not None:
            ledger.flush()


def _converted(
    batches: Iterator[pd.DataFrame], udfs: dict[str, Callable[[pd.Series], pd.Series]], timeout: float, ledger: Ledger | None
) -> Iterator[pd.DataFrame]:
    for batch in batches:
        outputs, codes, messages = ([None] * len(batch) for _ in range(3))
        batch = batch.reset_index(drop=True)
        for name, group in batch.groupby("converter"):
            if name in udfs:
                results = zip(*_apply_udf(udfs[name], group["content"]), strict=True)
                for row, (output, message) in zip(group.index, results, strict=True):
                    outputs[row], messages[row] = output, message
            else:
                columns = zip(group["argv"], group["staged_in"], group["staged_out"], group["content"], strict=True)
                for row, call in zip(group.index, columns, strict=True):
                    if ledger is None:
                        done = _run_command(*call, timeout)
                    else:
                        done = _recorded_command(ledger, group["rel_path"][row], *call, timeout)
                    outputs[row], codes[row], messages[row] = done
        yield pd.DataFrame(
            {
                "rel_path": batch["rel_path"],
                "target_path": batch["target_path"],
                "action": batch["action"],
                "converter": batch["converter"],
                "mtime": batch["mtime"],
                "mode": batch["mode"].astype("Int32"),
                "content": pd.Series(outputs, dtype=object),
                "exit_code": pd.Series(codes, dtype="Int32"),
                "message": pd.Series(messages, dtype=object),
            }
        )


def convert_in_workers(
    items: DataFrame,
    converters: DataFrame,
    registry: Converters,
    timeout: float = 3600.0,
    bounded: bool | None = None,
    record: tuple[str, float] | None = None,
) -> DataFrame:
    """Run the UDF and command converters of ``items`` in Python workers, in one pass.

    A command sees staged files named after the source and the target's extension; its words are
    rendered on the JVM. A failing row is reported in ``message`` and does not stop the others.
    ``record`` is a folder that executors can write to, and the seconds after which outputs that commands have
    finished are recorded there; a repeated task takes them over.
    """
    staged_in = F.concat(F.lit("in/"), file_stem("rel_path"), raw_ext("rel_path"))
    staged_out = F.concat(F.lit("out/data"), raw_ext("target_path"))
    variables = F.create_map(
        F.lit("input"),
        F.col("staged_in"),
        F.lit("output"),
        F.col("staged_out"),
        F.lit("stem"),
        file_stem("rel_path"),
        F.lit("ext"),
        raw_ext("rel_path"),
    )
    prepared = (
        with_converter(items.drop("kind"), converters, bounded)
        .withColumn("staged_in", staged_in)
        .withColumn("staged_out", staged_out)
        .withColumn("argv", F.when(F.col("command").isNotNull(), render_template("command", variables)))
        .withColumn("content", F.col("content").cast("binary"))
    )
    needed = ["rel_path", "target_path", "action", "converter", "mtime", "mode", "argv", "staged_in", "staged_out", "content"]
    udfs = dict(registry.udfs)
    return prepared.select(*needed).mapInPandas(lambda batches: _convert_batches(batches, udfs, timeout, record), _WORKER_SCHEMA)


def transform(items: DataFrame, registry: Converters, allow_empty: bool = False) -> DataFrame:
    """Copied and expression-converted items, entirely on the JVM."""
    return _checked(convert_expressions(items, registry.expressions), allow_empty)


def transform_in_workers(
    items: DataFrame,
    converters: DataFrame,
    registry: Converters,
    allow_empty: bool = False,
    timeout: float = 3600.0,
    bounded: bool | None = None,
    record: tuple[str, float] | None = None,
) -> DataFrame:
    """Items of UDF and command converters, with content in the type it came in."""
    content_type = dict(items.dtypes)["content"]
    done = convert_in_workers(items, converters, registry, timeout, bounded, record)
    return _checked(done.withColumn("content", F.col("content").cast(content_type)), allow_empty)
