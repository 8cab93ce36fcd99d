"""What a sync run is to do."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from tidemark.functions.globs import compile_globs
from tidemark.operators.convert import Converters
from tidemark.operators.rules import Rules


class SpecError(ValueError):
    """A sync specification that cannot be used."""


@dataclass(frozen=True)
class SyncSpec:
    """Rules and options of a run.

    ``modify_window`` is in seconds (negative: exact versions). ``on_conflict`` says what happens when
    several sources share one target: ``error``, or ``first`` in path order. A task runs ``command_items``
    commands at most, as long as 20,000 tasks suffice. With ``record_seconds`` outputs that commands have finished
    are recorded in the store after that many seconds (0: each at once) until the run is published: what a lost
    executor or a run that broke off had recorded isn't run again. Executors reach the store through Arrow then.
    ``deep_dirs`` finds directories to remove by a sweep that costs the same for every depth (see ``removable_dirs``).
    """

    rules: Rules
    converters: Converters = field(default_factory=Converters)
    copy_unmatched: bool = True
    source_exclude: tuple[str, ...] = ()
    target_exclude: tuple[str, ...] = ()
    modify_window: int = 0
    on_conflict: str = "error"
    strict_globs: bool = True
    allow_empty_source: bool = False
    allow_empty_output: bool = False
    command_timeout: float = 3600.0
    command_items: int = 1_000
    record_seconds: float | None = None
    deep_dirs: bool = False
    source_root: str | None = None
    target_root: str | None = None

    def __post_init__(self) -> None:
        if self.on_conflict not in ("error", "first"):
            raise SpecError(f"on_conflict must be 'error' or 'first', not {self.on_conflict!r}")
        if self.command_items < 1:
            raise SpecError("a task runs one command at least")
        compile_globs((*self.source_exclude, *self.target_exclude), self.strict_globs)
        if self.source_root is not None and self.target_root is not None:
            source, target = self.source_root.rstrip("/") + "/", self.target_root.rstrip("/") + "/"
            if source.startswith(target) or target.startswith(source):
                raise SpecError(f"source {self.source_root} and target {self.target_root} overlap")

    @staticmethod
    def from_config(spark: SparkSession, config: Mapping[str, Any], section: str = "sync", **options: Any) -> SyncSpec:
        """Spec of a parsed configuration with the tables ``[<section>]``, ``[converters.<name>]`` and
        ``[mappings]``. Unknown keys are ignored; local source and target folders are checked."""
        general = config.get(section, {})
        for name in ("source", "target"):
            if name not in general:
                raise SpecError(f"missing field {section}.{name}")
        source, target = general["source"], general["target"]
        if "://" not in source and not Path(source).is_dir():
            raise SpecError(f"source is not an existing directory: {source}")
        if "://" not in target and Path(target).exists() and not Path(target).is_dir():
            raise SpecError(f"target exists and is not a directory: {target}")
        commands = {
            name: converter["command"]
            for name, converter in config.get("converters", {}).items()
            if converter.get("command") is not None
        }
        return SyncSpec(
            rules=Rules.from_config(spark, config),
            converters=Converters(commands=commands),
            copy_unmatched=general.get("copy_unmatched", True),
            source_exclude=tuple(general.get("source_exclude", ())),
            target_exclude=tuple(general.get("target_exclude", ())),
            source_root=source,
            target_root=target,
            **options,
        )

    @staticmethod
    def from_toml(spark: SparkSession, text: str | bytes, section: str = "sync", **options: Any) -> SyncSpec:
        """Spec of a TOML document."""
        try:
            config = tomllib.loads(text.decode("utf-8") if isinstance(text, bytes) else text)
        except UnicodeDecodeError as error:
            raise SpecError(f"configuration is not UTF-8: {error}") from error
        except tomllib.TOMLDecodeError as error:
            raise SpecError(f"configuration is not TOML: {error}") from error
        return SyncSpec.from_config(spark, config, section, **options)
