"""The plan of a run: lazy frames that say what would be written, created and deleted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.diff import PLAN_COLUMNS, conflict_sources, known_targets, rank_sources, reconcile
from tidemark.operators.directories import all_dirs, missing_dirs, removable_dirs
from tidemark.operators.filters import exclude_paths, keep_mapped
from tidemark.operators.reports import action_summary, scanned_count
from tidemark.operators.rules import join_rules, map_paths
from tidemark.plans.spec import SyncSpec


def work_items(spec: SyncSpec, source: DataFrame) -> DataFrame:
    """Source rows that take part in the run, with extension, converter, its kind and target path."""
    kept = exclude_paths(source, spec.source_exclude, strict=spec.strict_globs)
    mapped = keep_mapped(map_paths(kept, spec.rules.mappings, spec.rules.bounded), spec.copy_unmatched)
    kinds = spec.rules.converters.select(
        F.col("name").alias("converter"), F.coalesce("kind", F.lit("command")).alias("kind")
    )
    return join_rules(mapped, kinds, "converter", "left", bounded=spec.rules.bounded)


@dataclass(frozen=True)
class SyncPlan:
    """A run that has not happened. Nothing is read before one of its frames is used."""

    spec: SyncSpec
    source: DataFrame
    target: DataFrame
    #: the first two work items of every target, every orphaned or protected target row, side by side (see
    #: ``reconcile``); a second item (``source_rank`` 2) shows that the target is contested
    diff: DataFrame
    known_dirs: DataFrame
    target_dirs: DataFrame
    #: False for a feed of changes, which cannot show that a path is gone
    prunes: bool = True
    #: target rows that the comparison leaves out because nothing can happen to them
    rest: DataFrame | None = None
    #: the state of the store that the target shows (see ``SnapshotStore.state``); None if it is no store's
    base: tuple[int, int] | None = None

    @property
    def items(self) -> DataFrame:
        return work_items(self.spec, self.source)

    @property
    def work(self) -> DataFrame:
        """One row per target path to convert, copy or skip."""
        return self.diff.filter("in_source and source_rank = 1").select(*PLAN_COLUMNS, "size", "mode")

    @property
    def creates(self) -> DataFrame:
        """Directories the target lacks."""
        return missing_dirs(self.known_dirs, self.target_dirs)

    @property
    def delete_files(self) -> DataFrame:
        return self.diff.filter("action = 'delete'").select(F.col("target_path").alias("path"))

    @property
    def delete_dirs(self) -> DataFrame:
        if not self.prunes:
            return self.target_dirs.limit(0)
        survivors = self.diff.filter("action <> 'delete'")
        return removable_dirs(self.target_dirs, self.known_dirs, survivors, "target_path", self.spec.deep_dirs)

    @property
    def deletes(self) -> DataFrame:
        """Everything that would go: ``path`` and ``kind``."""
        return self.delete_files.withColumn("kind", F.lit("file")).unionByName(
            self.delete_dirs.withColumn("kind", F.lit("dir"))
        )

    def conflicts(self) -> DataFrame:
        """Every source of a target that several claim, with the one that ``on_conflict="first"`` takes."""
        return conflict_sources(self.items)

    def scanned(self) -> DataFrame:
        return scanned_count(self.items)

    def summary(self) -> DataFrame:
        return action_summary(self.work)


def plan(
    spec: SyncSpec,
    source: DataFrame,
    target: DataFrame,
    source_dirs: DataFrame | None = None,
    target_dirs: DataFrame | None = None,
    prunes: bool = True,
    few_changes: bool = False,
    base: tuple[int, int] | None = None,
    settled: bool = False,
) -> SyncPlan:
    """Compare a source manifest with a target manifest under the rules of ``spec``.

    ``source_dirs`` and ``target_dirs`` add directories that hold no file; the others follow from the
    manifests. Without ``prunes`` the source is a feed of changes: unlisted target rows are kept, and a
    change older than the target is skipped. ``few_changes`` says that such a feed is known to be small
    enough to broadcast; the target is then filtered where it is read instead of being shuffled. ``base``
    names the store state that a target derived from a store's manifest shows; the manifest itself knows.
    ``settled`` says that each change of such a feed comes after what the target has of its path, so one of the
    same time or within the window replaces it too.
    """
    base = base or getattr(target, "store_state", None)
    items = work_items(spec, source)
    ranked = rank_sources(items, keep=2)
    known = exclude_paths(all_dirs(source, source_dirs), spec.source_exclude, "path", spec.strict_globs)
    compared, rest = target, None
    if few_changes and not prunes:
        touched = F.broadcast(known_targets(items).withColumnRenamed("target_path", "rel_path"))
        compared = target.join(touched, "rel_path", "left_semi")
        rest = target.join(touched, "rel_path", "left_anti")
    protect = spec.target_exclude if prunes else ("*",)
    window = None if settled and not prunes else spec.modify_window
    diff = reconcile(ranked, compared, window, protect, spec.strict_globs, newer_only=not prunes)
    return SyncPlan(spec, source, target, diff, known, all_dirs(target, target_dirs), prunes, rest, base)
