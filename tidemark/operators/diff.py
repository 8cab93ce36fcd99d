"""Comparing a source with a target: new, stale, fresh and orphaned paths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.globs import matches_glob
from tidemark.functions.paths import path_order
from tidemark.functions.versions import is_fresh
from tidemark.operators.filters import exclude_paths
from tidemark.sources.manifests import latest_versions

PLAN_COLUMNS = ("rel_path", "target_path", "ext", "converter", "action", "mtime", "target_mtime", "reason")


# --- several sources for one target ------------------------------------------------------------------


def rank_sources(work: DataFrame, keep: int = 1) -> DataFrame:
    """The first ``keep`` sources of each target in path order, numbered in ``source_rank``.

    The bound on the rank lets Spark cut every group down to ``keep`` rows per task before the shuffle
    (WindowGroupLimit), so a target with very many sources does not end up in one task.
    """
    in_order = Window.partitionBy("target_path").orderBy(path_order("rel_path"))
    return work.withColumn("source_rank", F.row_number().over(in_order)).filter(F.col("source_rank") <= keep)


def conflict_winners(work: DataFrame) -> DataFrame:
    """One source per target: the first in path order."""
    return rank_sources(work, keep=1).drop("source_rank")


def target_conflicts(work: DataFrame) -> DataFrame:
    """Targets claimed by more than one source: how many, and the first and last of them.

    A hash aggregate counts the claims, and only the rows of contested targets are ordered. Everything is
    folded before the shuffle; no list of sources is ever built.
    """
    order = path_order("rel_path")
    contested = work.groupBy("target_path").agg(F.count("*").alias("n")).filter("n > 1").select("target_path")
    return (
        work.join(contested, "target_path", "left_semi")
        .groupBy("target_path")
        .agg(
            F.count("*").alias("n_sources"),
            F.min_by("rel_path", order).alias("first_source"),
            F.max_by("rel_path", order).alias("last_source"),
        )
    )


def conflict_sources(work: DataFrame) -> DataFrame:
    """Every source of a contested target, a row each: ``target_path, rel_path, winner, n_sources``."""
    winners = target_conflicts(work).select("target_path", F.col("first_source").alias("winner"), "n_sources")
    return work.select("target_path", "rel_path").join(winners, "target_path").select(
        "target_path", "rel_path", "winner", "n_sources"
    )


# --- comparison ---------------------------------------------------------------------------------------


def _compare(
    work: DataFrame,
    target: DataFrame,
    how: str,
    window: int | None = 0,
    protect: Iterable[str] = (),
    strict: bool = True,
    newer_only: bool = False,
) -> DataFrame:
    present = target.select(
        F.col("rel_path").alias("target_path"),
        F.col("mtime").alias("target_mtime"),
        F.col("size").alias("target_size"),
        F.col("mode").alias("target_mode"),
        *[F.col(name) for name in target.columns if name == "data_version"],
        F.lit(True).alias("in_target"),
    )
    fresh = F.lit(False) if window is None else is_fresh("target_mtime", "mtime", window)
    if newer_only:
        fresh = fresh | (F.col("target_mtime") > F.col("mtime"))
    reason = (
        F.when(
            F.col("in_source").isNull(),
            F.when(matches_glob("target_path", protect, strict), "protected").otherwise("orphan"),
        )
        .when(F.col("in_target").isNull(), "new")
        .when(fresh, "fresh")
        .otherwise("stale")
    )
    action = (
        F.when(F.col("reason") == "protected", "keep")
        .when(F.col("reason") == "orphan", "delete")
        .when(F.col("reason") == "fresh", "skip")
        .when(F.col("converter").isNotNull(), "convert")
        .otherwise("copy")
    )
    joined = work.withColumn("in_source", F.lit(True)).join(present, "target_path", how)
    return joined.withColumn("reason", reason).withColumn("action", action)


def reconcile(
    ranked: DataFrame,
    target: DataFrame,
    window: int | None = 0,
    protect: Iterable[str] = (),
    strict: bool = True,
    newer_only: bool = False,
) -> DataFrame:
    """Work (see ``rank_sources``) and target manifest side by side: one pass that also finds orphans.

    ``reason`` is ``new``, ``stale`` or ``fresh`` for a source row and ``orphan`` or ``protected`` for
    a target without a source; ``action`` is ``convert``, ``copy``, ``skip``, ``delete`` or ``keep``.
    Both sides arrive partitioned by target path and cut down to a few rows per key, so the join adds no
    shuffle of its own and has no hot key.

    A target that is newer than its source is stale like an older one, unless ``newer_only`` is set. Without a window
    (None) no version counts as the same.
    """
    return _compare(ranked, latest_versions(target), "full", window, protect, strict, newer_only)


def classify(work: DataFrame, target: DataFrame, window: int = 0) -> DataFrame:
    """Every work row with its action and reason; ``target`` has one row per path.

    Targets shared by very many sources are left to the adaptive skew join, which can split the work
    side here because both sides are plain shuffles.
    """
    return _compare(work, target, "left", window).select(*PLAN_COLUMNS)


def known_targets(work: DataFrame) -> DataFrame:
    return work.select("target_path").distinct()


def orphan_files(target: DataFrame, work: DataFrame, protect: Iterable[str] = (), strict: bool = True) -> DataFrame:
    """Target rows that no work item accounts for, except those under a protecting glob."""
    known = known_targets(work).withColumnRenamed("target_path", "rel_path")
    return exclude_paths(target, protect, strict=strict).join(known, "rel_path", "left_anti")


def vanished(work: DataFrame, current: DataFrame) -> DataFrame:
    """Planned rows whose source is no longer there."""
    return work.join(current.select("rel_path"), "rel_path", "left_anti")
