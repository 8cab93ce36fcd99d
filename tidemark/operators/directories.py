"""Directories implied by a manifest, the ones to create and the ones that can go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import parent_dir, path_order
from tidemark.operators.sweep import unoccupied


def parent_dirs(manifest: DataFrame, path: str = "rel_path") -> DataFrame:
    """The directory of each path below the root, as ``path``; repeated as often as it has entries."""
    return manifest.select(parent_dir(path).alias("path")).filter("path is not null")


def with_ancestors(dirs: DataFrame) -> DataFrame:
    """Distinct directories together with those above them.

    The input is made distinct first, so only directories, not files, are multiplied by their depth.
    """
    depth = F.char_length("path") - F.char_length(F.replace("path", F.lit("/"))) + F.lit(1)
    prefixes = dirs.distinct().select("path", F.explode(F.sequence(F.lit(1), depth)).alias("n"))
    return prefixes.select(F.expr("substring_index(path, '/', n)").alias("path")).distinct()


def ancestor_dirs(manifest: DataFrame, path: str = "rel_path") -> DataFrame:
    """Distinct directories above the paths of a manifest, as ``path``."""
    return with_ancestors(parent_dirs(manifest, path))


def all_dirs(manifest: DataFrame, listed: DataFrame | None = None, path: str = "rel_path") -> DataFrame:
    """Directories above the files, and the listed ones (which may be empty) with those above them."""
    parents = parent_dirs(manifest, path)
    return with_ancestors(parents if listed is None else parents.unionByName(listed.select("path")))


def missing_dirs(source_dirs: DataFrame, target_dirs: DataFrame) -> DataFrame:
    """Directories the target lacks."""
    return source_dirs.join(target_dirs, "path", "left_anti")


def orphan_dirs(target_dirs: DataFrame, known_dirs: DataFrame) -> DataFrame:
    """Target directories without a counterpart in the source."""
    return target_dirs.join(known_dirs, "path", "left_anti")


def removable_dirs(
    target_dirs: DataFrame, known_dirs: DataFrame, survivors: DataFrame, path: str = "rel_path", deep: bool = False
) -> DataFrame:
    """Orphan directories that are empty once the orphan files are gone.

    A directory stays when a surviving file or a known directory lies anywhere below it. Testing that
    against the ancestors of the survivors gives the end state of removing empty directories deepest
    first, without going through the depths one by one.

    That multiplies the occupied directories by their depth. For ``deep`` trees a sweep in path order gives the same
    directories and shuffles each path as often whatever its depth (see ``unoccupied``).
    """
    if deep:
        return unoccupied(target_dirs, parent_dirs(survivors, path).unionByName(known_dirs.select("path")))
    occupied = with_ancestors(parent_dirs(survivors, path).unionByName(parent_dirs(known_dirs, "path")))
    return orphan_dirs(target_dirs, known_dirs).join(occupied, "path", "left_anti")


def deepest_first(dirs: DataFrame) -> DataFrame:
    """Directories in an order in which each comes before the one that contains it."""
    return dirs.orderBy(path_order("path").desc())
