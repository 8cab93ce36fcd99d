"""Row filters of a sync run."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.globs import matches_glob


def exclude_paths(df: DataFrame, patterns: Iterable[str], path: str = "rel_path", strict: bool = True) -> DataFrame:
    """Rows whose path matches none of the globs: source files, source directories or target files.

    Excluding a directory does not exclude what lies below it; that takes a pattern of its own.
    """
    patterns = tuple(patterns)
    return df.filter(~matches_glob(path, patterns, strict)) if patterns else df


def keep_mapped(df: DataFrame, copy_unmatched: bool = True) -> DataFrame:
    """Rows with a converter, or all rows when unmapped ones are to be copied."""
    return df if copy_unmatched else df.filter(F.col("converter").isNotNull())
