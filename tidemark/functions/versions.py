"""Version columns: how far two versions are apart and when a target counts as fresh."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.paths import ColumnOrName, as_column


def version_gap(target: ColumnOrName, source: ColumnOrName) -> Column:
    """Distance in whole (floored) seconds."""
    return F.abs(F.unix_seconds(as_column(target)) - F.unix_seconds(as_column(source)))


def is_fresh(target: ColumnOrName, source: ColumnOrName, window: int = 0) -> Column:
    """Does the target carry the source's version?

    A negative ``window`` asks for equality at full (microsecond) precision; otherwise versions up to
    ``window`` whole seconds apart, in either direction, count as the same.
    """
    if window < 0:
        return as_column(target) == as_column(source)
    return version_gap(target, source) <= F.lit(window)
