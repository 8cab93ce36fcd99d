"""Counts over plans and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import path_order


def scanned_count(work: DataFrame) -> DataFrame:
    """Number of work items."""
    return work.agg(F.count("*").alias("scanned"))


def action_summary(plan: DataFrame) -> DataFrame:
    """Rows and bytes per action and reason."""
    return plan.groupBy("action", "reason").agg(
        F.count("*").alias("items"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )


def failure_summary(outcome: DataFrame) -> DataFrame:
    """Failed items per converter and exit code."""
    failed = outcome.filter(F.col("status") == "failed")
    return failed.groupBy("converter", "exit_code").agg(F.count("*").alias("failures"))


def in_path_order(df: DataFrame, path: str = "rel_path") -> DataFrame:
    """Rows sorted by path, component by component."""
    return df.orderBy(path_order(path))
