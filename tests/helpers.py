"""Small frames and readers for the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

MANIFEST = "rel_path string, seconds double, size long, mode int"


def manifest(spark, files, mode=0o644):
    """``{path: seconds since the epoch}`` as a manifest."""
    rows = [(path, float(seconds), 10, mode) for path, seconds in files.items()]
    return spark.createDataFrame(rows, MANIFEST).select(
        "rel_path",
        F.timestamp_micros((F.col("seconds") * 1_000_000).cast("long")).alias("mtime"),
        "size",
        "mode",
    )


def payload(spark, contents):
    rows = [(path, content if isinstance(content, bytes) else content.encode()) for path, content in contents.items()]
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "rel_path string, content binary")


def dirs(spark, paths):
    return spark.createDataFrame([(path,) for path in paths], "path string")


def paths_of(df, column="rel_path"):
    return sorted(row[column] for row in df.select(column).collect())


def contents(store):
    return {row.rel_path: bytes(row.content) for row in store.content().collect()}


def statuses(result):
    return {row.rel_path: row.status for row in result.outcome.collect()}
