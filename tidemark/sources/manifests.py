"""Manifests: one row per path with its version, never its content."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import ColumnOrName, as_column, rel_path

MANIFEST_SCHEMA = "rel_path string, mtime timestamp, size bigint, mode int"
_UTC = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def manifest_from(
    df: DataFrame,
    key: ColumnOrName,
    version: ColumnOrName,
    size: ColumnOrName | None = None,
    mode: ColumnOrName | None = None,
) -> DataFrame:
    """Manifest of any keyed table: an inventory, a catalogue, or a table with a version column.

    A version without a time zone is read as UTC, so the session has to run in UTC.
    """

    def optional(value: ColumnOrName | None, dtype: str) -> Column:
        return (F.lit(None) if value is None else as_column(value)).cast(dtype)

    chosen = df.select(
        as_column(key).cast("string").alias("rel_path"),
        as_column(version).alias("mtime"),
        optional(size, "bigint").alias("size"),
        optional(mode, "int").alias("mode"),
    )
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    if dict(chosen.dtypes)["mtime"] == "timestamp_ntz" and zone not in _UTC:
        raise ValueError(f"zone-less versions need spark.sql.session.timeZone=UTC, not {zone}")
    return chosen.withColumn("mtime", F.col("mtime").cast("timestamp"))


def latest_versions(manifest: DataFrame) -> DataFrame:
    """One row per path: its newest version, and of several of one time the one with the largest hash of its columns.

    A row is taken as a whole, and which one depends on the rows only. The aggregates all fit a hash aggregate, so
    a path with very many rows is folded before the shuffle.
    """
    carried = [name for name in manifest.columns if name not in ("rel_path", "mtime")]
    # time first, then 62 bits of hash, in one number; a version without a time comes before all others
    span = F.lit(1 << 62).cast("decimal(19,0)")
    time = F.coalesce(F.unix_micros("mtime"), F.lit(-(1 << 63))).cast("decimal(19,0)")
    tie = F.shiftrightunsigned(F.xxhash64(*carried) if carried else F.lit(0).cast("bigint"), 2)
    order = (time * span + tie.cast("decimal(19,0)")).cast("decimal(38,0)")
    ordered = manifest.withColumn("_order", order)
    newest = ordered.groupBy("rel_path").agg(
        F.max("mtime").alias("mtime"), *[F.max_by(name, "_order").alias(name) for name in carried]
    )
    return newest.select(manifest.columns)


def scan_manifest(spark: SparkSession, root: str) -> DataFrame:
    """List the files below ``root`` with Spark's file source; content is pruned from the read.

    Spark keeps the listing on the driver and leaves out names starting with ``.`` or ``_``. For very
    large trees use ``scan_tree`` or an inventory table through ``manifest_from``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # the path column carries the scheme (file:/a, hdfs://host/a), the root may not
    plain = F.regexp_replace("path", r"\A[a-z0-9]+:(?://[^/]*(?=/))?", "")
    return manifest_from(files, rel_path(plain, _plain_root(root)), "modificationTime", size="length")


def _plain_root(root: str) -> str:
    if "://" in root:
        rest = root.split("://", 1)[1]
        return "/" + rest.split("/", 1)[1] if "/" in rest else "/"
    return os.path.abspath(root.removeprefix("file:"))
