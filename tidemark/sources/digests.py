"""Manifests with a tree of digests, so that two states can be compared without reading their rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import ColumnOrName, as_column, file_name
from tidemark.sources.commits import CommitLog
from tidemark.sources.manifests import MANIFEST_SCHEMA

#: children of a node of the digest tree
FANOUT = 16
DIGEST_SCHEMA = "level int, node int, digest string, rows bigint"


def path_bucket(path: ColumnOrName, buckets: int) -> Column:
    """The bucket of a path; a source and the target that any rule derives from it share theirs.

    Rules only replace what follows the last dot of a name, so the bucket is a hash of the folder and the name up
    to its first dot (the first character, a dot too, always counts).
    """
    path = as_column(path)
    name = file_name(path)
    folder = F.substr(path, F.lit(1), F.char_length(path) - F.char_length(name))
    kept = F.concat(folder, F.substr(name, F.lit(1), F.lit(1)), F.substring_index(F.substr(name, F.lit(2)), ".", 1))
    return F.pmod(F.xxhash64(kept), F.lit(buckets)).cast("int")


def levels_of(buckets: int) -> list[int]:
    """Nodes of each level of the tree, from the one root to the buckets."""
    sizes = [buckets]
    while sizes[0] > 1:
        sizes.insert(0, -(-sizes[0] // FANOUT))
    return sizes


def digest_leaves(manifest: DataFrame, buckets: int) -> DataFrame:
    """``(node, digest, rows)`` of every bucket, 0 rows included: independent of the order of the rows.

    Two different 64-bit hashes of each row (path, version, size and mode) are added up, one as an integer of any size
    and one bit by bit, so rows that come, go, change or are repeated show.
    """
    row = F.xxhash64("rel_path", F.unix_micros("mtime"), "size", "mode")
    other = F.xxhash64(F.lit("digest"), "mode", "size", F.unix_micros("mtime"), "rel_path")
    found = manifest.groupBy(path_bucket("rel_path", buckets).alias("node")).agg(
        F.count("*").alias("rows"), F.sum(row.cast("decimal(20,0)")).alias("total"), F.bit_xor(other).alias("mixed")
    )
    every = manifest.sparkSession.range(buckets).select(F.col("id").cast("int").alias("node"))
    spelled = F.concat_ws(":", F.col("rows").cast("string"), F.col("total").cast("string"), F.hex("mixed"))
    return every.join(found, "node", "left").select("node", F.coalesce(spelled, F.lit("0")).alias("digest"), F.coalesce("rows", F.lit(0)).alias("rows"))


def digest_tree(leaves: DataFrame, buckets: int) -> DataFrame:
    """All levels above and including ``leaves`` as ``DIGEST_SCHEMA``: a node's digest is that of its children's.

    A leaf without a digest, of which nothing is known, leaves all nodes above it without one.
    """
    sizes = levels_of(buckets)
    nodes = leaves.select(F.lit(len(sizes) - 1).alias("level"), "node", "digest", "rows")
    tree = nodes
    for level in range(len(sizes) - 2, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        nodes = nodes.groupBy((F.col("node") / FANOUT).cast("int").alias("node")).agg(
            F.when(F.count("digest") == F.count("*"), F.sha2(F.to_json(children), 256)).alias("digest"), F.sum("rows").alias("rows")
        )
        nodes = nodes.select(F.lit(level).alias("level"), "node", "digest", "rows")
        tree = tree.unionByName(nodes)
    return tree


def write_digests(tree: DataFrame, path: str) -> None:
    """A folder for each level, so that looking at the root opens one small file."""
    tree.repartition(1, "level").write.partitionBy("level").parquet(path)


def differing_buckets(spark: SparkSession, one: str, other: str, buckets: int) -> list[int]:
    """The buckets in which two written trees differ, or of which one knows nothing; compared from the root down.

    A level is read only below nodes that differ, and at most ``buckets`` numbers come to the driver.
    """
    open_nodes: list[int] = [0]
    for level, _ in enumerate(levels_of(buckets)):
        if level:
            open_nodes = [child for node in open_nodes for child in range(node * FANOUT, min((node + 1) * FANOUT, levels_of(buckets)[level]))]
        sides = [
            spark.read.schema("node int, digest string").parquet(f"{path}/level={level}").where(F.col("node").isin(open_nodes))
            for path in (one, other)
        ]
        both = sides[0].join(sides[1].withColumnRenamed("digest", "other"), "node", "full")
        same = F.coalesce(F.col("digest") == F.col("other"), F.lit(False))
        open_nodes = sorted(row.node for row in both.where(~same).select("node").collect())
        if not open_nodes:
            return []
    return open_nodes


class DigestedManifest:
    """Published states of a source, stored by bucket, each with its tree of digests."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = 256) -> None:
        self.spark = spark
        self.base = base.rstrip("/")
        self.buckets = buckets
        self.log = CommitLog(spark, base)

    def publish(self, manifest: DataFrame) -> int:
        """Write a state; its rows are shuffled once, to their buckets, and digested from what was written."""
        version, run = self.log.next_version(), uuid.uuid4().hex
        rows = manifest.select("rel_path", "mtime", "size", "mode").withColumn("bucket", path_bucket("rel_path", self.buckets))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(self._path("rows", version, run))
        written = self._rows(version, run).drop("bucket")
        write_digests(digest_tree(digest_leaves(written, self.buckets), self.buckets), self._path("digests", version, run))
        self.log.append(version, run=run, buckets=self.buckets)
        return version

    def _path(self, what: str, version: int, run: str) -> str:
        return f"{self.base}/{what}/version={version}/run={run}"

    def _rows(self, version: int, run: str) -> DataFrame:
        return self.spark.read.schema(MANIFEST_SCHEMA + ", bucket int").parquet(self._path("rows", version, run))

    def head(self) -> dict:
        head = self.log.head()
        if head is None:
            raise FileNotFoundError(f"no published state below {self.base}")
        if head["buckets"] != self.buckets:
            raise ValueError(f"the state has {head['buckets']} buckets, not {self.buckets}")
        return head

    def digests(self) -> str:
        """Where the digests of the newest state are."""
        head = self.head()
        return self._path("digests", head["version"], head["run"])

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The newest state, or its rows in some buckets: only their folders are listed and read."""
        head = self.head()
        rows = self._rows(head["version"], head["run"])
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")
