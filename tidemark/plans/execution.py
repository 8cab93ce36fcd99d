"""Carrying out a plan: stage, transform, publish."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.convert import OUTCOME_COLUMNS, transform, transform_in_workers
from tidemark.operators.directories import parent_dirs, with_ancestors
from tidemark.operators.rules import RuleError, check_rules
from tidemark.plans.planning import SyncPlan, plan
from tidemark.plans.spec import SyncSpec
from tidemark.sources.payloads import MAX_BROADCAST_KEY_BYTES, Payload, load_payload, repeated_content
from tidemark.sources.trees import TreeContent
from tidemark.sources.snapshots import STATE, STORED_MANIFEST_SCHEMA, SnapshotStore

#: content and items per task, and content per Arrow batch of the Python converters
PARTITION_BYTES = 128 << 20
PARTITION_ITEMS = 100_000
WORKER_BATCH_BYTES = 32 << 20
#: no run has more tasks than this for its content; beyond it tasks grow, which streams and spills allow
MAX_TASKS = 20_000
#: assumed when the manifest has no sizes
UNKNOWN_SIZE = 1 << 20
OUTCOME_SCHEMA = (
    "rel_path string, target_path string, action string, converter string, status string, exit_code int, "
    "message string, mtime timestamp"
)
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


class ConflictError(RuntimeError):
    """Several sources share one target."""


class PayloadError(RuntimeError):
    """The content table is not keyed by path."""


class EmptySourceError(RuntimeError):
    """An empty source would delete the whole target."""


@dataclass(frozen=True)
class SyncResult:
    """``outcome`` has one row per item, whatever became of it; ``version`` is the current one.

    An item whose target another source has taken is there with the status ``conflict``.
    """

    outcome: DataFrame
    version: int | None
    published: bool


def staged(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write once and go on from the written table, so nothing is computed twice."""
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _statistics(diff: DataFrame) -> list[Row]:
    """Counts and sizes per kind of row: a handful of groups."""
    size = F.coalesce("size", F.lit(UNKNOWN_SIZE))
    return (
        diff.groupBy("action", "reason", "kind", "source_rank")
        .agg(
            F.count("*").alias("items"),
            F.sum(size).alias("bytes"),
            F.sum(F.octet_length("target_path") + F.octet_length(F.coalesce("rel_path", F.lit("")))).alias("key_bytes"),
        )
        .collect()
    )


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound the bytes per Arrow batch, since rows carry whole contents."""
    before = spark.conf.get(_BATCH_BYTES)
    spark.conf.set(_BATCH_BYTES, str(WORKER_BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)


def _guard(plan: SyncPlan, statistics: list[Row], diff: DataFrame) -> None:
    if plan.spec.on_conflict == "error" and any(row.source_rank == 2 for row in statistics):
        shown = diff.filter("source_rank = 2").select("target_path").orderBy("target_path").limit(5).collect()
        raise ConflictError("several sources for " + ", ".join(row.target_path for row in shown))
    deletes = any(row.action == "delete" for row in statistics)
    has_work = any(row.source_rank is not None for row in statistics)
    if deletes and not has_work and not plan.spec.allow_empty_source and plan.source.isEmpty():
        raise EmptySourceError("the source is empty and the target is not")


def _tasks(spark: SparkSession, rows: list[Row], command_items: int) -> int:
    """Partitions for items of known total size: the cost follows the bytes and the commands, the memory the rows."""
    wanted = max(
        math.ceil(sum(row.bytes for row in rows) / PARTITION_BYTES),
        math.ceil(sum(row["items"] for row in rows) / PARTITION_ITEMS),
        math.ceil(sum(row["items"] for row in rows if row.kind == "command") / command_items),
    )
    return max(spark.sparkContext.defaultParallelism, min(wanted, MAX_TASKS))


def _check_work(plan: SyncPlan, diff: DataFrame, payload: Payload, statistics: list[Row]) -> None:
    """Raise for what would make the run fail after all converters have worked."""
    spec, worked = plan.spec, diff.filter(F.col("action").isin("convert", "copy"))
    for kind, known in (("expression", spec.converters.expressions), ("udf", spec.converters.udfs)):
        unknown = spec.rules.converters.filter((F.col("kind") == kind) & ~F.col("name").isin(*known))
        if any(row.kind == kind for row in statistics) and not unknown.isEmpty():
            names = worked.filter((F.col("kind") == kind) & ~F.col("converter").isin(*known)).select("converter").distinct()
            if missing := sorted(row.converter for row in names.limit(5).collect()):
                raise RuleError(f"no {kind} is registered for {', '.join(missing)}")
    key_bytes = sum(row.key_bytes for row in statistics if row.action in ("convert", "copy"))
    if shown := repeated_content(payload, worked, key_bytes).limit(5).collect():
        raise PayloadError("a path has more than one content: " + ", ".join(sorted(row.rel_path for row in shown)))


def _transformed(plan: SyncPlan, diff: DataFrame, payload: Payload, statistics: list[Row], ledger: str) -> DataFrame:
    """The worked items with their content; outputs of commands are recorded in ``ledger`` if the spec says so."""
    spec, spark = plan.spec, diff.sparkSession
    work = diff.filter(F.col("action").isin("convert", "copy")).select(
        "rel_path", "target_path", "action", "converter", "kind", "mtime", "mode"
    )
    todo = [row for row in statistics if row.action in ("convert", "copy")]
    in_workers = [row for row in todo if row.kind in ("udf", "command")]
    on_jvm = [row for row in todo if row.kind not in ("udf", "command")]
    parts: list[DataFrame] = []
    record = None if spec.record_seconds is None else (ledger, spec.record_seconds)
    python_kind = F.coalesce(F.col("kind").isin("udf", "command"), F.lit(False))
    if on_jvm:
        key_bytes, tasks = sum(row.key_bytes for row in on_jvm), _tasks(spark, on_jvm, spec.command_items)
        loaded = load_payload(payload, work.filter(~python_kind), key_bytes, tasks)
        parts.append(transform(loaded, spec.converters, spec.allow_empty_output))
    if in_workers:
        key_bytes, tasks = sum(row.key_bytes for row in in_workers), _tasks(spark, in_workers, spec.command_items)
        loaded = load_payload(payload, work.filter(python_kind), key_bytes, tasks)
        if key_bytes <= MAX_BROADCAST_KEY_BYTES and not isinstance(payload, TreeContent):
            # the content sits where it was read; spread the work
            loaded = loaded.repartition(tasks, "rel_path")
        parts.append(
            transform_in_workers(
                loaded,
                spec.rules.converters,
                spec.converters,
                spec.allow_empty_output,
                spec.command_timeout,
                spec.rules.bounded,
                record,
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _small(statistics: list[Row]) -> bool:
    """Is the list of worked items small enough to broadcast?"""
    worked = (row.key_bytes for row in statistics if row.action in ("convert", "copy"))
    return sum(worked) <= MAX_BROADCAST_KEY_BYTES


def _hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _vanished(diff: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """Planned items whose content was gone, as outcome rows."""
    planned = diff.filter(F.col("action").isin("convert", "copy"))
    return planned.join(_hinted(items.select("rel_path"), small), "rel_path", "left_anti").select(
        "rel_path",
        "target_path",
        "action",
        "converter",
        F.lit("vanished").alias("status"),
        F.lit(None).cast("int").alias("exit_code"),
        F.lit("source is gone").alias("message"),
        "mtime",
    )


def _skipped(diff: DataFrame) -> DataFrame:
    return diff.filter("action = 'skip' and source_rank = 1").select(
        "rel_path",
        "target_path",
        "action",
        "converter",
        F.lit("skipped").alias("status"),
        F.lit(None).cast("int").alias("exit_code"),
        F.lit(None).cast("string").alias("message"),
        "mtime",
    )


def _beaten(plan: SyncPlan, diff: DataFrame) -> DataFrame:
    """Sources whose target another one has taken, as outcome rows; the staged comparison says which one won."""
    contested = diff.filter("source_rank = 2").select("target_path")
    winners = diff.filter("source_rank = 1").join(contested, "target_path", "left_semi")
    winners = winners.select("target_path", F.col("rel_path").alias("winner"))
    return (
        plan.items.join(winners, "target_path")
        .filter("rel_path <> winner")
        .select(
            "rel_path",
            "target_path",
            F.lit("skip").alias("action"),
            "converter",
            F.lit("conflict").alias("status"),
            F.lit(None).cast("int").alias("exit_code"),
            F.concat(F.lit("target taken by "), "winner").alias("message"),
            "mtime",
        )
    )


def stamp(items: DataFrame, version: int) -> DataFrame:
    """Manifest rows of the items that succeeded: they carry the source's version and mode."""
    return items.filter("status = 'ok'").select(
        F.col("target_path").alias("rel_path"), "mtime", "size", "mode", F.lit(version).cast("bigint").alias("data_version")
    )


def next_manifest(diff: DataFrame, stamped: DataFrame, small: bool = False) -> DataFrame:
    """The target's manifest after the run.

    Rows that nothing happened to pass straight through; only stale rows have to be checked for a
    replacement. A failed item leaves the old target row in place; orphans are dropped.
    """
    previous = diff.select(
        "action",
        "reason",
        F.col("target_path").alias("rel_path"),
        F.col("target_mtime").alias("mtime"),
        F.col("target_size").alias("size"),
        F.col("target_mode").alias("mode"),
        (F.col("data_version") if "data_version" in diff.columns else F.lit(None)).cast("bigint").alias("data_version"),
    )
    untouched = previous.filter(F.col("action").isin("skip", "keep"))
    written = _hinted(stamped.select("rel_path"), small)
    unreplaced = previous.filter("reason = 'stale'").join(written, "rel_path", "left_anti")
    return untouched.unionByName(unreplaced).drop("action", "reason").unionByName(stamped)


def retired_content(diff: DataFrame, stamped: DataFrame, small: bool = False) -> DataFrame:
    """Content of the previous version that the run replaced or deleted."""
    had = diff.filter("data_version is not null").select(
        F.col("target_path").alias("rel_path"), "data_version", "action", "reason"
    )
    written = _hinted(stamped.select("rel_path"), small)
    replaced = had.filter("reason = 'stale'").join(written, "rel_path", "left_semi")
    return had.filter("action = 'delete'").unionByName(replaced).select("rel_path", "data_version")


def next_dirs(plan: SyncPlan, manifest: DataFrame, stamped: DataFrame) -> DataFrame:
    """The target's directories after the run: the known ones and all that lead to something.

    What would be removed is just the rest of the target's directories, so those need not be read. A
    feed of changes only adds directories.
    """
    if plan.prunes:
        return with_ancestors(plan.known_dirs.unionByName(parent_dirs(manifest)))
    return with_ancestors(plan.known_dirs.unionByName(parent_dirs(stamped)).unionByName(plan.target_dirs))


def manifest_changes(diff: DataFrame, stamped: DataFrame) -> DataFrame:
    """What the run changes in the target's manifest: rows written, and the paths of deleted ones marked ``gone``."""
    deleted = diff.filter("action = 'delete'").select(F.col("target_path").alias("rel_path"), F.lit(True).alias("gone"))
    written = stamped.withColumn("gone", F.lit(False))
    return written.unionByName(deleted, allowMissingColumns=True)


def dir_changes(plan: SyncPlan, before: DataFrame, manifest: DataFrame, stamped: DataFrame, small: bool = False) -> DataFrame:
    """Directories that the run adds to those before it, and, marked ``gone``, those it removes."""
    if plan.prunes:
        now = next_dirs(plan, manifest, stamped).withColumn("now", F.lit(True))
        both = now.join(before.withColumn("was", F.lit(True)), "path", "full").where("now is null or was is null")
        return both.select("path", F.col("now").isNull().alias("gone"))
    new = with_ancestors(plan.known_dirs.unionByName(parent_dirs(stamped)))
    there = before.join(_hinted(new, small), "path", "left_semi")
    return new.join(there, "path", "left_anti").withColumn("gone", F.lit(False))


def apply(
    plan: SyncPlan,
    payload: Payload,
    store: SnapshotStore,
    txn: str | None = None,
    rules_checked: bool = False,
    settled: Callable[[DataFrame], dict] | None = None,
) -> SyncResult:
    """Carry out ``plan``, reading ``payload(rel_path, content)`` only for rows that need work.

    The comparison and the transformed items are each written once; the outcome and the new manifest
    read them back. A run that finds nothing to do reads no content and publishes nothing. A
    transaction name (``<stream>-<batch>``) makes a repeated call a no-op. If another run has published
    since the manifest that the plan was made from, nothing is read, or nothing is published if that
    happens meanwhile. Converters without a function and paths with several contents are found before
    anything is converted. The manifest and the directories are published as changes to the version before.
    ``settled`` is told the outcome and gives the segment of digests to publish with it, also if nothing else
    has to be.
    """
    spark = store.spark
    if txn is not None and not re.fullmatch(r"[A-Za-z0-9_.]+-[0-9]+", txn):
        raise ValueError(f"a transaction is named <stream>-<batch>, not {txn!r}")
    if not rules_checked:
        check_rules(plan.spec.rules)
    head = store.log.head()
    if txn is not None and store.has_txn(txn):
        return SyncResult(spark.createDataFrame([], OUTCOME_SCHEMA), head["version"], False)
    if plan.base is None and head is not None:
        raise ValueError("the plan does not say which state of the store it was made from: give plan() base=store.state()")
    base = plan.base or store.state()  # a target that is no store's suits a store without versions only
    store.expect(base)
    version, run = base[0] + 1, txn or uuid.uuid4().hex
    # the same for a run that is started again after it broke off
    ledger = store.path("ledger", version, "commands")

    diff = staged(spark, plan.diff, store.path("diff", version, run))
    # directories follow from the same comparison: neither it nor the source's directories are derived again
    known = staged(spark, plan.known_dirs, store.path("known", version, run))
    plan = replace(plan, diff=diff, known_dirs=known)
    statistics = _statistics(diff)
    _guard(plan, statistics, diff)
    beaten = None
    if any(row.source_rank == 2 for row in statistics):
        beaten = staged(spark, _beaten(plan, diff), store.path("conflicts", version, run))
        diff = diff.filter("source_rank is null or source_rank = 1")
        statistics = [row for row in statistics if row.source_rank != 2]
    skipped = _skipped(diff) if beaten is None else _skipped(diff).unionByName(beaten)

    actions = {row.action for row in statistics}
    if not actions & {"convert", "copy", "delete"} and plan.creates.isEmpty() and plan.delete_dirs.isEmpty():
        if settled is None or head is None:
            return SyncResult(skipped, head["version"] if head else None, False)
        segments = {**head["segments"], "digests": [settled(skipped)]}
        store.commit(version, base, run=run, tables=[], txns=head["txns"], segments=segments)
        return SyncResult(skipped, version, True)

    tables = [] if beaten is None else ["conflicts"]
    small = _small(statistics)
    if actions & {"convert", "copy"}:
        _check_work(plan, diff, payload, statistics)
        with _small_batches(spark):
            items = staged(spark, _transformed(plan, diff, payload, statistics, ledger), store.path("items", version, run))
        gone = staged(spark, _vanished(diff, items, small), store.path("vanished", version, run))
        planned = sum(row["items"] for row in statistics if row.action in ("convert", "copy"))
        if items.count() + gone.count() != planned:
            raise PayloadError("a path has more than one content")
        tables += ["items", "vanished"]
        outcome = items.select(*OUTCOME_COLUMNS).unionByName(gone).unionByName(skipped)
        stamped = stamp(items, version)
    else:
        outcome = skipped
        stamped = spark.createDataFrame([], STORED_MANIFEST_SCHEMA)

    segments = {table: head["segments"][table] for table in STATE} if head else {}
    if head is None:
        after = next_manifest(diff, stamped, small)
        if plan.rest is not None:
            after = after.unionByName(plan.rest.select(after.columns))
        segments["manifest"] = [store.write_segment("manifest", after, version, run, -1)]
        manifest = store.merged("manifest", segments["manifest"])
        segments["dirs"] = [store.write_segment("dirs", next_dirs(plan, manifest, stamped), version, run, -1)]
    else:
        new = store.write_segment("manifest", manifest_changes(diff, stamped), version, run, 0)
        segments["manifest"] = [*segments["manifest"], *([new] if new else [])]
        manifest = store.merged("manifest", segments["manifest"])
        changed = dir_changes(plan, store.merged("dirs", segments["dirs"]), manifest, stamped, small)
        new = store.write_segment("dirs", changed, version, run, 0)
        segments["dirs"] = [*segments["dirs"], *([new] if new else [])]
    retired_bytes = sum(row.key_bytes for row in statistics if row.reason in ("stale", "orphan"))
    if retired_bytes and "data_version" in diff.columns:
        retired = retired_content(diff, stamped, small)
        retired.write.mode("overwrite").parquet(store.path("retired", version, run))
        tables.append("retired")
    if settled is not None:
        segments["digests"] = [settled(outcome)]
    txns = dict(head["txns"]) if head else {}
    if txn is not None:
        txns[txn.rpartition("-")[0]] = txn
    store.commit(version, base, run=run, tables=tables, txns=txns, retired_bytes=retired_bytes, segments=segments)
    if plan.spec.record_seconds is not None:
        store.log.delete(ledger)
    return SyncResult(outcome, version, True)


def run_sync(
    spec: SyncSpec,
    source: DataFrame,
    payload: Payload,
    store: SnapshotStore,
    source_dirs: DataFrame | None = None,
    initial_target: DataFrame | None = None,
) -> SyncResult:
    """Plan against the store's current version and carry the plan out.

    ``initial_target`` stands in for the store's manifest until there is a published version.
    """
    fresh_store = store.log.head() is None
    target = initial_target if fresh_store and initial_target is not None else store.manifest()
    base = (max(store.log.versions(), default=0), 0) if fresh_store else None
    return apply(plan(spec, source, target, source_dirs, store.dirs(), base=base), payload, store)
