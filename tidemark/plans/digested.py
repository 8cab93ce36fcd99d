"""Runs that read only where the source has changed since the run before."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.directories import all_dirs
from tidemark.operators.rules import check_rules
from tidemark.plans.execution import OUTCOME_SCHEMA, SyncResult, apply
from tidemark.plans.planning import plan
from tidemark.plans.spec import SyncSpec
from tidemark.sources.digests import DigestedManifest, differing_buckets, digest_tree, path_bucket, write_digests
from tidemark.sources.payloads import Payload
from tidemark.sources.snapshots import SnapshotStore


def spec_digest(spec: SyncSpec) -> str:
    """A hash of all that decides what a run does with a row; of converters in Python only their names."""
    parts = [repr((spec.copy_unmatched, spec.source_exclude, spec.target_exclude, spec.modify_window, spec.on_conflict, spec.allow_empty_output))]
    parts.append(repr((sorted(spec.converters.expressions), sorted(spec.converters.udfs), sorted(spec.converters.commands.items()))))
    for table in (spec.rules.mappings, spec.rules.converters):
        rows = table.select(F.xxhash64(F.to_json(F.struct("*"))).alias("h"))
        parts.append(repr(tuple(rows.agg(F.count("*"), F.sum(F.col("h").cast("decimal(20,0)")), F.bit_xor("h")).first())))
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def run_digested(spec: SyncSpec, source: DigestedManifest, payload: Payload, store: SnapshotStore) -> SyncResult:
    """Bring the store in step with the newest state of ``source``, reading only buckets that need it.

    A run keeps the digests of the source it has dealt with, without those of buckets in which an item failed,
    vanished or lost its target. The next one compares digests from the root down: where they are equal, no row is
    read on either side, and a source that has not changed costs a few small files. After a run of another kind,
    other rules, or another number of buckets everything is compared. The outcome has the items of the
    compared buckets.
    """
    spark = store.spark
    check_rules(spec.rules)
    head, state, wanted = store.log.head(), store.state(), spec_digest(spec)
    known = (head["segments"].get("digests") or [None])[0] if head else None
    buckets = None
    if known and known["spec"] == wanted and known["buckets"] == source.buckets:
        before = store.path("digests", known["version"], known["run"])
        buckets = differing_buckets(spark, before, source.digests(), source.buckets)
        if not buckets:
            return SyncResult(spark.createDataFrame([], OUTCOME_SCHEMA), head["version"], False)
    target, everything = store.manifest(), source.rows()
    if buckets is not None:
        target = target.where(path_bucket("rel_path", source.buckets).isin(buckets))
    intended = plan(spec, source.rows(buckets), target, all_dirs(everything), store.dirs(), base=state)
    # whether the source is empty, and who else claims a contested target, is a matter of the whole source
    intended = replace(intended, source=everything)
    version, run = state[0] + 1, f"digests-{uuid.uuid4().hex}"
    path = store.path("digests", version, run)

    def settled(outcome: DataFrame) -> dict:
        """The digests of the source but for buckets with open ends, written for the commit that follows."""
        ends = outcome.where("status in ('failed', 'vanished', 'conflict')")
        open_ones = ends.select(path_bucket("rel_path", source.buckets).alias("node")).distinct().withColumn("open", F.lit(True))
        last = spark.read.parquet(source.digests())
        leaves = last.where(F.col("level") == F.lit(last.agg(F.max("level")).first()[0]))
        leaves = leaves.join(F.broadcast(open_ones), "node", "left").withColumn("digest", F.when(F.col("open").isNull(), F.col("digest")))
        write_digests(digest_tree(leaves.select("node", "digest", "rows"), source.buckets), path)
        return {"version": version, "run": run, "level": -1, "rows": 0, "bytes": 0, "spec": wanted, "buckets": source.buckets}

    return apply(intended, payload, store, rules_checked=True, settled=settled)
