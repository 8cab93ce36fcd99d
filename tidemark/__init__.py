"""Keyed-snapshot synchronization on Spark.

A source manifest, a target manifest and a table of rules become a plan; the plan converts, copies or
deletes what differs and publishes the result as a new snapshot.
"""

from tidemark.operators import Converters, Rules
from tidemark.plans import SyncPlan, SyncResult, SyncSpec, apply, plan, run_digested, run_sync
from tidemark.sources import DigestedManifest, IndexedContent, SnapshotStore, TreeContent, manifest_from, scan_manifest, scan_tree, write_tree
from tidemark.streaming import sync_stream

__all__ = [
    "Converters",
    "DigestedManifest",
    "IndexedContent",
    "Rules",
    "SnapshotStore",
    "SyncPlan",
    "SyncResult",
    "SyncSpec",
    "TreeContent",
    "apply",
    "manifest_from",
    "plan",
    "run_digested",
    "run_sync",
    "scan_manifest",
    "scan_tree",
    "sync_stream",
    "write_tree",
]
