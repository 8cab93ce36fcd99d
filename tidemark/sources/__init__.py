"""Manifests, content and published snapshots."""

from tidemark.sources.commits import CommitLog
from tidemark.sources.digests import DigestedManifest
from tidemark.sources.indexed import IndexedContent
from tidemark.sources.listing import Tree, list_tree, scan_tree
from tidemark.sources.manifests import latest_versions, manifest_from, scan_manifest
from tidemark.sources.payloads import load_payload
from tidemark.sources.scratch import scratch_dir
from tidemark.sources.trees import TreeContent, write_tree
from tidemark.sources.snapshots import SnapshotStore, read_snapshot, write_snapshot

__all__ = [
    "CommitLog",
    "DigestedManifest",
    "IndexedContent",
    "SnapshotStore",
    "Tree",
    "TreeContent",
    "latest_versions",
    "list_tree",
    "load_payload",
    "manifest_from",
    "read_snapshot",
    "scan_manifest",
    "scan_tree",
    "scratch_dir",
    "write_snapshot",
    "write_tree",
]
