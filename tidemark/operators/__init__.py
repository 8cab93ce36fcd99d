"""DataFrame operators of a sync run."""

from tidemark.operators.convert import Converters, copy_through, transform, transform_in_workers
from tidemark.operators.diff import (
    classify,
    conflict_sources,
    conflict_winners,
    known_targets,
    orphan_files,
    rank_sources,
    reconcile,
    target_conflicts,
    vanished,
)
from tidemark.operators.directories import (
    all_dirs,
    ancestor_dirs,
    deepest_first,
    missing_dirs,
    orphan_dirs,
    removable_dirs,
)
from tidemark.operators.filters import exclude_paths, keep_mapped
from tidemark.operators.reports import action_summary, failure_summary, in_path_order, scanned_count
from tidemark.operators.rules import RuleError, Rules, check_rules, map_paths, rule_errors, with_converter
from tidemark.operators.sweep import unoccupied

__all__ = [
    "Converters",
    "RuleError",
    "Rules",
    "action_summary",
    "all_dirs",
    "ancestor_dirs",
    "check_rules",
    "classify",
    "conflict_sources",
    "conflict_winners",
    "copy_through",
    "deepest_first",
    "exclude_paths",
    "failure_summary",
    "in_path_order",
    "keep_mapped",
    "known_targets",
    "map_paths",
    "missing_dirs",
    "orphan_dirs",
    "orphan_files",
    "rank_sources",
    "reconcile",
    "removable_dirs",
    "rule_errors",
    "scanned_count",
    "target_conflicts",
    "transform",
    "transform_in_workers",
    "unoccupied",
    "vanished",
    "with_converter",
]
