"""Specs, plans and their execution."""

from tidemark.plans.digested import run_digested
from tidemark.plans.execution import ConflictError, EmptySourceError, PayloadError, SyncResult, apply, run_sync
from tidemark.plans.planning import SyncPlan, plan
from tidemark.plans.spec import SpecError, SyncSpec

__all__ = [
    "ConflictError",
    "EmptySourceError",
    "PayloadError",
    "SpecError",
    "SyncPlan",
    "SyncResult",
    "SyncSpec",
    "apply",
    "plan",
    "run_digested",
    "run_sync",
]
