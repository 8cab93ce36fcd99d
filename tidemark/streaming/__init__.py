"""Incremental runs over a feed of changes."""

from tidemark.streaming.incremental import sync_batch, sync_stream
from tidemark.streaming.newest import newest_changes

__all__ = ["newest_changes", "sync_batch", "sync_stream"]
