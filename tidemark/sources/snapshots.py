"""Published snapshots: written aside, then made visible by one small commit file.

Below ``base``, every table is written to a folder of its own and never changed afterwards. The commit of a
version names the folders that make it up; publishing that file is the only step that changes anything.

The state of a store (its manifest and its directories) is a base and the changes since, merged when it is
read. A run adds its changes only; ``compact`` merges them level by level, and ``vacuum`` deletes what no kept
version needs.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.commits import CommitLog
from tidemark.sources.manifests import MANIFEST_SCHEMA
from tidemark.sources.payloads import MAX_BROADCAST_KEY_BYTES

STORED_MANIFEST_SCHEMA = MANIFEST_SCHEMA + ", data_version bigint"
#: the tables of a state: their key and schema
STATE = {"manifest": ("rel_path", STORED_MANIFEST_SCHEMA), "dirs": ("path", "path string")}
#: all other tables of a version
RUN_TABLES = ("items", "vanished", "conflicts", "retired", "diff", "known", "changes", "digests", "ledger")
#: so many change sets of one level are merged into one of the next
FANOUT = 8
#: changes that amount to this share of the base are merged into it
BASE_SHARE = 0.5


class ConcurrentRunError(RuntimeError):
    """Another run has published since this one was planned."""


def write_snapshot(df: DataFrame, base: str) -> int:
    """Publish ``df`` as the next version of a dataset; readers see all of it or nothing."""
    log = CommitLog(df.sparkSession, base)
    version, run = log.next_version(), uuid.uuid4().hex
    df.write.parquet(f"{base.rstrip('/')}/snapshot/version={version}/run={run}")
    log.append(version, run=run)
    return version


def read_snapshot(spark: SparkSession, base: str) -> DataFrame:
    """The newest published version."""
    head = CommitLog(spark, base).head()
    if head is None:
        raise FileNotFoundError(f"no published snapshot below {base}")
    return spark.read.parquet(f"{base.rstrip('/')}/snapshot/version={head['version']}/run={head['run']}")


class SnapshotStore:
    """A sync target: a narrow manifest over content that is written once.

    The manifest says for every path which version wrote its content, so a run adds only the content that
    changed, however large the target is. ``manifest`` and ``dirs`` are the state: each commit lists the segments
    they consist of, a base (level -1) and the change sets after it, in which ``gone`` marks a deleted key.

    Tables of a run: ``items`` (content and outcome of worked items), ``vanished`` (items whose source was gone),
    ``conflicts`` (items that lost their target to another), ``retired`` (replaced or deleted content), ``diff`` (the
    comparison a run acted on), ``known`` (the source's directories) and, for feeds, ``changes``. A run that
    compares digests also keeps ``digests``, those of the source it has dealt with.
    """

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark = spark
        self.base = base.rstrip("/")
        self.log = CommitLog(spark, base)

    def commit(self, version: int, base: tuple[int, int], **entry: Any) -> None:
        """Publish what was planned against the state ``base``; fails if another run has published since."""
        self.expect(base)
        self.log.append(version, **entry)

    def expect(self, base: tuple[int, int]) -> None:
        """Raise unless the store is in the state ``base``."""
        if (now := self.state()) != base:
            raise ConcurrentRunError(f"planned against version {base[1]}, but version {now[1]} is published")

    def state(self) -> tuple[int, int]:
        """The newest version number taken, and the newest published version (0: none)."""
        head = self.log.head()
        return max(self.log.versions(), default=0), head["version"] if head else 0

    def path(self, table: str, version: int, run: str) -> str:
        return f"{self.base}/{table}/version={version}/run={run}"

    def _read(self, table: str, entries: list[dict[str, Any]]) -> DataFrame | None:
        paths = [self.path(table, entry["version"], entry["run"]) for entry in entries if table in entry["tables"]]
        return self.spark.read.option("basePath", f"{self.base}/{table}").parquet(*paths) if paths else None

    # --- state ---------------------------------------------------------------------------------------

    def write_segment(self, table: str, df: DataFrame, version: int, run: str, level: int) -> dict[str, Any] | None:
        """Write a base (level -1) or a change set, which has a column ``gone``; None for a change set without rows."""
        key = STATE[table][0]
        # counted while it is written, not by another pass
        seen = Observation()
        counted = df.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(key)), F.lit(0)).alias("bytes"))
        counted.write.mode("overwrite").parquet(self.path(table, version, run))
        if not seen.get["rows"] and level >= 0:
            return None
        return {"version": version, "run": run, "level": level, "rows": seen.get["rows"], "bytes": seen.get["bytes"]}

    def _segment(self, table: str, segment: dict[str, Any]) -> DataFrame:
        schema = STATE[table][1] + ("" if segment["level"] < 0 else ", gone boolean")
        return self.spark.read.schema(schema).parquet(self.path(table, segment["version"], segment["run"]))

    def _changes(self, table: str, segments: list[dict[str, Any]]) -> DataFrame:
        """The newest change of every key."""
        key = STATE[table][0]
        if len(segments) == 1:
            return self._segment(table, segments[0])
        numbered = [self._segment(table, segment).withColumn("_n", F.lit(n)) for n, segment in enumerate(segments)]
        union = reduce(DataFrame.unionByName, numbered)
        carried = F.struct(*(name for name in union.columns if name not in (key, "_n")))
        newest = union.groupBy(key).agg(F.max_by(carried, "_n").alias("_row"))
        return newest.select(key, "_row.*")

    def merged(self, table: str, segments: list[dict[str, Any]]) -> DataFrame:
        """The rows that a base and the changes after it amount to.

        While the keys of the changes take few bytes they are broadcast, and the base is not shuffled.
        """
        key, schema = STATE[table]
        if not segments:
            return self.spark.createDataFrame([], schema)
        base, rest = self._segment(table, segments[0]), segments[1:]
        if not rest:
            return base
        changes = self._changes(table, rest)
        keys = changes.select(key)
        if sum(segment["bytes"] for segment in rest) <= MAX_BROADCAST_KEY_BYTES:
            keys = F.broadcast(keys)
        return base.join(keys, key, "left_anti").unionByName(changes.where("not gone").select(base.columns))

    def _at(self, table: str, version: int | None) -> DataFrame:
        if version is None:
            entry = self.log.head()
        else:
            entry = next((e for e in self.log.entries() if e["version"] == version and e["segments"]), None)
            if entry is None:
                raise ValueError(f"version {version} is not published or no longer kept")
        return self.merged(table, entry["segments"][table] if entry else [])

    def segments(self) -> dict[str, list[dict[str, Any]]]:
        """What the current state consists of."""
        head = self.log.head()
        return {table: head["segments"][table] if head else [] for table in STATE}

    def manifest(self, version: int | None = None) -> DataFrame:
        """The target's rows. The frame remembers the state it shows, and a plan made from it carries that on.

        An older ``version`` can be read as long as ``vacuum`` keeps it.
        """
        state = self.state()
        frame = self._at("manifest", version)
        frame.store_state = state if version in (None, state[1]) else (version, version)
        return frame

    def dirs(self, version: int | None = None) -> DataFrame:
        return self._at("dirs", version)

    def compact(self, full: bool = False) -> bool:
        """Merge change sets, so reading the state stays cheap; what it reads as does not change.

        ``FANOUT`` sets of a level become one of the next level; sets with ``BASE_SHARE`` times the rows of the base,
        or any with ``full``, become a new base. So a row is rewritten a number of times that grows with the
        logarithm of the number of runs. True if there was anything to do.
        """
        state, head = self.state(), self.log.head()
        if head is None:
            return False
        version, run = state[0] + 1, f"compact-{uuid.uuid4().hex}"
        segments = dict(head["segments"])
        segments |= {table: self._compacted(table, segments[table], version, run, full) for table in STATE}
        if segments == head["segments"]:
            return False
        self.commit(version, state, run=run, tables=[], segments=segments, txns=head["txns"])
        return True

    def _compacted(self, table: str, live: list[dict[str, Any]], version: int, run: str, full: bool) -> list[dict[str, Any]]:
        changes = live[1:]
        if not changes:
            return live
        if full or sum(segment["rows"] for segment in changes) >= BASE_SHARE * live[0]["rows"]:
            return [self.write_segment(table, self.merged(table, live), version, run, -1)]
        first, level = len(changes), 0
        while True:
            start = first
            while start and changes[start - 1]["level"] == level:
                start -= 1
            # what was merged from below counts as one more of this level
            if first - start + (first < len(changes)) < FANOUT:
                break
            first, level = start, level + 1
        if first == len(changes):
            return live
        new = self.write_segment(table, self._changes(table, changes[first:]), version, run, level)
        return [live[0], *changes[:first], new]

    # --- content and outcomes ------------------------------------------------------------------------

    def content(self) -> DataFrame:
        """What runs have written of the current target: ``rel_path, mtime, size, mode, content``.

        These are the rows of the manifest with a ``data_version``. Rows taken over from an initial target have
        none: their content is where it was before.

        Runs list the content they replaced or deleted. As long as that list is small it is broadcast,
        so reading the target neither shuffles content nor needs the manifest; ``vacuum`` shortens it.
        """
        entries = self.log.entries()
        items = self._read("items", entries)
        if items is None:
            return self.manifest().limit(0).drop("data_version").withColumn("content", F.lit(None).cast("binary"))
        written = items.filter("status = 'ok'").select(
            F.col("target_path").alias("rel_path"),
            F.col("version").cast("bigint").alias("data_version"),
            "mtime",
            "size",
            "mode",
            "content",
        )
        retired = self._read("retired", entries)
        if retired is not None:
            retired = retired.select("rel_path", "data_version")
            if sum(entry.get("retired_bytes", 0) for entry in entries) <= MAX_BROADCAST_KEY_BYTES:
                retired = F.broadcast(retired)
            written = written.join(retired, ["rel_path", "data_version"], "left_anti")
        return written.drop("data_version")

    def outcomes(self) -> DataFrame | None:
        """One row per worked or vanished item of every published run that is kept, with its ``version``."""
        entries = [entry for entry in self.log.entries() if {"items", "vanished"} <= set(entry["tables"])]
        items, vanished = self._read("items", entries), self._read("vanished", entries)
        if items is None or vanished is None:
            return None
        return items.select(vanished.columns).unionByName(vanished).drop("run")

    def has_txn(self, txn: str) -> bool:
        """Has this transaction (``<stream>-<batch>``) been published?

        A stream publishes its batches in order, and every commit carries the newest one of each stream.
        """
        head = self.log.head()
        return bool(head) and head["txns"].get(txn.rpartition("-")[0]) == txn

    # --- cleaning up ---------------------------------------------------------------------------------

    def vacuum(self, keep: int = 1, min_age_seconds: float = 86_400) -> list[str]:
        """Delete what the ``keep`` newest runs and all since do not need; returns the deleted folders.

        Kept are their segments and outcomes, and all content that their manifests point to. Everything else of
        older, compacted, refused or unfinished runs goes, once it has not changed for ``min_age_seconds``: younger
        folders may belong to a run that is about to publish. First a version is published whose history no longer
        mentions what goes, then it is deleted; a vacuum that is cut short can simply be repeated.
        """
        if keep < 1:
            raise ValueError("the newest version cannot go")
        state, entries = self.state(), self.log.entries()
        if entries:
            runs = [n for n, entry in enumerate(entries) if entry["tables"]]
            first = runs[-keep] if len(runs) >= keep else 0
            older, kept = entries[:first], entries[first:]
            live = self._live_versions(kept)
            needed = self._versions_retiring(older, live)
            history = []
            for entry in older:
                tables = [t for t in entry["tables"] if t == "items" and entry["version"] in live or t == "retired" and entry["version"] in needed]
                if tables:
                    size = entry.get("retired_bytes", 0) if "retired" in tables else 0
                    history.append({**entry, "tables": tables, "segments": {}, "retired_bytes": size})
            history += kept
            if history != entries:
                run, head = f"vacuum-{uuid.uuid4().hex}", entries[-1]
                self.commit(state[0] + 1, state, history=history, run=run, tables=[], segments=head["segments"], txns=head["txns"])
                self.log.trim()
        marked = set()
        for entry in self.log.entries():
            marked |= {(table, entry["version"], entry["run"]) for table in entry["tables"]}
            marked |= {(table, s["version"], s["run"]) for table, segments in entry["segments"].items() for s in segments}
        before, gone = (time.time() - min_age_seconds) * 1000, []
        for table, version, run, changed in self.log.folders(*STATE, *RUN_TABLES):
            if (table, version, run) not in marked and changed <= before:
                gone.append(self.path(table, version, run))
                self.log.delete(gone[-1])
        return gone

    def _live_versions(self, kept: list[dict[str, Any]]) -> set[int]:
        """The versions whose content the manifests of these entries point to: at most one row for each version."""
        manifests = [self.merged("manifest", entry["segments"]["manifest"]).select("data_version") for entry in kept]
        rows = reduce(DataFrame.unionByName, manifests).where("data_version is not null").distinct().collect()
        return {row.data_version for row in rows}

    def _versions_retiring(self, entries: list[dict[str, Any]], live: set[int]) -> set[int]:
        """The versions whose lists of retired content tell about content that is still there."""
        retired = self._read("retired", entries)
        if retired is None:
            return set()
        there = self.spark.createDataFrame([(v,) for v in live], "data_version bigint")
        rows = retired.join(F.broadcast(there), "data_version", "left_semi").select("version").distinct().collect()
        return {int(row.version) for row in rows}
