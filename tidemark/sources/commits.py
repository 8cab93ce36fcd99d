"""The list of published versions: one small file each, and a folded list of the older ones."""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from pyspark.sql import SparkSession


class CommitLog:
    """The commit files below ``base``, through the cluster's own file system layer.

    ``<version>.claim`` is created if absent, which gives a version to one writer only; what the version consists
    of is then written aside and moved to ``<version>.json``, so a reader sees all of it or nothing. Every
    ``FOLD_EVERY`` versions all entries are folded into ``<version>.fold``: reading the whole history takes one
    listing and opens a bounded number of files, however many versions there are.
    """

    FOLD_EVERY = 16

    def __init__(self, spark: SparkSession, base: str) -> None:
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.base = self._path(base.rstrip("/"))
        self._folder = self._path(base.rstrip("/") + "/_commits")
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self) -> dict[str, set[int]]:
        """The versions with a file of each kind."""
        found: dict[str, set[int]] = {"json": set(), "claim": set(), "fold": set()}
        if self._fs.exists(self._folder):
            for status in self._fs.listStatus(self._folder):
                if match := re.fullmatch(r"([0-9]{10,})[.](json|claim|fold)", status.getPath().getName()):
                    found[match[2]].add(int(match[1]))
        return found

    def _file(self, version: int, kind: str) -> Any:
        return self._path(self._folder, f"{version:010d}.{kind}")

    def _load(self, version: int, kind: str) -> Any:
        """What a file holds, or None for one that is cut short or gone."""
        try:
            stream = self._fs.open(self._file(version, kind))
        except Exception as error:
            if "FileNotFoundException" in str(error):
                return None
            raise
        try:
            content = bytes(stream.readAllBytes())
        finally:
            stream.close()
        try:
            return json.loads(content)
        except ValueError:
            return None

    def _put(self, version: int, kind: str, content: Any) -> None:
        aside = self._path(self._folder, f"{version:010d}.{kind}.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        try:
            stream.write(json.dumps(content).encode())
        finally:
            stream.close()
        if not self._fs.rename(aside, self._file(version, kind)):
            raise OSError(f"could not publish version {version}: {self._file(version, kind)} exists")

    def versions(self) -> list[int]:
        """All version numbers that are taken, published or not."""
        found = self._listed()
        return sorted(found["json"] | found["claim"])

    def read(self, version: int) -> dict[str, Any] | None:
        return self._load(version, "json")

    def entries(self) -> list[dict[str, Any]]:
        """All published versions, oldest first."""
        found = self._listed()
        folded: list[dict[str, Any]] = []
        for version in sorted(found["fold"], reverse=True):
            fold = self._load(version, "fold")
            # a fold counts only with the commit that it ends with
            if fold and fold[-1] == self.read(version):
                folded = fold
                break
        last = folded[-1]["version"] if folded else 0
        newer = (self.read(version) for version in sorted(found["json"]) if version > last)
        return folded + [entry for entry in newer if entry]

    def head(self) -> dict[str, Any] | None:
        for version in sorted(self._listed()["json"], reverse=True):
            if entry := self.read(version):
                return entry
        return None

    def next_version(self) -> int:
        return max(self.versions(), default=0) + 1

    def append(self, version: int, history: list[dict[str, Any]] | None = None, **entry: Any) -> None:
        """Publish; fails if another writer has taken the version.

        ``history`` replaces the entries before this one, which takes a fold; it is written first and counts only
        once the commit is there.
        """
        if self._fs.exists(self._file(version, "json")):
            raise FileExistsError(f"version {version} exists")
        self._fs.create(self._file(version, "claim"), False).close()
        entry = {"version": version, **entry}
        if history is not None:
            self._put(version, "fold", [*history, entry])
        self._put(version, "json", entry)
        if history is None and version % self.FOLD_EVERY == 0:
            self._put(version, "fold", self.entries())

    def trim(self) -> None:
        """Delete the files of versions that the newest fold tells about, but for its own commit."""
        found = self._listed()
        whole = [v for v in found["fold"] if (fold := self._load(v, "fold")) and fold[-1] == self.read(v)]
        for kind, versions in found.items():
            for version in versions:
                if whole and version < max(whole):
                    self._fs.delete(self._file(version, kind), False)

    def folders(self, *tables: str) -> list[tuple[str, int, str, int]]:
        """(table, version, run, time of its last change in milliseconds) of every folder of these tables."""
        out = []
        for table in tables:
            if not self._fs.exists(self._path(self.base, table)):
                continue
            for version in self._fs.listStatus(self._path(self.base, table)):
                for run in self._fs.listStatus(version.getPath()) if version.isDirectory() else ():
                    number, name = version.getPath().getName(), run.getPath().getName()
                    if number.startswith("version=") and name.startswith("run="):
                        out.append((table, int(number[8:]), name[4:], run.getModificationTime()))
        return out

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
