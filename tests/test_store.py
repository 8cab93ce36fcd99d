"""The store's state as a base and changes, its compaction and vacuum, and content that is looked up by an index."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.helpers import contents, manifest, paths_of, payload, statuses
from tests.test_run import spec, untouchable
from tidemark import Converters, SyncSpec, apply, plan, run_sync
from tidemark.operators import RuleError, Rules
from tidemark.plans import PayloadError
from tidemark.sources import CommitLog, IndexedContent, snapshots
from tidemark.sources.indexed import RepeatedKeyError
from tidemark.sources.snapshots import ConcurrentRunError


def publish(store, changes, first=False):
    """Publish ``{path: size, or None for gone}`` as a base or as a change set."""
    state, head = store.state(), store.log.head()
    version, run = state[0] + 1, f"r{state[0]}"
    rows = [(path, size, size is None) for path, size in changes.items()]
    df = store.spark.createDataFrame(rows, "rel_path string, size bigint, gone boolean")
    df = df.selectExpr("rel_path", "cast(null as timestamp) mtime", "size", "cast(null as int) mode", f"{version}L data_version", "gone")
    segments = dict(head["segments"]) if head else {"manifest": [], "dirs": []}
    new = store.write_segment("manifest", df.drop("gone") if first else df, version, run, -1 if first else 0)
    segments["manifest"] = [*segments["manifest"], new]
    store.commit(version, state, run=run, tables=[], txns={}, segments=segments)


def sizes(store, version=None):
    return {row.rel_path: row["size"] for row in store.manifest(version).collect()}


def folders(store):
    return sorted(str(p.relative_to(store.base)) for p in Path(store.base).glob("[a-z]*/version=*/run=*"))


@pytest.mark.parametrize("limit", [-1, 1 << 20])
def test_compaction_changes_no_read(spark, store, monkeypatch, limit):
    monkeypatch.setattr(snapshots, "MAX_BROADCAST_KEY_BYTES", limit)
    monkeypatch.setattr(snapshots, "FANOUT", 3)
    rng = random.Random(limit)
    expected = {f"p{n}": n for n in range(60)}
    publish(store, expected, first=True)
    levels = []
    for round_number in range(9):
        changes = {f"p{rng.randrange(70)}": rng.choice([None, 1000 + round_number]) for _ in range(2)}
        publish(store, changes)
        for path, size in changes.items():
            expected.pop(path, None)
            if size is not None:
                expected[path] = size
        before = store.manifest()
        compacted = store.compact()
        assert sizes(store) == expected == {row.rel_path: row["size"] for row in before.collect()}
        levels.append([s["level"] for s in store.segments()["manifest"]])
        assert compacted == (round_number % 3 == 2)
    assert levels == [[-1, 0], [-1, 0, 0], [-1, 1], [-1, 1, 0], [-1, 1, 0, 0], [-1, 1, 1], [-1, 1, 1, 0], [-1, 1, 1, 0, 0], [-1, 2]]
    assert store.compact(full=True) and not store.compact(full=True)
    assert sizes(store) == expected and len(store.segments()["manifest"]) == 1
    assert sizes(store, version=1) == {f"p{n}": n for n in range(60)}


def test_many_changes_become_a_base(spark, store):
    publish(store, {"a": 1, "b": 2}, first=True)
    publish(store, {"a": None, "c": 3})
    assert store.compact() and [s["level"] for s in store.segments()["manifest"]] == [-1]
    assert sizes(store) == {"b": 2, "c": 3}


def test_a_run_writes_its_changes_only(spark, store):
    files = {f"d{n % 7}/f{n}": 1 for n in range(300)}
    run_sync(spec(spark), manifest(spark, files), payload(spark, dict.fromkeys(files, "x")), store)
    changed = {**files, "d0/f0": 9, "new/g": 1}
    del changed["d1/f1"]
    run_sync(spec(spark), manifest(spark, changed), payload(spark, dict.fromkeys(changed, "y")), store)
    written = {table: segments[-1]["rows"] for table, segments in store.segments().items()}
    assert written == {"manifest": 3, "dirs": 1} and [len(s) for s in store.segments().values()] == [2, 2]
    after = dict(contents(store))
    assert paths_of(store.manifest()) == sorted(changed) == sorted(after) and paths_of(store.dirs(), "path") == sorted({*(f"d{n}" for n in range(7)), "new"})
    assert store.compact(full=True) and contents(store) == after and paths_of(store.manifest()) == sorted(changed)
    # the compacted state is a state like any other
    assert not run_sync(spec(spark), manifest(spark, changed), untouchable(spark), store).published
    left = {path: 1 for path in changed if path != "new/g"} | {"d0/f0": 9}
    assert run_sync(spec(spark), manifest(spark, left), untouchable(spark), store).published
    assert "new" not in paths_of(store.dirs(), "path") and "new/g" not in contents(store)


def test_vacuum_deletes_what_no_kept_version_needs(spark, store):
    files = payload(spark, {"a": "1", "b": "1", "c": "1"})
    run_sync(spec(spark), manifest(spark, {"a": 1, "b": 1}), files, store)
    run_sync(spec(spark), manifest(spark, {"a": 5, "b": 1}), payload(spark, {"a": "2", "b": "2"}), store)
    run_sync(spec(spark), manifest(spark, {"a": 7, "b": 1}), payload(spark, {"a": "3", "b": "3"}), store)
    run_sync(spec(spark), manifest(spark, {"a": 7, "b": 1}), untouchable(spark), store)  # nothing to do
    late = plan(spec(spark), manifest(spark, {"c": 1}), store.manifest())
    before, read = folders(store), contents(store)
    assert store.vacuum() == [] and folders(store) == before  # all of it is young
    gone = store.vacuum(min_age_seconds=0)
    assert gone and contents(store) == read == {"a": b"3", "b": b"1"} and paths_of(store.manifest()) == ["a", "b"]
    left = folders(store)
    # the content of "a" that was replaced is gone with its version, and nothing is left of the run without work
    assert not any(f.startswith(("items/version=2", "diff/", "known/", "vanished/version=1", "vanished/version=2")) for f in left)
    assert any(f.startswith("items/version=1/") for f in left) and any(f.startswith("items/version=3/") for f in left)
    assert {row.version for row in store.outcomes().collect()} == {3}
    assert store.vacuum(min_age_seconds=0) == [] and folders(store) == left
    with pytest.raises(ConcurrentRunError):
        apply(late, files, store)
    # life goes on
    run_sync(spec(spark), manifest(spark, {"a": 7, "b": 1, "c": 1}), files, store)
    assert contents(store) == {"a": b"3", "b": b"1", "c": b"1"}
    with pytest.raises(ValueError, match="no longer kept"):
        store.manifest(version=1)


def test_history_opens_a_bounded_number_of_files(spark, tmp_path, monkeypatch):
    log, opened = CommitLog(spark, str(tmp_path / "log")), []
    load = CommitLog._load
    monkeypatch.setattr(CommitLog, "_load", lambda self, *file: opened.append(file) or load(self, *file))
    for n in range(1, 51):
        log.append(n, run=f"r{n}")
    opened.clear()
    assert [e["version"] for e in log.entries()] == list(range(1, 51))
    assert len(opened) <= 2 + CommitLog.FOLD_EVERY
    # a fold that is cut short is passed over, one without its commit does not count
    folder = tmp_path / "log" / "_commits"
    (folder / "0000000048.fold").write_text('[{"version": 1')
    (folder / ".0000000048.fold.crc").unlink()
    log._put(51, "fold", [{"version": 51, "run": "never published"}])
    assert [e["version"] for e in log.entries()] == list(range(1, 51))
    log.trim()
    assert [e["version"] for e in log.entries()] == list(range(1, 51))
    assert min(int(p.name[:10]) for p in folder.glob("0*.json")) == 32


def test_a_claimed_version_stays_taken(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, str(tmp_path / "log"))
    with monkeypatch.context() as patch:
        patch.setattr(CommitLog, "_put", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            log.append(1, run="x")
    assert log.head() is None and log.entries() == [] and log.next_version() == 2
    with pytest.raises(Exception, match="exist"):
        log.append(1, run="y")


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("indexed")
    store = IndexedContent(spark, str(base))
    rows = spark.range(20_000).selectExpr("format_string('k/%05d.txt', id) rel_path", "cast(concat('content ', id) as binary) content")
    rows = rows.unionByName(spark.createDataFrame([(None, b"no path")], "rel_path string, content binary"))
    assert store.add(rows, total_bytes=40 << 10, file_bytes=1 << 10) == 1
    return base, store


def test_only_files_that_may_hold_a_path_are_opened(spark, indexed):
    base, content = indexed
    wanted = [f"k/{n:05d}.txt" for n in (3, 4, 5_000, 5_001, 19_999)] + ["k/00007.txt.gone", "a", "zzz", None]
    work = spark.createDataFrame([(w, 1) for w in wanted], "rel_path string, n int")
    (entry, files), = content.files_for(work)
    assert 3 <= len(files) <= 4 and entry["files"] >= 30
    for path in base.glob("data/*/*/*.parquet"):
        if path.name not in files:
            path.rename(path.with_suffix(".kept"))
            path.write_bytes(b"opening this raises")
            Path(path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    try:
        from tidemark.sources import load_payload

        found = {row.rel_path: bytes(row.content) for row in load_payload(content, work, key_bytes=100).collect()}
        assert found == {f"k/{n:05d}.txt": f"content {n}".encode() for n in (3, 4, 5_000, 5_001, 19_999)}
        with pytest.raises(Exception, match="(?i)parquet|footer|magic"):
            content.frame().agg(F.sum(F.octet_length("content"))).collect()
    finally:
        for path in base.glob("data/*/*/*.kept"):
            path.rename(path.with_suffix(".parquet"))


def test_indexed_content_equals_the_join(spark, indexed, store):
    _, content = indexed
    files = {f"k/{n:05d}.txt": 1 for n in range(0, 20_000, 1_999)} | {"k/none": 1}
    result = run_sync(spec(spark), manifest(spark, files), content, store)
    assert statuses(result) == {path: "vanished" if path == "k/none" else "ok" for path in files}
    want = content.frame().where(F.col("rel_path").isin(*files)).collect()
    assert contents(store) == {row.rel_path: bytes(row.content) for row in want} and len(want) == len(files) - 1


def test_generations_replace_each_other(spark, tmp_path):
    content = IndexedContent(spark, str(tmp_path / "c"))
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "rel_path string")
    assert content.frame().isEmpty() and content.narrowed(work).isEmpty()
    content.add(payload(spark, {"a": "1", "b": "1", "x": "1"}))
    content.add(payload(spark, {"b": "2", "c": "2"}))
    with pytest.raises(RepeatedKeyError):
        content.add(payload(spark, {"a": "3"}).unionByName(payload(spark, {"a": "4"})))
    content.add(payload(spark, {}))
    read = {row.rel_path: bytes(row.content) for row in content.frame().collect()}
    assert read == {"a": b"1", "b": b"2", "c": b"2", "x": b"1"}
    narrowed = {row.rel_path: bytes(row.content) for row in content.narrowed(work).collect()}
    assert {path: narrowed[path] for path in "abc"} == {path: read[path] for path in "abc"}


def test_what_cannot_succeed_fails_before_any_converter(spark, store):
    converters = Converters().register_command("touch", ["touch", f"{store.base}-called-{{stem}}", "{output}"])
    chosen = spec(spark, [("x", "touch", "y")], converters)
    source, files = manifest(spark, {"a.x": 1}), payload(spark, {"a.x": "1"})
    repeated = files.unionByName(files)
    with pytest.raises(PayloadError):
        run_sync(chosen, source, repeated, store)
    late = plan(chosen, source, store.manifest())
    unnamed = plan(chosen, source, store.manifest().filter("true"))
    run_sync(spec(spark), manifest(spark, {"b": 1}), payload(spark, {"b": "1"}), store)
    with pytest.raises(ConcurrentRunError):
        apply(late, files, store)
    with pytest.raises(ValueError, match="which state"):
        apply(unnamed, files, store)
    lacking = SyncSpec(rules=Rules.of(spark, [("x", "nothing", "y")], [("nothing", "expression", None)]), converters=Converters())
    with pytest.raises(RuleError, match="nothing"):
        run_sync(lacking, source, untouchable(spark), store)
    assert not list(Path(store.base).parent.glob("*-called-*"))


def test_versions_of_one_time_have_one_order(spark):
    from tidemark.sources import latest_versions

    rows = [("a", 5, None, 9), ("a", 5, 1, None), ("a", 5, 1, 3), ("a", 4, 7, 7), ("b", None, 2, 2), ("b", 1, None, None), ("c", None, 1, 1)]
    results = []
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, "rel_path string, t long, size long, mode int").withColumn("mtime", F.timestamp_seconds("t")).drop("t").coalesce(1)
        results.append({r.rel_path: (r["size"], r["mode"]) for r in latest_versions(df).collect()})
    assert results[0] == results[1] == results[2]
    assert results[0]["a"] in {(None, 9), (1, None), (1, 3)} and results[0]["b"] == (None, None) and results[0]["c"] == (1, 1)
