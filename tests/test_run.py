"""Whole runs into a store: what the sync tests of a file tool check, on small frames."""

from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.helpers import contents, dirs, manifest, paths_of, payload, statuses
from tidemark import Converters, SyncSpec, apply, plan, run_sync
from tidemark.operators import RuleError, Rules
from tidemark.plans import ConflictError, EmptySourceError, PayloadError, execution
from tidemark.operators.convert import _apply_udf
from tidemark.sources import CommitLog
from tidemark.sources.snapshots import ConcurrentRunError


def spec(spark, mappings=(), converters=None, **options):
    converters = converters or Converters().register("same", lambda content: content)
    return SyncSpec(rules=converters.rules(spark, mappings), converters=converters, **options)


def untouchable(spark):
    """A payload that fails the job as soon as it is read."""
    return spark.range(1).select(
        F.concat(F.lit("x"), F.col("id").cast("string")).alias("rel_path"),
        F.raise_error(F.lit("content was read")).cast("binary").alias("content"),
    )


def test_nested_copy_then_nothing_to_do(spark, store):
    source = manifest(spark, {"a/b/deep.txt": 1.25, "top.txt": 2})
    files = payload(spark, {"a/b/deep.txt": "deep", "top.txt": "top", "unrelated": "x"})
    first = run_sync(spec(spark), source, files, store)
    assert first.published and first.version == 1
    assert statuses(first) == {"a/b/deep.txt": "ok", "top.txt": "ok"}
    assert contents(store) == {"a/b/deep.txt": b"deep", "top.txt": b"top"}
    assert paths_of(store.dirs(), "path") == ["a", "a/b"]
    # the second run plans nothing but skips, reads no content and publishes nothing
    again = plan(spec(spark), source, store.manifest(), target_dirs=store.dirs())
    assert again.work.filter("action <> 'skip'").isEmpty() and again.deletes.isEmpty() and again.creates.isEmpty()
    second = run_sync(spec(spark), source, untouchable(spark), store)
    assert (second.published, second.version) == (False, 1)
    assert statuses(second) == {"a/b/deep.txt": "skipped", "top.txt": "skipped"}


def test_target_carries_version_and_mode_of_the_source(spark, store):
    run_sync(spec(spark), manifest(spark, {"a": 1.25}, mode=0o600), payload(spark, {"a": "x"}), store)
    row = store.manifest().select(F.unix_micros("mtime").alias("us"), "mode", "size", "data_version").first()
    assert tuple(row) == (1_250_000, 0o600, 1, 1)
    # a change of mode alone is no work
    assert not run_sync(spec(spark), manifest(spark, {"a": 1.25}, mode=0o644), untouchable(spark), store).published


def test_unmatched_files_are_copied_or_not(spark, store):
    source, files = manifest(spark, {"other.txt": 1}), payload(spark, {"other.txt": "test file"})
    result = run_sync(spec(spark, copy_unmatched=False), source, files, store)
    assert result.outcome.isEmpty() and store.manifest().isEmpty()
    run_sync(spec(spark), source, files, store)
    assert contents(store) == {"other.txt": b"test file"}


def test_only_changed_content_is_written_again(spark, store):
    files = payload(spark, {"a": "1", "b": "1", "c": "1"})
    run_sync(spec(spark), manifest(spark, {"a": 1, "b": 1, "c": 1}), files, store)
    result = run_sync(
        spec(spark), manifest(spark, {"a": 1, "b": 9, "d": 1}), payload(spark, {"a": "2", "b": "2", "c": "2", "d": "2"}), store
    )
    assert statuses(result) == {"a": "skipped", "b": "ok", "d": "ok"}
    assert contents(store) == {"a": b"1", "b": b"2", "d": b"2"}
    versions = {row.rel_path: row.data_version for row in store.manifest().collect()}
    assert versions == {"a": 1, "b": 2, "d": 2}
    # a path that comes back is new content, not the old one
    run_sync(spec(spark), manifest(spark, {"a": 1, "b": 9, "c": 1, "d": 1}), payload(spark, {"c": "3"}), store)
    assert contents(store) == {"a": b"1", "b": b"2", "c": b"3", "d": b"2"}
    assert {row.version for row in store.outcomes().collect()} == {1, 2, 3}


def test_content_is_the_same_with_a_long_list_of_retired_content(spark, store, monkeypatch):
    from tidemark.sources import snapshots

    for seconds in (1, 9):
        run_sync(spec(spark), manifest(spark, {"a": seconds, "b": 1}), payload(spark, {"a": str(seconds), "b": "b"}), store)
    monkeypatch.setattr(snapshots, "MAX_BROADCAST_KEY_BYTES", -1)
    assert contents(store) == {"a": b"9", "b": b"b"}


def test_exclude_orphan_and_protection(spark, store):
    files = payload(spark, dict.fromkeys(["keep.txt", "skip.log", "orphan.txt", "list.m3u"], "x"))
    run_sync(spec(spark), manifest(spark, dict.fromkeys(["keep.txt", "skip.log", "orphan.txt", "list.m3u"], 1)), files, store)
    options = {"source_exclude": ("*.log",), "target_exclude": ("*.m3u",)}
    result = run_sync(spec(spark, **options), manifest(spark, {"keep.txt": 1, "skip.log": 1}), untouchable(spark), store)
    assert result.published
    assert sorted(contents(store)) == ["keep.txt", "list.m3u"]


def test_extension_changed_and_kept(spark, store):
    source = manifest(spark, {"song.fake": 1, "photo.JPG": 1})
    mappings = [("fake", "same", "out"), ("jpg", "same", "jpg")]
    run_sync(spec(spark, mappings), source, payload(spark, {"song.fake": "s", "photo.JPG": "p"}), store)
    assert contents(store) == {"song.out": b"s", "photo.JPG": b"p"}


def test_a_plan_changes_nothing(spark, store):
    source = manifest(spark, {"a": 1})
    assert plan(spec(spark), source, store.manifest()).work.count() == 1
    assert store.log.head() is None and store.manifest().isEmpty()


def test_empty_directories(spark, store):
    source, listed = manifest(spark, {"f": 1}), dirs(spark, ["empty_dir", "nested/empty"])
    run_sync(spec(spark), source, payload(spark, {"f": "x"}), store, source_dirs=listed)
    assert paths_of(store.dirs(), "path") == ["empty_dir", "nested", "nested/empty"]
    assert not run_sync(spec(spark), source, untouchable(spark), store, source_dirs=listed).published
    assert run_sync(spec(spark), source, untouchable(spark), store).published
    assert paths_of(store.dirs(), "path") == []
    assert contents(store) == {"f": b"x"}


def test_empty_source(spark, store):
    nothing = manifest(spark, {})
    assert not run_sync(spec(spark), nothing, untouchable(spark), store).published
    run_sync(spec(spark), manifest(spark, {"a/b": 1}), payload(spark, {"a/b": "x"}), store)
    with pytest.raises(EmptySourceError):
        run_sync(spec(spark), nothing, untouchable(spark), store)
    assert contents(store) == {"a/b": b"x"}
    run_sync(spec(spark, allow_empty_source=True), nothing, untouchable(spark), store)
    assert contents(store) == {} and store.dirs().isEmpty()


def test_a_failing_converter_isolates_the_row(spark, store):
    fails_on_bad = Converters().register("maybe", lambda c: F.when(F.col("rel_path") != "file.bad", c))
    options = {"mappings": [("bad", "maybe", "out")], "converters": fails_on_bad}
    source = manifest(spark, {"file.bad": 1, "good.bad": 1, "copy.txt": 1})
    files = payload(spark, {"file.bad": "b", "good.bad": "g", "copy.txt": "c"})
    result = run_sync(spec(spark, **options), source, files, store)
    assert statuses(result) == {"file.bad": "failed", "good.bad": "ok", "copy.txt": "ok"}
    assert contents(store) == {"good.out": b"g", "copy.txt": b"c"}
    # the next run tries again, and success takes
    fixed = {"mappings": [("bad", "same", "out")]}
    assert statuses(run_sync(spec(spark, **fixed), source, files, store))["file.bad"] == "ok"
    # a failure of a stale row keeps the old target
    result = run_sync(spec(spark, **options), manifest(spark, {"file.bad": 50, "good.bad": 1, "copy.txt": 1}), files, store)
    assert statuses(result)["file.bad"] == "failed"
    assert contents(store)["file.out"] == b"b"
    assert store.manifest().filter("rel_path = 'file.out'").select(F.unix_seconds("mtime")).first()[0] == 1


def test_vanished_sources_keep_their_old_target(spark, store):
    run_sync(spec(spark), manifest(spark, {"a": 1, "b": 1}), payload(spark, {"a": "1", "b": "1"}), store)
    result = run_sync(spec(spark), manifest(spark, {"a": 5, "b": 5, "c": 5}), payload(spark, {"b": "2"}), store)
    assert statuses(result) == {"a": "vanished", "b": "ok", "c": "vanished"}
    assert contents(store) == {"a": b"1", "b": b"2"}


def test_content_has_to_be_keyed(spark, store):
    files = payload(spark, {"a": "1"}).unionByName(payload(spark, {"a": "2"}))
    # one item twice and one item gone would add up, so the items are told apart by key
    for source in (manifest(spark, {"a": 1}), manifest(spark, {"a": 1, "b": 1})):
        with pytest.raises(PayloadError):
            run_sync(spec(spark), source, files, store)
    assert store.log.head() is None


@pytest.mark.parametrize("limit", [-1, 1 << 30])
def test_long_and_short_work_lists_give_the_same_result(spark, store, monkeypatch, limit):
    from tidemark.plans import execution
    from tidemark.sources import payloads

    monkeypatch.setattr(execution, "MAX_BROADCAST_KEY_BYTES", limit)
    monkeypatch.setattr(payloads, "MAX_BROADCAST_KEY_BYTES", limit)
    converters = Converters().register("same", lambda c: c).register_udf("up", lambda c: c.map(bytes.upper))
    chosen = spec(spark, [("u", "up", None)], converters)
    files = payload(spark, {"a.u": "a", "b": "b", "d.u": "d"})
    run_sync(chosen, manifest(spark, {"a.u": 1, "b": 1, "c": 1}), files, store)
    result = run_sync(chosen, manifest(spark, {"a.u": 5, "c": 1, "d.u": 1}), files, store)
    assert statuses(result) == {"a.u": "ok", "c": "vanished", "d.u": "ok"}
    assert contents(store) == {"a.u": b"A", "d.u": b"D"}


def test_conflicting_targets(spark, store):
    mappings = [("flac", "same", "opus"), ("mp3", "same", "opus")]
    source = manifest(spark, {"s.mp3": 1, "s.flac": 1, "t.mp3": 1})
    files = payload(spark, {"s.mp3": "m", "s.flac": "f", "t.mp3": "t"})
    with pytest.raises(ConflictError, match="s.opus"):
        run_sync(spec(spark, mappings), source, files, store)
    assert store.log.head() is None
    source = source.unionByName(manifest(spark, {"s.opus": 1}))
    chosen = spec(spark, mappings, on_conflict="first")
    lost = {"s.mp3": "conflict", "s.opus": "conflict"}
    result = run_sync(chosen, source, files, store)
    assert statuses(result) == {"s.flac": "ok", "t.mp3": "ok"} | lost
    assert {row.message for row in result.outcome.filter("status = 'conflict'").collect()} == {"target taken by s.flac"}
    assert contents(store) == {"s.opus": b"f", "t.opus": b"t"}
    assert paths_of(store.manifest()) == ["s.opus", "t.opus"]
    # a run without work reports them too
    again = run_sync(chosen, source, untouchable(spark), store)
    assert not again.published and statuses(again) == {"s.flac": "skipped", "t.mp3": "skipped"} | lost


def test_bad_rules_stop_the_run(spark, store):
    broken = SyncSpec(rules=Rules.of(spark, [("a", "nowhere", None)]))
    with pytest.raises(RuleError):
        run_sync(broken, manifest(spark, {"x.a": 1}), untouchable(spark), store)


def test_mixed_batch(spark, store):
    source = manifest(spark, {"1.flac": 1, "2.flac": 2, "3.flac": 3, "other.txt": 4})
    files = payload(spark, {"1.flac": "1", "2.flac": "2", "3.flac": "3", "other.txt": "o"})
    chosen = spec(spark, [(".flac", "same", ".opus")])
    assert plan(chosen, source, store.manifest()).scanned().first().scanned == 4
    run_sync(chosen, source, files, store)
    assert contents(store) == {"1.opus": b"1", "2.opus": b"2", "3.opus": b"3", "other.txt": b"o"}


def test_text_payloads_stay_text(spark, store):
    up = Converters().register("up", F.upper)
    files = spark.createDataFrame([("a.txt", "grün"), ("b.md", "plain")], "rel_path string, content string")
    run_sync(spec(spark, [("txt", "up", "up")], up), manifest(spark, {"a.txt": 1, "b.md": 1}), files, store)
    assert {row.rel_path: row.content for row in store.content().collect()} == {"a.up": "GRÜN", "b.md": "plain"}


def test_initial_target_stands_in_for_an_empty_store(spark, store):
    elsewhere = manifest(spark, {"a": 1, "gone": 1})
    result = run_sync(spec(spark), manifest(spark, {"a": 1, "b": 1}), payload(spark, {"b": "x"}), store, initial_target=elsewhere)
    assert statuses(result) == {"a": "skipped", "b": "ok"}
    assert paths_of(store.manifest()) == ["a", "b"]


def test_nothing_is_visible_before_the_commit(spark, store, monkeypatch):
    source, files = manifest(spark, {"a": 1}), payload(spark, {"a": "x"})

    def lost(*_, **__):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(CommitLog, "append", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            run_sync(spec(spark), source, files, store)
    assert store.log.head() is None and store.manifest().isEmpty() and contents(store) == {}
    assert run_sync(spec(spark), source, files, store).version == 1
    assert contents(store) == {"a": b"x"}


def test_a_run_planned_against_an_older_version_cannot_publish(spark, store):
    from tidemark import SnapshotStore

    source, files = manifest(spark, {"a": 1}), payload(spark, {"a": "x", "b": "y"})
    late = plan(spec(spark), source, store.manifest(), target_dirs=store.dirs())
    run_sync(spec(spark), manifest(spark, {"b": 1}), files, SnapshotStore(spark, store.base))
    with pytest.raises(ConcurrentRunError):
        apply(late, files, store)
    assert contents(store) == {"b": b"y"}
    # planned anew, it goes through
    run_sync(spec(spark), source, files, store)
    assert contents(store) == {"a": b"x"}


def test_a_named_transaction_happens_once(spark, store):
    source, files = manifest(spark, {"a": 1}), payload(spark, {"a": "x"})
    intended = plan(spec(spark), source, store.manifest())
    assert apply(intended, files, store, txn="feed-0").published
    assert not apply(intended, untouchable(spark), store, txn="feed-0").published
    assert store.log.versions() == [1]


def test_plan_apply_plan_is_empty_on_random_trees(spark, tmp_path):
    import random

    from tidemark import SnapshotStore

    generator = random.Random(11)
    suffixes = ["", ".txt", ".FLAC", ".flac", ".tar.gz"]
    store = SnapshotStore(spark, str(tmp_path / "random"))
    for round_number in range(3):
        files = {
            "/".join(generator.choice("abc") for _ in range(generator.randint(0, 3))) + f"/n{n}{generator.choice(suffixes)}": n + round_number
            for n in range(40)
            if generator.random() < 0.8
        }
        files = {path.lstrip("/"): seconds for path, seconds in files.items()}
        chosen = spec(spark, [("flac", "same", "opus")], target_exclude=("*.txt",), on_conflict="first")
        protected = {path for path in contents(store) if path.endswith(".txt")}
        run_sync(chosen, manifest(spark, files), payload(spark, dict.fromkeys(files, "x")), store)
        after = plan(chosen, manifest(spark, files), store.manifest(), target_dirs=store.dirs())
        assert after.work.filter("action <> 'skip'").isEmpty() and after.deletes.isEmpty() and after.creates.isEmpty()
        expected = {path.rsplit(".", 1)[0] + ".opus" if path.lower().endswith(".flac") else path for path in files}
        assert set(contents(store)) == expected | protected


def test_second_plan_from_one_version_is_refused(spark, store):
    """Two plans made from version 1: the one applied later must not undo the other, whoever looked meanwhile."""
    files = payload(spark, {"a": "x", "b": "y", "c": "z"})
    run_sync(spec(spark), manifest(spark, {"a": 1}), files, store)
    plans = [plan(spec(spark), manifest(spark, {"a": 1, n: 1}), store.manifest(), target_dirs=store.dirs()) for n in "bc"]
    assert apply(plans[0], files, store).published
    store.manifest()
    with pytest.raises(ConcurrentRunError):
        apply(plans[1], files, store)
    assert contents(store) == {"a": b"x", "b": b"y"} and paths_of(store.manifest()) == ["a", "b"]


def test_unfinished_and_foreign_commit_files_are_passed_over(store):
    folder = Path(store.base) / "_commits"
    folder.mkdir(parents=True)
    (folder / "0000000001.json").write_text('{"version": 1, "ru')
    (folder / "notes.txt").write_text("x")
    assert store.log.head() is None and store.state() == (1, 0)


def test_wrong_udf_results_fail_their_rows_only():
    content = pd.Series([b"a", b"b", b"c"])
    assert _apply_udf(lambda s: s.iloc[:1] if len(s) > 1 else s, content) == ([b"a", b"b", b"c"], [None] * 3)
    outputs, messages = _apply_udf(lambda s: s.map(lambda x: "text" if x == b"b" else x), content)
    assert outputs == [b"a", None, b"c"] and messages == [None, "output is str, not bytes", None]


def counted_source(spark, files, seen):
    """A manifest whose rows are counted as they are read."""

    def read(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = manifest(spark, files)
    return rows.mapInPandas(read, rows.schema)


@pytest.mark.parametrize("limit", [1, 64 << 20])
def test_the_source_is_read_once_to_compare_and_once_for_directories(spark, store, monkeypatch, limit):
    monkeypatch.setattr(execution, "WORKER_BATCH_BYTES", limit)
    converters = Converters().register_udf("twice", lambda content: content.map(lambda value: value * 2))
    rules = SyncSpec(rules=converters.rules(spark, [("raw", "twice", "out")]), converters=converters)
    files = {f"d/{n}.raw": 1 for n in range(6)}
    content = payload(spark, {path: path for path in files})
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    for published in (True, False):
        seen = spark.sparkContext.accumulator(0)
        assert run_sync(rules, counted_source(spark, files, seen), content, store).published is published
        assert seen.value <= 2 * len(files)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    assert contents(store) == {f"d/{n}.out": f"d/{n}.rawd/{n}.raw".encode() for n in range(6)}


def recorded(store):
    return [row.rel_path for row in store.spark.read.parquet(*map(str, Path(store.base).glob("ledger/*/*/part-*/*.parquet"))).collect()]


def test_a_run_that_broke_off_repeats_unfinished_commands_only(spark, store, tmp_path):
    script = 'echo {stem} >> "$0/log"; [ {stem} != f31 ] || [ -e "$0/killed" ] || { touch "$0/killed"; sleep 1; kill -9 $PPID; }; tr a-z A-Z < {input} > {output}'
    converters = Converters().register_command("up", ["sh", "-c", script.replace("{ t", "{{ t").replace("; }", "; }}"), str(tmp_path)])
    spec_ = spec(spark, [(".txt", "up", ".out")], converters, record_seconds=0)
    files = {f"f{n}.txt": f"text {n}" for n in range(40)}
    log = tmp_path / "log"
    with pytest.raises(Exception, match="(?i)python worker|crashed|EOF"):
        run_sync(spec_, manifest(spark, dict.fromkeys(files, 1)), payload(spark, files), store)
    done = recorded(store)
    assert done and len(done) == len(set(done)) and "f31.txt" not in done
    log.write_text("")
    # a changed source isn't taken from the record
    changed = done[0]
    files[changed] = "other"
    result = run_sync(spec_, manifest(spark, dict.fromkeys(files, 1)), payload(spark, files), store)
    again = [f"{name}.txt" for name in log.read_text().split()]
    assert sorted(again) == sorted(set(files) - set(done) | {changed})
    assert set(statuses(result).values()) == {"ok"}
    assert contents(store) == {path.replace("txt", "out"): text.upper().encode() for path, text in files.items()}
    assert not list(Path(store.base).glob("ledger/*/*"))


def test_commands_of_a_task_are_bounded(spark, monkeypatch):
    rows = [Row(bytes=10, items=900, kind="command"), Row(bytes=10, items=900, kind="udf")]
    assert execution._tasks(spark, rows, 9) == 100
    assert execution._tasks(spark, rows, 10**6) == spark.sparkContext.defaultParallelism
