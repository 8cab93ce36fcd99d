"""Comparing states by their digests: the same result as comparing all rows, and no row read where nothing changed."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.helpers import contents, manifest, paths_of, payload, statuses
from tests.test_run import spec, untouchable
from tidemark import Converters, DigestedManifest, SnapshotStore, plan, run_digested, run_sync
from tidemark.functions import target_path
from tidemark.sources.digests import differing_buckets, levels_of, path_bucket


def test_a_target_is_in_the_bucket_of_its_source(spark):
    names = ["a", "a.b", "a.b.c", ".rc", ".rc.x", "..x", "a.", "é.flac", "x y.tar.gz", "."]
    paths = [prefix + name for prefix in ("", "d/", "d.e/f.g/") for name in names]
    df = spark.createDataFrame([(p, e) for p in paths for e in (".opus", ".tar.gz", "", ".x")], "p string, e string")
    found = df.withColumn("t", F.when(F.col("e") == "", F.col("p")).otherwise(target_path("p", F.lower(F.regexp_extract("p", r"[^/]([.][^./]*)$", 1)), "e")))
    assert found.where(path_bucket("p", 1 << 20) != path_bucket("t", 1 << 20)).isEmpty()
    assert levels_of(1) == [1] and levels_of(16) == [1, 16] and levels_of(300) == [1, 2, 19, 300]


def test_differing_buckets(spark, tmp_path):
    rng = random.Random(3)
    files = {f"d{n % 5}/f{n}.x": n for n in range(400)}
    one = DigestedManifest(spark, str(tmp_path / "one"), buckets=100)
    other = DigestedManifest(spark, str(tmp_path / "other"), buckets=100)
    one.publish(manifest(spark, files).repartition(7))
    for change in ({}, {"d0/f0.x": 9}, {f"d9/n{n}.y": 1 for n in range(3)}, {path: None for path in rng.sample(sorted(files), 4)}):
        changed = {path: seconds for path, seconds in {**files, **change}.items() if seconds is not None}
        other.publish(manifest(spark, dict(reversed(changed.items()))))
        df = spark.createDataFrame([(path,) for path in change] or [("none",)], "p string")
        want = sorted({row[0] for row in df.select(path_bucket("p", 100)).collect()}) if change else []
        assert differing_buckets(spark, one.digests(), other.digests(), 100) == want
        assert paths_of(other.rows(want)) == sorted(r.rel_path for r in other.rows().where(path_bucket("rel_path", 100).isin(want)).collect())
    with pytest.raises(ValueError, match="buckets"):
        DigestedManifest(spark, str(tmp_path / "one"), buckets=50).rows()


def test_digested_runs_equal_full_runs(spark, tmp_path):
    generator = random.Random(5)
    source = DigestedManifest(spark, str(tmp_path / "source"), buckets=40)
    by_digest, in_full = (SnapshotStore(spark, str(tmp_path / name)) for name in ("digest", "full"))
    chosen = spec(spark, [("flac", "same", "opus")], target_exclude=("*.txt",), source_exclude=("skip/*",), on_conflict="first")
    files = {}
    for round_number in range(4):
        for path in generator.sample(sorted(files), len(files) // 8):
            del files[path]
        for n in range(40 if not files else 5):
            folder = generator.choice(["", "a/", "a/b/", "skip/", f"only{round_number}/"])
            files[f"{folder}n{generator.randrange(60)}{generator.choice(['', '.txt', '.FLAC', '.flac', '.opus'])}"] = 10 * round_number + n
        source.publish(manifest(spark, files))
        content = payload(spark, {path: f"{path} {seconds}" for path, seconds in files.items()})
        first = run_digested(chosen, source, content, by_digest)
        second = run_sync(chosen, manifest(spark, files), content, in_full)
        full = statuses(second)
        assert {p: s for p, s in full.items() if s not in ("skipped", "conflict")} == {p: s for p, s in statuses(first).items() if s not in ("skipped", "conflict")}
        assert contents(by_digest) == contents(in_full)
        assert paths_of(by_digest.manifest()) == paths_of(in_full.manifest()) and paths_of(by_digest.dirs(), "path") == paths_of(in_full.dirs(), "path")
    after = plan(chosen, manifest(spark, files), by_digest.manifest(), target_dirs=by_digest.dirs())
    assert after.work.filter("action <> 'skip'").isEmpty() and after.deletes.isEmpty()


def test_a_run_without_changes_reads_digests_only(spark, store, tmp_path):
    source = DigestedManifest(spark, str(tmp_path / "source"), buckets=30)
    files = {f"f{n}.x": 1 for n in range(50)}
    source.publish(manifest(spark, files))
    fails = Converters().register("maybe", lambda c: F.when(F.col("rel_path") != "f7.x", c))
    chosen = spec(spark, [("x", "maybe", "y")], fails)
    assert run_digested(chosen, source, payload(spark, dict.fromkeys(files, "1")), store).published
    assert len(contents(store)) == 49
    # the bucket of the item that failed is looked at again, and no other
    again = run_digested(chosen, source, payload(spark, {"f7.x": "1"}), store)
    assert statuses(again)["f7.x"] == "failed" and len(statuses(again)) < 10
    fixed = spec(spark, [("x", "same", "y")], Converters().register("same", lambda c: c))
    other_rules = run_digested(fixed, source, payload(spark, {"f7.x": "1"}), store)
    assert statuses(other_rules) == {path: "ok" if path == "f7.x" else "skipped" for path in files}
    version = store.state()[1]
    for path in [*Path(source.base).glob("rows/**/*.parquet"), *Path(store.base).glob("manifest/**/*.parquet")]:
        path.rename(path.with_suffix(".away"))
    quiet = run_digested(fixed, source, untouchable(spark), store)
    assert (quiet.published, quiet.version) == (False, version) and quiet.outcome.isEmpty()
    for path in [*Path(source.base).glob("rows/**/*.away"), *Path(store.base).glob("manifest/**/*.away")]:
        path.rename(path.with_suffix(".parquet"))
    # another kind of run leaves no digests; compaction and vacuum keep them
    store.compact(full=True)
    store.vacuum(min_age_seconds=0)
    assert not run_digested(fixed, source, untouchable(spark), store).published
    run_sync(fixed, manifest(spark, {**files, "g.x": 1}), payload(spark, {"g.x": "2"}), store)
    assert sorted(statuses(run_digested(fixed, source, untouchable(spark), store))) == sorted(files)
    assert "g.y" not in contents(store)
