import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.helpers import dirs, manifest, paths_of
from tidemark import Converters, SyncSpec, plan
from tidemark.operators import (
    ancestor_dirs,
    classify,
    conflict_winners,
    deepest_first,
    map_paths,
    orphan_files,
    rank_sources,
    removable_dirs,
    target_conflicts,
    unoccupied,
)


def spec(spark, mappings=(("flac", "opus", "opus"),), **options):
    converters = Converters().register("opus", lambda content: content)
    return SyncSpec(rules=converters.rules(spark, mappings), converters=converters, **options)


def actions(frame):
    return {row.rel_path: (row.action, row.reason) for row in frame.collect()}


def test_actions_and_reasons(spark):
    source = manifest(spark, {"new.flac": 1, "stale.flac": 5, "fresh.flac": 5.9, "copy.txt": 1, "older.txt": 1})
    target = manifest(spark, {"stale.opus": 4, "fresh.opus": 5, "older.txt": 9, "gone.opus": 1})
    found = plan(spec(spark), source, target)
    assert actions(found.work) == {
        "new.flac": ("convert", "new"),
        "stale.flac": ("convert", "stale"),
        "fresh.flac": ("skip", "fresh"),
        "copy.txt": ("copy", "new"),
        "older.txt": ("copy", "stale"),
    }
    assert paths_of(found.delete_files, "path") == ["gone.opus"]
    summary = {(row.action, row.reason): (row["items"], row.bytes) for row in found.summary().collect()}
    assert summary == {
        ("convert", "new"): (1, 10),
        ("convert", "stale"): (1, 10),
        ("copy", "new"): (1, 10),
        ("copy", "stale"): (1, 10),
        ("skip", "fresh"): (1, 10),
    }
    assert found.scanned().first().scanned == 5


def test_unmatched_files_become_orphans_when_not_copied(spark):
    source = manifest(spark, {"a.flac": 1, "b.txt": 1})
    target = manifest(spark, {"b.txt": 1})
    assert paths_of(plan(spec(spark), source, target).deletes, "path") == []
    dropped = plan(spec(spark, copy_unmatched=False), source, target)
    assert paths_of(dropped.work) == ["a.flac"]
    assert paths_of(dropped.deletes, "path") == ["b.txt"]


def test_excluded_sources_lose_their_target_and_protected_targets_stay(spark):
    source = manifest(spark, {"keep.txt": 1, "skip.log": 1})
    target = manifest(spark, {"skip.log": 1, "list.m3u": 1, "orphan.txt": 1})
    found = plan(spec(spark, source_exclude=("*.log",), target_exclude=("*.m3u",)), source, target)
    assert paths_of(found.work) == ["keep.txt"]
    assert paths_of(found.delete_files, "path") == ["orphan.txt", "skip.log"]
    assert paths_of(orphan_files(target, found.work, ["*.m3u"])) == ["orphan.txt", "skip.log"]


def test_window_makes_small_differences_fresh(spark):
    source, target = manifest(spark, {"a": 10}), manifest(spark, {"a": 12.9})
    reasons = [plan(spec(spark, modify_window=w), source, target).work.first().reason for w in (-1, 0, 1, 2)]
    assert reasons == ["stale", "stale", "stale", "fresh"]


def test_changed_mapping_orphans_the_old_target(spark):
    found = plan(spec(spark, [("flac", "opus", "ogg")]), manifest(spark, {"a.flac": 1}), manifest(spark, {"a.opus": 1}))
    assert found.work.first().target_path == "a.ogg"
    assert paths_of(found.delete_files, "path") == ["a.opus"]


def test_directories(spark):
    source = manifest(spark, {"a/b/deep.txt": 1, "skip/x.log": 1})
    target = manifest(spark, {"a/old.txt": 1, "gone/deep/er/x.txt": 1, "gone/list.m3u": 1, "lost/y.txt": 1})
    found = plan(
        spec(spark, target_exclude=("*.m3u",), source_exclude=("skip*",)),
        source,
        target,
        source_dirs=dirs(spark, ["empty_dir", "nested/empty"]),
        target_dirs=dirs(spark, ["hollow/core", "nested/empty"]),
    )
    # "skip*" takes the directory too; "skip" alone would not take the file in it
    assert paths_of(found.known_dirs, "path") == ["a", "a/b", "empty_dir", "nested", "nested/empty"]
    assert paths_of(found.creates, "path") == ["a/b", "empty_dir"]
    removed = [row.path for row in deepest_first(found.delete_dirs).collect()]
    assert removed == ["lost", "hollow/core", "hollow", "gone/deep/er", "gone/deep"]
    kinds = {(row.path, row.kind) for row in found.deletes.collect()}
    assert ("lost/y.txt", "file") in kinds and ("lost", "dir") in kinds


def test_excluding_a_directory_keeps_its_files(spark):
    found = plan(spec(spark, source_exclude=("tmp",)), manifest(spark, {"tmp/a.txt": 1}), manifest(spark, {}))
    assert paths_of(found.work) == ["tmp/a.txt"]
    assert found.known_dirs.isEmpty()


def test_removable_dirs_against_brute_force(spark):
    generator = random.Random(3)

    def tree(count):
        return {"/".join(generator.choice("abc") for _ in range(generator.randint(1, 4))) + f"/f{n}" for n in range(count)}

    for _ in range(3):
        target, source = tree(25), tree(3)
        survivors = {path for path in target if generator.random() < 0.15}
        above = lambda paths: {p.rsplit("/", n)[0] for p in paths for n in range(1, p.count("/") + 1)}
        known, left = above(source), above(target)
        removed = set()
        for path in sorted(left, key=lambda p: -p.count("/")):
            inside = {p for p in (left - removed) | known | survivors if p.startswith(path + "/")}
            if path not in known and not inside:
                removed.add(path)
        frames = [manifest(spark, dict.fromkeys(paths, 1)) for paths in (target, source, survivors)]
        for deep in (False, True):
            found = removable_dirs(ancestor_dirs(frames[0]), ancestor_dirs(frames[1]), frames[2], deep=deep)
            assert paths_of(found, "path") == sorted(removed)


def test_a_sweep_of_deep_trees(spark):
    # chains of 200 directories; one has a file at its end, one half way, one nowhere
    chain = lambda name: ["/".join([name, *["d"] * n]) for n in range(200)]
    target = dirs(spark, [*chain("a"), *chain("a-b"), *chain("b")]).repartition(3)
    survivors = manifest(spark, {f"{chain('a')[-1]}/f": 1, f"{chain('a-b')[99]}/f": 1})
    found = removable_dirs(target, dirs(spark, []), survivors, deep=True)
    assert paths_of(found, "path") == sorted([*chain("a-b")[100:], *chain("b")])
    shown = found._jdf.queryExecution().toString()
    assert "Generate" not in shown and "rangepartitioning" in shown


def test_a_sweep_of_odd_paths(spark):
    paths = [None, None, "", "/x", "a", "a", "a/b", "a-b", "a\u00e9/\U0001f600", "z//y"]
    given = dirs(spark, paths)
    assert paths_of(unoccupied(given, dirs(spark, [])), "path") == sorted({p for p in paths if p is not None})
    kept = dirs(spark, ["/x/1", "a/b/c", "a/b/c", None, "a\u00e9/\U0001f600/1", "z//y"])
    assert paths_of(unoccupied(given, kept), "path") == ["a-b"]
    assert unoccupied(dirs(spark, []), kept).isEmpty()


def test_a_sweep_across_tasks(spark):
    # the kept path lies in another range than the directories above it
    given = dirs(spark, [f"top/{n:04}" for n in range(2000)] + ["top", "up"])
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        found = paths_of(unoccupied(given, dirs(spark, ["top/1999/in/it", "up/x"])), "path")
    finally:
        spark.conf.unset(conf)
    assert found == [f"top/{n:04}" for n in range(1999)]


def test_conflicts(spark):
    mappings = [("flac", "opus", "opus"), ("mp3", "opus", "opus")]
    source = manifest(spark, {"d/song.flac": 1, "d/song.mp3": 2, "d/song.opus": 3, "other.flac": 1})
    work = map_paths(source, spec(spark, mappings).rules.mappings)
    assert [tuple(row) for row in target_conflicts(work).collect()] == [("d/song.opus", 3, "d/song.flac", "d/song.opus")]
    assert paths_of(conflict_winners(work)) == ["d/song.flac", "other.flac"]
    first = plan(spec(spark, mappings, on_conflict="first"), source, manifest(spark, {}))
    assert paths_of(first.work) == ["d/song.flac", "other.flac"]
    claims = {(row.rel_path, row.winner, row.n_sources) for row in first.conflicts().collect()}
    assert claims == {(f"d/song.{ext}", "d/song.flac", 3) for ext in ("flac", "mp3", "opus")}
    # every row is classified, winners or not
    assert classify(work, manifest(spark, {"d/song.opus": 2})).filter("reason = 'stale'").count() == 2


@pytest.mark.parametrize("keep", [1, 2])
def test_a_target_with_most_of_the_sources_is_cut_down_before_the_shuffle(spark, keep):
    claims = spark.range(20_000).select(
        F.concat(F.lit("s/"), F.col("id").cast("string")).alias("rel_path"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("target_path"),
    )
    ranked = rank_sources(claims, keep)
    text = ranked._jdf.queryExecution().executedPlan().toString()
    before_shuffle = text[text.index("Exchange") :]
    assert f"row_number(), {keep}, Partial" in before_shuffle
    assert ranked.filter("target_path = 'hot'").count() == keep
    assert conflict_winners(claims).filter("target_path = 'hot'").first().rel_path == "s/0"
    assert target_conflicts(claims).first().n_sources == 6667


def test_classifying_a_hot_target_can_be_split(spark):
    """Most rows claim one target; the adaptive skew join spreads them over several tasks."""
    rows = spark.range(30_000).select(
        F.concat(F.lit("s/"), F.col("id").cast("string")).alias("rel_path"),
        F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("target_path"),
        F.timestamp_seconds(F.col("id")).alias("mtime"),
        F.lit("").alias("ext"),
        F.lit(None).cast("string").alias("converter"),
    )
    target = manifest(spark, {"hot": 1, "t3": 3})
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = classify(rows.repartition(8), target)
        counts = Counter(row.reason for row in found.collect())
        text = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert counts == {"stale": 19_999, "new": 9_999, "fresh": 2}
    assert "skew=true" in text


def test_target_rows_of_one_path_count_once(spark):
    target = manifest(spark, {"a": 1}).unionByName(manifest(spark, {"a": 5}))
    found = plan(spec(spark), manifest(spark, {"a": 5}), target)
    assert actions(found.work) == {"a": ("skip", "fresh")}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_result_does_not_depend_on_partitioning(spark, partitions):
    source = manifest(spark, {f"{n % 5}/{n}.flac": n for n in range(60)}).repartition(int(partitions))
    target = manifest(spark, {f"{n % 5}/{n}.opus": n + (n % 3) for n in range(20, 80)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = plan(spec(spark), source, target)
        counts = {(row.action, row.reason): row["items"] for row in found.summary().collect()}
        deleted = found.delete_files.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    fresh = sum(1 for n in range(20, 60) if n % 3 == 0)
    assert counts == {("convert", "new"): 20, ("convert", "stale"): 40 - fresh, ("skip", "fresh"): fresh}
    assert deleted == 20
