import os

import pytest
from pyspark.sql import functions as F

from tests.helpers import manifest, paths_of
from tidemark.sources import (
    CommitLog,
    latest_versions,
    load_payload,
    manifest_from,
    read_snapshot,
    scan_manifest,
    scan_tree,
    scratch_dir,
    write_snapshot,
)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree 1%"
    for path, text in {"a.txt": "one", "d/b c.txt": "three", "d/e/ü.bin": "x", ".hidden": "h", "d/_part": "p"}.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
        os.utime(file, ns=(0, 1_704_067_200_123_456_789))
    (root / "empty" / "inner").mkdir(parents=True)
    return root


def test_scan_manifest(spark, tree):
    for root in (str(tree), f"file:{tree}", f"{tree}/"):
        found = scan_manifest(spark, root)
        # Spark's file source leaves out names that start with a dot or an underscore
        assert paths_of(found) == ["a.txt", "d/b c.txt", "d/e/ü.bin"]
    row = found.filter("rel_path = 'd/b c.txt'").select("size", F.unix_micros("mtime").alias("us")).first()
    assert tuple(row) == (5, 1_704_067_200_123_000)
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan[scan.index("ReadSchema") :]


def test_scan_tree_lists_everything(spark, tree):
    files, dirs = scan_tree(spark, str(tree))
    assert paths_of(files) == [".hidden", "a.txt", "d/_part", "d/b c.txt", "d/e/ü.bin"]
    assert paths_of(dirs, "path") == ["d", "d/e", "empty", "empty/inner"]
    row = files.filter("rel_path = 'a.txt'").select("size", F.unix_micros("mtime").alias("us"), "mode").first()
    assert tuple(row) == (3, 1_704_067_200_123_456, (tree / "a.txt").stat().st_mode & 0o7777)


def test_scan_tree_by_uri(spark, tree):
    plain = tree.parent / "plain"
    (plain / "d").mkdir(parents=True)
    (plain / "d" / "f").write_text("four")
    files, dirs = scan_tree(spark, f"file://{plain}")
    assert [(row.rel_path, row.size) for row in files.collect()] == [("d/f", 4)]
    assert paths_of(dirs, "path") == ["d"]


def test_scan_errors_fail_the_job(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        scan_manifest(spark, str(tmp_path / "nowhere")).count()
    with pytest.raises(Exception, match="nowhere"):
        scan_tree(spark, str(tmp_path / "nowhere"))


def test_manifest_from_any_table(spark):
    table = spark.sql("select 7 as id, timestamp_ntz'1969-12-31 23:59:59.5' as t, 3 as n")
    row = manifest_from(table, "id", "t", size="n").select("*", F.unix_micros("mtime").alias("us")).first()
    assert (row.rel_path, row.us, row.size, row.mode) == ("7", -500_000, 3, None)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ValueError, match="UTC"):
            manifest_from(table, "id", "t")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_latest_versions_fold_before_the_shuffle(spark):
    feed = manifest(spark, {"a": 1, "b": 5}).unionByName(manifest(spark, {"a": 3}, mode=0o600))
    newest = latest_versions(feed)
    text = newest._jdf.queryExecution().executedPlan().toString()
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text
    assert {(row.rel_path, row.mode) for row in newest.collect()} == {("a", 0o600), ("b", 0o644)}


def test_small_work_lists_are_broadcast_and_long_ones_joined(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "rel_path string, content string")
    work = files.filter("rel_path = 'b'").select("rel_path")
    hinted = load_payload(files, work, key_bytes=1)
    assert hinted._jdf.queryExecution().analyzed().toString().count("broadcast") == 1
    plain = load_payload(files, work, key_bytes=1 << 40)
    assert "broadcast" not in plain._jdf.queryExecution().analyzed().toString()
    sized = load_payload(files, work, key_bytes=1 << 40, tasks=7)
    assert hinted.collect() == plain.collect() == sized.collect() == [("b", "2")]
    text = sized._jdf.queryExecution().executedPlan().toString()
    initial = text[text.index("Initial Plan") :] if "Initial Plan" in text else text
    # one shuffle per side, the content side as wide as the work side, and no sort
    assert initial.count("Exchange hashpartitioning(rel_path") == initial.count(", 7), ") == 2
    assert "ShuffledHashJoin" in initial and "Sort " not in initial


def test_bucketed_content_is_not_shuffled(spark):
    spark.range(100).select(F.col("id").cast("string").alias("rel_path"), F.col("id").cast("string").alias("content")).write.bucketBy(
        4, "rel_path"
    ).mode("overwrite").saveAsTable("bucketed_content")
    work = spark.range(10).select(F.col("id").cast("string").alias("rel_path")).repartition("rel_path")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        loaded = load_payload(spark.table("bucketed_content"), work)
        text = loaded._jdf.queryExecution().executedPlan().toString()
        assert loaded.count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    content_side = text[text.index("FileScan") :] if text.index("Range") < text.index("FileScan") else text[: text.index("Range")]
    assert text.count("Exchange") == 1 and "Bucketed: true" in content_side


def test_snapshots_are_published_whole(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "snap")
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, base)
    assert write_snapshot(spark.range(3), base) == 1
    before = read_snapshot(spark, base)
    # the next version may be computed from the current one
    assert write_snapshot(before.filter("id > 0"), base) == 2
    assert read_snapshot(spark, base).count() == 2 and before.count() == 3
    with monkeypatch.context() as patch:
        patch.setattr(CommitLog, "append", lambda *_, **__: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            write_snapshot(spark.range(50), base)
    assert read_snapshot(spark, base).count() == 2
    with pytest.raises(Exception, match="boom"):
        write_snapshot(spark.range(3).select(F.raise_error(F.lit("boom")).cast("int").alias("x")), base)
    assert CommitLog(spark, base).versions() == [1, 2]


def test_two_writers_cannot_take_one_version(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.next_version() == 1
    log.append(1, run="x")
    with pytest.raises(Exception, match="exist"):
        log.append(1, run="y")
    assert log.head() == {"version": 1, "run": "x"}


def test_an_unfinished_commit_file_is_passed_over(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    log.append(1, run="x")
    (tmp_path / "log" / "_commits" / "0000000002.json").touch()
    assert log.head() == {"version": 1, "run": "x"}
    assert log.next_version() == 3


def test_scratch_is_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_dir(spark), scratch_dir(spark)
    assert first.startswith(shared) and first != second


def test_links_of_a_tree(spark, tree):
    from tidemark.sources import list_tree

    elsewhere = tree.parent / "elsewhere"
    elsewhere.mkdir()
    (elsewhere / "x.txt").write_text("linked")
    os.symlink(elsewhere, tree / "d" / "there")
    os.symlink(tree / "a.txt", tree / "d" / "alias.txt")
    os.symlink(tree, tree / "d" / "e" / "up")
    os.symlink(tree / "none", tree / "gone")
    plain = [".hidden", "a.txt", "d/_part", "d/alias.txt", "d/b c.txt", "d/e/ü.bin"]
    found = list_tree(spark, str(tree))
    assert paths_of(found.files) == sorted([*plain, "d/there/x.txt"]) and "d/there" in paths_of(found.dirs, "path")
    reasons = {"d/e/up": "link to a directory above", "gone": "link to nothing"}
    assert {r.path: r.reason for r in found.skipped.collect()} == reasons
    assert found.files.filter("rel_path = 'd/alias.txt'").first()["size"] == 3
    kept = list_tree(spark, str(tree), follow_links=False)
    assert paths_of(kept.files) == sorted(plain)
    assert {r.path: r.reason for r in kept.skipped.collect()} == reasons | {"d/there": "link to a directory", "d/e/up": "link to a directory above"}


def test_large_directories_are_looked_at_by_many_tasks(spark, tmp_path, monkeypatch):
    from tidemark.sources import listing

    for n in range(40):
        (tmp_path / "big" / f"s{n % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "big" / f"f{n}").write_text("x" * n)
    whole = [sorted(map(tuple, part.collect())) for part in scan_tree(spark, str(tmp_path / "big"))]
    monkeypatch.setattr(listing, "LOOKED_AT", 3)
    assert [sorted(map(tuple, part.collect())) for part in scan_tree(spark, str(tmp_path / "big"))] == whole and len(whole[0]) == 40


def test_content_of_a_tree_is_opened_for_work_only(spark, store, tree):
    from tests.helpers import contents, statuses
    from tests.test_run import spec
    from tidemark import TreeContent, run_sync

    files, dirs = scan_tree(spark, str(tree))
    for name in ("a.txt", "d/_part"):  # up to date or excluded: nobody may open them
        (tree / name).unlink()
        (tree / name).mkdir()
    os.unlink(tree / "d" / "e" / "ü.bin")
    fresh = files.filter("rel_path = 'a.txt'")
    result = run_sync(spec(spark, source_exclude=("*_part",)), files, TreeContent(f"file:{tree}"), store, dirs, initial_target=fresh)
    assert statuses(result) == {"a.txt": "skipped", ".hidden": "ok", "d/b c.txt": "ok", "d/e/ü.bin": "vanished"}
    assert contents(store) == {".hidden": b"h", "d/b c.txt": b"three"}
    work = spark.createDataFrame([("../tree 1%/.hidden",), ("/etc/hostname",), ("",), (None,), ("d",)], "rel_path string")
    assert load_payload(TreeContent(str(tree)), work).isEmpty()


def test_a_tree_is_written_from_a_table(spark, tmp_path):
    from tidemark import TreeContent, write_tree

    root = tmp_path / "out"
    rows = [("a/b.txt", b"1", 0o600), ("c", None, 0o644), ("../x", b"2", None), (None, b"3", None)]
    df = spark.createDataFrame([(p, bytearray(c) if c else None, m) for p, c, m in rows], "rel_path string, content binary, mode int")
    df = df.withColumn("mtime", F.timestamp_micros(F.lit(1_704_067_200_123_456)))
    for _ in range(2):
        assert {(r.rel_path, r.status) for r in write_tree(df, str(root), tasks=2).collect()} == {("a/b.txt", "ok"), ("c", "ok"), ("../x", "outside"), (None, "outside")}
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*")) == ["out", "out/a", "out/a/b.txt", "out/c"]
    found, _ = scan_tree(spark, str(root))
    row = found.filter("rel_path = 'a/b.txt'").select(F.unix_micros("mtime").alias("us"), "mode", "size").first()
    assert tuple(row) == (1_704_067_200_123_456, 0o600, 1)
    read = load_payload(TreeContent(f"file://{root}"), found.select("rel_path"))
    assert {r.rel_path: bytes(r.content) for r in read.collect()} == {"a/b.txt": b"1", "c": b""}


def test_tree_content_is_read_and_written_in_small_batches(spark, tmp_path):
    import pyarrow as pa

    from tidemark import write_tree
    from tidemark.sources import trees

    size, name = 300_000, "spark.sql.execution.arrow.maxBytesPerBatch"
    files = spark.range(40).select(
        F.concat(F.lit("d/"), F.col("id").cast("string")).alias("rel_path"), F.repeat(F.lit("x"), size).cast("binary").alias("content")
    )
    before = spark.conf.get(name)
    try:
        assert write_tree(files.coalesce(1), str(tmp_path)).where("status = 'ok'").count() == 40
        sent = files.coalesce(1).mapInArrow(
            lambda batches: (pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]}) for batch in batches), "bytes long"
        )
        assert sent.agg(F.max("bytes")).first()[0] <= (4 << 20) + 2 * size
    finally:
        spark.conf.set(name, before)
    work = pa.RecordBatch.from_pydict({"rel_path": [f"d/{n}" for n in range(41)], "n": list(range(41))})
    read = list(trees._read_batches(str(tmp_path), iter([work])))
    assert [n for batch in read for n in batch.column("n").to_pylist()] == list(range(40))
    assert all(len(content) == size for batch in read for content in batch.column("content").to_pylist())
    assert len(read) > 1 and max(batch.nbytes for batch in read) <= (4 << 20) + 2 * size
