import random

from pyspark.sql import functions as F

from tests.helpers import contents, manifest, payload
from tests.test_run import spec, untouchable
from tidemark.streaming import sync_batch, sync_stream


def seconds(store):
    rows = store.manifest().select("rel_path", F.unix_seconds("mtime").alias("s")).collect()
    return {row.rel_path: row.s for row in rows}


def test_a_feed_is_taken_in_once(spark, store, tmp_path):
    feed, checkpoint = str(tmp_path / "feed"), str(tmp_path / "checkpoint")
    files = payload(spark, {"a.flac": "a", "b": "b", "c": "c"})
    chosen = spec(spark, [("flac", "same", "opus")])

    def run():
        stream = spark.readStream.schema(manifest(spark, {}).schema).parquet(feed)
        sync_stream(chosen, stream, files, store, checkpoint).awaitTermination()

    manifest(spark, {"a.flac": 1, "b": 1}).unionByName(manifest(spark, {"b": 4})).write.parquet(feed)
    run()
    assert seconds(store) == {"a.opus": 1, "b": 4}
    assert contents(store) == {"a.opus": b"a", "b": b"b"}
    run()
    assert store.log.versions() == [1]
    # nothing is deleted for not being mentioned; older changes do not win
    manifest(spark, {"c": 2, "b": 3, "a.flac": 9}).write.mode("append").parquet(feed)
    run()
    assert seconds(store) == {"a.opus": 9, "b": 4, "c": 2}
    assert store.log.versions() == [1, 2]


def test_a_replayed_batch_changes_nothing(spark, store):
    files = payload(spark, {"a": "x"})
    assert sync_batch(spec(spark), manifest(spark, {"a": 1}), files, store, "feed-0").published
    assert sync_batch(spec(spark), manifest(spark, {"a": 2}), files, store, "feed-1").published
    assert not sync_batch(spec(spark), manifest(spark, {"a": 3}), untouchable(spark), store, "feed-1").published
    assert seconds(store) == {"a": 2}
    # another stream numbers its batches on its own
    assert sync_batch(spec(spark), manifest(spark, {"a": 4}), files, store, "other-1").published


def test_batch_order_does_not_matter(spark, tmp_path):
    from tidemark import SnapshotStore

    found = []
    for order in ([1, 3, 2], [3, 2, 1]):
        store = SnapshotStore(spark, str(tmp_path / f"store{order[0]}"))
        for number, at in enumerate(order):
            sync_batch(spec(spark, modify_window=-1), manifest(spark, {"a": at, f"n{at}": at}), payload(spark, {"a": "x", f"n{at}": "y"}), store, f"f-{number}")
        found.append(seconds(store))
    assert found[0] == found[1] == {"a": 3, "n1": 1, "n2": 2, "n3": 3}


def changes(spark, rows):
    frame = spark.createDataFrame(rows, "rel_path string, seconds long, size long, mode int")
    return frame.select("rel_path", F.timestamp_seconds("seconds").alias("mtime"), "size", "mode")


def taken_in(spark, folder, batches, window=0):
    """The store after a stream has met the batches one by one, and the progress of each run."""
    from tidemark import SnapshotStore

    store, progress = SnapshotStore(spark, f"{folder}/store"), []
    files = payload(spark, {row[0]: row[0] for batch in batches for row in batch})
    for batch in batches:
        changes(spark, batch).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
        stream = spark.readStream.schema(changes(spark, []).schema).parquet(f"{folder}/feed")
        query = sync_stream(spec(spark, modify_window=window), stream, files, store, f"{folder}/checkpoint", keyed_state=True)
        query.awaitTermination()
        progress.append(query.lastProgress)
    return store, progress


def state_of(store):
    rows = store.manifest().select("rel_path", F.unix_seconds("mtime").alias("s"), "mode").collect()
    return {row.rel_path: (row.s, row.mode) for row in rows}


def test_keyed_state_gives_one_result_for_every_order(spark, tmp_path):
    draw = random.Random(5)
    # few times, so that many changes of a path share one and differ in their mode only
    rows = [(f"p{draw.randrange(6)}", draw.randrange(8), 10, draw.randrange(4)) for _ in range(40)]
    found = []
    for parts in (1, 2):
        shuffled = draw.sample(rows, len(rows))
        store, _ = taken_in(spark, tmp_path / str(parts), [shuffled[part::parts] for part in range(parts)], window=5)
        found.append(state_of(store))
    assert found[0] == found[1]
    newest = {}
    for path, at, _, _ in rows:
        newest[path] = max(at, newest.get(path, at))
    assert {path: at for path, (at, _) in found[0].items()} == newest
    assert all((path, at, 10, mode) in rows for path, (at, mode) in found[0].items())


def test_keyed_state_touches_the_paths_of_a_batch_only(spark, tmp_path):
    batches = [[(f"p{n}", 5, 10, 0) for n in range(200)], [("p1", 9, 10, 0), ("p2", 3, 10, 0), ("p7", 5, 10, 0), ("new", 1, 10, 0)]]
    store, progress = taken_in(spark, tmp_path, batches)
    operators = [run["stateOperators"][0] for run in progress]
    assert [state["numRowsUpdated"] for state in operators] == [200, 2]
    assert operators[-1]["numRowsTotal"] == 201
    assert state_of(store) == {**{f"p{n}": (5, 0) for n in range(200)}, "p1": (9, 0), "new": (1, 0)}


def test_newest_changes_of_odd_feeds(spark, tmp_path):
    from tidemark.streaming import newest_changes
    from tidemark.streaming.newest import STATE_STORE

    odd = changes(spark, [(None, 3, 1, 1), (None, 4, 1, 1), ("a", None, 1, 1), ("", 2, None, None), ("", 2, None, None)])
    hot = spark.range(30_000).select(
        F.lit("hot").alias("rel_path"), F.timestamp_seconds("id").alias("mtime"), F.col("id").alias("size"), F.lit(1).alias("mode")
    )
    odd.unionByName(hot).unionByName(odd.limit(0)).withColumn("_note", F.lit("x")).write.parquet(f"{tmp_path}/feed")
    feed = spark.readStream.schema("rel_path string, mtime timestamp, size long, mode int, _note string").parquet(f"{tmp_path}/feed")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        writer = newest_changes(feed).writeStream.format("memory").queryName("odd_feed").outputMode("update")
        query = writer.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    seen = spark.table("odd_feed").withColumn("mtime", F.unix_seconds("mtime"))
    assert sorted(map(tuple, seen.collect()), key=str) == sorted(
        [(None, 4, 1, 1, "x"), ("a", None, 1, 1, "x"), ("", 2, None, None, "x"), ("hot", 29_999, 29_999, 1, "x")], key=str
    )
    # folded in the tasks that read the feed: no task is sent all changes of a hot path
    assert query.lastProgress["stateOperators"][0]["numRowsUpdated"] == 4
