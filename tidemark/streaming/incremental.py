"""Following a feed of source changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.rules import check_rules
from tidemark.plans.execution import OUTCOME_SCHEMA, SyncResult, apply, staged
from tidemark.plans.planning import plan
from tidemark.plans.spec import SyncSpec
from tidemark.sources.manifests import latest_versions
from tidemark.sources.payloads import MAX_BROADCAST_KEY_BYTES, Payload
from tidemark.sources.snapshots import FANOUT, SnapshotStore
from tidemark.streaming.newest import STATE_STORE, newest_changes


def sync_batch(
    spec: SyncSpec,
    changes: DataFrame,
    payload: Payload,
    store: SnapshotStore,
    txn: str,
    rules_checked: bool = False,
    newest: bool = False,
) -> SyncResult:
    """Bring the newest version of every changed path into the store.

    Paths that are not in the batch keep their state: a feed of changes says nothing about them, so
    nothing is deleted. A change older than the target is skipped; with ``modify_window=-1`` the order of
    batches does not matter, otherwise a change within the window of the target does not replace it. The
    transaction name makes a replayed batch a no-op. A batch writes its own rows of the manifest only, and
    every few batches those are merged (see ``SnapshotStore.compact``).

    ``newest`` says that each change is known to come after all earlier ones of its path (see ``newest_changes``):
    then it replaces the target unless that has a later time, whatever the window.
    """
    if store.has_txn(txn):
        return SyncResult(store.spark.createDataFrame([], OUTCOME_SCHEMA), store.log.head()["version"], False)
    # written once: the batch is not recomputed, and its size decides how it meets the target
    target = store.manifest()
    listed = staged(store.spark, latest_versions(changes), store.path("changes", target.store_state[0] + 1, txn))
    key_bytes = listed.agg(F.coalesce(F.sum(F.octet_length("rel_path")), F.lit(0))).first()[0]
    intended = plan(
        spec,
        listed,
        target,
        target_dirs=store.dirs(),
        prunes=False,
        few_changes=key_bytes <= MAX_BROADCAST_KEY_BYTES,
        settled=newest,
    )
    result = apply(intended, payload, store, txn, rules_checked)
    if result.published and max(map(len, store.segments().values())) > FANOUT:
        store.compact()
    return result


def sync_stream(
    spec: SyncSpec,
    feed: DataFrame,
    payload: Payload,
    store: SnapshotStore,
    checkpoint: str,
    name: str = "feed",
    keyed_state: bool = False,
) -> StreamingQuery:
    """Start a query that takes in what a streaming manifest ``feed`` has to offer, then stops.

    Batches are at-least-once; each publishes under a name made of the stream and the batch number. With
    ``keyed_state`` the stream remembers the newest change of every path (see ``newest_changes``): changes that an
    earlier batch has overtaken never reach the store, and the result is the same for every order of the feed, also
    with a window and for changes of one time. A checkpoint belongs to one of the two ways.
    """

    check_rules(spec.rules)

    def on_batch(changes: DataFrame, batch_id: int) -> None:
        # the batch runs in a session of its own; keep every frame of it in there
        session = changes.sparkSession
        local = SnapshotStore(session, store.base)
        sync_batch(spec, changes, payload, local, f"{name}-{batch_id}", rules_checked=True, newest=keyed_state)

    def start(changes: DataFrame) -> StreamingQuery:
        writer = changes.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        return writer.outputMode("update" if keyed_state else "append").trigger(availableNow=True).start()

    if not keyed_state:
        return start(feed)
    # a query takes its settings over when it starts
    conf, name_of_store = feed.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name_of_store)
    conf.set(name_of_store, STATE_STORE)
    try:
        return start(newest_changes(feed))
    finally:
        conf.set(name_of_store, before)
