"""One function per query: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import (
    file_ext,
    file_stem,
    join_base,
    normalize_ext,
    raw_ext,
    rel_path,
    render_template,
    template_error,
    version_gap,
    with_extension,
)
from tidemark.operators import (
    Converters,
    Rules,
    action_summary,
    ancestor_dirs,
    classify,
    conflict_sources,
    conflict_winners,
    copy_through,
    deepest_first,
    exclude_paths,
    failure_summary,
    in_path_order,
    keep_mapped,
    known_targets,
    map_paths,
    missing_dirs,
    orphan_dirs,
    orphan_files,
    rank_sources,
    reconcile,
    removable_dirs,
    rule_errors,
    scanned_count,
    target_conflicts,
    vanished,
    with_converter,
)
from tidemark.plans import SyncSpec, plan, run_digested, run_sync
from tidemark.sources import (
    DigestedManifest,
    IndexedContent,
    SnapshotStore,
    TreeContent,
    load_payload,
    manifest_from,
    read_snapshot,
    scan_manifest,
    scan_tree,
    scratch_dir,
    write_snapshot,
    write_tree,
)
from tidemark.streaming import sync_batch, sync_stream
from workloads import frames

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


# --- path columns -------------------------------------------------------------------------------------


@query("ext_histogram")
def ext_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.doc_source(spark, sf_dir).groupBy(file_ext("rel_path").alias("ext")).agg(F.count("*").alias("n"))


@query("target_paths")
def target_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.doc_work(spark, sf_dir).select("rel_path", "ext", "converter", "target_path")


@query("path_parts")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.doc_source(spark, sf_dir).select("rel_path")
    pages = frames.pages(spark, sf_dir).select("rel_path")
    joined = join_base(F.lit("/data/source"), "rel_path")
    return docs.unionByName(pages).select(
        joined.alias("absolute"),
        rel_path(joined, "/data/source").alias("relative"),
        raw_ext("rel_path").alias("raw_ext"),
        file_ext("rel_path").alias("ext"),
        file_stem("rel_path").alias("stem"),
        normalize_ext(F.substring_index("rel_path", ".", -1)).alias("normalized"),
        with_extension("rel_path", F.lit(".out")).alias("replaced"),
        with_extension("rel_path", F.lit(".")).alias("stripped"),
    )


# --- filters ------------------------------------------------------------------------------------------


@query("source_excluded")
def source_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exclude_paths(frames.doc_source(spark, sf_dir), ["*.txt"]).select("rel_path")


@query("source_excluded_globs")
def source_excluded_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = ["src1/**/*.FLAC", "{src2,src3}/[de]?/*", "**/[!0-8]*.png", "src4?/*", r"src\5/*"]
    return exclude_paths(frames.doc_source(spark, sf_dir), patterns).select("rel_path")


@query("dirs_excluded")
def dirs_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = ancestor_dirs(frames.doc_source(spark, sf_dir))
    return exclude_paths(dirs, ["src1?", "*/fr"], "path")


@query("unmatched_dropped")
def unmatched_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned_count(keep_mapped(frames.doc_work(spark, sf_dir), copy_unmatched=False))


# --- comparison ---------------------------------------------------------------------------------------


def _plan_rows(spark: SparkSession, sf_dir: str, window: int) -> DataFrame:
    rows = classify(frames.doc_work(spark, sf_dir), frames.doc_target(spark, sf_dir), window)
    return rows.select(
        "rel_path",
        "target_path",
        "ext",
        "converter",
        "action",
        "reason",
        F.unix_micros("mtime").alias("mtime_us"),
        F.unix_micros("target_mtime").alias("target_mtime_us"),
        version_gap("target_mtime", "mtime").alias("gap"),
    )


@query("sync_plan_w0")
def sync_plan_w0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_rows(spark, sf_dir, 0)


@query("sync_plan_w1")
def sync_plan_w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_rows(spark, sf_dir, 1)


@query("sync_plan_w2")
def sync_plan_w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_rows(spark, sf_dir, 2)


@query("sync_plan_w3600")
def sync_plan_w3600(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_rows(spark, sf_dir, 3600)


@query("sync_plan_exact")
def sync_plan_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_rows(spark, sf_dir, -1)


def doc_spec(spark: SparkSession, converters: Converters | None = None, **options) -> SyncSpec:
    converters = converters or frames.text_converters()
    return SyncSpec(
        rules=converters.rules(spark, frames.DOC_MAPPINGS),
        converters=converters,
        target_exclude=frames.PROTECTED,
        **options,
    )


def _doc_plan(spark: SparkSession, sf_dir: str, **options):
    return plan(doc_spec(spark, **options), frames.doc_source(spark, sf_dir), frames.doc_target(spark, sf_dir))


@query("sync_plan_summary")
def sync_plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_plan(spark, sf_dir).summary()


@query("scanned_items")
def scanned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_plan(spark, sf_dir, source_exclude=("*.txt", "src7/*")).scanned()


@query("event_state_sync")
def event_state_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, earlier = frames.event_states(spark, sf_dir)
    rows = classify(map_paths(now, frames.doc_mappings(spark)), earlier)
    return rows.select("target_path", "action", "reason", F.unix_micros("mtime").alias("mtime_us"))


@query("bulk_plan_summary")
def bulk_plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan over the largest manifest, conflicts resolved, orphans included."""
    ranked = rank_sources(frames.line_work(spark, sf_dir))
    diff = reconcile(ranked, frames.line_target(spark, sf_dir), 0, ["gone/A/*"])
    return action_summary(diff.withColumn("size", F.coalesce("size", "target_size")))


# --- deletions and directories ------------------------------------------------------------------------


@query("orphans")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = orphan_files(frames.doc_target(spark, sf_dir), frames.doc_work(spark, sf_dir), frames.PROTECTED)
    return doomed.select(F.col("rel_path").alias("path"), F.unix_micros("mtime").alias("mtime_us"))


@query("orphans_and_protected")
def orphans_and_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = reconcile(rank_sources(frames.doc_work(spark, sf_dir)), frames.doc_target(spark, sf_dir), 0, frames.PROTECTED)
    return diff.filter("in_source is null").select(F.col("target_path").alias("path"), "action", "reason")


@query("known_target_set")
def known_target_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_targets(frames.doc_work(spark, sf_dir))


@query("dir_tree")
def dir_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of the line items' sources, three deep."""
    return ancestor_dirs(frames.line_work(spark, sf_dir)).groupBy(F.size(F.split("path", "/")).alias("depth")).agg(
        F.count("*").alias("n")
    )


@query("ancestor_dirs")
def source_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestor_dirs(frames.doc_source(spark, sf_dir))


@query("missing_dirs")
def dirs_to_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = ancestor_dirs(frames.doc_source(spark, sf_dir))
    return missing_dirs(source, ancestor_dirs(frames.doc_target(spark, sf_dir)))


@query("orphan_dirs")
def unknown_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = ancestor_dirs(frames.doc_target(spark, sf_dir))
    return orphan_dirs(target, ancestor_dirs(frames.doc_source(spark, sf_dir)))


def _dirs_to_remove(spark: SparkSession, sf_dir: str, deep: bool) -> DataFrame:
    target, work = frames.doc_target(spark, sf_dir), frames.doc_work(spark, sf_dir)
    survivors = reconcile(rank_sources(work), target, 0, frames.PROTECTED).filter("action <> 'delete'")
    known = ancestor_dirs(frames.doc_source(spark, sf_dir))
    return deepest_first(removable_dirs(ancestor_dirs(target), known, survivors, "target_path", deep))


@query("removable_dirs")
def dirs_to_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirs_to_remove(spark, sf_dir, deep=False)


@query("removable_dirs_deep")
def deep_dirs_to_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same directories by a sweep in path order."""
    return _dirs_to_remove(spark, sf_dir, deep=True)


@query("plan_deletes")
def plan_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_plan(spark, sf_dir).deletes


# --- conflicts ----------------------------------------------------------------------------------------


@query("target_conflicts")
def line_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_conflicts(frames.line_work(spark, sf_dir))


@query("conflict_sources")
def line_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict_sources(frames.line_work(spark, sf_dir))


@query("conflict_outcome")
def conflict_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run in which up to three documents claim each target: one is converted, the others are reported."""
    claims = frames.doc_claims(spark, sf_dir)
    converters = Converters().register("clean", lambda text: F.replace(text, F.lit(" "), F.lit("_")))
    rules = converters.rules(spark, [(ext, "clean", "txt") for ext in frames.CLAIM_EXTENSIONS])
    spec = SyncSpec(rules=rules, converters=converters, on_conflict="first", allow_empty_output=True)
    store = SnapshotStore(spark, scratch_dir(spark, "claims"))
    result = run_sync(spec, claims.drop("content"), claims.select("rel_path", "content"), store)
    beaten = F.when(F.col("status") == "conflict", F.col("message"))
    return result.outcome.select("rel_path", "target_path", "status", beaten.alias("message"))


@query("conflict_winner")
def conflict_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_path_order(conflict_winners(frames.line_work(spark, sf_dir))).select(
        "target_path", "rel_path", F.unix_micros("mtime").alias("mtime_us"), "size"
    )


# --- templates and rules ------------------------------------------------------------------------------


@query("template_render")
def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's command, rendered; NULL where the template is malformed."""
    count = len(frames.TEMPLATES)
    converters = Rules.of(
        spark, (), [(f"t{n}", "command", ["tool", text, "-o", "{output}"]) for n, text in enumerate(frames.TEMPLATES)]
    ).converters
    work = frames.doc_work(spark, sf_dir).withColumn(
        "converter", F.concat(F.lit("t"), (F.col("doc_id") % count).cast("string"))
    )
    variables = F.create_map(
        F.lit("input"),
        F.col("rel_path"),
        F.lit("output"),
        F.col("target_path"),
        F.lit("stem"),
        file_stem("rel_path"),
        F.lit("ext"),
        raw_ext("rel_path"),
    )
    return with_converter(work, converters).select(
        "rel_path", "converter", F.array_join(render_template("command", variables), " ").alias("command_line")
    )


@query("template_errors")
def template_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = (
        frames.doc_templates(spark, sf_dir)
        .unionByName(frames.event_templates(spark, sf_dir))
        .unionByName(frames.page_templates(spark, sf_dir))
    )
    return (
        templates.withColumn("error", template_error("template"))
        .filter("error is not null")
        .select("subject", "error.code", "error.pos", "error.name")
    )


@query("rule_errors")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_errors(frames.doc_rules(spark, sf_dir)).select("rule", "subject", "code")


# --- conversion ---------------------------------------------------------------------------------------


def _sync_into_store(spark: SparkSession, sf_dir: str, converters: Converters, payload: DataFrame | None = None, **options):
    store = SnapshotStore(spark, scratch_dir(spark, "store"))
    if payload is None:
        payload = frames.doc_payload(spark, sf_dir)
    result = run_sync(
        doc_spec(spark, converters, **options),
        frames.doc_source(spark, sf_dir),
        payload,
        store,
        initial_target=frames.doc_target(spark, sf_dir),
    )
    return store, result


def _written(store: SnapshotStore) -> DataFrame:
    return store.content().select(
        "rel_path",
        F.unix_micros("mtime").alias("mtime_us"),
        "size",
        "mode",
        F.md5(F.col("content").cast("binary")).alias("digest"),
    )


@query("convert_text")
def convert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content written by a run whose converters are column expressions."""
    store, _ = _sync_into_store(spark, sf_dir, frames.text_converters())
    return _written(store)


@query("convert_udf")
def convert_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLAC files become their digest and images their length, in Arrow batches."""

    def digest(content: pd.Series) -> pd.Series:
        return content.map(lambda data: hashlib.sha256(data).hexdigest().encode())

    def lengths(content: pd.Series) -> pd.Series:
        return content.map(lambda data: str(len(data)).encode())

    converters = frames.text_converters()
    del converters.expressions["opus"], converters.expressions["jpg"]
    store, _ = _sync_into_store(
        spark, sf_dir, converters.register_udf("opus", digest).register_udf("jpg", lengths)
    )
    return _written(store)


@query("convert_command")
def convert_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images are copied by an external command, archives meet a command that fails."""
    converters = frames.text_converters()
    del converters.expressions["jpg"], converters.expressions["gz"]
    converters.register_command("jpg", ["cp", "{input}", "{output}"])
    converters.register_command("gz", ["sh", "-c", "echo no {stem} >&2; exit 3"])
    _, result = _sync_into_store(spark, sf_dir, converters)
    return result.outcome.select("rel_path", "target_path", "action", "converter", "status", "exit_code", "message")


@query("payload_for_work")
def payload_for_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content is loaded for new and stale rows only."""
    rows = classify(frames.doc_work(spark, sf_dir), frames.doc_target(spark, sf_dir))
    loaded = load_payload(frames.doc_payload(spark, sf_dir), rows.filter("action <> 'skip'"))
    return loaded.select("rel_path", "action", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("indexed_payload")
def indexed_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, looked up in content with an index."""
    content = IndexedContent(spark, scratch_dir(spark, "indexed"))
    content.add(frames.doc_payload(spark, sf_dir), file_bytes=4 << 20)
    work = classify(frames.doc_work(spark, sf_dir), frames.doc_target(spark, sf_dir)).filter("action <> 'skip'")
    key_bytes = work.agg(F.coalesce(F.sum(F.octet_length("rel_path")), F.lit(0))).first()[0]
    return load_payload(content, work, key_bytes).select("rel_path", "action", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("tree_to_content")
def tree_to_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: listed by the executors, compared, and opened by the tasks that convert them."""
    root = scratch_dir(spark, "files")
    statuses = write_tree(frames.documents(spark, sf_dir).drop("mode"), root).groupBy("status").count().collect()
    if [row.status for row in statuses] != ["ok"]:
        raise ValueError(f"not all documents could be written: {statuses}")
    files, dirs = scan_tree(spark, root)
    store = SnapshotStore(spark, scratch_dir(spark, "store"))
    spec = doc_spec(spark, frames.text_converters())
    run_sync(spec, files, TreeContent(root), store, source_dirs=dirs, initial_target=frames.doc_target(spark, sf_dir))
    return _written(store).drop("mode")


@query("copied_items")
def copied_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and stale documents without a converter, content as it is."""
    rows = classify(frames.doc_work(spark, sf_dir), frames.doc_target(spark, sf_dir)).filter("action = 'copy'")
    copied = copy_through(load_payload(frames.doc_payload(spark, sf_dir), rows))
    return copied.select("target_path", F.unix_micros("mtime").alias("mtime_us"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query("strip_html")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a source: tags out of every page, written as text."""
    pages = frames.newest_pages(spark, sf_dir)
    source = manifest_from(pages, "rel_path", "mtime", size=F.char_length("content"))
    converters = Converters().register("text", lambda html: F.regexp_replace(html, "<[^>]*>", " "))
    spec = SyncSpec(rules=converters.rules(spark, [("html", "text", "txt")]), converters=converters)
    store = SnapshotStore(spark, scratch_dir(spark, "pages"))
    run_sync(spec, source, pages.select("rel_path", "content"), store)
    return _written(store).drop("mode")


# --- runs ---------------------------------------------------------------------------------------------


@query("post_sync_manifest")
def post_sync_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _sync_into_store(spark, sf_dir, frames.text_converters())
    return store.manifest().select(
        "rel_path", F.unix_micros("mtime").alias("mtime_us"), "mode", F.col("data_version").isNotNull().alias("written")
    )


@query("content_matches_manifest")
def content_matches_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's written rows and the content's rows side by side."""
    store, _ = _sync_into_store(spark, sf_dir, frames.text_converters())
    listed = store.manifest().filter("data_version is not null").alias("m")
    read = store.content().alias("c")
    same = [F.col(f"m.{name}").eqNullSafe(F.col(f"c.{name}")) for name in ("rel_path", "mtime", "size", "mode")]
    return listed.join(read, F.col("m.rel_path") == F.col("c.rel_path"), "full").select(
        F.coalesce("m.rel_path", "c.rel_path").alias("rel_path"), (same[0] & same[1] & same[2] & same[3]).alias("agrees")
    )


@query("post_sync_dirs")
def post_sync_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _sync_into_store(spark, sf_dir, frames.text_converters())
    return store.dirs()


@query("second_run")
def second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run right after a run would do: nothing but skip and keep."""
    store, _ = _sync_into_store(spark, sf_dir, frames.text_converters())
    again = plan(doc_spec(spark), frames.doc_source(spark, sf_dir), store.manifest(), target_dirs=store.dirs())
    return again.diff.groupBy("action", "reason").agg(F.count("*").alias("items"))


@query("vanished")
def lost_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned rows whose document is gone by the time of the run."""
    rows = classify(frames.doc_work(spark, sf_dir), frames.doc_target(spark, sf_dir)).filter("action <> 'skip'")
    current = frames.documents(spark, sf_dir).filter("doc_id % 19 <> 0")
    return vanished(rows, current).select("rel_path", "target_path", F.lit("vanished").alias("status"))


def _faulty_run(spark: SparkSession, sf_dir: str):
    converters = frames.text_converters()
    del converters.expressions["jpg"], converters.expressions["gz"]
    odd = F.when(F.char_length("content") % 3 != 0, F.replace("content", F.lit(" "), F.lit("_")))
    converters.register("opus", lambda _: odd)
    converters.register_command("jpg", ["sh", "-c", "exit 3"]).register_command("gz", ["false"])
    present = frames.documents(spark, sf_dir).filter("doc_id % 19 <> 0").select("rel_path", "content")
    return _sync_into_store(spark, sf_dir, converters, present)


@query("sync_outcome")
def sync_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of a run in which converters fail and sources disappear."""
    _, result = _faulty_run(spark, sf_dir)
    return result.outcome.select(
        "rel_path", "target_path", "action", "converter", "status", "exit_code", F.unix_micros("mtime").alias("mtime_us")
    )


@query("faulty_manifest")
def faulty_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed and vanished items leave the old target row as it was."""
    store, _ = _faulty_run(spark, sf_dir)
    return store.manifest().select("rel_path", F.unix_micros("mtime").alias("mtime_us"))


@query("failure_summary")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, result = _faulty_run(spark, sf_dir)
    return failure_summary(result.outcome)


# --- sources, sinks, streams --------------------------------------------------------------------------


def _document_tree(spark: SparkSession, sf_dir: str) -> str:
    """Documents written as text files under source/lang."""
    root = scratch_dir(spark, "tree")
    docs = frames.read(spark, sf_dir, "documents")
    docs.select(F.col("source").alias("s"), F.col("lang").alias("l"), "text").write.partitionBy("s", "l").text(root)
    return root


def _bytes_per_dir(manifest: DataFrame) -> DataFrame:
    data = manifest.filter("rel_path like '%.txt'")
    return data.groupBy(F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1).alias("dir")).agg(F.sum("size").alias("bytes"))


@query("scan_manifest")
def tree_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes_per_dir(scan_manifest(spark, _document_tree(spark, sf_dir)))


@query("scan_tree")
def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tree listed by the executors, with its directories."""
    files, dirs = scan_tree(spark, _document_tree(spark, sf_dir))
    # checksum side files are listed too; they do not end in .txt
    return dirs.select(F.col("path").alias("dir")).join(_bytes_per_dir(files), "dir", "left")


@query("snapshot_sink")
def snapshot_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions published one after the other; readers see the second."""
    base = scratch_dir(spark, "snapshot")
    source = frames.doc_source(spark, sf_dir)
    write_snapshot(source.filter("size > 1000"), base)
    write_snapshot(source, base)
    return read_snapshot(spark, base).select("rel_path", F.unix_micros("mtime").alias("mtime_us"), "size", "mode")


@query("incremental_content")
def incremental_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, then new versions of the long ones, then old versions of all: changes, merged and cleaned up."""
    docs = frames.documents(spark, sf_dir).select(*frames.MANIFEST, "content")
    hour = F.expr("interval 1 hour")
    newer = docs.filter("size > 1000").withColumns({"mtime": F.col("mtime") + hour, "content": F.concat(F.lit("second "), "content")})
    older = docs.withColumns({"mtime": F.col("mtime") - hour, "content": F.lit("too late")})
    spec = SyncSpec(rules=Converters().rules(spark, []), modify_window=-1)
    store = SnapshotStore(spark, scratch_dir(spark, "changes"))
    for number, batch in enumerate((docs, newer, older)):
        sync_batch(spec, batch.drop("content"), batch.select("rel_path", "content"), store, f"documents-{number}")
    store.compact(full=True)
    store.vacuum(min_age_seconds=0)
    return _written(store)


@query("compacted_manifest")
def compacted_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest after the same batches, read as a base with changes."""
    docs = frames.doc_source(spark, sf_dir)
    spec = SyncSpec(rules=Converters().rules(spark, []), modify_window=-1)
    store = SnapshotStore(spark, scratch_dir(spark, "changes"))
    content = frames.doc_payload(spark, sf_dir)
    run_sync(spec, docs, content, store)
    run_sync(spec, docs.filter("size <= 1000").withColumn("mtime", F.col("mtime") + F.expr("interval 1 hour")), content, store)
    return store.manifest().select("rel_path", F.unix_micros("mtime").alias("mtime_us"), "size", "data_version")


@query("digested_run")
def digested_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two published states of the documents; the second run reads the buckets whose digests differ."""
    docs = frames.doc_source(spark, sf_dir)
    source = DigestedManifest(spark, scratch_dir(spark, "states"), buckets=64)
    store = SnapshotStore(spark, scratch_dir(spark, "digested"))
    spec = SyncSpec(rules=Converters().rules(spark, []))
    later = F.when(F.col("size") > 1000, F.expr("interval 1 hour")).otherwise(F.expr("interval 0 hour"))
    for state in (docs, docs.withColumn("mtime", F.col("mtime") + later)):
        source.publish(state)
        run_digested(spec, source, frames.doc_payload(spark, sf_dir), store)
    return store.manifest().select("rel_path", F.unix_micros("mtime").alias("mtime_us"), "size", "data_version")


@query("many_globs")
def many_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of pages that none of many globs exclude."""
    return exclude_paths(frames.pages(spark, sf_dir).select("rel_path", "page_id"), frames.page_globs())


def _feed_runs(spark: SparkSession, sf_dir: str, keyed_state: bool) -> DataFrame:
    base = scratch_dir(spark, "feed")
    events = frames.read(spark, sf_dir, "events")
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"), F.lit(".FLAC"))
    feed = manifest_from(events, key, "ts", size="event_id")
    middle = F.lit("2024-01-25").cast("timestamp")
    payload = feed.select("rel_path").distinct().withColumn("content", F.col("rel_path"))
    spec = doc_spec(spark, modify_window=-1)
    store = SnapshotStore(spark, f"{base}/store")
    for part in (feed.filter(F.col("mtime") < middle), feed.filter(F.col("mtime") >= middle)):
        part.write.mode("append").parquet(f"{base}/feed")
        stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 64).parquet(f"{base}/feed")
        sync_stream(spec, stream, payload, store, f"{base}/checkpoint", keyed_state=keyed_state).awaitTermination()
    return store.manifest().select("rel_path", F.unix_micros("mtime").alias("mtime_us"))


@query("incremental")
def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a feed of versions, taken in by two incremental runs."""
    return _feed_runs(spark, sf_dir, keyed_state=False)


@query("incremental_keyed")
def incremental_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feed; the stream itself remembers the newest version of every path."""
    return _feed_runs(spark, sf_dir, keyed_state=True)
